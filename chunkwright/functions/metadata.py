"""Zarr v2 metadata documents, consolidated metadata and reference manifests."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from chunkwright.errors import MetadataError, UnsupportedOperationError
from chunkwright.functions.dtypes import ElementType, element_type

ARRAY_DOC, GROUP_DOC, ATTRS_DOC, CONSOLIDATED_DOC = ".zarray", ".zgroup", ".zattrs", ".zmetadata"


@dataclass(frozen=True)
class ArrayMeta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    order: str
    separator: str
    compressor: dict | None
    fill_value: object
    filters: object
    attrs: dict = field(default_factory=dict)

    def element(self) -> ElementType:
        """The element type; this is where an unknown dtype or a filter is refused, not on open."""
        if self.filters:
            raise UnsupportedOperationError("arrays with filters can't be decoded")
        return element_type(self.dtype)

    def with_attrs(self, attrs: dict) -> ArrayMeta:
        return ArrayMeta(**{**self.__dict__, "attrs": attrs})


def _load(raw: bytes | str, name: str) -> dict:
    try:
        doc = json.loads(raw)
    except ValueError as error:
        raise MetadataError(f"Invalid {name}: not JSON") from error
    if not isinstance(doc, dict):
        raise MetadataError(f"Invalid {name}: not an object")
    return doc


def _version(doc: dict, name: str) -> None:
    if doc.get("zarr_format") != 2 or isinstance(doc.get("zarr_format"), bool):
        raise MetadataError(f"Invalid {name}: zarr_format must be 2")


def parse_array(raw: bytes | str) -> ArrayMeta:
    doc = _load(raw, ARRAY_DOC)
    _version(doc, ARRAY_DOC)
    shape, chunks = doc.get("shape"), doc.get("chunks")
    if not isinstance(shape, list) or not isinstance(chunks, list) or len(shape) != len(chunks):
        raise MetadataError("shape and chunks must be arrays of equal length")
    if any(not isinstance(c, int | float) or c <= 0 for c in chunks):
        raise MetadataError("each chunk length must be above 0")
    if doc.get("order") not in ("C", "F"):
        raise MetadataError(f"unknown order: {doc.get('order')}")
    if not isinstance(doc.get("dtype"), str):
        raise MetadataError("dtype must be a string")
    separator = doc.get("dimension_separator", ".")
    if separator not in (".", "/"):
        raise MetadataError(f"unknown dimension_separator: {separator}")
    return ArrayMeta(tuple(map(int, shape)), tuple(map(int, chunks)), doc["dtype"], doc["order"], separator, doc.get("compressor"), doc.get("fill_value"), doc.get("filters"))


def parse_group(raw: bytes | str) -> None:
    _version(_load(raw, GROUP_DOC), GROUP_DOC)


def parse_attrs(raw: bytes | str | None) -> dict:
    return {} if raw is None else _load(raw, ATTRS_DOC)


class Consolidated:
    """The documents of a whole hierarchy, by key."""

    def __init__(self, raw: bytes | str):
        documents = _load(raw, CONSOLIDATED_DOC).get("metadata")
        if not isinstance(documents, dict):
            raise MetadataError(f'Invalid {CONSOLIDATED_DOC}: missing "metadata"')
        self._documents = {k: json.dumps(v).encode() for k, v in documents.items()}

    def get(self, key: str) -> bytes | None:
        return self._documents.get(key)

    def has(self, key: str) -> bool:
        return key in self._documents

    def keys(self) -> list[str]:
        return list(self._documents)

    def list_children(self, prefix: str = "") -> list[str]:
        return child_names(self._documents, prefix)


def child_names(keys, prefix: str = "") -> list[str]:
    """Distinct first path segments below a prefix, in order; hidden names aren't children."""
    start = f"{prefix}/" if prefix else ""
    below = (k[len(start) :] for k in keys if k.startswith(start))
    names = (k.split("/", 1)[0] for k in below if "/" in k)
    return list(dict.fromkeys(n for n in names if n and not n.startswith(".")))


Reference = str | list


def parse_manifest(raw: bytes | str) -> dict[str, Reference]:
    """The references of a version 1 manifest: key -> inline text, [url], or [url, offset, length]."""
    doc = _load(raw, "reference manifest")
    if doc.get("version") != 1:
        raise MetadataError(f"Unsupported manifest version: {doc.get('version')}")
    refs = doc.get("refs")
    if not isinstance(refs, dict):
        raise MetadataError('Invalid reference manifest: missing "refs"')
    for key, ref in refs.items():
        whole = isinstance(ref, list) and len(ref) in (1, 3) and isinstance(ref[0], str)
        if not isinstance(ref, str) and not (whole and all(isinstance(x, int | float) for x in ref[1:])):
            raise MetadataError(f'Invalid reference for "{key}"')
    return refs
