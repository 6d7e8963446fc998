"""Chunk codecs by id. A user's registration replaces a built-in one."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

from chunkwright.errors import CodecError
from chunkwright.functions import blosc1

Decoder = Callable[[bytes], bytes]
Factory = Callable[[dict], Decoder]


class CodecRegistry:
    def __init__(self) -> None:
        self._factories: dict[str, Factory] = {}

    def register(self, name: str, factory: Factory) -> None:
        """``factory`` gets the compressor's configuration and returns bytes -> bytes; executors must be able to unpickle it."""
        self._factories[name] = factory

    def has(self, name: str) -> bool:
        return name in self._factories

    def get(self, config: dict) -> Decoder:
        name = config.get("id")
        if name not in self._factories:
            raise CodecError(f'No codec registered for compressor "{name}". Available: {", ".join(sorted(self._factories)) or "(none)"}')
        decode = self._factories[name](config)

        def guarded(data: bytes) -> bytes:
            try:
                return decode(data)
            except CodecError:
                raise
            except Exception as error:
                raise CodecError(f"{name}: {error}") from error

        return guarded

    def custom(self) -> dict[str, Factory]:
        """The registrations that executors don't have by themselves."""
        return {k: v for k, v in self._factories.items() if _BUILT_IN.get(k) is not v}


_BUILT_IN: dict[str, Factory] = {
    "zlib": lambda config: zlib.decompress,
    "gzip": lambda config: gzip.decompress,
    "blosc": lambda config: blosc1.decode,
}
codec_registry = CodecRegistry()
for _name, _factory in _BUILT_IN.items():
    codec_registry.register(_name, _factory)
