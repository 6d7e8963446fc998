"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns.  Beside them a lexer reads source and
configuration syntax into (name, literal) pairs: an identifier, perhaps quoted,
then ``=``, ``:``, ``:=`` or ``=>``, then literals and names joined by ``+``.
Constants are propagated: a name on the right stands for the literals last given
to it.  A pair scores by the words of its name and the look of its literal; where
the score reaches the threshold, each of its literals becomes a span of kind
``literal``, wherever it was written.

Spans are (kind, start, end) in code points, the end exclusive.  Null text is
empty; an empty text has no spans; a text of any length is scanned whole, in time
that grows as its length.  A name given anew stands for its new value alone.  Rows are independent of each other, extra
columns aren't read, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from chunkwright.runtime import ship, tidied

KINDS = ("assign", "access", "hex", "literal")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile(r"[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

_OPERATOR = re.compile(r":=|=>|[:=]")
_VALUE = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z_][\w.-]*(?![\w+/]))|([\w+/=.~-]+))""", re.ASCII)
_PLUS = re.compile(r"[ \t]*\+")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: What the words of a name weigh; pairs of words weigh when they stand together.
NAME_WEIGHTS = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 3, "jwt": 2, "key": 1, "cert": 1, "salt": 1}
PAIR_WEIGHTS = {("api", "key"): 3, ("access", "key"): 3, ("private", "key"): 3, ("signing", "key"): 3, ("encryption", "key"): 3, ("client", "secret"): 3, ("db", "pass"): 3}
#: Least literal length, and the sum of name weight and look at which a literal is a secret.
LITERAL_CHARS, THRESHOLD = 8, 5.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if _ASSIGN_HINT.search(text):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    single = max((NAME_WEIGHTS.get(w, 0) for w in words), default=0)
    return max([single, *(PAIR_WEIGHTS.get(p, 0) for p in zip(words, words[1:], strict=False))])


class Value:
    """What a name stands for: its literals, and by reference the values that it was joined from.

    Counts of bytes are summed, not gathered again, so a chain of assignments costs no more than its text.
    """

    __slots__ = ("counts", "given", "letters", "parts", "digits", "size", "spaced", "spans")

    def __init__(self, spans: list[tuple[int, int]], texts: list[str], parts: list[Value]):
        self.spans, self.parts, self.given = spans, parts, False
        plain = "".join(texts)
        self.counts = Counter(plain.encode())
        for part in parts:
            self.counts.update(part.counts)
        self.size = sum(self.counts.values())
        self.spaced = " " in plain or any(p.spaced for p in parts)
        self.digits = any(map(str.isdigit, plain)) or any(p.digits for p in parts)
        self.letters = any(map(str.isalpha, plain)) or any(p.letters for p in parts)

    def score(self) -> float:
        """0 to 3: bits a byte, and whether letters and digits mix."""
        if self.size < LITERAL_CHARS or self.spaced:
            return 0.0
        bits = -sum(k / self.size * log2(k / self.size) for k in self.counts.values() if k / self.size)
        return min(2.0, bits / 2) + (self.digits and self.letters)

    def give(self) -> Iterator[tuple[int, int]]:
        """All literal spans below that weren't given before."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.given:
                value.given = True
                yield from value.spans
                todo += value.parts


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, literal spans, names on the right) of each assignment, in order."""
    at = 0
    for op in _OPERATOR.finditer(text):
        if op.start() < at:
            continue
        stop = op.start()
        while stop > at and text[stop - 1] in " \t":
            stop -= 1
        if stop > at and text[stop - 1] in "\"'":
            stop -= 1
        start = stop
        while start > at and text[start - 1] in _NAME_CHARS:
            start -= 1
        name = text[start:stop].strip("-.")
        if not name or not (name[0].isalpha() or name[0] == "_"):
            continue
        literals, refs, end = [], [], op.end()
        while value := _VALUE.match(text, end):
            end = value.end()
            group = value.lastindex
            if group == 3:
                refs.append(value[3])
                if any(c.isdigit() for c in value[3]):  # configuration files leave literals bare
                    literals.append(value.span(3))
            else:
                literals.append(value.span(group))
            if not (plus := _PLUS.match(text, end)):
                break
            end = plus.end()
        if literals or refs:
            at = end
            yield name, literals, refs


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    for name, literals, refs in assignments(text):
        parts = {id(known[ref]): known[ref] for ref in refs if ref in known}
        value = known[name] = Value(literals, [text[a:b] for a, b in literals], list(parts.values()))
        weight = name_score(name)
        if weight and value.size and weight + value.score() >= THRESHOLD:
            found.update(s for s in value.give() if s[1] > s[0])
    return [("literal", a, b) for a, b in found]


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed, then end."""
    lexed = lexed_spans(text) if ":" in text or "=" in text else []
    return sorted(base_spans(text) + lexed, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, the count of each base kind, base_sha256, spans, n_literal."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for value in batch.column(1):
                found = all_spans(value.as_py() or "")
                by = Counter(k for k, _, _ in found)
                for k in KINDS:
                    counts[k].append(by[k])
                digests.append(hashlib.sha256(joined([s for s in found if s[0] != "literal"]).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"{id_col} {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced by a mark."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := value.as_py()) is None else redact(t, all_spans(t)) for value in batch.column(place)]
            columns = [*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(tidied(run), docs.schema)
