"""Byte-level BPE by monoid tree reduction.

``encode`` halves a span until it is short, encodes the leaves by lowest rank
first, and joins neighbours.  A join re-encodes a window around the seam and
widens it until the tokens on both edges are *settled*: two adjacent tokens are
settled if their joined bytes encode to just these two.  A row of tokens all of
whose neighbours are settled is the encoding of its bytes, so the tokens outside
the window need no second look.  ``decode`` concatenates bytes up a tree.

Null text counts as empty; an empty text has no tokens.  Texts of any length are
encoded whole, in slices that end where the pattern's matches do; only a stretch
without a single space is held as one.  Extra columns are not read, whatever their
names.  Rows are independent: repeated rows give repeated results, and an empty
table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.runtime import ship, tidied

#: Spans of at most so many bytes are leaves.
LEAF_BYTES = 24
#: Longer spans find their lowest rank through a heap.
HEAP_BYTES = 256
#: Stands for the rank of a pair that isn't a token.
NO_RANK = 1 << 40
#: Words and pieces that a worker remembers, each, and pairs of tokens, unless told otherwise. 100,000 take about 20 MB.
MEMO_ENTRIES = 800_000
#: Rows of an output batch, characters that are cut into words at once, and ids that are decoded at once.
SLICE_ROWS, SLICE_CHARS, SLICE_IDS = 256, 1 << 18, 1 << 16
#: Longer pieces are encoded each time, so a memo's bytes stay bounded.
MEMO_PIECE_CHARS = 64


#: The public pattern for which a space between a character that isn't white space and one that isn't begins a match.
SPACE_BEGINS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that white space or an end of the text adjoins, and one that neither does.
BESIDE_SPACE, LONE_SPACE = regex.compile(r"\s | (?:\s|\Z)|\A "), regex.compile(r"(?<=\S) (?=\S)")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Remembers ``make(key)``. At half its bound it starts anew, and what it held before is still looked up, so frequent keys stay."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound = make, bound
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_PIECE_CHARS:
            if len(self) >= self.bound // 2:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.before = {}
        self.clear()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = MEMO_ENTRIES):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.space_begins = pattern == SPACE_BEGINS
        self.settled_memo: dict[tuple[int, int], bool] = {}
        self.piece_memo = Memo(lambda piece: pack(self.encode_bytes(piece.encode())), memo_entries)
        self.word_memo = Memo(self._word, memo_entries)
        self.memo_entries = memo_entries

    def forget(self) -> None:
        """Empty the memos: a worker that lives on may run other operators next."""
        self.settled_memo.clear()
        self.piece_memo.forget()
        self.word_memo.forget()

    # encoding

    def span(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        if len(data) > HEAP_BYTES:
            return self._span_by_heap(data)
        get, none = self.ranks.get, NO_RANK
        cuts = list(range(len(data) + 1))  # the parts are data[cuts[i]:cuts[i + 1]]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            del cuts[at + 1], pairs[at]
            start = cuts[at]
            if at < len(pairs):
                pairs[at] = get(data[start : cuts[at + 2]], none)
            if at:
                pairs[at - 1] = get(data[cuts[at - 1] : cuts[at + 1]], none)
        ranks = self.ranks
        return [ranks[data[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _span_by_heap(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # a part is data[i:end[i]]
        before = list(range(-1, n - 1))
        alive = [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(queue, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or end[i] >= n or not alive[end[i]] or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def settled(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.settled_memo.get(key)
        if known is None:
            if len(self.settled_memo) >= self.memo_entries:
                self.settled_memo.clear()
            known = self.settled_memo[key] = self.span(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of what two encodings stand for."""
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.span(self.decode_tokens(left[a:] + right[:b]))
            if (a == 0 or self.settled(left[a - 1], window[0])) and (b == len(right) or self.settled(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.span(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        A space begins a match of the pattern unless it stands beside other white
        space or at an end of the text.  So a text splits before each other space into
        words that have the same matches as the whole, and a long text into slices first.
        """
        if not self.space_begins:
            return b"".join(map(self.piece_memo.__getitem__, self.pieces.findall(text)))
        if len(text) <= SLICE_CHARS:
            return self._words(text)
        out, at = [], 0
        while at < len(text):
            cut = LONE_SPACE.search(text, at + SLICE_CHARS)
            stop = cut.start() if cut else len(text)
            out.append(self._words(text[at:stop]))
            at = stop
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        pieces = self.pieces.findall(word)
        # A word that is one piece is remembered once, as the word.
        return pack(self.encode_bytes(word.encode())) if len(pieces) == 1 else b"".join(map(self.piece_memo.__getitem__, pieces))

    def _words(self, text: str) -> bytes:
        # A slice begins with a space that begins a match.
        words = LONE_SPACE.split(text) if BESIDE_SPACE.search(text) else text.split(" ")
        lookup = self.word_memo.__getitem__
        return lookup(words[0]) + b"".join([lookup(f" {word}") for word in words[1:]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    # decoding

    def decode_tokens(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        level = [self.decode_tokens(ids[i : i + leaf]) for i in range(0, len(ids), leaf)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_ENCODERS: dict[tuple[str, str, int], TreeBpe] = {}


def encoder(path: str, pattern: str, memo_entries: int = MEMO_ENTRIES) -> TreeBpe:
    """One encoder for each worker process, vocabulary and size of memo."""
    key = (path, pattern, memo_entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeBpe(load_ranks(path), pattern, memo_entries)
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memo_entries: int = MEMO_ENTRIES, keep_memos: bool = True
) -> DataFrame:
    """Per document: its id, n_tokens, ids (if wanted), ids_sha256, decoded_sha256 (of the ids decoded again).

    Workers remember up to ``memo_entries`` words and pieces. Where they share an executor's memory with other operators' work,
    fewer entries, emptied at the end of each task (``keep_memos``), trade time for space; the result is the same.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunkwright.llm.bpe import encoder

        bpe = encoder(path, pattern, memo_entries)
        try:
            for batch in batches:
                for low in range(0, len(batch), SLICE_ROWS):  # the ids of a whole batch would take several times its texts
                    yield encoded(bpe, batch.slice(low, SLICE_ROWS))
        finally:
            if not keep_memos:
                bpe.forget()

    def encoded(bpe: TreeBpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids, digests, back = [], [], [], []
        for value in batch.column(1):
            packed = bpe.encode_packed(value.as_py() or "")
            numbers = np.frombuffer(packed, dtype="<u4")
            counts.append(len(numbers))
            digests.append(hashlib.sha256(packed).hexdigest())
            whole = hashlib.sha256()
            for at in range(0, len(numbers), SLICE_IDS):
                whole.update(bpe.decode(numbers[at : at + SLICE_IDS].tolist()))
            back.append(whole.hexdigest())
            if with_ids:
                ids.append(numbers.astype("<i4"))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), schema)
