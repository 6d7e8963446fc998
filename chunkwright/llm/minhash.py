"""Near-duplicate documents by MinHash.

A document's set is its distinct word shingles.  Equal sets collapse to one node
first (128 bits of the set, the smallest id stands for it), so copies cost
nothing further.  ``BANDS * ROWS`` universal hash minima are cut into bands; nodes that
share a band's minima are candidates.  In each bucket the smallest node is paired
with the others.  Pairs pass a size filter, the agreement of their minima, and
last the exact count on full sets.  Components of the links come from alternating
large-star and small-star.

A bucket whose nodes all lie in one component needs no further pairs.  The rest
are cut into blocks of about BLOCK_NODES nodes; a task takes two blocks of a bucket and
counts, as a product of two matrices, what each node's full set shares with each
other's.  Only links leave the task, so no pair that shares a bucket goes untested
unless its ends are connected already, and no list of pairs is ever written.

With 40 bands of 5 a pair at similarity 0.8 shares no bucket with a probability
of 1.3e-7, and fails the agreement test with less than 1e-6.

Defined cases: null text and text without words have the empty set, link with
nothing and are kept; fewer words than a shingle's make one shingle; equal sets are
one node; rows that repeat an id get equal results; an id that comes with
different texts links through the texts of which it is the smallest id; rows
without an id link with nothing and are kept; an empty table gives no rows.
Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.components import components
from chunkwright.llm.shingles import mix, set_id, shingle_set
from chunkwright.runtime import few, scratched, ship, stage, tidied

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
_SEED = np.random.default_rng(5)
_A = (_SEED.integers(0, 1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _SEED.integers(0, 1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_COMBINE = _SEED.integers(1, 1 << 63, size=ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SALT = _SEED.integers(1, 1 << 63, size=BANDS, dtype=np.uint64)
#: Shingles that are hashed at once.
_BLOCK = 2048
#: Nodes of a block of an unresolved bucket, about, and set members that a task compares at once.
BLOCK_NODES, COMPARED_MEMBERS = 400, 1 << 15
#: How many standard deviations of agreement below the threshold still pass to the exact count.
SIGNATURE_SLACK = 5.0


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, x.shape[1], _BLOCK):
        part = x[:, i : i + _BLOCK] * _A
        part += _B
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.astype(np.uint64).reshape(BANDS, ROWS)
    return mix((rows * _COMBINE).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def sketch(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc, n (set size), sid, bands, sig (16 bits of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.slice(low, 1024)
                n, sids, bands, sigs = [], [], [], []
                for value in part.column(1):
                    shingles = shingle_set(value.as_py(), width)
                    n.append(len(shingles))
                    sids.append(set_id(shingles))
                    if len(shingles):
                        minima = signature(shingles)
                        bands.append(band_keys(minima))
                        sigs.append(minima.astype(np.uint16).tobytes())
                    else:
                        bands.append(None)
                        sigs.append(None)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "sid", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col)).mapInArrow(tidied(run), "doc bigint, n bigint, sid binary, bands array<bigint>, sig binary")


def _agreeing(pairs: DataFrame, signatures: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose minima agree about as often as the similarity asks."""
    least = int(HASHES * (similarity - SIGNATURE_SLACK * (similarity * (1 - similarity) / HASHES) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(len(batch), HASHES) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    both = pairs.join(signatures.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(signatures.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(wanted: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles of the nodes in ``wanted`` (node, sid); only their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                found = [shingle_set(v.as_py(), width) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_id(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "sid", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(few(wanted.select("node")), "node", "left_semi")
    # An id that repeats with another text is dropped here by its set's id.
    full = texts.mapInArrow(tidied(run), "node bigint, sid binary, shingles binary").join(wanted, ["node", "sid"], "left_semi")
    # A node has several sets where its id came with several texts.
    return stage(full.dropDuplicates(["node", "sid"]).select("node", "shingles"), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are similar on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return stage(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct(), "minhash-links")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left has in common with each on the right, over slices of the members that both sides have."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    both = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    known = np.intersect1d(*both)
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    for low in range(0, len(known), COMPARED_MEMBERS):
        part, planes = known[low : low + COMPARED_MEMBERS], []
        for side, members, owner in zip((left, right), both, owners, strict=True):
            at = np.minimum(np.searchsorted(part, members), len(part) - 1)
            hit = part[at] == members
            plane = np.zeros((len(side), len(part)), dtype=np.float32)
            plane[owner[hit], at[hit]] = 1
            planes.append(plane)
        out += np.rint(planes[0] @ planes[1].T).astype(np.int64)
    return out


def _linked_in_blocks(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside buckets; a bucket is cut into blocks, and a task compares two of them at a time.

    Pairs are rows of a matrix in the task; only links leave it.
    """

    def run(table: pa.Table) -> pa.Table:
        block, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sides = [np.flatnonzero(block == side[0]) for side in (i, j)]
        shingles = table.column("shingles")
        members = [[np.frombuffer(shingles[int(k)].as_buffer(), dtype=np.uint64) for k in side] for side in sides]
        sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in members]
        shared = shared_counts(*members)
        linked = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
        linked &= component[sides[0]][:, None] != component[sides[1]][None, :]
        a, b = (node[side[at]] for side, at in zip(sides, np.nonzero(linked), strict=True))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(29)).cast("long"), blocks).cast("int")
    dealt = cells.withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = dealt.join(sets, "node")
    return stage(full.groupBy("band", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct(), "minhash-links")


def _unresolved(cells: DataFrame, label: DataFrame) -> DataFrame:
    """The cells (band, node, component, size) of buckets of three and more nodes that hold several components."""
    marked = cells.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = marked.groupBy("band").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("size > 2 and lo < hi").select("band", "size")
    return stage(marked.join(mixed, "band"), "minhash-open")


@scratched
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id).

    Linked: 100 * size of the intersection >= percent * size of the union.
    """
    ship(docs.sparkSession)
    rows = stage(sketch(docs, width, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "minhash-sketch")
    least = F.min(F.struct("doc", "row"))
    firsts = stage(rows.where("n > 0 and doc is not null").groupBy("sid").agg(least.alias("least")).select("sid", F.col("least.doc").alias("node"), F.col("least.row").alias("first")), "minhash-nodes")
    nodes = rows.join(firsts, "sid").where("row = first").select("node", "n", "sid", "bands", "sig")
    cells = nodes.select(F.explode("bands").alias("band"), "node", "n")
    # Buckets with at least two nodes; the counts are summed before the shuffle.
    shared = cells.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("hi")).where(F.col("hub.node") < F.col("hi")).select("band", "hub")
    cells = stage(cells.join(shared, "band").select("band", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "minhash-cells")
    sized = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    pairs = cells.where((F.col("node") > F.col("hub")) & sized(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    # Only nodes that share a bucket are ever compared.
    signatures = stage(nodes.select("node", "sid", "sig").join(cells.select("node").distinct(), "node", "left_semi"), "minhash-signatures")
    agreeing = stage(_agreeing(pairs, signatures, percent / 100), "minhash-pairs")
    wanted = agreeing.select(F.col("a").alias("node")).unionByName(agreeing.select(F.col("b").alias("node"))).distinct()
    sets = _sets(signatures.select("node", "sid").join(wanted, "node", "left_semi"), docs, width, id_col, text_col)
    label = components(_confirmed(agreeing, sets, percent), "a", "b")
    mixed = _unresolved(cells, label)
    if not mixed.isEmpty():
        more = signatures.select("node", "sid").join(mixed.select("node").distinct(), "node", "left_semi")
        found = _linked_in_blocks(mixed, _sets(more, docs, width, id_col, text_col), percent)
        if not found.isEmpty():
            label = components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(found), "a", "b")
    members = rows.join(firsts, "sid", "left").select("doc", "n", "node")
    component = F.coalesce("component", "node", "doc")
    out = members.join(label, "node", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id"))).withColumn("kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))
