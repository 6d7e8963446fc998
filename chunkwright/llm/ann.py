"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are scaled and lifted to the unit sphere, so the largest inner product is
the least distance.  Each of several orderings projects them onto its own few
random directions, maps each coordinate to its place in the normal distribution,
shifts the grid and takes the Hilbert key.  An ordering is cut at quantiles of
its keys into blocks of bounded size.  A query visits the blocks around its own
key, each of which keeps its ``k`` best by the exact inner product; the blocks'
answers merge and rerank.

A window is a fixed share of an ordering, whatever the size of the table: on data
without structure (independent directions in many dimensions) no curve keeps
neighbours closer than that.  Fewer orderings and smaller shares suit clustered
data; ``recall`` measures what they give.

Equal vectors form one point whose smallest ``k + 1`` ids are kept, so ties and
large groups of copies need no wider window.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, as query or candidate; vectors of another length than the first in
id order take no part either; rows without an id neither; rows that repeat an id are one,
with the least of its vectors (component by component) where these differ; a query never meets its own id; with fewer than
``k`` candidates all that are found come back; ties go to the smaller id; an empty
table gives no rows.  Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.runtime import scratched, ship, stage

ORDERINGS = 10
#: Projected dimensions and bits of each for a Hilbert key; their product is below 63.
CURVE_DIMS, CURVE_BITS = 4, 12
#: Blocks of an ordering, and how many on each side of a query's own it visits.
BLOCKS, REACH = 32, 2
#: Points and queries of a block that meet in one group; larger blocks are split by salts of both.
BLOCK_POINTS, BLOCK_QUERIES = 50_000, 20_000
#: Queries whose products with a group's points are held at once.
QUERY_SLICE = 128
#: How many more than needed a group keeps, for products that rounding puts in another order.
SPARE = 12
#: Relative error of the quantiles that cut an ordering.
QUANTILE_ACCURACY = 2_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (a row each, coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess rotations, from the highest bit down
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], dtype=np.int64), top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _normal_place(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, by a fine table."""
    grid = np.linspace(-5, 5, 2001)
    dist = NormalDist()
    return np.interp(z, grid, np.array([dist.cdf(g) for g in grid]))


def curve_keys(unit: np.ndarray, orderings: int = ORDERINGS, seed: int = 11) -> np.ndarray:
    """The key of each vector (rows, of unit length) in each ordering."""
    random = np.random.default_rng(seed)
    d, out = unit.shape[1], []
    basis = np.linalg.qr(random.standard_normal((d, d)))[0]
    for m in range(orderings):
        if (m + 1) * CURVE_DIMS <= d:  # orderings see directions at right angles while there are any
            axes = basis[:, m * CURVE_DIMS : (m + 1) * CURVE_DIMS]
        else:
            axes = np.linalg.qr(random.standard_normal((d, min(d, CURVE_DIMS))))[0]
        place = _normal_place(unit @ axes * np.sqrt(d))
        shifted = (place + random.random(axes.shape[1])) / 2
        out.append(hilbert_keys((shifted * ((1 << CURVE_BITS) - 1)).astype(np.int64), CURVE_BITS))
    return np.stack(out, axis=1)


def largest(scores: np.ndarray, n: int) -> np.ndarray:
    """The columns of the ``n`` largest scores of each row; of equal ones at the cut, the first columns."""
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    least = np.take_along_axis(scores, top, axis=1).min(axis=1)
    for row in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > n):
        above = np.flatnonzero(scores[row] > least[row])
        top[row] = np.concatenate([above, np.flatnonzero(scores[row] == least[row])[: n - len(above)]])
    return top


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    width = rows.agg(F.min(F.struct("id", F.size("v").alias("d")))["d"].alias("d")).first()["d"]
    return rows.where(F.size("v") == F.lit(width or 0))


@scratched
def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS, reach: int = REACH) -> DataFrame:
    """Per query (rows of ``queries``, which are rows of ``vectors`` too): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    # Smallest ids first: enough that a query's own can be left out. The rest of a group of copies can't be among the k.
    keep = k + 1
    ranked = rows.select("id", "v", F.xxhash64("v").alias("point"))
    low = stage(_smallest(ranked, keep), "ann-ids")
    longest = low.agg(F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))).first()[0] or 1.0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch.column("v").flatten()).reshape(len(batch), -1)
            is_query = np.array(batch.column("is_query"))
            norm = np.linalg.norm(x, axis=1)
            unit = x / np.where(is_query, norm, longest)[:, None]
            lift = np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(axis=1)))
            keys = curve_keys(np.hstack([unit, lift[:, None]]), orderings)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    own = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    asked = own.select("id", "v", F.array(F.lit(0).cast("long")).alias("ids"), F.lit(True).alias("is_query"))
    points = low.select(F.element_at("ids", 1).alias("id"), "v", "ids", F.lit(False).alias("is_query"))
    schema = "id bigint, v array<double>, ids array<bigint>, is_query boolean, keys array<bigint>"
    both = stage(points.unionByName(asked).mapInArrow(keyed, schema), "ann-keys")
    cuts = [F.percentile_approx(F.col("keys")[m], [i / BLOCKS for i in range(1, BLOCKS)], QUANTILE_ACCURACY).alias(f"c{m}") for m in range(orderings)]
    found = both.where("not is_query").agg(F.count("*").alias("n"), *cuts).first()
    bounds = [sorted(found[f"c{m}"] or []) for m in range(orderings)]
    n_asked = both.where("is_query").count()
    salts = max(1, -(-2 * (found["n"] or 0) // (BLOCKS * BLOCK_POINTS)))
    # Queries may all lie in one block, unlike points, whose quantiles cut the blocks.
    ask_salts = max(1, -(-n_asked // BLOCK_QUERIES))

    def block(m: int):
        key = F.col("keys")[m]
        return F.size(F.filter(F.array(*map(F.lit, bounds[m])).cast("array<bigint>"), lambda bound: bound <= key))

    placed = both.withColumn("at", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), block(m).alias("b")) for m in range(orderings)))))
    base = placed.where("not is_query").select("id", "v", "is_query", "at.m", "at.b", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    base = base.withColumn("ask_salt", F.explode(F.sequence(F.lit(0), F.lit(ask_salts - 1))))
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at.b") - reach), F.least(F.lit(BLOCKS - 1), F.col("at.b") + reach)))
    visits = placed.where("is_query").select("id", "v", "is_query", "at.m", near.alias("b")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    visits = visits.withColumn("ask_salt", F.pmod(F.xxhash64("id"), F.lit(ask_salts)).cast("int"))

    def best(group: pa.Table) -> pa.Table:
        ask = np.array(group["is_query"])
        v = np.array(group["v"].combine_chunks().flatten()).reshape(len(group), -1) if len(group) else np.zeros((0, 1))
        ids, queries_at, base_at = np.array(group["id"]), np.flatnonzero(ask), np.flatnonzero(~ask)
        out_q, out_p = [], []
        if len(base_at):
            base_at = base_at[np.argsort(ids[base_at])]
            points, n = v[base_at], min(keep + SPARE, len(base_at))
            for start in range(0, len(queries_at), QUERY_SLICE):
                part = queries_at[start : start + QUERY_SLICE]
                out_q.append(np.repeat(ids[part], n))
                out_p.append(base_at[largest(v[part] @ points.T, n)].ravel())
        q = np.concatenate(out_q) if out_q else np.zeros(0, dtype=np.int64)
        p = np.concatenate(out_p) if out_p else np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": pa.array(q, pa.int64()), "point": pa.array(ids[p] if len(p) else np.zeros(0, dtype=np.int64), pa.int64())})

    # Neighbouring blocks and orderings give the same point again.
    candidates = base.unionByName(visits).groupBy("m", "b", "salt", "ask_salt").applyInArrow(best, "query_id bigint, point bigint").distinct()
    scored = candidates.join(low.select(F.element_at("ids", 1).alias("point"), F.col("v").alias("pv"), "ids"), "point").join(asked.select(F.col("id").alias("query_id"), "v"), "query_id")
    exact = F.aggregate(F.zip_with("v", "pv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    each = scored.select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """v, ids: the n smallest distinct ids of each vector; a large group is cut down in salted parts first."""
    parts = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["point", "v", "salt"], ["point", "v"]):
        order = Window.partitionBy(*keys).orderBy("id")
        parts = parts.withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= n)
    return parts.groupBy("point", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("v", "ids")


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same result over one block that holds all points: what recall is measured against."""
    return search(vectors, queries, k, id_col, vector_col, orderings=1, reach=BLOCKS)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours that were found."""
    hits = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, truth.count())
