"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together.  Groups, the largest
first, go to the least-loaded shard through a heap.  Groups of one size are
interchangeable, so the driver sees only how many groups there are of each size: n
different sizes need n * n / 2 bytes of text at least, which bounds them.  A size's groups are
dealt at once, and each shard gets as many as the heap would have given it one by one.
Which ones follows from their rank among the groups of that size.

Ranks and slots are numbered without gaps: rows are dealt into salted cells, cells get
offsets from their counts, and a row's number is its cell's offset plus its rank in the
cell.  No task holds a whole size or a whole shard.

Defined cases: null text has no bytes, the checksum of no bytes, and the same
group as empty texts; repeated rows are kept; an empty table gives no rows; with
fewer groups than shards some shards stay empty; ties go to the smaller shard, and among
groups of one size the order is that of a hash of the text.  Extra columns aren't read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.runtime import scratched, stage

#: What each row costs beside its bytes.
ROW_BYTES = 16
#: Rows of a cell within which numbers are ranked.
CELL_ROWS = 50_000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets, the least-loaded shard taking the next, ties to the first; ``loads`` grow."""

    def below(level: int) -> list[int]:
        # An item goes to a shard while its load is at most `level`.
        return [max(0, (level - load) // size + 1) for load in loads]

    low, high = min(loads) - 1, min(loads) + size * count
    while high - low > 1:  # the least level that takes all items
        middle = (low + high) // 2
        low, high = (low, middle) if sum(below(middle)) >= count else (middle, high)
    given, last = below(high - 1), below(high)
    rest = count - sum(given)
    for shard, most in enumerate(last):
        if rest and most > given[shard]:
            given[shard] += 1
            rest -= 1
    for shard, n in enumerate(given):
        loads[shard] += n * size
    return given


def schedule(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, end rank, shard) for so many groups of each size, the largest size first.

    Sizes with fewer groups than shards go through a heap, larger ones are dealt at once; both give the same.
    """
    loads = [0] * shards
    heap = [(0, shard) for shard in range(shards)]
    out = []
    for size, count in sorted(sizes.items(), reverse=True):
        if count < shards:
            for rank in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                loads[shard] = load + size
                out.append((size, rank, rank + 1, shard))
            continue
        rank = 0
        for shard, n in enumerate(deal(loads, size, count)):
            if n:
                out.append((size, rank, rank + n, shard))
                rank += n
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
    return out


def numbered(rows: DataFrame, key: str, order: str, name: str, total: int) -> DataFrame:
    """``rows`` with a number from 0 within each ``key``, without gaps, by cells of a hash of ``order``."""
    cells = max(1, -(-total // CELL_ROWS))
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64(order), F.lit(cells)))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy(key, "_cell").count().select(key, "_cell", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(order))
    return dealt.withColumn("_rank", rank).join(offsets, [key, "_cell"]).withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_cell", "_rank", "_before")


@scratched
def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, size, text_crc32, group (a hash of the text), shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    classes = groups.groupBy("bytes").agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).collect()
    placed = schedule({r["bytes"]: r["groups"] for r in classes}, shards)
    total = sum(r["rows"] for r in classes)
    # At most one row for each size and shard, or for each group.
    stretches = stage(spark.createDataFrame(placed, "bytes long, low long, high long, shard int"), "shard-stretches")
    ranked = numbered(groups.select("group", "bytes"), "bytes", "group", "rank", sum(r["groups"] for r in classes))
    of_group = stage(ranked.join(stretches, "bytes").where("rank >= low and rank < high").select("group", "shard"), "shard-places")
    dealt = rows.join(of_group, "group")
    return numbered(dealt, "shard", "row", "slot", total).select(F.col("id").alias(id_col), "size", "text_crc32", "group", "shard", "slot")
