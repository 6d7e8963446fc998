"""Near-duplicate passages by compact windows.

A text is its row of word shingles.  For each of several hash functions the
Cartesian tree of the shingles' hashes splits it into compact windows (l, c, r):
all its passages that begin in [l, c] and end in [c, r] have their least hash at c.
Windows shorter than the least passage are left out, so a text has about
2 * length / least passage of them.

Windows join by their least shingle c and by an interval that both must hold: they
meet where each reaches ``REACH`` places to the same side of c, and the shingle there
is the same.  Each window thus has at most two buckets.  A passage that two texts share
word by word puts them into a common bucket under every hash function, and a passage
with edits does under most.

In each bucket every text is paired with the smallest one, its hub, and never with
all others.  A pair is verified on all its shingles at once: equal runs along the
diagonals are chained over small gaps, and a chain is a common passage if it is long
enough on both sides and 80 % similar as sets of shingles; one that fails is split at its
widest gap.  So a pair finds all occurrences, wherever the windows met.

The hub may be like none, or share less of a passage than others of the bucket do
among themselves.  Two texts that share more than either does with the hub go on
alike where their runs with the hub end.  So each run leaves two keys for each
of its ends, its last shingle with the first and with the fifth one beyond, and texts with equal keys
meet in a further round, under another hub.  An end that lies inside a
verified passage of its text, with whichever other, only waits: its key counts if some other text's end there is open.
Rounds end when they bring no new pair, and
no list of all pairs in a bucket is ever made.  What isn't compared are two texts whose
common run lies in passages that each of them shares with others.  Such texts are of one class as a
rule, through the hub; where their run goes on beyond these passages, its last words may be left out of the regions.

Verified spans that overlap within a text make a region; regions linked by verified
pairs form a class.  Equal texts are one text (64 bits of a hash stand for it)
before all this, and are expanded again at the end.

Defined cases: null text and text shorter than the least passage have no region;
equal texts that are long enough are one region each; a passage that occurs several
times in a text gives each occurrence, if another document has it too, and none
if no other has; rows that repeat an id and its text are one; texts of one id
don't count as each other's document; rows without an id are left out; texts of any
length are read whole; an empty table gives no rows.  Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.llm.components import components
from chunkwright.llm.shingles import mix, shingle_hashes, word_hashes
from chunkwright.runtime import few, scratched, ship, stage, tidied, together, unstage

#: Hash functions. One finds each exact repeat; more find near repeats, whose windows differ from one to the other.
HASHES = 3
#: Hash functions whose windows are on disk at a time.
AT_ONCE = 3
#: Least passage in words, and words of a shingle.
LEAST_WORDS, WIDTH = 50, 5
#: Least similarity of verified passages in per cent.
PERCENT = 80
#: How many places from the least shingle two windows must agree once more.
REACH = 10
#: Pairs that a task verifies, about.
PAIRS_A_TASK = 2000
#: Equal runs that a chain takes in, and the widest gap between two of them, in shingles.
LEAST_RUN, WIDEST_GAP = 3, 48
#: How far beyond a run's end its second key looks; runs that lack at most twice as much count their next shingle too.
AHEAD = 5
_SALTS = np.random.default_rng(41).integers(1, 1 << 63, size=64, dtype=np.uint64)
_NEAR, _FAR = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r), ends included, of each window of at least ``least`` positions; of equal hashes the leftmost counts as the least."""
    out, todo = [], [(0, len(hashes) - 1)]
    while todo:
        l, r = todo.pop()
        if r - l + 1 < least:
            continue
        c = l + int(hashes[l : r + 1].argmin())
        out.append((l, c, r))
        todo += [(l, c - 1), (c + 1, r)]
    return out


def buckets(tokens: np.ndarray, salts: np.ndarray, least: int) -> np.ndarray:
    """The distinct buckets of a text's windows under some hash functions."""
    if len(tokens) < least:
        return np.zeros(0, dtype=np.int64)
    found = []
    for salt in salts:
        l, c, r = np.array(compact_windows(mix(tokens ^ salt), least)).T
        near = tokens[c] * _NEAR + salt
        for side, there, held in ((1, c + REACH, c + REACH <= r), (2, c - REACH, c - REACH >= l)):
            found.append(near[held] + tokens[there[held]] * _FAR + np.uint64(side))
    return _distinct(mix(np.concatenate(found))).view(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return np.concatenate([x[:1], x[1:][x[1:] != x[:-1]]])


def _tokens(text: str | None, width: int) -> np.ndarray:
    words = word_hashes((text or "").encode())
    return shingle_hashes(words, width) if len(words) >= width else words[:0]


def _met(texts: DataFrame, least: int, width: int, salts: np.ndarray) -> DataFrame:
    """hub, doc: each text of a bucket with the smallest one in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                found = [buckets(_tokens(text.as_py(), width), salts, least) for text in part.column(1)]
                docs = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(docs)], names=["bucket", "doc"])

    cells = stage(texts.mapInArrow(tidied(run), "bucket bigint, doc bigint"), "passage-cells")
    grouped = cells.groupBy("bucket").agg(F.min("doc").alias("hub"), F.max("doc").alias("hi"))
    # The hubs are staged so that Spark can split a hot bucket's texts in the join.
    hubs = stage(grouped.where("hub < hi").select("bucket", "hub"), "passage-hubs")
    pairs = stage(cells.join(hubs, "bucket").where("doc > hub").select("hub", "doc").distinct(), "passage-met")
    unstage(cells, hubs)
    return pairs


def _met_again(ends: DataFrame, fresh: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """hub, doc for each text whose end is open, or whose hub's is; keys without fresh ends have nothing new.

    ``spans`` (doc, start, end) are the passages that are verified so far; an end inside one of its text's isn't open.
    """
    ends = ends.join(few(fresh.select("key").distinct()), "key", "left_semi")
    # Distinct spans of one text, which are no more than a few for each of its words.
    covered = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start"] <= F.col("low")) & (F.col("high") < s["end"] - (width - 1)))
    wanted = ends.where("open").join(covered, "doc", "left").select("key", "doc", (~F.coalesce(inside, F.lit(False))).alias("open"))
    ends = stage(wanted.unionByName(ends.where("not open").select("key", "doc", "open")), "passage-ends")
    first_open = F.min(F.when(F.col("open"), F.col("doc")))
    grouped = ends.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("hi"), first_open.alias("first"))
    hubs = stage(grouped.where("hub < hi and first is not null").select("key", "hub", (F.col("first") == F.col("hub")).alias("hub_open")), "passage-hubs")
    return ends.join(hubs, "key").where("doc > hub and (open or hub_open)").select("hub", "doc").distinct()


# verification


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = _distinct(x), _distinct(y)
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _first_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with equal shingles: each of one side with the first equal one of the other side."""
    out = []
    for x, y in ((a, b), (b, a)):
        order = np.argsort(y, kind="stable")
        known = y[order]
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = np.flatnonzero(known[at] == x)
        out.append((hit, order[at[hit]]))
    return np.concatenate([out[0][0], out[1][1]]), np.concatenate([out[0][1], out[1][0]])


def equal_runs(a: np.ndarray, b: np.ndarray, least: int = LEAST_RUN) -> list[tuple[int, int, int]]:
    """(i, j, n): maximal runs a[i:i + n] == b[j:j + n], in order of i; a run that occurs often pairs with first occurrences only."""
    if not len(a) or not len(b):
        return []
    i, j = _first_pairs(a, b)
    if not len(i):
        return []
    wide = len(a) + 2  # so that no run goes on from one diagonal to the next
    line = np.sort((i - j + len(b)) * wide + i)
    line = line[np.flatnonzero(np.diff(line, prepend=-1))]
    cut = np.flatnonzero(np.diff(line, prepend=line[0] - 2) != 1)
    size = np.diff(cut, append=len(line))
    cut, size = cut[size >= least], size[size >= least]
    start = line[cut] % wide
    shift = line[cut] // wide - len(b)
    found, reached = [], {}
    for i0, n, d in sorted(zip(start.tolist(), size.tolist(), shift.tolist(), strict=True)):
        if reached.get(d, -1) >= i0:
            continue
        # Shingles that occur earlier, too, leave holes in a run.
        j0, i1 = i0 - d, i0 + n
        same = a[i1 : i1 + len(b) - (i1 - d)] == b[i1 - d : i1 - d + len(a) - i1]
        n += len(same) if same.all() else int(same.argmin())
        back = min(i0, j0)
        same = (a[i0 - back : i0] == b[j0 - back : j0])[::-1]
        more = back if same.all() else int(same.argmin())
        reached[d] = i0 + n
        found.append((i0 - more, j0 - more, n + more))
    return sorted(found)


def chained(runs: list[tuple[int, int, int]], gap: int = WIDEST_GAP) -> list[list[tuple[int, int, int]]]:
    """Runs that follow each other on both sides with small gaps, the nearest diagonal first."""
    open_: list[list[tuple[int, int, int]]] = []
    done: list[list[tuple[int, int, int]]] = []
    for i, j, n in runs:
        live, best, least = [], None, None
        for chain in open_:
            p, q, m = chain[-1]
            if i - (p + m) > gap:
                done.append(chain)
                continue
            live.append(chain)
            ahead, beside = i - (p + m), j - (q + m)
            if -WIDTH <= ahead and -WIDTH <= beside <= gap and i > p and j > q and (least is None or abs(ahead - beside) < least):
                best, least = chain, abs(ahead - beside)
        open_ = live
        if best is None:
            open_.append([(i, j, n)])
        else:
            best.append((i, j, n))
    return done + open_


def verified(a: np.ndarray, b: np.ndarray, least: int, percent: int = PERCENT, runs: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of common passages in shingles, ends excluded."""
    todo = chained(equal_runs(a, b) if runs is None else runs)
    todo.sort(key=lambda c: -(c[-1][0] + c[-1][2] - c[0][0]))
    out: list[tuple[int, int, int, int]] = []
    for whole in todo:
        parts = [whole]
        while parts:
            chain = parts.pop()
            (p, s, _), (i, j, n) = chain[0], chain[-1]
            q, t = i + n, j + n
            if q - p < least or t - s < least or any(w <= p and q <= x and y <= s and t <= z for w, x, y, z in out):
                continue
            if len(chain) > 1 and not _similar(a[p:q], b[s:t], percent):
                gaps = [max(v[0] - u[0], v[1] - u[1]) - u[2] for u, v in zip(chain, chain[1:], strict=False)]
                cut = gaps.index(max(gaps)) + 1
                parts += [chain[:cut], chain[cut:]]
                continue
            out.append((p, q, s, t))
    return out


def run_ends(b: np.ndarray, runs: list[tuple[int, int, int]], spans: list[tuple[int, int, int, int]], least: int) -> set[tuple[int, int, int, bool]]:
    """(key, low, high, open) of the ends of runs that could hold a bucket, for the second text of a pair; low and high are the two shingles that make a key."""
    out = set()
    for _, j, n in runs:
        if n <= REACH:
            continue
        for side, edge, step in ((1, j + n - 1, 1), (2, j, -1)):
            for ahead in (1, AHEAD):
                there = edge + step * ahead
                if not 0 <= there < len(b) or (ahead == 1 and n < least - 2 * AHEAD):
                    continue
                low, high = min(edge, there), max(edge, there)
                inside = any(s <= low and high < t for _, _, s, t in spans)
                key = (int(b[edge]) * int(_NEAR) + int(b[there]) * int(_FAR) + 2 * ahead + side) & 0x7FFFFFFFFFFFFFFF
                # Beyond a verified run only a stretch of its own counts.
                out.add((key, low, high, not inside and not (ahead == 1 and n >= least)))
    return out


def _verify(pairs: DataFrame, tokens: DataFrame, least: int, width: int, percent: int) -> DataFrame:
    """Links: hub, hub_start, hub_end, doc, start, end (words, ends excluded) of verified passages. Ends of runs: doc, key, low, high, open."""
    names = ["hub", "hub_start", "hub_end", "doc", "start", "end", "key", "low", "high", "open"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hub, doc, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
                runs = equal_runs(a, b)
                spans = verified(a, b, least, percent, runs)
                rows += [(hub, p, q + width - 1, doc, s, t + width - 1, *[None] * 4) for p, q, s, t in spans]
                rows += [(None, None, None, doc, None, None, *end) for end in run_ends(b, runs, spans, least)]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if name == "open" else pa.int64()) for c, name in zip(columns, names, strict=True)], names=names)

    both = pairs.join(tokens.select("doc", F.col("tokens").alias("y")), "doc").join(tokens.select(F.col("doc").alias("hub"), F.col("tokens").alias("x")), "hub")
    return both.select("hub", "doc", "x", "y").mapInArrow(tidied(compare), ", ".join(f"{n} {'boolean' if n == 'open' else 'bigint'}" for n in names))


def _tokens_of(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                packed = [(_tokens(t.as_py(), width) >> np.uint64(32)).astype(np.uint32).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["doc", "tokens"])

    found = texts.join(few(wanted), "doc", "left_semi").select("doc", "text").mapInArrow(tidied(shingled), "doc bigint, tokens binary")
    return stage(found.dropDuplicates(["doc"]), "passage-tokens")


def _links(texts: DataFrame, least: int, width: int, percent: int, hashes: int) -> DataFrame:
    """All verified links between different texts, over as many rounds as bring new pairs."""
    met = [_met(texts, least, width, _SALTS[i : min(hashes, i + AT_ONCE)]) for i in range(0, hashes, AT_ONCE)]
    pairs = stage(together(met).distinct(), "passage-pairs")
    unstage(*met)
    both = lambda p: p.select(F.col("hub").alias("doc")).unionByName(p.select("doc")).distinct()
    # Whoever meets in a later round was in a pair of the first.
    tokens = _tokens_of(texts, both(pairs), width)
    compared, found, n, slots = [pairs], [], pairs.count(), texts.sparkSession.sparkContext.defaultParallelism
    while n:
        needed = tokens.join(few(both(pairs)), "doc", "left_semi") if found else tokens
        # Late rounds have few pairs, and should have few files.
        links = _verify(pairs, needed, least, width, percent).coalesce(max(slots, -(-n // PAIRS_A_TASK)))
        found.append(stage(links, "passage-links"))
        seen = together(found)
        ends, fresh = (t.where("key is not null").select("key", "doc", "low", "high", "open") for t in (seen, found[-1]))
        links = seen.where("hub is not null")
        spans = links.select("doc", "start", "end").unionByName(links.select(F.col("hub").alias("doc"), F.col("hub_start").alias("start"), F.col("hub_end").alias("end")))
        pairs = stage(_met_again(ends, fresh, spans, width).join(together(compared), ["hub", "doc"], "left_anti"), "passage-pairs")
        compared.append(pairs)
        n = pairs.count()
    if not found:
        found = [stage(_verify(pairs, tokens, least, width, percent), "passage-links")]
    unstage(tokens, *compared)
    return together(found).where("hub is not null").select("hub", "hub_start", "hub_end", "doc", "start", "end")


@scratched
def passages(docs: DataFrame, least_words: int = LEAST_WORDS, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES) -> DataFrame:
    """Per region of a document that another document has too: id, start, end (in words, end excluded), class_id, class_start.

    A class is named by the id and start of its first region.
    """
    ship(docs.sparkSession)
    least = least_words - width + 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("id").isNotNull()).withColumn("doc", F.xxhash64("text"))
    prints = stage(rows.select("id", "doc").distinct(), "passage-prints")
    groups = stage(prints.groupBy("doc").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("doc", "first"), "passage-groups")
    copies = prints.join(groups.select("doc", "first"), "doc").where("id > first").select("id", "doc")
    texts = rows.join(few(copies), ["id", "doc"], "left_anti").select("doc", "text")
    links = _links(texts, least, width, percent, hashes)

    # Staged, or else Spark counts the words of all texts, to filter them before the join.
    counted = stage(texts.join(few(groups.select("doc")), "doc", "left_semi").select("doc", _word_count("text").alias("end")), "passage-counts")
    whole = counted.distinct().where(F.col("end") >= least_words).select("doc", F.lit(0).cast("long").alias("start"), "end")
    spans = links.select("doc", "start", "end").unionByName(links.select(F.col("hub").alias("doc"), F.col("hub_start").alias("start"), F.col("hub_end").alias("end"))).unionByName(whole)
    spans = spans.groupBy("doc", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc").orderBy("start")
    fresh = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    at = F.max(F.when(F.col("fresh"), F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = stage(spans.withColumn("fresh", fresh).withColumn("region", at).select("doc", "start", "end", "region"), "passage-spans")
    regions = stage(spans.groupBy("doc", "region").agg(F.max("end").alias("end")).withColumn("node", F.monotonically_increasing_id()), "passage-regions")
    place = spans.join(regions.select("doc", "region", "node"), ["doc", "region"]).select("doc", "start", "node")
    linked = links.join(place, ["doc", "start"]).select("hub", "hub_start", F.col("node").alias("u"))
    edges = linked.join(place.select(F.col("doc").alias("hub"), F.col("start").alias("hub_start"), F.col("node").alias("v")), ["hub", "hub_start"]).select("u", "v")
    named = regions.join(components(edges), "node", "left").select("doc", F.col("region").alias("start"), "end", F.coalesce("component", "node").alias("component"))
    # Equal texts have the same regions.
    out = stage(named.join(prints.select("id", "doc"), "doc").select("id", "start", "end", "component").distinct(), "passage-out")
    first = out.groupBy("component").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    return out.join(first, "component").select(F.col("id").alias(id_col), "start", "end", F.col("first.id").alias("class_id"), F.col("first.start").alias("class_start"))


def _word_count(text_col: str):
    trimmed = F.regexp_replace(F.col(text_col), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")
