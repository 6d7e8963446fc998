"""Benchmark decontamination through a positional inverted index; DataFrame functions only.

The index holds a posting (row, term, position) for each training word that is a
term of some benchmark item, and one more entry per row with its word count.  Postings of
other words could meet no window, so they aren't stored; ``build_index`` takes any vocabulary,
and an index for phrases not known yet needs that of the training texts themselves.
Each window of an item's words is looked up from its rarest term on: the postings
of that term, less its offset in the window, give candidate starts, and these are
intersected with the offset-adjusted postings of the second rarest term, then of
the others.  ``slop`` lets each term stand so many places off (proximity); the words hit
then are those that stand for a term, not those between them.

Words are runs of characters other than ASCII ones that aren't letters or digits;
A-Z count as a-z.

Defined cases: null and empty texts have no words; an item without words has no
window, one with fewer than ``width`` words has one; equal windows of several
items count for each; rows that repeat an id are looked at one by one; null ids are
kept; without items nothing is contaminated; an empty table gives no rows.
Extra columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.runtime import few, scratched, stage

#: Separators before letters are lower-cased, so A-Z are word characters.
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands behind the last word of a row; no word can hold this character.
_END = "\x00"


def lower_ascii(word: Column) -> Column:
    """A-Z to a-z and nothing else; plain words take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def exploded(rows: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep``, pos, word for each word, and a last row with word = _END and pos = the word count."""
    parts = rows.select(*keep, F.split(F.coalesce(text, F.lit("")), _SEPARATORS).alias("_parts"))
    names = [c for c in parts.columns if c != "_parts"]
    first, last = F.element_at("_parts", 1) == "", (F.size("_parts") > 1) & (F.element_at("_parts", -1) == "")
    words = parts.select(*names, first.cast("int").alias("_first"), last.cast("int").alias("_last"), F.posexplode(F.concat("_parts", F.array(F.lit(_END)))).alias("_at", "_word"))
    is_end = F.col("_word") == _END
    at = F.col("_at") - F.col("_first") - F.when(is_end, F.col("_last")).otherwise(0)
    return words.where(F.col("_word") != "").select(*names, at.alias("pos"), lower_ascii(F.col("_word")).alias("word"))


@dataclass
class Index:
    postings: DataFrame  # row, term, pos
    rows: DataFrame  # row, id, n_words
    terms: DataFrame  # term, word


def windows_of(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words: each run of ``width`` consecutive words, or all of an item that has fewer."""
    words = exploded(items, F.col(text_col), F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("string").alias("item")).where(F.col("word") != _END)
    whole = words.groupBy("_row", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]).alias("words"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1)))
    return whole.select("item", "words", starts.alias("at")).select("item", F.slice("words", F.col("at"), F.lit(width)).alias("words")).distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Write the postings of the vocabulary's words (column word) and each row's word count."""
    terms = stage(vocabulary.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "index-terms")
    words = exploded(docs, F.col(text_col), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    ends = F.lit(-1).cast("long")
    known = terms.unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("word"), ends.alias("term")))
    # The terms are those of the benchmark; Spark broadcasts them if their measured size allows it.
    stored = stage(words.join(known, "word").select("row", "id", "term", "pos"), "index-postings")
    return Index(
        stored.where("term >= 0").select("row", "term", "pos"),
        stored.where("term = -1").select("row", "id", F.col("pos").cast("long").alias("n_words")),
        terms,
    )


def find_windows(index: Index, windows: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, window, length, start of each occurrence; row, pos of each word in one); ``windows`` has window (a number) and words."""
    frequency = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    parts = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word")).join(index.terms, "word")
    by_rarity = Window.partitionBy("window").orderBy("n", "offset")
    ranked = stage(parts.join(frequency, "term").select("window", "length", "offset", "term", F.row_number().over(by_rarity).alias("rank")), "windows-ranked")
    # A window with a term that no row holds can't occur.
    present = ranked.groupBy("window", "length").agg(F.count("*").alias("found")).where("found = length").select("window")
    ranked = ranked.join(present, "window", "left_semi")
    starts = (
        index.postings.join(ranked.where("rank = 1").drop("rank"), "term")
        .select("row", "window", "length", (F.col("pos") - F.col("offset")).alias("start"))
        .where("start >= 0" if not slop else f"start >= -{slop}")
    )
    starts = stage(starts, "window-starts")
    near = stage(index.postings.join(few(starts.select("row").distinct()), "row", "left_semi"), "window-postings")
    for ranks in ("rank = 2", "rank > 2"):
        needed = starts.join(ranked.where(ranks), ["window", "length"])
        asked = needed.select("row", "window", "length", "start", "rank", "term", (F.col("start") + F.col("offset")).alias("pos"))
        if slop:
            asked = asked.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
        counted = asked.join(near, ["row", "term", "pos"]).groupBy("row", "window", "length", "start").agg(F.count_distinct("rank").alias("met") if slop else F.count("*").alias("met"))
        met = F.col("met") == (F.lit(1) if ranks == "rank = 2" else F.col("length") - 2)
        # A window of one term (or two) has nothing more to meet.
        short = "length < 2" if ranks == "rank = 2" else "length < 3"
        starts = stage(counted.where(met).select("row", "window", "length", "start").unionByName(starts.where(short)), "window-starts")
    found = stage(starts.distinct(), "window-hits")
    places = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    if slop:
        at = F.col("start") + F.col("offset")
        asked = found.join(ranked, ["window", "length"]).select("row", "term", F.explode(F.sequence(at - slop, at + slop)).alias("pos"))
        places = asked.join(near, ["row", "term", "pos"]).select("row", "pos")
    return found, places.distinct()


@scratched
def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """Per row: id, n_words, n_hit (words inside occurrences), n_items, items (sorted ids), contaminated."""
    by_item = stage(windows_of(items, width).withColumn("window", F.xxhash64("words")), "windows")
    windows = by_item.groupBy("window").agg(F.first("words").alias("words"))
    index = build_index(docs, by_item.select(F.explode("words").alias("word")), id_col, text_col)
    hits, covered = find_windows(index, windows, slop)
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    found = hits.select("row", "window").distinct().join(by_item.select("window", "item"), "window").select("row", "item").distinct()
    # At most one entry for each benchmark item.
    of_row = found.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = n_hit.join(of_row, "row")
    out = index.rows.join(both, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
