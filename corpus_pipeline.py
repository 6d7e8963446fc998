"""A corpus pipeline out of the operators in ``chunkwright.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last keep the
columns of ``documents`` (and any further ones).

* language: documents whose language can't be told go; these are the ones without a letter (``und``).
* near_duplicates: of each group of near copies (five words, 0.8) the smallest id stays.
* decontamination: documents that hold ten consecutive words of a benchmark item go.
* secrets: spans of secrets are replaced by a mark; ``n_chars``, where there is one, follows the text.
* tokens: each document becomes its byte-level BPE ids, with digests of them and of the bytes they decode to.

Decisions are made and applied row by row.  Where ids are null or repeat, rows get numbers of their own: then
the first row of a group of near copies stays, and repeated rows are copies too.  Null text ends in the language stage.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm import bpe, decontam, langid, minhash, queries, secrets
from chunkwright.runtime import few, read_table, scratch, stage


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows and the column that tells them apart: doc_id, or a number written beside them if ids are null or repeat."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    name = "_" * (1 + max(map(len, docs.columns)))
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Further columns may have any name, so that none clashes with the prediction's.
    plain = [f"_{i}" for i in range(len(docs.columns))]
    marked = langid.predict(docs.toDF(*plain), langid.fit(docs), text_col=plain[docs.columns.index("text")], keep=plain)
    return marked.where("lang_pred != 'und'").select(*plain).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    with scratch(spark) as keep:
        found = minhash.near_duplicates(rows, width=5, percent=80, id_col=key)
        gone = keep(stage(found.where("not kept").select(key), "pipeline-copies"))
    return rows.join(few(gone), key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    with scratch(spark) as keep:
        found = decontam.decontaminate(rows, read_table(spark, sf_dir, "benchmark"), width=10, id_col=key)
        gone = keep(stage(found.where("contaminated").select(key), "pipeline-contaminated"))
    return rows.join(few(gone), key, "left_anti").select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # The executors still hold what the earlier stages needed, so the encoder's memos are small here and last for a task.
    return bpe.encode_documents(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo_entries=200_000, keep_memos=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_spans), ("tokens", tokens)]

#: Linear classifiers and byte-level BPE aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
