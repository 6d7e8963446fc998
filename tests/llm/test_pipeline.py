import re

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from chunkwright.llm import bpe, langid, secrets

from .test_dedup import brute_components
from .test_text import brute_contamination

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """Every stage's decisions, by other means; the language stage must keep all text with a letter here."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    told = {r.doc_id: r for r in langid.predict(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    left = [(d, t) for d, t in docs if told[d].lang_pred != "und"]
    assert len(left) >= len(docs) - 2
    group = brute_components(left, 5, 80)
    left = [(d, t) for d, t in left if group[d][1] == d]
    hit = brute_contamination(left, items, 10)
    left = [(d, t) for d, t in left if not hit[d][1]]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {d: theirs.encode_ordinary(secrets.redact(t, secrets.all_spans(t))) for d, t in left}
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == want
    assert not any(re.search("AKIA[A-Z0-9]{14}", secrets.redact(t, secrets.all_spans(t))) for _, t in left)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs"])
def test_stages_keep_columns_on_odd_rows(spark, request, name):
    docs = request.getfixturevalue(name)
    for step_name, step in corpus_pipeline.STAGES[:-1]:
        docs_after = step(spark, docs, SF)
        assert docs_after.columns == docs.columns, step_name
        ids = sorted(r.doc_id for r in docs_after.select("doc_id").collect())
        if name == "no_docs":
            assert ids == []
        elif step_name == "language":
            assert 2 not in ids and 3 not in ids and 7 not in ids and {1, 4, 5} <= set(ids)
        elif step_name == "near_duplicates":
            assert ids == [1, 2, 3, 5, 6, 7]
        else:
            assert ids == [1, 2, 3, 4, 5, 5, 6, 7]


def test_rows_without_an_id_and_clashing_ids(spark, make_prose):
    """Decisions hold for rows: a contaminated or copied row goes although it has no id, a clean one stays although its id is shared."""
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE length(text) > 200 ORDER BY item_id LIMIT 1").fetchall()[0][0]
    a, b, c, d = (make_prose(i, 600) for i in (1, 2, 3, 4))
    rows = [(None, a), (None, a), (7, b), (7, f"{c} {item}"), (None, f"{item} {d}"), (8, b), (9, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    once = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert once.columns == ["doc_id", "text"]
    assert sorted(((r.doc_id or 0), r.text) for r in once.collect()) == sorted([(0, a), (7, b), (7, rows[3][1]), (0, rows[4][1])])
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert sorted(((r.doc_id or 0), r.text) for r in clean.collect()) == sorted([(0, a), (0, a), (7, b), (8, b), (9, a)])
    assert corpus_pipeline.secret_spans(spark, docs, SF).count() == 7
