import hashlib
import random
import re
import time

import duckdb
import public_tokenizers
import pytest
import tiktoken

from chunkwright.llm import bpe, decontam, langid, queries, secrets

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def both():
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return bpe.TreeBpe(RANKS, public_tokenizers.PATTERN), theirs


def test_tree_encoding_equals_the_library(both):
    ours, theirs = both
    rng = random.Random(4)
    alphabets = ["ab", "aaab", "abcdefgh etionr", "=-_ \n\t", " the and ingéèü漢字\U0001f600", "0123456789abcdef", "   \x1c\r\n", "'sdtl "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 9, 60, 900]))) for _ in range(400)]
    texts += ["".join(rng.choice(a) for _ in range(1500)) for a in alphabets] + ["", " ", "  ", "a  b", "a \n b ", "z" * 5000, "ab" * 4000]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids, leaf=7) == t.encode()


def test_spaces_beside_other_white_space(both):
    ours, theirs = both
    rng = random.Random(9)
    texts = ["x \u00a0 \u00a0 y", "x \u00a0 \u00a0", "x \u00a0", " x", "x ", "a \u00a0b", "a\u00a0 b", "a\n b", "a \nb", "x \u3000 \u2003 y", "x\u0085 y"]
    texts += ["".join(rng.choice(["x", "the", "7", ".", " ", " ", "\u00a0", " \u00a0", "\n", "\u3000", "\u2009", "\x1c", "\u200b"]) for _ in range(rng.choice([3, 9, 40]))) for _ in range(3000)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t), t
    assert ours.encode(texts[0]) == [87, 11504, 331]


def test_every_row_of_white_space(both):
    """All strings of up to six of these, bare and between words."""
    ours, theirs = both
    rows = [""]
    for _ in range(6):
        rows = [""] + [r + c for r in rows for c in " \n\t\u00a0\u3000"]
    rows = sorted(set(rows))
    texts = [t for r in rows for t in (r, f"x{r}y")]
    want = theirs.encode_ordinary_batch(texts, num_threads=2)
    assert [t for t, ids in zip(texts, want, strict=True) if ours.encode(t) != ids] == []


def test_long_texts_are_cut_where_matches_end(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bpe, "SLICE_CHARS", 7)
    rng = random.Random(12)
    for _ in range(600):
        t = "".join(rng.choice(["word", "'s", " ", " ", "  ", "\n", "12", ".", "\u00a0", "é"]) for _ in range(rng.choice([5, 30, 90])))
        assert ours.encode(t) == theirs.encode_ordinary(t), t


def test_heap_and_list_merges_agree(both):
    ours, _ = both
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"aeinrst ") for _ in range(rng.randrange(1, 200)))
        assert ours.span(data) == ours._span_by_heap(data)


def test_memo_is_bounded():
    memo = bpe.Memo(len, 10)
    assert [memo["x" * (i % 50)] for i in range(500)] == [i % 50 for i in range(500)] and len(memo) <= 10


def test_encode_documents(both, odd_docs, no_docs):
    _, theirs = both
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    found = bpe.encode_documents(odd_docs, path, public_tokenizers.PATTERN).collect()
    assert len(found) == 8
    for r in found:
        want = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.ids, r.n_tokens) == (want, len(want)) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    small = bpe.encode_documents(odd_docs, path, public_tokenizers.PATTERN, memo_entries=4, keep_memos=False).collect()
    assert sorted(map(str, small)) == sorted(map(str, found))
    assert bpe.encode_documents(no_docs, path, public_tokenizers.PATTERN).count() == 0


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_base_spans_match_the_patterns():
    rng = random.Random(8)
    parts = ["password", "PassWD", "api_key", "ApiKey", "toKen", "ſecret", "token", "=", ": ", '"', "'", " ", "AKIA", "AKIA1234567890ABCD", "deadbeef", "0123456789abcdef", "abc.def/ghi=jkl", "secret", "\n", "x", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert sorted(s for s in secrets.all_spans(text) if s[0] != "literal") == brute_base(text), text


def test_lexer_pairs_propagation_and_scores():
    text = 'seed = "q7Zt19LmXw"\nDB_PASSWORD := seed\ncolor = "blue1234567"\nclientSecret => \'Aa1\' + \'Bb2Cc3Dd4\'\nnote: "a plain sentence"'
    found = {text[a:b] for k, a, b in secrets.all_spans(text) if k == "literal"}
    assert found == {"q7Zt19LmXw", "Aa1", "Bb2Cc3Dd4"}
    assert secrets.all_spans("He said: nothing is a secret here; tokens = many words.") == []


def test_a_chain_of_constants_takes_time_as_its_length():
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdefghXYZ01234567") for _ in range(4)) for _ in range(20_000)]
    lines = ['k = "q7Zt19LmXw"'] + [f'k = k + "{x}"' for x in pieces] + ["token = k", "a = k + k", "secret = a"]
    began = time.perf_counter()
    found = secrets.lexed_spans("\n".join(lines))
    assert time.perf_counter() - began < 8 and len(found) == 20_001


def test_a_name_given_anew_has_its_new_value_alone():
    text = 'x = "q7Zt19LmXw"\nx = "plain"\ntoken = x\ny = "Zz81Lm4Qw"\nsecret = y\n'
    assert {text[a:b] for _, a, b in secrets.lexed_spans(text)} == {"Zz81Lm4Qw"}


def test_scan_and_redact(odd_docs, no_docs, spark):
    docs = spark.createDataFrame([(1, "k token = 0123456789abcdef01 end", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, spans long")
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert found[1].spans.startswith("assign:2:") and (found[1].n_assign, found[1].n_hex, found[2].n_hex, found[3].spans) == (1, 1, 0, "")
    clean = {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}
    assert clean == {1: "k [SECRET] end", 2: None, 3: ""}
    assert secrets.scan(no_docs).count() == 0 and secrets.scan(odd_docs).count() == 8


SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    found = queries.QUERIES["op2_language_tree"](spark, SF).toPandas().set_index("doc_id")
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df().set_index("doc_id")["lang"]
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang_pred == truth[held.index]).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_language_families_and_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(x for g in model.families for x in g) == list(range(len(model.labels)))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()}
    assert found[2] == found[3] == found[7] == ("und", 0.0) and found[5][0] in model.labels
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    one = langid.fit(odd_docs.where("lang = 'yy'"))
    assert {r.lang_pred for r in langid.predict(odd_docs.where("doc_id = 1"), one).collect()} == {"yy"}


def test_features_of_slices_agree(monkeypatch, make_prose):
    text = ("Café " + make_prose(3, 900)).encode()
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_SLICE", 64)
    assert abs(langid.features(text) - whole).max() < 1e-6


def brute_contamination(docs, items, width):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = split(text)
        windows += [(str(item), w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w]
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, w in windows:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def test_decontamination_matches_brute_force(spark, make_prose):
    items = [(1, make_prose(70, 25)), (2, "Only, three WORDS!"), (3, None), (4, ""), (5, make_prose(71, 10)), (6, make_prose(71, 10)), (7, "same same same same same same same same same same same"), (10, "soloÉ")]
    docs = [(1, f"x {items[0][1]} y"), (2, f"{make_prose(72, 30)}. {' '.join(items[0][1].split()[3:14])} -- only three words only three words"), (3, None), (4, ""), (5, "..."), (6, items[4][1].upper()), (7, "same " * 15), (8, "soloÉ SOLOÉ soloé"), (9, make_prose(73, 200)), (10, "!lead " + make_prose(74, 40) + "!")]
    found = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in found} == brute_contamination(docs, items, 10)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) for r in found)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "red green very blue"), (2, "red green far far blue"), (3, "blue red green")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    hits = lambda slop: {r.doc_id for r in decontam.decontaminate(docs, items, slop=slop).where("contaminated").collect()}
    assert hits(0) == set() and hits(1) == {1} and hits(2) >= {1, 2}


def test_proximity_hits_the_words_that_stand_for_terms(spark):
    docs = spark.createDataFrame([(1, "red very green blue"), (2, "red green blue red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = decontam.decontaminate(docs, items, slop=1)
    assert {r.doc_id: r.n_hit for r in rows.collect()} == {1: 3, 2: 3}


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one", "x")], "item_id long, text string, pos string")
    found = decontam.decontaminate(odd_docs, items).collect()
    assert len(found) == 8 and {r.doc_id for r in found if r.contaminated} == {6}
    assert decontam.decontaminate(no_docs, items).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(odd_docs, items.limit(0)).collect())
