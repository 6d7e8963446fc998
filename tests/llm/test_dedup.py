import random
import re
from collections import defaultdict

from chunkwright.llm import components, minhash, shingles, substring
from chunkwright.llm.components import components as connected


def word_list(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_shingles(text, width):
    w = word_list(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(docs, width, percent):
    sets = {d: brute_shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_shingle_hashes_follow_words():
    texts = ["a b c d e", "A  b\nc d\te", "a b c", "", None, "Éa bé c d", "x" * 3000 + " y z w"]
    for t in texts:
        assert len(shingles.shingle_set(t, 4)) == len(brute_shingles(t, 4))
    assert list(shingles.shingle_set(texts[0], 4)) == list(shingles.shingle_set(texts[1], 4))


def test_long_text_in_slices(monkeypatch, make_prose):
    text = make_prose(3, 5000)
    whole = shingles.word_hashes(text.encode())
    monkeypatch.setattr(shingles, "SLICE_BYTES", 100)
    assert (shingles.word_hashes(text.encode()) == whole).all()


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 9000 + i) for i in range(50)] + [(3, 3), (5, 4), (4, 5)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100} and {found[9000 + i] for i in range(50)} == {7}
    assert found[4] == found[5] == 4 and 3 not in found
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(make_prose, groups=4, size=6, words=150):
    rng, docs, n = random.Random(5), [], 0
    for g in range(groups):
        base = make_prose(100 + g, words).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            docs.append((n, " ".join(copy)))
            n += 1
    return docs + [(n + i, make_prose(900 + i, 80)) for i in range(10)]


def test_near_duplicates_match_brute_force(spark, make_prose):
    docs = [*near_copies(make_prose), (500, None), (501, ""), (502, "Two words"), (503, "two  WORDS"), (504, "two")]
    truth = brute_components(docs, 4, 80)
    found = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == truth
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_bucket_with_several_components_is_resolved(spark, make_prose, monkeypatch):
    """With one row a band, unlike documents meet in a bucket whose smallest node is like none of them."""
    shared = make_prose(1, 60)
    docs = [(i, f"{shared} {make_prose(50 + i // 3, 90)} tail{i}") for i in range(12)]
    monkeypatch.setattr(minhash, "BANDS", 200)
    monkeypatch.setattr(minhash, "ROWS", 1)
    monkeypatch.setattr(minhash, "_COMBINE", minhash._COMBINE[:1])
    monkeypatch.setattr(minhash, "_BAND_SALT", minhash._SEED.integers(1, 1 << 62, size=200).astype("uint64"))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()}
    assert found == {d: c for d, (_, c) in brute_components(docs, 4, 80).items()}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    found = minhash.near_duplicates(odd_docs, 4, 80).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 8 and by[4].component_id == 1 and not by[4].kept
    assert all(by[d].kept and by[d].n_shingles == 0 for d in (2, 3, 7)) and by[6].n_shingles == 1
    assert minhash.near_duplicates(no_docs).count() == 0


def test_compact_windows_cover_each_passage_once():
    rng = random.Random(2)
    import numpy as np

    hashes = np.array([rng.randrange(40) for _ in range(60)], dtype=np.uint64)
    windows = substring.compact_windows(hashes, 5)
    assert all(b - a >= 4 for a, _, b in windows) and substring.compact_windows(hashes[:4], 5) == []
    for i in range(60):
        for j in range(i + 4, 60):
            holds = [(a, c, b) for a, c, b in windows if a <= i <= c <= j <= b]
            assert len(holds) == 1 and hashes[holds[0][1]] == hashes[i : j + 1].min()


def test_passages_cover_every_exact_repeat(spark, make_prose):
    passage, phrase = make_prose(7, 70), make_prose(8, 20)
    docs = [(i, f"{make_prose(20 + i, 40 + 13 * i)} {passage} {make_prose(60 + i, 30)}") for i in range(6)]
    docs += [(10 + i, f"{make_prose(200 + i, 90)} {phrase} {make_prose(300 + i, 60)}") for i in range(5)]
    docs += [(20, make_prose(400, 80)), (21, make_prose(400, 80)), (22, None), (23, ""), (24, make_prose(401, 20)), (25, make_prose(401, 20))]
    words, grams = {d: word_list(t) for d, t in docs}, defaultdict(set)
    for d, w in words.items():
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(d)
    got = defaultdict(set)
    for r in substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.doc_id].update(range(r.start, r.end))
        assert r.end <= len(words[r.doc_id])
    for d, w in words.items():
        for k in range(len(w) - 49):
            if len(grams[tuple(w[k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= got[d]
    assert set(got) == {*range(6), 20, 21}


def test_near_passages_with_edits(spark, make_prose):
    passage = make_prose(9, 120).split()
    edited = passage[:40] + ["inserted"] + passage[40:80] + ["swapped"] + passage[81:]
    docs = [(1, f"{make_prose(30, 100)} {' '.join(passage)} {make_prose(31, 40)}"), (2, f"{make_prose(32, 55)} {' '.join(edited)} {make_prose(33, 90)}"), (3, make_prose(34, 300))]
    found = substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2} and len({r.class_id for r in found}) == 1


def test_exact_repeats_meet_past_a_smaller_text(spark, make_prose):
    """A smaller text quotes too little of the passage that two others share, and takes the buckets; within the hub every repeat counts."""
    docs, want = [], {}
    for k in range(12):
        quote, tail = make_prose(500 + k, 47), make_prose(600 + k, 6)
        docs += [(10 * k, f"{make_prose(700 + k, 60)} {quote} {make_prose(800 + k, 60)}")]
        docs += [(10 * k + i, f"{make_prose(900 + 10 * k + i, 40 + i)} {quote} {tail} {make_prose(1100 + 10 * k + i, 50)}") for i in (1, 2)]
        want |= {10 * k + i: (40 + i, 93 + i) for i in (1, 2)}
    twice = make_prose(1300, 55)
    docs += [(200, f"{twice} {make_prose(1301, 80)} {twice}"), (201, f"{make_prose(1302, 60)} {twice}")]
    found = substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = defaultdict(set)
    for r in found:
        got[r.doc_id].update(range(r.start, r.end))
    for d, (start, end) in want.items():
        assert set(range(start, end)) <= got[d], d
    assert {*range(55), *range(135, 190)} <= got[200] and set(range(60, 115)) <= got[201]
    assert all(r.class_id == r.doc_id // 10 * 10 + 1 for r in found if r.doc_id < 200)


def test_passages_with_an_inserted_word(spark, make_prose):
    docs = []
    for k in range(40):
        passage = make_prose(2000 + k, 60).split()
        docs += [(2 * k, f"{make_prose(2100 + k, 70)} {' '.join(passage)} {make_prose(2200 + k, 50)}")]
        docs += [(2 * k + 1, f"{make_prose(2300 + k, 40)} {' '.join([*passage[:30], 'inserted', *passage[30:]])} {make_prose(2400 + k, 80)}")]
    found = substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({r.doc_id // 2 for r in found}) >= 39


def covered(found):
    out = defaultdict(set)
    for r in found:
        out[r.doc_id].update(range(r.start, r.end))
    return out


def test_each_of_many_occurrences_counts(spark, make_prose):
    """40 documents hold one passage twice, and every other one a boilerplate line behind it that many more documents have."""
    passage, line = make_prose(3000, 55), make_prose(3001, 30)
    docs, want = [], {}
    for k in range(40):
        parts = [make_prose(3100 + k, 30 + k), passage, line if k % 2 else "", make_prose(3200 + k, 60), passage, make_prose(3300 + k, 20)]
        docs.append((k, " ".join(parts)))
        second = 30 + k + 55 + (30 if k % 2 else 0) + 60
        want[k] = {*range(30 + k, 85 + k), *range(second, second + 55)}
    docs += [(100 + k, f"{make_prose(3400 + k, 50)} {line} {make_prose(3500 + k, 50)}") for k in range(30)]
    found = substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = covered(found)
    assert all(want[k] <= got[k] for k in range(40)) and set(got) == set(range(40)) and {r.class_id for r in found} == {0}


def test_shared_beyond_any_hub(spark, make_prose):
    """Texts share parts of one long text, each pair another stretch; whichever is a bucket's hub, every repeat of 50 words counts but for four words at most."""
    rng, words, docs = random.Random(31), make_prose(3600, 400).split(), []
    for k in range(30):
        at, n = rng.randrange(0, 340), rng.choice([30, 45, 52, 60, 90])
        docs.append((k, f"{make_prose(3700 + k, 40)} {' '.join(words[at : at + n])} {make_prose(3800 + k, 40)}"))
    plain, grams = {d: word_list(t) for d, t in docs}, defaultdict(set)
    for d, w in plain.items():
        for i in range(len(w) - 49):
            grams[tuple(w[i : i + 50])].add(d)
    got = covered(substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    wanted = 0
    for d, w in plain.items():
        for i in range(len(w) - 49):
            if len(grams[tuple(w[i : i + 50])]) > 1:
                wanted += 1
                assert len(set(range(i, i + 50)) - got[d]) < substring.AHEAD, (d, i)
    assert wanted > 60


def test_recall_of_near_repeats(spark):
    """Passages of 60 to 150 words, one to three edits, against every pair that verification by itself accepts."""
    rng, docs, pairs = random.Random(17), [], []
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    for k in range(240):
        n, edits = rng.choice([(60, 1), (60, 1), (100, 2), (150, 3)])
        passage = fresh(n)
        edited = list(passage)
        for at in sorted(rng.sample(range(6, n - 6), edits), reverse=True):
            edited[at : at + rng.choice([0, 1])] = fresh(rng.choice([0, 1])) or ["gone"]
        a, b = (" ".join(fresh(rng.randrange(30, 90)) + p + fresh(rng.randrange(30, 90))) for p in (passage, edited))
        docs += [(2 * k, a), (2 * k + 1, b)]
        tokens = [(substring._tokens(t, 5) >> 32).astype("uint32") for t in (a, b)]
        if substring.verified(*tokens, 46):
            pairs.append((k, edits))
    found = substring.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    classes = {r.doc_id: r.class_id for r in found}
    for n in (1, 2, 3):
        of = [k for k, edits in pairs if edits == n]
        hit = sum(classes.get(2 * k) == classes.get(2 * k + 1) == 2 * k for k in of)
        print(f"recall with {n} edits: {hit} of {len(of)}")
        assert len(of) >= 20 and hit >= 0.9 * len(of)
    assert all(r.class_id // 2 == r.doc_id // 2 for r in found)


def test_runs_and_chains_by_brute_force():
    import numpy as np

    rng = random.Random(23)
    for _ in range(300):
        a, b = (np.array([rng.randrange(9) for _ in range(rng.randrange(1, 60))], dtype=np.uint32) for _ in range(2))
        runs = substring.equal_runs(a, b, 3)
        longest = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                longest = max(longest, n)
        assert all((a[i : i + n] == b[j : j + n]).all() and (i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]) and (i == 0 or j == 0 or a[i - 1] != b[j - 1]) for i, j, n in runs)
        assert sorted({(i - j, i) for i, j, _ in runs}) == sorted((i - j, i) for i, j, _ in runs)
    unique = np.arange(200, dtype=np.uint32)
    assert substring.verified(unique, np.concatenate([unique[150:] + 500, unique[20:150]]), 46) == [(20, 150, 50, 180)]
    line = np.tile(np.arange(12, dtype=np.uint32), 300)
    assert substring.verified(line, line[:2400], 46)


def test_passages_odd_rows(odd_docs, no_docs):
    found = substring.passages(odd_docs).collect()
    assert {r.doc_id for r in found} == {1, 4} and all((r.start, r.end, r.class_id) == (0, 120, 1) for r in found)
    assert substring.passages(no_docs).count() == 0


def test_an_id_with_several_texts(spark, make_prose):
    a, b = make_prose(90, 150), make_prose(91, 150)
    docs = [(1, a), (1, b), (2, a), (3, b), (4, f"{make_prose(92, 60)} {make_prose(93, 60)}"), (4, f"{make_prose(93, 60)} {make_prose(94, 60)}"), (None, a)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect() if r.doc_id}
    assert linked == {1: 1, 2: 1, 3: 1, 4: 4}
    found = {(r.doc_id, r.start, r.end, r.class_id) for r in substring.passages(table).collect()}
    assert found == {(1, 0, 150, 1), (2, 0, 150, 1), (3, 0, 150, 1)}
