import hashlib
import heapq
import io
import random
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest

from chunkwright.llm import ann, chat, shard, warc


# nearest neighbours


def test_hilbert_curve_visits_neighbours():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, point string")


def truth(x, q, k):
    s = x.astype(np.float32).astype(float) @ x[q].astype(np.float32).astype(float)
    order = [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q]
    return order[:k], s


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(3).standard_normal((1500, 16))
    x *= np.random.default_rng(4).uniform(0.5, 2, (1500, 1))
    table = vectors(spark, x)
    found = ann.search(table, table.where("vec_id % 50 = 0"), 10).toPandas()
    hits = 0
    for q, rows in found.groupby("query_id"):
        want, s = truth(x, q, 10)
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 11))
        assert np.allclose(rows.score, s[rows.vec_id], rtol=0, atol=1e-9)
        hits += len(set(want) & set(rows.vec_id))
    assert hits / 300 >= 0.9
    full = ann.exact_search(table, table.where("vec_id % 500 = 0"), 10).toPandas()
    assert all(list(r.sort_values("rank").vec_id) == truth(x, q, 10)[0] for q, r in full.groupby("query_id"))


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0]
    bad = [(50, None, "a"), (51, [0.0, 0.0], "a"), (52, [float("nan"), 1.0], "a"), (53, [None, 1.0], "a"), (54, [float("inf"), 1.0], "a")]
    table = vectors(spark, [same] * 30 + [[1.0, 1.0]], bad)
    found = ann.search(table, table.where("vec_id in (0, 20, 30, 50, 51)"), 5).collect()
    by = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in found}}
    assert by == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 30: [0, 1, 2, 3, 4]}
    assert ann.search(table.limit(0), table.limit(0), 5).count() == 0
    assert ann.search(table.where("vec_id = 3"), table.where("vec_id = 3"), 5).count() == 0


def test_repeated_rows_clashing_ids_and_ties_at_the_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_POINTS", 20)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    x = np.random.default_rng(6).standard_normal((40, 4))
    plain = vectors(spark, x)
    want = ann.exact_search(plain, plain.where("vec_id % 5 = 0"), 6).orderBy("query_id", "rank").collect()
    twice = plain.unionByName(plain.where("vec_id % 2 = 0"))
    found = ann.exact_search(twice, twice.where("vec_id % 5 = 0"), 6).orderBy("query_id", "rank").collect()
    assert found == want and len(want) == 48
    for q in (0, 35):
        assert [r.vec_id for r in want if r.query_id == q] == truth(x, q, 6)[0]
    # An id with two vectors has the least of them, and comes once in an answer.
    clash = vectors(spark, [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]], [(1, [2.0, 0.0], "x")])
    assert [(r.vec_id, round(r.score, 6)) for r in ann.exact_search(clash, clash.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(1, 0.9), (2, 0.0)]
    # 64 axes and one query: all scores but one are the same.
    axes = vectors(spark, np.eye(64))
    assert [r.vec_id for r in ann.exact_search(axes, axes.where("vec_id = 9"), 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_largest_prefers_the_first_of_equals():
    scores = np.array([[1.0, 3, 2, 2, 2, 0], [5, 5, 5, 5, 5, 5], [0, 1, 2, 3, 4, 5]])
    assert [sorted(r) for r in ann.largest(scores, 3).tolist()] == [[1, 2, 3], [0, 1, 2], [3, 4, 5]]


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = table.where("vec_id % 20 = 0")
    found = ann.recall(ann.search(table, asked), ann.exact_search(table, asked))
    print("recall", found)
    assert found >= 0.9


# chat


def test_template_round_trip():
    t, rng = chat.Template(), random.Random(1)
    parts = ["</s>", "<s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\\", "<", "[", "\n", "ok", "</turn>", "<role>", "é"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "tool<", "", "a</role>b"]), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(5))]
        formatted = "".join(s for role, text in turns for s, _ in t.segments(role, text))
        assert list(t.read(formatted)) == turns
    with pytest.raises(ValueError):
        list(t.read("no turn"))


def test_format_validates_turn_order(spark):
    rows = [(1, 0, "system", "s", 1), (1, 1, "user", "u", 1), (1, 2, "assistant", "a", 1), (2, 0, "assistant", "a", 1), (3, 1, "user", None, 1), (3, 0, "user", "x", 1), (4, 0, None, "n", 1), (None, 0, "user", "q", 1), (5, 0, "user", "d", 1), (5, 0, "user", "d", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state long")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: False}
    assert (found[1].n_turns, found[1].loss_chars, found[3].n_turns, found[5].n_turns) == (3, 1, 2, 2)
    assert found[3].turns_sha256 == hashlib.sha256(b"user\nx\nuser\n\n").hexdigest()
    segments = chat.conversations_of(chat.format_turns(turns.where("conv_id = 1"))).orderBy("turn", "segment").collect()
    assert [(s.text, s.loss) for s in segments if s.turn == 2] == [("<s>", False), ("a", True), ("</s>", False)]
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_a_stored_table_is_put_in_order_again(spark, tmp_path, make_prose):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {c} {t}") for c in (1, 2) for t in range(1500)] + [(3, 0, "user", make_prose(1, 30_000))]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    straight = chat.read_back(formatted, in_order=True).orderBy("conv_id").collect()
    formatted.repartition(4).write.parquet(str(tmp_path / "chat"))
    assert chat.read_back(spark.read.parquet(str(tmp_path / "chat"))).orderBy("conv_id").collect() == straight
    assert [r.n_turns for r in straight] == [1500, 1500, 1]
    assert straight[0].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == 1).encode()).hexdigest()


# shards


def plain_loads(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_schedule_of_sizes_equals_the_plain_heap():
    rng = random.Random(2)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        sizes = [rng.choice([1, 2, 3, 7, 16, 50, rng.randrange(1, 400)]) for _ in range(rng.randrange(0, 120))]
        loads, seen = [0] * shards, Counter()
        for size, low, high, k in shard.schedule(Counter(sizes), shards):
            assert low == seen[size] < high
            seen[size] = high
            loads[k] += size * (high - low)
        assert seen == Counter(sizes) and loads == plain_loads(sizes, shards)


def test_shards_are_balanced_gapless_and_whole(spark, make_prose, monkeypatch):
    monkeypatch.setattr(shard, "CELL_ROWS", 10)
    docs = [(i, make_prose(i, 5 + i % 60), i) for i in range(600)] + [(1000 + i, "hot copy of one text", 0) for i in range(300)] + [(2000, None, 0), (2001, ""), (2001, "")][:1] + [(2001, "", 0), (2001, "", 0)]
    found = shard.shard_documents(spark.createDataFrame(docs, "doc_id long, text string, shard long"), 8).toPandas()
    assert len(found) == len(docs)
    for _, rows in found.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert (found.groupby("group").shard.nunique() == 1).all()
    loads = found.groupby("shard")["size"].sum()
    assert list(loads.reindex(range(8), fill_value=0)) == plain_loads(found.groupby("group")["size"].sum().tolist(), 8)
    sizes = found.set_index("doc_id")["size"]
    assert sizes[2000] == 16 and (found[found.doc_id == 2001].text_crc32 == 0).all()


def test_no_documents_no_shards(no_docs):
    assert shard.shard_documents(no_docs, 4).count() == 0


# archives


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def package(zip64, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a/data"), "w", force_zip64=zip64) as member:
            member.write(b"hello stored bytes")
        z.writestr("index", b"0 18")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


def with_zip64_end(data):
    """The same package with a ZIP64 end record and locator, the plain fields overflowed."""
    at = data.rfind(warc.EOCD)
    count, length, start = struct.unpack_from("<HII", data, at + 10)
    end64 = warc.EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, at, 1)
    end = warc.EOCD + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return data[:at] + end64 + locator + end


def with_wide_entry(data):
    """The first central entry's sizes and offset moved into a ZIP64 extra field."""
    at = data.rfind(warc.EOCD)
    count, length, start = struct.unpack_from("<HII", data, at + 10)
    entry = data[start:]
    n_name, n_extra = struct.unpack_from("<HH", entry, 28)
    packed, plain = struct.unpack_from("<II", entry, 20)
    offset = struct.unpack_from("<I", entry, 42)[0]
    extra = struct.pack("<HHQQQ", 1, 24, plain, packed, offset)
    head = bytearray(entry[: 46 + n_name])
    struct.pack_into("<IIHH", head, 20, 0xFFFFFFFF, 0xFFFFFFFF, n_name, len(extra))
    struct.pack_into("<I", head, 42, 0xFFFFFFFF)
    directory = bytes(head) + extra + entry[46 + n_name + n_extra : length]
    return data[:start] + directory + warc.EOCD + struct.pack("<HHHHIIH", 0, 0, count, count, len(directory), start, 0)


@pytest.mark.parametrize("data", [package(False), package(True), package(True, b"PK\x05\x06 a comment"), with_zip64_end(package(True)), with_wide_entry(package(False))])
def test_directories_and_ranges(data):
    source = Bytes(data)
    entries = warc.locate(source, len(data))
    at, n = warc.stored_range(source, entries["a/data"])
    assert data[at : at + n] == b"hello stored bytes" and set(entries) == {"a/data", "index", "packed"}
    with pytest.raises(warc.ArchiveError):
        warc.stored_range(source, entries["packed"])


def test_broken_packages():
    data = package(False)
    for broken in (b"", data[:-30], data.replace(warc.CENTRAL, b"PK__")):
        with pytest.raises(warc.ArchiveError):
            warc.locate(Bytes(broken), len(broken))


def test_pages_round_trip(spark, make_prose, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 3000)
    long = make_prose(1, 300)
    rows = [(1, "http://a/\r\nx", long, 1), (2, None, long, 1), (3, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u", "é" * 999 + "\r\n\r\nWARC/1.1", 1), (9, "u", long, 1), (9, "u", long, 1)]
    rows += [(100 + i, "v", make_prose(50 + i, 200 + i), 1) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    found = warc.round_trip(pages, with_payload=True).collect()
    assert sorted(r.page_id for r in found) == sorted(r[0] for r in rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in found:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        revisit = r.page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload == (None if revisit else html[r.page_id])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_are_read_by_tasks_that_follow_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", (64 << 20, 1 << 10))
    big = "".join(random.Random(3).choice("abcdefgh<>") for _ in range(3 << 20))
    rows = [(i, "u", f"{i} {hashlib.sha512(str(i).encode()).hexdigest() * 40}", "x") for i in range(200)] + [(500, None, big, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(2)
    found = warc.round_trip(pages)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in found.collect()} == {(i, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h, _ in rows}


def test_a_changed_payload_is_noticed():
    record = warc.warc_record(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None, False)
    assert warc.parse_record(record).payload == b"body"
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(record.replace(b"body", b"bodx"))
