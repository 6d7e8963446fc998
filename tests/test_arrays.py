import json
import threading
import time
import urllib.parse
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from chunkwright.errors import ArrayError, CodecError, MetadataError, MissingChunkError, SliceError, StoreError, UnsupportedOperationError
from chunkwright.operators import array as arrays
from chunkwright.operators import session, spatial
from chunkwright.plans import fixtures
from chunkwright.sources import source
from chunkwright.sources.caches import ABSENT, Cache, DiskCache, InMemoryCache, MemoryCache, RedisCache
from chunkwright.sources.hooks import Hooks
from chunkwright.sources.reader import ReadOptions
from chunkwright.sources.stores import CachedStore, FileSystemStore, HttpStore, MemoryStore, ReferenceStore, S3Store, Store, derive_store_id, open_store


def encoded(values, chunks, dtype, path="", order="C", compressor=None, fill_value=0, separator=".", skip=(), padding=0x7F, attrs=None):
    """Keys of an array, built in this process, as other writers lay it out."""
    values = np.asarray(values)
    out = {f"{path}/.zarray".lstrip("/"): json.dumps(fixtures.array_document(values.shape, chunks, dtype, order, compressor, fill_value, separator)).encode()}
    if attrs is not None:
        out[f"{path}/.zattrs".lstrip("/")] = json.dumps(attrs).encode()
    grid = [-(-n // c) for n, c in zip(values.shape, chunks, strict=True)]
    for at in np.ndindex(*grid):
        if at in skip:
            continue
        chunk = np.full(int(np.prod(chunks)) * np.dtype(dtype).itemsize, padding, np.uint8).view(dtype).reshape(chunks).copy()
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        chunk[tuple(slice(0, n) for n in part.shape)] = part
        key = separator.join(map(str, at)) or "0"
        out[f"{path}/{key}".lstrip("/")] = fixtures.compress(chunk.tobytes(order=order), compressor, np.dtype(dtype).itemsize)
    return out


class RangedStore(MemoryStore):
    """Counts what is asked for; for reads in this process."""

    def __init__(self, data):
        super().__init__(data)
        self.asked = []

    def get(self, key):
        self.asked.append((key, None))
        return super().get(key)

    def get_range(self, key, offset, length):
        self.asked.append((key, (offset, length)))
        return None if key not in self.data else self.data[key][offset : offset + length]


def rows(df, n):
    return {tuple(r[:n]): r[n] for r in df.collect()}


def as_dict(values, start=()):
    start = start or (0,) * values.ndim
    return {tuple(int(i + s) for i, s in zip(at, start, strict=True)): values[at] for at in np.ndindex(*values.shape)}


PADDED = np.add.outer(np.arange(4) * 10, np.arange(10))


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("compressor", [None, {"id": "zlib"}, {"id": "blosc", "cname": "zstd"}])
def test_spark_and_local_reads_agree_with_numpy(spark, order, compressor):
    values = np.arange(7 * 11, dtype="<i4").reshape(7, 11)
    a = arrays.open_array(spark, MemoryStore(encoded(values, [3, 4], "<i4", order=order, compressor=compressor)))
    for selection in (None, [[1, 6], [2, 9]], [3, None], [None, 10], [[0, 0], None], [[6, 7], [3, 4]]):
        box = arrays.indexing.normalize(selection, a.shape)
        want = values[tuple(slice(*b) for b in box)]
        assert (a.to_numpy(selection) == want).all()
        assert rows(a.get(selection), 2) == as_dict(want, tuple(b[0] for b in box))


def test_padding_never_leaks_and_ranges_are_read(spark):
    store = RangedStore(encoded(PADDED, [4, 8], "<i4"))
    a = arrays.open_array(spark, store)
    store.asked.clear()
    assert a.to_numpy([None, [8, 10]]).ravel().tolist() == [8, 9, 18, 19, 28, 29, 38, 39]
    assert store.asked == [("0.1", None)]
    store.asked.clear()
    assert (a.to_numpy([[1, 3], None], ReadOptions(concurrency=1)) == PADDED[1:3]).all()
    assert sorted(store.asked, key=str) == [("0.0", (32, 64)), ("0.1", None)]
    assert (a.to_numpy([[1, 3], None], ReadOptions(byte_range=False)) == PADDED[1:3]).all()
    assert a.to_numpy([[3, 6], [9, 12]]).tolist() == [[39, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert a.to_numpy([[-1, 1], [0, 1]]).ravel().tolist() == [0, 0]
    with pytest.raises(SliceError):
        a.get([None])
    with pytest.raises(Exception, match="leaves the shape"):
        a.get([[0, 9], None], bounds="error").collect()


@pytest.mark.parametrize(("fill", "want"), [(-9999, -9999.0), (7, 7.0), (0, 0.0), (None, 0.0), ("NaN", None)])
def test_missing_chunks(spark, fill, want):
    seen = []
    a = arrays.open_array(spark, MemoryStore(encoded(np.array([1, 2, 3, 4], "<f4"), [2], "<f4", fill_value=fill, skip={(1,)})))
    got = a.to_numpy(options=ReadOptions(hooks=Hooks(missing_chunk=seen.append)))
    assert got[:2].tolist() == [1, 2] and (np.isnan(got[2:]).all() if want is None else got[2:].tolist() == [want] * 2)
    assert seen == [{"key": "1"}]
    spark_rows = rows(a.get([[1, 4]]), 1)
    assert spark_rows[(1,)] == 2 and (spark_rows[(3,)] != spark_rows[(3,)] if want is None else spark_rows[(3,)] == want)
    with pytest.raises(MissingChunkError):
        a.to_numpy(options=ReadOptions(strict=True))
    with pytest.raises(Exception, match="missing chunk: 1"):
        a.get(strict=True).collect()


def test_scalars_and_big_integers(spark):
    zero = arrays.open_array(spark, MemoryStore(encoded(np.array(5, "<i8"), [], "<i8")))
    assert [r.value for r in zero.get().collect()] == [5] and zero.to_numpy() == 5
    big = arrays.open_array(spark, MemoryStore(encoded(np.array([2**64 - 1, 3], "<u8"), [2], "<u8")))
    assert [int(r.value) for r in big.get().orderBy("i0").collect()] == [2**64 - 1, 3]
    swapped = arrays.open_array(spark, MemoryStore(encoded(np.array([0, 3600, -7200], ">i8"), [3], ">i8")))
    assert [r.value for r in swapped.get().orderBy("i0").collect()] == [0, 3600, -7200]
    empty = arrays.open_array(spark, MemoryStore(encoded(np.zeros((0, 3), "<f4"), [2, 2], "<f4")))
    assert empty.get().count() == 0 and empty.to_numpy().shape == (0, 3)


def test_filters_on_index_columns_prune_chunks(spark, tmp_path):
    for key, data in encoded(np.arange(1000, dtype="<f8"), [10], "<f8").items():
        (tmp_path / key).write_bytes(data)
    a = arrays.open_array(spark, str(tmp_path))
    fetched = a.events([[95, 123]]).orderBy("key").collect()
    assert [r.key for r in fetched] == ["10", "11", "12", "9"]
    plan = a.get().where("i0 >= 500 and i0 < 520")
    for n in range(100):
        if n not in (50, 51):
            (tmp_path / str(n)).write_bytes(b"broken")  # reading any other chunk would fail
    assert sorted(r.i0 for r in plan.collect()) == list(range(500, 520))
    assert [r.value for r in a.get().where("i0 in (503, 511)").orderBy("i0").collect()] == [503, 511]
    (tmp_path / "70").write_bytes(np.arange(700, 710, dtype="<f8").tobytes())
    assert [r.value for r in a.get().where("i0 in (503, 705, 5000)").orderBy("i0").collect()] == [503, 705]
    assert a.get().where("i0 = 505 and value > 600").count() == 0
    with pytest.raises(Exception, match="6 bytes where 8"):
        a.get([600]).collect()


def test_partitions_are_packed_by_bytes(spark):
    handle = arrays.open_handle(MemoryStore(encoded(np.zeros((64, 64), "<f4"), [2, 2], "<f4")), "")
    options = {"selection": json.dumps([None, [0, 32]])}
    few = source.ChunkedReader({"value": handle}, options).partitions()
    many = source.ChunkedReader({"value": handle}, {**options, "max_partition_bytes": "800"}).partitions()
    assert len(few) == 1 and (few[0].first, few[0].last) == (0, 512)
    assert len(many) > 40 and [p.first for p in many[1:]] == [p.last for p in many[:-1]]
    assert len(source.ChunkedReader({"value": handle}, {**options, "min_partitions": "6"}).partitions()) == 6


def hierarchy():
    data = {".zgroup": b'{"zarr_format": 2}', ".zattrs": b'{"description": "nested"}', "level1/.zgroup": b'{"zarr_format": 2}', "level1/.zattrs": b'{"depth": 1}', "level1/level2/.zgroup": b'{"zarr_format": 2}'}
    data |= encoded(np.array([1, 2, 3], "<f4"), [3], "<f4", "level1/array_a") | encoded(np.array([10, 20, 30, 40], "<i4"), [4], "<i4", "level1/level2/array_b")
    return data


@pytest.mark.parametrize("consolidated", [False, True])
def test_groups(spark, consolidated):
    data = hierarchy()
    if consolidated:
        documents = {k: json.loads(v) for k, v in data.items() if k.rpartition("/")[2].startswith(".z")}
        data[".zmetadata"] = json.dumps({"metadata": documents}).encode()
    g = arrays.open_group(spark, MemoryStore(data))
    assert g.attrs == {"description": "nested"} and g.children() == ["level1"] and [n for n, _ in g.groups()] == ["level1"]
    one = g.get_group("level1")
    assert one.attrs == {"depth": 1} and [n for n, _ in one.arrays()] == ["array_a"] and one.contains("level2/array_b") and not one.contains("x")
    assert rows(g.get_array("level1/level2/array_b").get(), 1) == {(i,): v for i, v in enumerate([10, 20, 30, 40])}
    assert {(r.path, r.kind) for r in g.catalog().collect()} == {("", "group"), ("level1", "group"), ("level1/array_a", "array"), ("level1/level2", "group"), ("level1/level2/array_b", "array")}
    assert isinstance(arrays.open(spark, MemoryStore(data), "/level1/"), arrays.Group) and isinstance(arrays.open(spark, MemoryStore(data), "level1/array_a"), arrays.Array)
    for bad in (lambda: g.get_array("no"), lambda: g.get_group("no"), lambda: arrays.open(spark, MemoryStore(data), "no"), lambda: arrays.open_group(spark, MemoryStore({}))):
        with pytest.raises(MetadataError):
            bad()


def test_read_multiple(spark):
    data = {".zgroup": b'{"zarr_format": 2}'}
    data |= encoded(np.array([1, 2], "<i4"), [1], "<i4", "a") | encoded(np.array([3, 4], "<i4"), [1], "<i4", "b", skip={(1,)}) | encoded(np.array([5, 6], "<i4"), [2], "<i4", "c")
    g = arrays.open_group(spark, MemoryStore(data))
    found = g.to_numpy(["a", "nothing", "b", "a"])
    assert list(found) == ["a", "b"] and found["b"].tolist() == [3, 0]
    with pytest.raises(MissingChunkError, match="b/1"):
        g.to_numpy(["a", "b"], options=ReadOptions(strict=True))
    assert (g.to_numpy(["a", "c"], options=ReadOptions(max_in_flight_bytes=1))["c"] == [5, 6]).all()
    wide = g.read_wide(["c", "a", "nothing"]).orderBy("i0").collect()
    assert [tuple(r) for r in wide] == [(0, 5, 1), (1, 6, 2)] and g.read_wide(["a"]).columns == ["i0", "a"]


def test_shared_metadata_cache(spark):
    class Broken(Cache):
        def get(self, key):
            raise RuntimeError

        def set(self, key, value, ttl_ms=None):
            raise RuntimeError

    data, seen = hierarchy(), []
    store, cache = RangedStore(data), InMemoryCache(1 << 20)
    options = arrays.OpenOptions(cache, "mine", Hooks(cache_hit=seen.append))
    arrays.open_group(spark, store, "", options).get_array("level1/array_a")
    store.asked.clear()
    arrays.open_group(spark, store, "", options).get_array("level1/array_a")
    assert store.asked == [] and {e["tier"] for e in seen} == {"shared"} and cache.get("mine:.zmetadata") == ABSENT
    with pytest.raises(StoreError):
        arrays.open(spark, store, "", arrays.OpenOptions(cache))
    assert arrays.open(spark, store, "level1", arrays.OpenOptions(Broken(), "x")).attrs == {"depth": 1}


def test_caches(tmp_path):
    lru = MemoryCache(10)
    for k in "abc":
        lru.set(k, b"1234")
    assert lru.get("a") is None and lru.get("b") and lru.total_bytes == 8
    lru.set("big", b"x" * 50)
    assert len(lru) == 1 and lru.get("big")
    lru.delete("big")
    lru.set("empty", b"")
    assert lru.total_bytes == len("empty") + 16
    with pytest.raises(ValueError):
        MemoryCache(0)
    timed = InMemoryCache(100)
    timed.set("k", b"v", ttl_ms=-1)
    timed.set("l", b"v", ttl_ms=60_000)
    assert timed.get("k") is None and timed.has("l")

    disk = DiskCache(str(tmp_path), "s3://b/p", None, 10)
    for k in ("x/0", "x/1", "x/2"):
        disk.set(k, b"1234")
    assert disk.get("x/0") is None and disk.get("x/2") == b"1234" and DiskCache(str(tmp_path), "other").get("x/2") is None
    assert DiskCache(str(tmp_path), "s3://b/p", 0).get("x/2") is None
    disk.clear()
    assert disk.get("x/2") is None

    class Client:
        def __init__(self):
            self.kept, self.expiry = {}, None

        def get(self, k):
            return self.kept.get(k)

        def set(self, k, v, px=None):
            self.kept[k], self.expiry = v, px

        def exists(self, k):
            return int(k in self.kept)

    shared = RedisCache(client := Client())
    shared.set("a", b"\x00\xff", 1500)
    assert shared.get("a") == b"\x00\xff" and client.expiry == 1500 and shared.has("a") and shared.get("b") is None


def test_cached_store(tmp_path, spark):
    inner, seen = RangedStore(encoded(np.arange(6, dtype="<i4"), [2], "<i4")), []
    with pytest.warns(UserWarning, match="max_bytes"):
        CachedStore(inner, str(tmp_path / "w"))
    store = CachedStore(inner, str(tmp_path / "c"), store_id="one", max_bytes=1e6, hooks=Hooks(cache_hit=seen.append))
    a = arrays.open_array(spark, store)
    assert a.to_numpy(options=ReadOptions(byte_range=False)).tolist() == list(range(6))
    inner.asked.clear()
    assert a.to_numpy().tolist() == list(range(6)) and inner.asked == [] and {e["tier"] for e in seen} == {"disk"}
    store.get(".zarray")
    assert inner.asked == [(".zarray", None)]
    assert rows(a.get(), 1) == {(i,): i for i in range(6)}
    expired = CachedStore(inner, str(tmp_path / "c"), store_id="one", ttl=0, max_bytes=1e6)
    inner.asked.clear()
    expired.get("0")
    assert inner.asked == [("0", None)]


def test_memory_cache_keeps_decoded_chunks(spark):
    store = RangedStore(encoded(np.arange(8, dtype="<i4"), [4], "<i4", compressor={"id": "zlib"}))
    a, cache, decoded = arrays.open_array(spark, store), MemoryCache(1000), []
    options = ReadOptions(memory_cache=cache, hooks=Hooks(chunk_decoded=decoded.append))
    store.asked.clear()
    assert a.to_numpy(options=options).tolist() == a.to_numpy(options=options).tolist() == list(range(8))
    assert len(store.asked) == len(decoded) == 2 and decoded[0]["codec"] == "zlib" and len(cache) == 2


def test_file_store_contract(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "k").write_bytes(b"0123456789")
    seen = []
    s = FileSystemStore(f"file://{tmp_path}", Hooks(store_fetch=seen.append))
    assert s.get("d/k") == b"0123456789" and s.get("no") is None and s.get("d/k/no") is None and s.has("d/k") and not s.has("x")
    assert s.get_range("d/k", 2, 3) == b"234" and s.get_range("no", 0, 1) is None and list(s.list("")) == ["d"] and list(s.list("zz")) == []
    with pytest.raises(StoreError):
        s.get_range("d/k", 8, 5)
    assert s.head("d/k").size == 10 and s.head("no") is None and seen[0]["bytes"] == 10 and list(s.list("d")) == ["d/k"]


def test_store_names():
    class Bucket:
        bucket, prefix, endpoint = "b", "p/q", None

    class Outer:
        inner = Bucket()

    Bucket.endpoint = "http://minio"
    assert derive_store_id(Outer()) == "s3://b/p/q?endpoint=http://minio" and derive_store_id(HttpStore("http://h/x/")) == "http://h/x"
    assert derive_store_id(MemoryStore({})) is None and derive_store_id(open_store("s3://b/p")) == "s3://b/p"
    looped = Outer()
    looped.inner = looped
    assert derive_store_id(looped) is None


class Handler(BaseHTTPRequestHandler):
    data, fails, log, whole, ports = {}, [], [], False, []
    protocol_version = "HTTP/1.1"

    def empty(self, status, **fields):
        self.send_response(status)
        self.send_header("Content-Length", "0")
        for k, v in fields.items():
            self.send_header(k, v)
        self.end_headers()

    def do_GET(self):
        self.log.append((self.command, self.path, self.headers.get("Range"), self.headers.get("X-Key")))
        self.ports.append(self.client_address[1])
        if self.fails:
            return self.empty(self.fails.pop())
        body = self.data.get(self.path.lstrip("/"))
        if body is None:
            return self.empty(404)
        if isinstance(body, str):
            return self.empty(302, Location=f"/{body}")
        wanted = self.headers.get("Range")
        if wanted and not self.whole:
            a, b = map(int, wanted.removeprefix("bytes=").split("-"))
            body = body[a : b + 1]
        self.send_response(206 if wanted and not self.whole else 200)
        self.send_header("Content-Length", str(len(body)))
        self.send_header("ETag", '"v1"')
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body)

    do_HEAD = do_GET

    def log_message(self, *args):
        return


@pytest.fixture
def server():
    Handler.data, Handler.fails, Handler.log, Handler.whole = {}, [], [], False
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", Handler
    http.shutdown()


def test_http_store(server, spark):
    url, handler = server
    handler.data.update(encoded(PADDED, [4, 8], "<i4"))
    retries = []
    s = HttpStore(url, headers={"X-Key": "k"}, hooks=Hooks(retry=retries.append), base_delay_ms=1)
    handler.fails += [500, 503]
    assert s.get("0.0") == handler.data["0.0"] and len(retries) == 2 and handler.log[-1][3] == "k"
    assert s.get("no") is None and not s.has("no") and s.has("0.0") and s.head("0.0").etag == '"v1"'
    assert s.get_range("0.0", 4, 8) == handler.data["0.0"][4:12]
    handler.whole = True
    assert s.get_range("0.0", 4, 8) == handler.data["0.0"][4:12]
    with pytest.raises(StoreError):
        s.get_range("0.0", 120, 50)
    handler.whole = False
    with pytest.raises(UnsupportedOperationError):
        s.list("")
    handler.fails += [503] * 4
    with pytest.raises(StoreError, match="4 attempt"):
        s.get("0.0")
    handler.fails += [403]
    with pytest.raises(StoreError):
        s.get("0.0")
    handler.fails.clear()
    a = arrays.open_array(spark, HttpStore(url))
    assert rows(a.get([[1, 3], None]), 2) == as_dict(PADDED[1:3], (1, 0))
    assert ("GET", "/0.0", "bytes=32-95", None) in handler.log


def test_http_connections_stay_open_and_are_bounded(server):
    url, handler = server
    handler.data["k"] = b"x" * 10
    ports = handler.ports
    ports.clear()
    s = HttpStore(url, max_connections=1)
    assert [s.get("k") for _ in range(5)] == [b"x" * 10] * 5 and len(set(ports)) == 1
    ports.clear()
    s = HttpStore(url, keep_alive=False)
    assert [s.get("k") for _ in range(3)] == [b"x" * 10] * 3 and len(set(ports)) == 3
    handler.data["moved"] = "k"
    assert s.get("moved") == b"x" * 10


class Slow(MemoryStore):
    """Every chunk takes a while, as from far away."""

    def get(self, key):
        if key[-1].isdigit():
            time.sleep(0.05)
        return super().get(key)


def test_a_task_fetches_ahead(spark):
    values = np.arange(200, dtype="<i4")
    a = arrays.open_array(spark, Slow(encoded(values, [2], "<i4", compressor={"id": "zlib"})))
    want = {(i,): i for i in range(200)}
    assert rows(a.get([[0, 2]]), 1)  # the worker is up
    took = {}
    for n in (1, 50):
        began = time.perf_counter()
        assert rows(a.get(min_partitions=1, max_partition_bytes=1 << 30, concurrency=n), 1) == want
        took[n] = time.perf_counter() - began
    assert took[1] > 5 and took[50] < took[1] / 8
    began = time.perf_counter()  # the budget holds two chunks at a time
    assert rows(a.get(min_partitions=1, max_partition_bytes=1 << 30, max_in_flight_bytes=2 * 16), 1) == want
    assert time.perf_counter() - began > 2.4


def test_an_error_ahead_stops_the_read(spark):
    data = encoded(np.arange(40, dtype="<i4"), [2], "<i4")
    data["7"] = b"short"
    with pytest.raises(Exception, match="bytes for a chunk"):
        arrays.open_array(spark, Slow(data)).get(min_partitions=1, byte_range="off").collect()


def test_unnamed_stores_share_no_cached_chunks(spark):
    """Workers live on between reads, and what they keep of one store must not serve another."""
    for k in range(12):
        values = np.arange(6, dtype="<i4") + 1000 * k
        a = arrays.open_array(spark, MemoryStore(encoded(values, [3], "<i4", compressor={"id": "zlib"})))
        for _ in range(2):
            assert rows(a.get(memory_cache_bytes=1 << 20, min_partitions=1), 1) == {(i,): int(v) for i, v in enumerate(values)}


def test_an_overwritten_store_is_read_afresh(spark, tmp_path):
    for k in range(3):
        values = np.arange(6, dtype="<i4") + 1000 * k
        for key, data in encoded(values, [3], "<i4", compressor={"id": "zlib"}).items():
            (tmp_path / key).write_bytes(data)
        a = arrays.open_array(spark, str(tmp_path))
        assert rows(a.get(memory_cache_bytes=1 << 20, min_partitions=1), 1) == {(i,): int(v) for i, v in enumerate(values)}


def test_hooks_and_warnings_reach_spark_reads(spark, tmp_path):
    log = str(tmp_path / "log")

    def note(event):
        with open(log, "a") as out:
            out.write(f"{json.dumps(event)}\n")

    store = MemoryStore(encoded(np.arange(8, dtype="<i4"), [4], "<i4", compressor={"id": "zlib"}) | {"g/.zgroup": b'{"zarr_format": 2}'})
    a = arrays.open_array(spark, store)
    assert len(a.get(hooks=Hooks(chunk_decoded=note, in_flight=note)).collect()) == 8
    seen = [json.loads(line) for line in open(log)]
    assert sum(isinstance(e, dict) and e["codec"] == "zlib" for e in seen) == 2 and any(isinstance(e, (int, float)) and e > 0 for e in seen)
    with pytest.warns(UserWarning, match="32 bytes"):
        a.get(large_read_warning_bytes=20)


class S3Handler(Handler):
    """As much of the protocol as reading takes: objects with ranges, and one page of a listing."""

    def do_GET(self):
        path, _, query = self.path.partition("?")
        if "list-type" in query or (self.command == "GET" and path.strip("/") == "bucket"):
            prefix = urllib.parse.unquote(dict(p.partition("=")[::2] for p in query.split("&")).get("prefix", ""))
            keys = sorted(k for k in self.data if k.startswith(prefix))
            items = "".join(f"<Contents><Key>{k}</Key><Size>{len(self.data[k])}</Size><LastModified>2024-01-01T00:00:00.000Z</LastModified></Contents>" for k in keys)
            body = f'<?xml version="1.0"?><ListBucketResult><Name>bucket</Name><KeyCount>{len(keys)}</KeyCount><IsTruncated>false</IsTruncated>{items}</ListBucketResult>'.encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            return
        body = self.data.get(path.removeprefix("/bucket/"))
        self.log.append((self.command, path, self.headers.get("Range")))
        if body is None:
            self.send_response(404)
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        wanted = self.headers.get("Range")
        a, b = map(int, wanted.removeprefix("bytes=").split("-")) if wanted else (0, len(body) - 1)
        self.send_response(206 if wanted else 200)
        part = body[a : b + 1]
        self.send_header("Content-Length", str(len(part)))
        if wanted:
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(body)}")
        self.send_header("Last-Modified", "Mon, 01 Jan 2024 00:00:00 GMT")
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(part)

    do_HEAD = do_GET


def test_s3_store(spark):
    S3Handler.data, S3Handler.log = {f"run/{k}": v for k, v in encoded(PADDED, [4, 8], "<i4").items()}, []
    http = ThreadingHTTPServer(("127.0.0.1", 0), S3Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        s = S3Store("bucket", "run", region="us-east-1", endpoint=f"http://127.0.0.1:{http.server_port}", anonymous=True, warm_on_create=True, max_connections=16)
        assert s.get("0.0") == S3Handler.data["run/0.0"] and s.get("no") is None and s.has("0.0") and not s.has("no")
        assert s.get_range("0.0", 4, 8) == S3Handler.data["run/0.0"][4:12] and s.head("0.0").size == len(S3Handler.data["run/0.0"]) and s.head("no") is None
        assert set(s.list("")) == {k.removeprefix("run/") for k in S3Handler.data}
        s.prewarm()
        a = arrays.open_array(spark, s)
        assert rows(a.get([[1, 3], None]), 2) == as_dict(PADDED[1:3], (1, 0))
        assert any(method == "GET" and wanted == "bytes=32-95" for method, _, wanted in S3Handler.log)
        assert derive_store_id(s) == f"s3://bucket/run?endpoint=http://127.0.0.1:{http.server_port}"
    finally:
        http.shutdown()


def test_reference_store(tmp_path, spark, server):
    (tmp_path / "data").write_bytes(np.arange(10, dtype="<f4").tobytes())
    document = json.dumps(fixtures.array_document([15], [5], "<f4"))
    url, handler = server
    handler.data["dir/far"] = np.arange(100, 105, dtype="<f4").tobytes()
    spec = {"version": 1, "refs": {"v/.zarray": document, "v/0": [str(tmp_path / "data"), 0, 20], "v/1": [f"file://{tmp_path}/data", 20, 20], "v/2": [f"{url}/dir/far"], "x": "base64:aGk="}}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    s = ReferenceStore.from_file(str(tmp_path / "spec.json"))
    assert len(s) == 5 and sorted(s.list("v/")) == ["v/.zarray", "v/0", "v/1", "v/2"] and s.has("v/0") and not s.has("v/9") and s.get("x") == b"base64:aGk="
    assert ReferenceStore(spec, decode_base64=True).get("x") == b"hi" and not s.ranged
    a = arrays.open_array(spark, f"reference+{tmp_path}/spec.json", "v")
    assert [r.value for r in a.get().orderBy("i0").collect()] == [*map(float, range(10)), *map(float, range(100, 105))]


class Doubling(Store):
    """A user's own store: computes its chunks."""

    def get(self, key):
        if key == ".zarray":
            return json.dumps(fixtures.array_document([6], [2], "<i4")).encode()
        return np.array([int(key) * 2, int(key) * 2 + 1], "<i4").tobytes() if key.isdigit() else None

    def has(self, key):
        return self.get(key) is not None

    def list(self, prefix):
        return iter([".zarray", "0", "1", "2"])


def test_custom_store_and_codec(spark):
    assert [r.value for r in arrays.open_array(spark, Doubling()).get().orderBy("i0").collect()] == list(range(6))
    bad = arrays.open_array(spark, MemoryStore(encoded(np.arange(3, dtype="<i4"), [3], "<i4") | {"0": zlib.compress(b"x")}))
    with pytest.raises(CodecError):
        bad.to_numpy()
    unknown = encoded(np.arange(3, dtype="<i4"), [3], "<i4")
    unknown[".zarray"] = unknown[".zarray"].replace(b'"compressor": null', b'"compressor": {"id": "mystery"}')
    with pytest.raises(CodecError, match="mystery"):
        arrays.open_array(spark, MemoryStore(unknown)).to_numpy()


# grids


def grid_group(spark, ny=3, nx=4, dtype="<f4", attrs=None):
    lat, lon = np.add.outer(10 + np.arange(ny), np.zeros(nx)), np.add.outer(np.zeros(ny), 20 + np.arange(nx))
    data = {".zgroup": b'{"zarr_format": 2}', ".zattrs": json.dumps(attrs or {}).encode()}
    data |= encoded(lat.astype(dtype), [2, 2], dtype, "lat") | encoded(lon.astype(dtype), [2, 2], dtype, "lon")
    return arrays.open_group(spark, MemoryStore(data))


def brute_nearest(grid, lat, lon):
    y, x = grid.lat.astype(float) - lat, (grid.lon.astype(float) - lon) * np.cos(lat * np.pi / 180)
    d = np.where(np.isnan(y) | np.isnan(x), np.inf, y * y + x * x)
    cell = int(d.argmin())
    return (0, 0, np.inf) if not np.isfinite(d[cell]) else (cell // grid.nx, cell % grid.nx, np.sqrt(d[cell]) * 111.195)


def test_nearest_cells(spark):
    grid = spatial.GridIndex.from_group(grid_group(spark))
    for point, cell in (((10, 20), (0, 0)), ((12, 23), (2, 3)), ((11.4, 22.6), (1, 3)), ((10.4, 20.4), (0, 0)), ((10.5, 20), (0, 0))):
        found = grid.nearest(*point)
        assert (found.i, found.j) == cell
    assert grid.nearest(10, 20).distance_km < 1e-9
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-60, 60, 2000), rng.uniform(-170, 170, 2000)
    lat[::17], lon[::31] = np.nan, np.nan
    lat[5:9], lon[5:9] = 1.5, 2.5
    wild = spatial.GridIndex.from_coordinates(lat, lon, 40, 50)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-80, 80, 60), rng.uniform(-180, 180, 60), strict=True)] + [(1.5, 2.5)]
    for p in points:
        found, want = wild.nearest(*p), brute_nearest(wild, *p)
        assert (found.i, found.j) == want[:2] and found.distance_km == pytest.approx(want[2])
    table = spark.createDataFrame([(n, *p) for n, p in enumerate(points)], "id long, lat double, lon double")
    for result in (wild.nearest_many(table), spatial.nearest_join(table, wild.to_df(spark))):
        assert {r.id: (r.i, r.j) for r in result.collect()} == {n: brute_nearest(wild, *p)[:2] for n, p in enumerate(points)}
    odd = spark.createDataFrame([(0, 89.9999, 7.0), (1, -90.0, 3.0), (2, 500.0, 0.0), (3, None, 1.0), (4, float("nan"), 1.0)], "id long, lat double, lon double")
    joined = {r.id: (r.i, r.j) for r in spatial.nearest_join(odd, wild.to_df(spark)).collect()}
    assert joined == {r.id: (r.i, r.j) for r in wild.nearest_many(odd).collect()} and joined[3] == joined[4] == (0, 0)
    assert [joined[n] for n in range(3)] == [brute_nearest(wild, *p)[:2] for p in ((89.9999, 7.0), (-90.0, 3.0), (500.0, 0.0))]
    nothing = spatial.GridIndex.from_coordinates([float("nan")] * 4, [0.0] * 4, 2, 2).nearest(1, 1)
    assert (nothing.i, nothing.j, nothing.distance_km) == (0, 0, float("inf"))


def test_a_large_curvilinear_grid(spark, monkeypatch):
    ny, nx = 300, 400
    i, j = np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij")
    lat, lon = -35 + i * 0.09 + np.sin(j / 60), -60 + j * 0.09 + np.cos(i / 50)
    grid = spatial.GridIndex.from_coordinates(lat, lon, ny, nx)
    rng = np.random.default_rng(5)
    targets = np.column_stack([rng.uniform(-40, 0, 400), rng.uniform(-65, -15, 400)])
    a, b, km = grid.nearest_of(targets[:, 0], targets[:, 1])
    for p, x, y, d in zip(targets, a, b, km, strict=True):
        want = brute_nearest(grid, *p)
        assert (x, y) == want[:2] and d == pytest.approx(want[2])
    data = {".zgroup": b'{"zarr_format": 2}'} | encoded(lat, [100, 150], "<f4", "lat") | encoded(lon, [100, 150], "<f4", "lon")
    group = arrays.open_group(spark, MemoryStore(data))
    table = spark.createDataFrame([(n, float(p[0]), float(p[1])) for n, p in enumerate(targets[:100])], "id long, lat double, lon double")
    small = spatial.nearest_cells(group, table).orderBy("id").collect()
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", 1000)
    assert [(r.id, r.i, r.j) for r in spatial.nearest_cells(group, table).orderBy("id").collect()] == [(r.id, r.i, r.j) for r in small]
    assert [(r.i, r.j) for r in small] == list(zip(a[:100].tolist(), b[:100].tolist(), strict=True))


def most_rows(spark, done):
    """The most rows that an operator has given in the queries after those done, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions, most = store.executionsList(), 0
    for k in range(executions.size()):
        if (execution := executions.apply(k)).executionId() > done:
            values, metrics = store.executionMetrics(execution.executionId()), execution.metrics()
            rows = [metrics.apply(m) for m in range(metrics.size())]
            found = [values.get(m.accumulatorId()) for m in rows if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in found if v.isDefined())])
    return most


def test_a_join_with_dense_cells_makes_few_rows(spark):
    """Points among cells that lie close, and points far from all of them, don't meet every cell."""
    n, rng = 200, np.random.default_rng(8)
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    grid = spatial.GridIndex.from_coordinates(10 + i * 1e-3, 20 + j * 1e-3, n, n)
    lat, lon = np.append(rng.uniform(10, 10.2, 200), rng.uniform(10.3, 11, 50)), np.append(rng.uniform(20, 20.2, 200), rng.uniform(20.3, 21, 50))
    table = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))], "id long, lat double, lon double")
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = max([-1, *(store.executionsList().apply(k).executionId() for k in range(store.executionsList().size()))])
    found = spatial.nearest_join(table, grid.to_df(spark)).orderBy("id").collect()
    a, b, km = grid.nearest_of(lat, lon)
    assert [(r.i, r.j) for r in found] == list(zip(a.tolist(), b.tolist(), strict=True)) and [r.distance_km for r in found] == pytest.approx(km.tolist())
    assert n * n <= most_rows(spark, done) <= 2 * (n * n + len(lat))


def test_ties_and_equal_places_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK_CELLS", 16)
    rng = np.random.default_rng(9)
    lat, lon = rng.integers(-5, 6, 1500).astype(float), rng.integers(-5, 6, 1500).astype(float)
    lat[:400], lon[:400] = 0.0, 0.0
    lat[7::50] = np.nan
    grid = spatial.GridIndex.from_coordinates(lat, lon, 30, 50)
    points = [(a / 2, b / 2) for a in range(-14, 15, 3) for b in range(-14, 15)] + [(90.0, 3.0), (-90.0, 170.0), (400.0, 1.0), (None, 1.0), (1.0, float("inf"))]
    table = spark.createDataFrame([(n, *p) for n, p in enumerate(points)], "id long, lat double, lon double")
    for some in (table, table.limit(0)):
        joined = spatial.nearest_join(some, grid.to_df(spark))
        want = grid.nearest_many(some)
        assert sorted(map(tuple, joined.select("id", "i", "j").collect())) == sorted(map(tuple, want.select("id", "i", "j").collect())) and joined.dtypes == want.dtypes
    narrow = grid.to_df(spark).selectExpr("cast(i as int) as i", "cast(j as int) as j", "lat", "lon")
    for cells in (narrow, narrow.where("lat > 1000")):
        joined = spatial.nearest_join(table, cells)
        assert joined.count() == len(points) and dict(joined.dtypes)["i"] == dict(joined.dtypes)["j"] == "int"
    assert {(r.i, r.j, r.distance_km) for r in joined.collect()} == {(0, 0, float("inf"))}


def test_grid_snapshots_and_keys(spark):
    grid = spatial.GridIndex.from_group(grid_group(spark))
    data = grid.to_bytes()
    again = spatial.GridIndex.from_bytes(data)
    assert (again.lat == grid.lat).all() and (again.lon == grid.lon).all() and again.to_bytes() == data and len(data) == 12 + 8 * 12
    for bad in (data[:8], b"xxxx" + data[4:], data[:-1]):
        with pytest.raises(ArrayError):
            spatial.GridIndex.from_bytes(bad)
    with pytest.raises(ArrayError):
        spatial.GridIndex.from_coordinates([1, 2], [1, 2], 2, 2)
    with pytest.raises(ArrayError):
        spatial.GridIndex.from_group(grid_group(spark, dtype="<i8"))
    attrs = {"source_model": "WRF", "experiment": "sse002", "grid_id": 1}
    group, cache = grid_group(spark, attrs=attrs), InMemoryCache(10_000)
    key = spatial.grid_cache_key(group, group.get_array("lat"), group.get_array("lon"))
    assert key.startswith("gridindex:WRF-sse002-1-3x4-") and key != spatial.grid_cache_key(group, group.get_array("lat"), group.get_array("lon"), verify=True)
    spatial.GridIndex.load_cached(group, cache)
    assert cache.has(key)
    spatial.GridIndex.load_cached(group, cache, grid_key="my grid/1")
    assert cache.has("gridindex:mygrid1") and spatial._key_part("漢字") == spatial._digest("漢字")
    with pytest.warns(UserWarning):
        spatial.GridIndex.load_cached(grid_group(spark))


def test_point_series_labels_and_points(spark, monkeypatch):
    values = np.arange(2 * 1 * 3 * 4, dtype="<f8").reshape(2, 1, 3, 4)
    data = {".zgroup": b'{"zarr_format": 2}'} | encoded(values, [1, 1, 2, 2], "<f8", "v", attrs={"_ARRAY_DIMENSIONS": ["time", "z", "y", "x"]})
    data |= encoded(np.array([10, 20, 30], "<f4"), [3], "<f4", "y") | encoded(np.array([0, 5, 9, 12], "<f4"), [4], "<f4", "x")
    g = arrays.open_group(spark, MemoryStore(data))
    assert [r.value for r in g.get_array("v").point_series(1, 2).orderBy("i0").collect()] == values[:, 0, 1, 2].tolist()
    found = spatial.select_labels(g, {"y": 21.0, "x": 11.0})
    assert list(found) == ["v"] and [r.value for r in found["v"].orderBy("i0").collect()] == values[:, 0, 1, 3].tolist()
    monkeypatch.setattr(spatial, "LOCAL_LABELS", 2)
    assert [r.value for r in spatial.select_labels(g, {"y": 21.0, "x": 11.0}, ["v"])["v"].orderBy("i0").collect()] == values[:, 0, 1, 3].tolist()
    lat, lon = np.meshgrid([10, 20, 30], [0, 5, 9, 12], indexing="ij")
    data |= encoded(lat, [3, 4], "<f4", "lat", attrs={"_ARRAY_DIMENSIONS": ["y", "x"]}) | encoded(lon, [3, 4], "<f4", "lon", attrs={"_ARRAY_DIMENSIONS": ["y", "x"]})
    found = spatial.select_labels(arrays.open_group(spark, MemoryStore(data)), {"lat": 21.0, "lon": 8.0})
    assert list(found) == ["v"] and [r.value for r in found["v"].orderBy("i0").collect()] == values[:, 0, 1, 2].tolist()
    with pytest.raises(SliceError):
        spatial.select_labels(arrays.open_group(spark, MemoryStore(data)), {"lat": 21.0})
    best = spatial.nearest_1d(g.get_array("y").get(), g.get_array("y").get(), (19.0, 19.0)).first()
    assert best.point == 1


def test_sessions(spark):
    data = {".zgroup": b'{"zarr_format": 2}'} | encoded(np.array([10, 20, 30], "<i4"), [3], "<i4", "lat")
    made, shared = [], InMemoryCache(10_000)

    def make():
        made.append(RangedStore(data))
        return made[-1]

    registry = session.DatasetRegistry(spark, session.RegistryOptions(max_datasets=2, chunk_memory_cache_bytes=1000, coordinate_cache=shared))
    a = registry.open("a", make)
    assert registry.open("a", make) is a and len(made) == 1
    assert a.decoded_array("lat", "domain").tolist() == [10.0, 20.0, 30.0] and a.decoded_array("lat", "domain").dtype == np.float64
    made[0].asked.clear()
    assert a.to_numpy("lat").tolist() == [10, 20, 30] and made[0].asked == [("lat/.zarray", None), ("lat/.zattrs", None)]
    b = registry.open("b", make)
    made[1].asked.clear()
    assert b.decoded_array("lat", "domain").tolist() == [10.0, 20.0, 30.0] and made[1].asked == []
    registry.open("a", make)
    registry.open("c", make)
    assert len(registry) == 2 and registry.open("a", make) is a and registry.open("b", make) is not b
    assert [r.value for r in a.decoded_df("lat").orderBy("i0").collect()] == [10.0, 20.0, 30.0]
    registry.clear()
    assert len(registry) == 0
    with pytest.raises(ValueError):
        session.DatasetRegistry(spark, session.RegistryOptions(max_datasets=0))
