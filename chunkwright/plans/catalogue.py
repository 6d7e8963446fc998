"""The registered queries of the array engine, and SQL that says the same on the tables."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.errors import ArrayError, MissingChunkError
from chunkwright.functions.codecs import codec_registry
from chunkwright.functions.metadata import ARRAY_DOC, ATTRS_DOC, GROUP_DOC, parse_array
from chunkwright.operators import array as arrays
from chunkwright.operators import spatial
from chunkwright.operators.session import DatasetRegistry, RegistryOptions
from chunkwright.plans import fixtures, serving
from chunkwright.runtime import read_table
from chunkwright.sources import source
from chunkwright.sources.caches import InMemoryCache, MemoryCache
from chunkwright.sources.hooks import Hooks
from chunkwright.sources.reader import ReadOptions, peak_bytes
from chunkwright.sources.stores import CachedStore, HttpStore, ReferenceStore, Store, derive_store_id, open_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


# arrays out of tables


def _cells_1d(spark: SparkSession, sf_dir: str, table: str, key: str, value: str) -> DataFrame:
    return read_table(spark, sf_dir, table).select(F.col(key).cast("long").alias("i0"), F.expr(value).alias("value"))


def _store_1d(spark: SparkSession, sf_dir: str, name: str, table: str, key: str, value: str, dtype: str, **options: object) -> str:
    def build(folder: str) -> None:
        cells = _cells_1d(spark, sf_dir, table, key, value)
        fixtures.encode_array(cells, folder, "", [cells.count()], [options.pop("chunk", 1000)], dtype, **options)

    return fixtures.once(spark, sf_dir, name, build)


def _array_1d(spark: SparkSession, sf_dir: str, name: str = "prices", table: str = "orders", key: str = "o_orderkey", value: str = "o_totalprice", dtype: str = "<f8", **options: object) -> arrays.Array:
    return arrays.open_array(spark, _store_1d(spark, sf_dir, name, table, key, value, dtype, **options))


def _embeddings(spark: SparkSession, sf_dir: str, name: str = "embeddings", **options: object) -> arrays.Array:
    """[n, 64] 32-bit floats in chunks of [100, 24]: both dimensions end in a partial chunk."""

    def build(folder: str) -> None:
        table = read_table(spark, sf_dir, "embeddings")
        cells = table.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value")).withColumn("i1", F.col("i1").cast("long"))
        fixtures.encode_array(cells, folder, "", [table.count(), 64], options.pop("chunks", [100, 24]), "<f4", **options)

    return arrays.open_array(spark, fixtures.once(spark, sf_dir, name, build))


def _events(spark: SparkSession, sf_dir: str) -> arrays.Group:
    """A group: value [n / 100, 10, 10] by event_id, the last step filled up with -1, and a curvilinear grid [10, 10]."""

    def build(folder: str) -> None:
        events = read_table(spark, sf_dir, "events").select("event_id", "value")
        n = -(-events.count() // 100)
        every = spark.range(n * 100).withColumnRenamed("id", "event_id").join(events, "event_id", "left")
        cells = every.select(F.expr("event_id div 100").alias("i0"), F.expr("(event_id div 10) % 10").alias("i1"), F.expr("event_id % 10").alias("i2"), F.coalesce("value", F.lit(-1.0)).alias("value"))
        fixtures.encode_array(cells, folder, "value", [n, 10, 10], [16, 4, 4], "<f8", attrs={"_ARRAY_DIMENSIONS": ["time", "y", "x"]})
        grid = spark.range(100).select(F.expr("id div 10").alias("i0"), F.expr("id % 10").alias("i1"))
        fixtures.encode_array(grid.withColumn("value", F.expr("i0 * 2.5 + i1 * 0.25")), folder, "lat", [10, 10], [4, 4], "<f4")
        fixtures.encode_array(grid.withColumn("value", F.expr("i1 * 3.0 - i0 * 0.5")), folder, "lon", [10, 10], [4, 4], "<f4")
        fixtures.write_bytes(folder, GROUP_DOC, b'{"zarr_format": 2}')

    return arrays.open_group(spark, fixtures.once(spark, sf_dir, "events", build))


def _orders_group(spark: SparkSession, sf_dir: str) -> str:
    """price, customer (other chunks) and status/open, with consolidated metadata."""

    def build(folder: str) -> None:
        orders = read_table(spark, sf_dir, "orders")
        n, documents = orders.count(), {GROUP_DOC: {"zarr_format": 2}, ATTRS_DOC: {"title": "orders"}, f"status/{GROUP_DOC}": {"zarr_format": 2}}
        for path, value, dtype, chunk in (("price", "o_totalprice", "<f8", 1000), ("customer", "o_custkey", "<i8", 700), ("status/open", "if(o_orderstatus = 'O', 1, 0)", "|b1", 4000)):
            cells = orders.select(F.col("o_orderkey").cast("long").alias("i0"), F.expr(value).alias("value"))
            documents[f"{path}/{ARRAY_DOC}"] = fixtures.encode_array(cells, folder, path, [n], [chunk], dtype)
        for key in (GROUP_DOC, ATTRS_DOC, f"status/{GROUP_DOC}"):
            fixtures.write_bytes(folder, key, json.dumps(documents[key]).encode())
        fixtures.write_bytes(folder, ".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": documents}).encode())

    return fixtures.once(spark, sf_dir, "orders-group", build)


_ALL_PRICES = "SELECT o_orderkey::BIGINT AS i0, o_totalprice AS value FROM orders"
_ALL_EMBEDDINGS = "SELECT vec_id::BIGINT AS i0, r.i AS i1, embedding[r.i + 1] AS value FROM embeddings, range(64) r(i)"
_ALL_EVENTS = "SELECT r.i // 100 AS i0, (r.i // 10) % 10 AS i1, r.i % 10 AS i2, coalesce(value, -1.0) AS value FROM range((SELECT (count(*) + 99) // 100 * 100 FROM events)) r(i) LEFT JOIN events ON event_id = r.i"

# selections


@query("array_full_read_1d", _ALL_PRICES)
def _(spark, sf_dir):
    return _array_1d(spark, sf_dir).get()


@query("array_slice_1d", f"{_ALL_PRICES} WHERE o_orderkey >= 137 AND o_orderkey < 1450")
def _(spark, sf_dir):
    return _array_1d(spark, sf_dir).get([[137, 1450]])


@query("array_index_point", f"{_ALL_PRICES} WHERE o_orderkey = 42")
def _(spark, sf_dir):
    return _array_1d(spark, sf_dir).get([42])


@query("array_filter_pushdown", f"{_ALL_PRICES} WHERE o_orderkey >= 990 AND o_orderkey < 1010")
def _(spark, sf_dir):
    return _array_1d(spark, sf_dir).get().where("i0 >= 990 AND i0 < 1010")


@query("array_filter_values", f"{_ALL_PRICES} WHERE o_orderkey IN (5, 1003, 1004, 999999999)")
def _(spark, sf_dir):
    return _array_1d(spark, sf_dir).get().where("i0 IN (5, 1003, 1004, 999999999)")


@query("array_sql_view", f"SELECT i0 // 1000 AS block, count(*) AS n, max(value) AS highest FROM ({_ALL_PRICES}) GROUP BY block")
def _(spark, sf_dir):
    _array_1d(spark, sf_dir).get().createOrReplaceTempView("prices_array")
    return spark.sql("SELECT i0 div 1000 AS block, count(*) AS n, max(value) AS highest FROM prices_array GROUP BY 1")


@query("array_full_read_2d", _ALL_EMBEDDINGS)
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir).get()


@query("array_slice_2d_cross_chunk", f"{_ALL_EMBEDDINGS} WHERE vec_id >= 90 AND vec_id < 210 AND r.i >= 20 AND r.i < 50")
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir).get([[90, 210], [20, 50]])


@query("array_row", f"{_ALL_EMBEDDINGS} WHERE vec_id = 123")
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir).get([123, None])


@query("array_column", f"{_ALL_EMBEDDINGS} WHERE r.i = 63")
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir).get([None, 63])


@query("array_f_order", _ALL_EMBEDDINGS)
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir, "embeddings-f", order="F", compressor={"id": "zlib", "level": 1}).get()


@query("array_linear_order", "SELECT r.i AS i1, vec_id::BIGINT AS i0, embedding[r.i + 1] AS value, (vec_id - 10) * 5 + r.i - 2 AS linear FROM embeddings, range(64) r(i) WHERE vec_id >= 10 AND vec_id < 40 AND r.i >= 2 AND r.i < 7")
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir).linear([[10, 40], [2, 7]])


@query("array_series", "SELECT 7::BIGINT AS n0, 64::BIGINT AS n1, ((vec_id - 100) * 64 + r.i)::INTEGER AS linear, embedding[r.i + 1] AS value FROM embeddings, range(64) r(i) WHERE vec_id >= 100 AND vec_id < 107")
def _(spark, sf_dir):
    row = _embeddings(spark, sf_dir).series([[100, 107], None])
    return row.select(F.col("shape")[0].alias("n0"), F.col("shape")[1].alias("n1"), F.posexplode("data").alias("linear", "value"))


@query("array_out_of_bounds", "SELECT r.i AS i0, coalesce(o_totalprice, -1.0) AS value FROM range((SELECT max(o_orderkey)::BIGINT - 40 FROM orders), (SELECT max(o_orderkey)::BIGINT + 2100 FROM orders)) r(i) LEFT JOIN orders ON o_orderkey = r.i")
def _(spark, sf_dir):
    a = _array_1d(spark, sf_dir, "prices-fill", fill_value=-1.0)
    return a.get([[a.shape[0] - 41, a.shape[0] + 2099]])


@query("array_byte_range", f"{_ALL_EMBEDDINGS} WHERE vec_id >= 130 AND vec_id < 171")
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir, "embeddings-wide", chunks=[100, 64]).get([[130, 171], None])


@query("array_slash_separator", _ALL_EMBEDDINGS)
def _(spark, sf_dir):
    return _embeddings(spark, sf_dir, "embeddings-slash", separator="/").get()


# decoding


def _decoding(name: str, table: str, key: str, value: str, dtype: str, sql_value: str, **options: object) -> None:
    @query(f"array_{name}", f"SELECT {key}::BIGINT AS i0, {sql_value} AS value FROM {table}")
    def _(spark, sf_dir):
        return _array_1d(spark, sf_dir, name, table, key, value, dtype, **options).get()


_decoding("big_endian", "part", "p_partkey", "p_retailprice", ">f8", "p_retailprice")
_decoding("zlib", "orders", "o_orderkey", "o_totalprice", "<f8", "o_totalprice", compressor={"id": "zlib", "level": 1})
_decoding("gzip", "orders", "o_orderkey", "o_totalprice", "<f8", "o_totalprice", compressor={"id": "gzip", "level": 1})
for _inner in ("lz4", "zstd", "snappy", "zlib"):
    _decoding(f"blosc_{_inner}", "orders", "o_orderkey", "o_totalprice", "<f8", "o_totalprice", compressor={"id": "blosc", "cname": _inner, "shuffle": 1})
_decoding("blosc_bitshuffle", "orders", "o_orderkey", "o_totalprice", "<f8", "o_totalprice", compressor={"id": "blosc", "cname": "lz4", "shuffle": 2, "shuffle_name": "bit"})
_decoding("blosc_split", "orders", "o_orderkey", "o_totalprice", "<f8", "o_totalprice", compressor={"id": "blosc", "cname": "lz4", "shuffle": 1, "split": True})
_decoding("int64", "events", "event_id", "user_id", "<i8", "user_id::BIGINT")
_decoding("int64_big_endian", "events", "event_id", "user_id", ">i8", "user_id::BIGINT", compressor={"id": "zlib"})
_decoding("int32", "part", "p_partkey", "p_size", "<i4", "p_size::INTEGER")
_decoding("uint32", "orders", "o_orderkey", "o_custkey + 3000000000", "<u4", "o_custkey::BIGINT + 3000000000")
_decoding("int16", "part", "p_partkey", "p_size * -3", ">i2", "(p_size * -3)::SMALLINT")
_decoding("uint16", "part", "p_partkey", "p_size + 65000", "<u2", "(p_size + 65000)::INTEGER")
_decoding("uint8", "part", "p_partkey", "p_size + 200", "|u1", "(p_size + 200)::SMALLINT")
_decoding("int8", "part", "p_partkey", "p_size - 60", "|i1", "(p_size - 60)::TINYINT")
_decoding("bool", "part", "p_partkey", "if(p_size > 25, 1, 0)", "|b1", "(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::TINYINT")
_decoding("float32", "customer", "c_custkey", "c_acctbal", "<f4", "c_acctbal::FLOAT")


@query("array_uint64", "SELECT event_id::BIGINT AS i0, (user_id::HUGEINT + 18446744073709000000)::VARCHAR AS value FROM events")
def _(spark, sf_dir):
    found = _array_1d(spark, sf_dir, "uint64", "events", "event_id", "cast(user_id as decimal(20,0)) + 18446744073709000000", "<u8").get()
    return found.withColumn("value", F.col("value").cast("string"))


@query("array_custom_codec", _ALL_PRICES)
def _(spark, sf_dir):
    codec_registry.register("xor", fixtures.xor_codec)
    return _array_1d(spark, sf_dir, "xor", compressor={"id": "xor", "key": 255}).get()


def _filled(name: str, fill: object, sql_fill: str) -> None:
    @query(f"array_fill_{name}", f"SELECT o_orderkey::BIGINT AS i0, CASE WHEN (o_orderkey // 1000) % 3 = 0 THEN {sql_fill} ELSE o_totalprice END AS value FROM orders")
    def _(spark, sf_dir):
        return _array_1d(spark, sf_dir, f"fill-{name}", fill_value=fill, keep="c0 % 3 <> 0").get()


_filled("missing", -9999, "-9999.0")
_filled("nan", "NaN", "'nan'::DOUBLE")
_filled("null", None, "0.0")
_filled("infinity", "-Infinity", "'-inf'::DOUBLE")


def _parts(spark: SparkSession, sf_dir: str) -> str:
    def build(folder: str) -> None:
        cells = _cells_1d(spark, sf_dir, "part", "p_partkey", "p_size")
        fixtures.encode_array(cells, folder, "size", [cells.count()], [512], "<i4")
        fixtures.write_bytes(folder, GROUP_DOC, b'{"zarr_format": 2}')

    return fixtures.once(spark, sf_dir, "part-group", build)


def _indexed(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"i0": np.arange(len(values)), "value": values}))


@query("decoded_array_f64", "SELECT p_partkey::BIGINT AS i0, p_size::DOUBLE AS value FROM part")
def _(spark, sf_dir):
    """From the shared cache, which another session's read has filled."""
    folder, shared = _parts(spark, sf_dir), InMemoryCache(64 << 20)
    for _ in range(2):
        dataset = DatasetRegistry(spark, RegistryOptions(coordinate_cache=shared)).open(folder, lambda: open_store(folder))
        values = dataset.decoded_array("size", cache_key=folder)
    return _indexed(spark, values)


@query("decoded_array_rows", "SELECT p_partkey::BIGINT AS i0, p_size::DOUBLE AS value FROM part")
def _(spark, sf_dir):
    folder = _parts(spark, sf_dir)
    return DatasetRegistry(spark).open(folder, lambda: open_store(folder)).decoded_df("size")


@query("dataset_read", "SELECT p_partkey::BIGINT AS i0, p_size::INTEGER AS value FROM part WHERE p_partkey >= 100 AND p_partkey < 700")
def _(spark, sf_dir):
    folder = _parts(spark, sf_dir)
    options = RegistryOptions(chunk_memory_cache_bytes=1 << 20, hooks=Hooks(cache_hit=lambda event: None))
    return DatasetRegistry(spark, options).open(folder, lambda: open_store(folder)).read("size", [[100, 700]])


@query("local_read", "SELECT p_partkey::BIGINT AS i0, p_size::DOUBLE AS value FROM part WHERE p_partkey >= 10 AND p_partkey < 150")
def _(spark, sf_dir):
    """A small array in the driver: eight threads under a budget of a few chunks."""
    array = arrays.open_array(spark, _parts(spark, sf_dir), "size")
    options = ReadOptions(concurrency=8, max_in_flight_bytes=3 * peak_bytes(array.handle.meta), large_read_warning_bytes=float("inf"))
    found = array.to_numpy([[10, 150]], options)
    return _indexed(spark, found.astype(float)).withColumn("i0", F.col("i0") + 10)


# stores and caches


@query("store_http", _ALL_PRICES)
def _(spark, sf_dir):
    url = serving.serve(spark, _store_1d(spark, sf_dir, "prices", "orders", "o_orderkey", "o_totalprice", "<f8"))
    return arrays.open_array(spark, HttpStore(url, max_connections=8)).get(concurrency=8)


@query("store_http_ranges", f"{_ALL_EMBEDDINGS} WHERE vec_id >= 130 AND vec_id < 171")
def _(spark, sf_dir):
    _embeddings(spark, sf_dir, "embeddings-wide", chunks=[100, 64])
    url = serving.serve(spark, fixtures.once(spark, sf_dir, "embeddings-wide", None))
    return arrays.open_array(spark, url).get([[130, 171], None])


@query("store_retries", "SELECT p_partkey::BIGINT AS i0, p_size::INTEGER AS value FROM part")
def _(spark, sf_dir):
    """The first two requests of every key fail."""
    url = serving.serve(spark, _parts(spark, sf_dir), failing=2)
    return arrays.open_array(spark, HttpStore(url, base_delay_ms=1), "size").get()


@query("store_heads", "SELECT r.i::VARCHAR AS key, 8000::BIGINT AS http_bytes, 8000::BIGINT AS file_bytes FROM range((SELECT (count(*) + 999) // 1000 FROM orders)) r(i)")
def _(spark, sf_dir):
    folder = _store_1d(spark, sf_dir, "prices", "orders", "o_orderkey", "o_totalprice", "<f8")
    http, file = HttpStore(serving.serve(spark, folder)), open_store(folder)
    keys = [k for k in file.list("") if k.isdigit()]
    return spark.createDataFrame([(k, http.head(k).size, file.head(k).size) for k in keys], "key string, http_bytes bigint, file_bytes bigint")


@query("store_cached", _ALL_PRICES)
def _(spark, sf_dir):
    folder = _store_1d(spark, sf_dir, "prices", "orders", "o_orderkey", "o_totalprice", "<f8")
    store = CachedStore(open_store(folder), os.path.join(tempfile.gettempdir(), "chunkwright-cache"), store_id=folder, max_bytes=64 << 20)
    return arrays.open_array(spark, store).get()


class _Dearer(Store):
    """A user's own store: every price of another store, plus one."""

    def __init__(self, uri: str):
        self.uri = uri

    def get(self, key: str) -> bytes | None:
        data = open_store(self.uri).get(key)
        return data if data is None or not key.isdigit() else (np.frombuffer(data, "<f8") + 1).tobytes()

    def has(self, key: str) -> bool:
        return open_store(self.uri).has(key)

    def list(self, prefix: str) -> Iterator[str]:
        return open_store(self.uri).list(prefix)


@query("store_custom", "SELECT o_orderkey::BIGINT AS i0, o_totalprice + 1 AS value FROM orders")
def _(spark, sf_dir):
    return arrays.open_array(spark, _Dearer(_store_1d(spark, sf_dir, "prices", "orders", "o_orderkey", "o_totalprice", "<f8"))).get()


@query("store_ids", "SELECT * FROM (VALUES ('s3://b/p/q', 's3://b/p/q'), ('http://h/x/', 'http://h/x'), ('/data', NULL)) t(uri, store_id)")
def _(spark, sf_dir):
    return spark.createDataFrame([(uri, derive_store_id(open_store(uri))) for uri in ("s3://b/p/q", "http://h/x/", "/data")], "uri string, store_id string")


@query("memory_cache_chunks", "SELECT read.i AS read, count(*) AS chunks, read.i = 1 AS cached FROM range(2) read(i), range((SELECT (count(*) + 511) // 512 FROM part)) c(i) GROUP BY read.i")
def _(spark, sf_dir):
    """Two local reads that share a chunk cache: what the hooks saw of each."""
    array, cache, rows = arrays.open_array(spark, _parts(spark, sf_dir), "size"), MemoryCache(1 << 24), []
    for read in range(2):
        seen: list[bool] = []
        hooks = Hooks(cache_hit=lambda event, to=seen: to.append(True), cache_miss=lambda event, to=seen: to.append(False))
        array.to_numpy(options=ReadOptions(memory_cache=cache, hooks=hooks))
        rows += [(read, len(seen), all(seen))]
    return spark.createDataFrame(rows, "read bigint, chunks bigint, cached boolean")


@query("worker_cache_reads", "SELECT (CASE WHEN n.i = 0 THEN o_totalprice ELSE o_totalprice + 1 END) AS value, n.i AS store, o_orderkey::BIGINT AS i0 FROM orders, range(2) n(i)")
def _(spark, sf_dir):
    """Two stores without a name of their own, read by the same workers with a cache of decoded chunks."""
    folder = _store_1d(spark, sf_dir, "prices", "orders", "o_orderkey", "o_totalprice", "<f8")
    stores = (open_store(folder), _Dearer(folder))
    parts = [arrays.open_array(spark, s).get(memory_cache_bytes=8 << 20).withColumn("store", F.lit(n).cast("bigint")) for n, s in enumerate(stores)]
    return parts[0].unionByName(parts[1])


@query("metadata_cache", "SELECT * FROM (VALUES (0, 4), (1, 0)) t(opened, requests)")
def _(spark, sf_dir):
    """How many documents two opens of a group and an array in it ask the store for, with a shared cache."""
    shared, rows = InMemoryCache(1 << 20), []
    for opened in range(2):
        misses: list[dict] = []
        options = arrays.OpenOptions(shared, "parts", Hooks(cache_miss=misses.append))
        arrays.open_group(spark, _parts(spark, sf_dir), "", options).get_array("size")
        rows.append((opened, len([m for m in misses if m["tier"] == "shared"])))
    return spark.createDataFrame([(o, min(n, 4)) for o, n in rows], "opened int, requests int")


@query("array_or_group", "SELECT * FROM (VALUES ('', 'Group'), ('price', 'Array'), ('status', 'Group'), ('status/open', 'Array')) t(path, kind)")
def _(spark, sf_dir):
    folder = _orders_group(spark, sf_dir)
    return spark.createDataFrame([(p, type(arrays.open(spark, folder, p)).__name__) for p in ("", "price", "status", "status/open")], "path string, kind string")


@query("strict_mode", "SELECT r.i::VARCHAR AS key, true AS missing FROM range((SELECT (count(*) + 999) // 1000 FROM orders)) r(i) WHERE r.i % 3 = 0")
def _(spark, sf_dir):
    """The chunks that strict reads refuse, one by one."""
    array = _array_1d(spark, sf_dir, "fill-missing", fill_value=-9999, keep="c0 % 3 <> 0")
    rows = []
    for k in range(-(-array.shape[0] // 1000)):
        try:
            array.to_numpy([[k * 1000, k * 1000 + 1]], ReadOptions(strict=True))
        except MissingChunkError:
            rows.append((str(k), True))
    return spark.createDataFrame(rows, "key string, missing boolean")


@query("chunk_peak_bytes", "SELECT * FROM (VALUES ('<f8', 8000::BIGINT), ('>f8 zlib', 24000::BIGINT), ('<f8 zlib', 16000::BIGINT)) t(kind, bytes)")
def _(spark, sf_dir):
    kinds = (("<f8", None), (">f8", {"id": "zlib"}), ("<f8", {"id": "zlib"}))
    found = [(f"{d} zlib" if c else d, peak_bytes(parse_array(json.dumps(fixtures.array_document([5000], [1000], d, compressor=c)).encode()))) for d, c in kinds]
    return spark.createDataFrame(found, "kind string, bytes bigint")


@query("refusals", "SELECT * FROM (VALUES ('rank', 'SliceError'), ('backwards', 'SliceError'), ('no array', 'MetadataError'), ('no group', 'MetadataError'), ('http list', 'UnsupportedOperationError'), ('snapshot', 'ArrayError')) t(what, error)")
def _(spark, sf_dir):
    prices = _array_1d(spark, sf_dir)
    tries = {
        "rank": lambda: prices.get([0, 0]),
        "backwards": lambda: prices.get([[5, 2]]),
        "no array": lambda: arrays.open_array(spark, _orders_group(spark, sf_dir), "nothing"),
        "no group": lambda: arrays.open_group(spark, _orders_group(spark, sf_dir), "price"),
        "http list": lambda: HttpStore("http://127.0.0.1:9").list(""),
        "snapshot": lambda: spatial.GridIndex.from_bytes(b"short"),
    }
    rows = []
    for what, run in tries.items():
        try:
            run()
        except ArrayError as error:
            rows.append((what, type(error).__name__))
    return spark.createDataFrame(rows, "what string, error string")


# workloads on three dimensions


@query("array_3d_full", _ALL_EVENTS)
def _(spark, sf_dir):
    return _events(spark, sf_dir).get_array("value").get()


@query("array_3d_field", f"SELECT * FROM ({_ALL_EVENTS}) WHERE i0 = 5")
def _(spark, sf_dir):
    return _events(spark, sf_dir).get_array("value").get([5, None, None])


@query("array_3d_point_series", f"SELECT * FROM ({_ALL_EVENTS}) WHERE i1 = 7 AND i2 = 2")
def _(spark, sf_dir):
    return _events(spark, sf_dir).get_array("value").point_series(7, 2)


_GRID = "SELECT i.i AS i, j.j AS j, (i.i * 2.5 + j.j * 0.25)::FLOAT::DOUBLE AS lat, (j.j * 3.0 - i.i * 0.5)::FLOAT::DOUBLE AS lon FROM range(10) i(i), range(10) j(j)"
_POINTS = "SELECT s_suppkey::BIGINT AS id, (s_suppkey * 7919 % 2301) / 100.0 + 0.0137 AS plat, (s_suppkey * 104729 % 2713) / 100.0 + 0.0071 AS plon FROM supplier"
_NEAREST = f"""
SELECT id, plat, plon, i, j, round(sqrt(d) * 111.195, 6) AS distance_km FROM (
    SELECT p.*, g.i, g.j, d, row_number() OVER (PARTITION BY id ORDER BY d, i, j) AS n
    FROM (SELECT p.*, g.i, g.j, (g.lat - plat) * (g.lat - plat) + pow((g.lon - plon) * cos(plat * pi() / 180), 2) AS d FROM ({_POINTS}) p, ({_GRID}) g) p
) WHERE n = 1""".replace("SELECT p.*, g.i, g.j, d, row_number", "SELECT *, row_number")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("long")
    return read_table(spark, sf_dir, "supplier").select(key.alias("id"), (key * 7919 % 2301 / 100.0 + 0.0137).alias("plat"), (key * 104729 % 2713 / 100.0 + 0.0071).alias("plon"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("distance_km", F.round("distance_km", 6))


@query("nearest_many", _NEAREST)
def _(spark, sf_dir):
    return _rounded(spatial.GridIndex.from_group(_events(spark, sf_dir)).nearest_many(_points(spark, sf_dir), "plat", "plon"))


@query("nearest_many_join", _NEAREST)
def _(spark, sf_dir):
    cells = spatial.GridIndex.from_group(_events(spark, sf_dir)).to_df(spark)
    return _rounded(spatial.nearest_join(_points(spark, sf_dir), cells, "plat", "plon"))


def _large_grid(spark: SparkSession, sf_dir: str) -> arrays.Group:
    """A curvilinear grid with about as many cells as there are customers."""

    def build(folder: str) -> None:
        side = int(read_table(spark, sf_dir, "customer").count() ** 0.5)
        grid = spark.range(side * side).select(F.expr(f"id div {side}").alias("i0"), F.expr(f"id % {side}").alias("i1"))
        fixtures.encode_array(grid.withColumn("value", F.expr(f"i0 * 23.0D / {side} + i1 * 2.0D / {side}")), folder, "lat", [side, side], [32, 48], "<f4")
        fixtures.encode_array(grid.withColumn("value", F.expr(f"i1 * 27.0D / {side} - i0 * 3.0D / {side}")), folder, "lon", [side, side], [32, 48], "<f4")
        fixtures.write_bytes(folder, GROUP_DOC, b'{"zarr_format": 2}')

    return arrays.open_group(spark, fixtures.once(spark, sf_dir, "large-grid", build))


_SIDE = "(SELECT floor(sqrt(count(*)))::BIGINT FROM customer)"
_LARGE = f"SELECT i.i AS i, j.j AS j, (i.i * 23.0::DOUBLE / n + j.j * 2.0::DOUBLE / n)::FLOAT::DOUBLE AS lat, (j.j * 27.0::DOUBLE / n - i.i * 3.0::DOUBLE / n)::FLOAT::DOUBLE AS lon FROM range({_SIDE}) i(i), range({_SIDE}) j(j), (SELECT {_SIDE} AS n)"


@query("nearest_many_large", _NEAREST.replace(_GRID, _LARGE))
def _(spark, sf_dir):
    return _rounded(spatial.nearest_cells(_large_grid(spark, sf_dir), _points(spark, sf_dir), "plat", "plon"))


@query("nearest_join_large", _NEAREST.replace(_GRID, _LARGE))
def _(spark, sf_dir):
    """As for a grid that is too large to copy: scanned by tasks and joined by tiles."""
    return _rounded(spatial.nearest_join(_points(spark, sf_dir), spatial.grid_cells(_large_grid(spark, sf_dir)), "plat", "plon"))


@query("grid_cached", f"SELECT i, j, lat::FLOAT AS lat, lon::FLOAT AS lon FROM ({_GRID})")
def _(spark, sf_dir):
    """A grid as another process finds it: a snapshot in a shared cache."""
    shared = InMemoryCache(1 << 20)
    spatial.GridIndex.load_cached(_events(spark, sf_dir), shared, grid_key="events")
    return spatial.GridIndex.load_cached(_events(spark, sf_dir), shared, grid_key="events").to_df(spark)


@query("grid_snapshot", f"SELECT i, j, lat::FLOAT AS lat, lon::FLOAT AS lon FROM ({_GRID})")
def _(spark, sf_dir):
    grid = spatial.GridIndex.from_group(_events(spark, sf_dir))
    return spatial.GridIndex.from_bytes(grid.to_bytes()).to_df(spark)


@query("grid_keys", "SELECT 'gridindex:events1' AS key, true AS found")
def _(spark, sf_dir):
    shared = InMemoryCache(1 << 20)
    spatial.GridIndex.load_cached(_events(spark, sf_dir), shared, grid_key="events/1")
    return spark.createDataFrame([("gridindex:events1", shared.has("gridindex:events1"))], "key string, found boolean")


@query("nearest_point_1d", "SELECT s_suppkey::BIGINT AS point FROM (SELECT s_suppkey, plat, plon FROM (SELECT id AS s_suppkey, plat, plon FROM (" + _POINTS + ")) ORDER BY (plat - 11.3) * (plat - 11.3) + pow((plon - 8.2) * cos(radians(11.3)), 2), s_suppkey LIMIT 1)")
def _(spark, sf_dir):
    points = _points(spark, sf_dir)
    coordinates = (points.select(F.col("id").alias("i0"), F.col(c).alias("value")) for c in ("plat", "plon"))
    return spatial.nearest_1d(*coordinates, (11.3, 8.2)).select("point")


@query("select_labels", f"SELECT * FROM ({_ALL_EVENTS}) WHERE i1 = 7 AND i2 = 3")
def _(spark, sf_dir):
    """By labels of the 1-D coordinates y = 0.5, 1.5, ... and x = 10, 20, ..."""

    def build(folder: str) -> None:
        value = _events(spark, sf_dir).get_array("value").get()
        fixtures.encode_array(value, folder, "value", [value.agg(F.max("i0")).first()[0] + 1, 10, 10], [16, 4, 4], "<f8", attrs={"_ARRAY_DIMENSIONS": ["time", "y", "x"]})
        line = spark.range(10).withColumnRenamed("id", "i0")
        fixtures.encode_array(line.withColumn("value", F.col("i0") + 0.5), folder, "y", [10], [10], "<f8", attrs={"_ARRAY_DIMENSIONS": ["y"]})
        fixtures.encode_array(line.withColumn("value", F.col("i0") * 10.0 + 10), folder, "x", [10], [10], "<f8", attrs={"_ARRAY_DIMENSIONS": ["x"]})
        fixtures.write_bytes(folder, GROUP_DOC, b'{"zarr_format": 2}')

    group = arrays.open_group(spark, fixtures.once(spark, sf_dir, "events-labels", build))
    return spatial.select_labels(group, {"y": 7.4, "x": 43.0})["value"]


@query("nearest_cell", f"SELECT i, j FROM ({_GRID}) ORDER BY (lat - 11.3) * (lat - 11.3) + pow((lon - 8.2) * cos(11.3 * pi() / 180), 2), i, j LIMIT 1")
def _(spark, sf_dir):
    found = spatial.GridIndex.from_group(_events(spark, sf_dir)).nearest(11.3, 8.2)
    return spark.createDataFrame([(found.i, found.j)], "i bigint, j bigint")


@query("nearest_point_series", f"SELECT e.* FROM ({_ALL_EVENTS}) e, (SELECT i, j FROM ({_GRID}) ORDER BY (lat - 11.3) * (lat - 11.3) + pow((lon - 8.2) * cos(11.3 * pi() / 180), 2), i, j LIMIT 1) c WHERE i1 = c.i AND i2 = c.j")
def _(spark, sf_dir):
    group = _events(spark, sf_dir)
    return spatial.point_series(group, "value", spatial.GridIndex.from_group(group), 11.3, 8.2)


# groups and metadata


@query("read_multiple", "SELECT o_orderkey::BIGINT AS i0, o_totalprice AS price, o_custkey::BIGINT AS customer FROM orders WHERE o_orderkey >= 650 AND o_orderkey < 1430")
def _(spark, sf_dir):
    group = arrays.open_group(spark, _orders_group(spark, sf_dir))
    return group.read_wide(["price", "unknown", "customer"], [[650, 1430]])


@query("read_multiple_map", "SELECT 'price' AS name, count(*) AS n, max(o_totalprice) AS highest FROM orders WHERE o_orderkey < 900 UNION ALL SELECT 'customer', count(*), max(o_custkey)::DOUBLE FROM orders WHERE o_orderkey < 900")
def _(spark, sf_dir):
    found = arrays.open_group(spark, _orders_group(spark, sf_dir)).read_multiple(["price", "unknown", "customer", "price"], [[0, 900]])
    parts = [df.agg(F.count("*").alias("n"), F.max(F.col("value").cast("double")).alias("highest")).select(F.lit(name).alias("name"), "n", "highest") for name, df in found.items()]
    return parts[0].unionByName(parts[1])


@query("group_list_arrays", "SELECT * FROM (VALUES ('customer'), ('price')) t(name)")
def _(spark, sf_dir):
    group = arrays.open_group(spark, _orders_group(spark, sf_dir))
    return spark.createDataFrame([(name,) for name, _ in group.arrays()], "name string")


@query("group_contains", "SELECT * FROM (VALUES ('price', true), ('status', true), ('status/open', true), ('nothing', false)) t(name, found)")
def _(spark, sf_dir):
    group = arrays.open_group(spark, _orders_group(spark, sf_dir))
    return spark.createDataFrame([(n, group.contains(n)) for n in ("price", "status", "status/open", "nothing")], "name string, found boolean")


@query(
    "consolidated_catalog",
    """SELECT * FROM (SELECT '' AS path, 'group' AS kind, NULL::VARCHAR AS dtype, NULL::BIGINT AS length, '{"title": "orders"}' AS attrs_json
       UNION ALL SELECT 'status', 'group', NULL, NULL, '{}' UNION ALL SELECT 'price', 'array', '<f8', count(*), '{}' FROM orders
       UNION ALL SELECT 'customer', 'array', '<i8', count(*), '{}' FROM orders UNION ALL SELECT 'status/open', 'array', '|b1', count(*), '{}' FROM orders)""",
)
def _(spark, sf_dir):
    found = arrays.open_group(spark, _orders_group(spark, sf_dir)).catalog()
    return found.select("path", "kind", "dtype", F.col("shape")[0].alias("length"), "attrs_json")


@query("nested_group_read", "SELECT o_orderkey::BIGINT AS i0, (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::TINYINT AS value FROM orders")
def _(spark, sf_dir):
    return arrays.open_group(spark, _orders_group(spark, sf_dir)).get_group("status").get_array("open").get()


@query("data_source_options", "SELECT o_orderkey::BIGINT AS i0, o_totalprice AS value FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 1200")
def _(spark, sf_dir):
    source.register(spark)
    return spark.read.format("chunked").option("path", _orders_group(spark, sf_dir)).option("array", "price").option("selection", "[[10, 1200]]").load()


@query("chunk_grid", "SELECT a.a AS c0, b.b AS c1, a.a || '.' || b.b AS key FROM range((SELECT (count(*) + 99) // 100 FROM embeddings)) a(a), range(3) b(b)")
def _(spark, sf_dir):
    return _chunk_list(_embeddings(spark, sf_dir))


@query("chunks_for_slice", "SELECT a.a AS c0, b.b AS c1, a.a || '.' || b.b AS key FROM range(0, 3) a(a), range(0, 3) b(b)")
def _(spark, sf_dir):
    return _chunk_list(_embeddings(spark, sf_dir), [[90, 210], [20, 50]])


@query("chunk_keys_slash", "SELECT a.a AS c0, b.b AS c1, a.a || '/' || b.b AS key FROM range((SELECT (count(*) + 99) // 100 FROM embeddings)) a(a), range(3) b(b)")
def _(spark, sf_dir):
    return _chunk_list(_embeddings(spark, sf_dir, "embeddings-slash", separator="/"))


@query("chunk_bytes", "SELECT count(*) AS n, count(*) * 8000 AS bytes FROM range((SELECT (count(*) + 999) // 1000 FROM orders))")
def _(spark, sf_dir):
    return _array_1d(spark, sf_dir).chunk_table().agg(F.count("*").alias("n"), F.sum("nbytes").alias("bytes"))


@query("fetch_events", "SELECT '1.0' AS key, false AS missing, 10496::BIGINT AS fetched_bytes, 7680::BIGINT AS range_offset, 2624::BIGINT AS cells")
def _(spark, sf_dir):
    found = _embeddings(spark, sf_dir, "embeddings-wide", chunks=[100, 64]).events([[130, 171], None])
    return found.select("key", "missing", "fetched_bytes", "range_offset", "cells")


def _chunk_list(array: arrays.Array, selection=None) -> DataFrame:
    found = array.events(selection)
    return found.select(F.col("chunk_coord")[0].alias("c0"), F.col("chunk_coord")[1].alias("c1"), "key")


@query("reference_manifest", _ALL_PRICES)
def _(spark, sf_dir):
    """A manifest's text: every quarter of every stored chunk as a chunk of its own."""
    folder = _store_1d(spark, sf_dir, "prices", "orders", "o_orderkey", "o_totalprice", "<f8")
    shape = arrays.open_array(spark, folder).shape
    document = fixtures.array_document(shape, [250], "<f8")
    refs = {ARRAY_DOC: json.dumps(document)} | {str(i): [f"{folder}/{i // 4}", i % 4 * 2000, 2000] for i in range(-(-shape[0] // 250))}
    return arrays.open_array(spark, ReferenceStore(json.dumps({"version": 1, "refs": refs}))).get()
