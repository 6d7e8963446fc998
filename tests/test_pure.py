import socket
import struct
import threading
import time
import urllib.error

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwright.errors import CodecError, MetadataError, MissingChunkError, RetryExhaustedError, SliceError, StoreError, UnsupportedOperationError
from chunkwright.functions import blosc1, codecs, dtypes, indexing, metadata
from chunkwright.plans import fixtures
from chunkwright.sources import retry
from chunkwright.sources.hooks import Hooks, fire
from chunkwright.sources.limiter import ByteLimiter

DOC = '{"zarr_format": 2, "shape": [4, 10], "chunks": [4, 8], "dtype": "<i4", "order": "C", "compressor": null, "fill_value": 0, "filters": null}'


def changed(**parts):
    import json

    return json.dumps({**json.loads(DOC), **parts})


def test_selections_and_chunk_boxes():
    assert indexing.normalize([None, [5, 15], 3], [100, 200, 50]) == [(0, 100), (5, 15), (3, 4)]
    assert indexing.chunk_box([(0, 5), (0, 10)], [10, 20]) == [(0, 1), (0, 1)]
    assert indexing.chunk_box([(0, 15), (0, 25)], [10, 20]) == [(0, 2), (0, 2)]
    assert indexing.chunk_box([(25, 26)], [10]) == [(2, 3)] and indexing.chunk_box([(-3, 2)], [10]) == [(-1, 1)]
    assert list(indexing.coordinates(indexing.grid_box([3, 5], [2, 2]))) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert indexing.chunk_box([(2, 2)], [10]) == [(0, 0)]
    for bad in ([[0, 1]], [None, None, None], [[3, 2], None]):
        with pytest.raises(SliceError):
            indexing.normalize(bad, [4, 4])


def test_keys_and_strides():
    assert indexing.chunk_key([1, 2, 3]) == "1.2.3" and indexing.chunk_key([1, 2], "/") == "1/2" and indexing.chunk_key([]) == "0"
    assert indexing.strides([2, 3, 4]) == [12, 4, 1] and indexing.strides([2, 3, 4], "F") == [1, 2, 6] and indexing.strides([]) == []


def test_nth_coordinate_counts_like_the_list():
    box = [(-1, 2), (4, 6), (0, 3)]
    assert [indexing.nth_coordinate(box, n) for n in range(18)] == list(indexing.coordinates(box))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=3))
def test_byte_spans_hold_exactly_their_cells(dims):
    chunks = [c for c, _, _ in dims]
    part = [(min(a, b, c), min(max(a, b), c)) for c, a, b in dims]
    span = indexing.byte_span(part, chunks, 4)
    whole = np.arange(np.prod(chunks), dtype="<i4").reshape(chunks)
    cells = whole[tuple(slice(a, b) for a, b in part)]
    if span is not None:
        got = np.frombuffer(whole.tobytes()[span[0] : span[0] + span[1]], dtype="<i4")
        assert got.tolist() == cells.ravel().tolist()
    elif 0 < cells.size < whole.size:
        flat = cells.ravel()
        assert flat[-1] - flat[0] + 1 != cells.size


def test_element_types_and_fill():
    assert dtypes.element_type(">f8").big_endian and dtypes.element_type("|b1").size == 1
    for bad in ("<f2", "|S3", "<U4", "<M8[s]", "<c8", "|O", ""):
        with pytest.raises((MetadataError, IndexError)):
            dtypes.element_type(bad)
    cases = [("<f4", "NaN", None), ("<f8", "-Infinity", -np.inf), ("<i4", "NaN", 0), ("<i4", None, 0), ("<i4", True, 0), ("<f4", "12", 0), ("|u1", 300, 44), ("|i1", 200, -56), ("<i2", -9999.7, -9999), ("<u8", 2**64 - 1, 2**64 - 1), ("<f4", 7, 7)]
    for name, fill, want in cases:
        got = dtypes.fill_scalar(fill, dtypes.element_type(name))
        assert np.isnan(got) if want is None else got == want
    assert dtypes.to_arrow(np.array([2**64 - 1, 5], dtype="<u8"), dtypes.element_type("<u8")).to_pylist()[0] == 2**64 - 1


def test_array_documents():
    meta = metadata.parse_array(DOC)
    assert meta.shape == (4, 10) and meta.separator == "." and metadata.parse_array(changed(dimension_separator="/")).separator == "/"
    for bad in ({"zarr_format": 3}, {"chunks": [4]}, {"chunks": [4, 0]}, {"order": "K"}, {"dtype": 4}, {"dimension_separator": "-"}):
        with pytest.raises(MetadataError):
            metadata.parse_array(changed(**bad))
    with pytest.raises(MetadataError):
        metadata.parse_array("{")
    with pytest.raises(UnsupportedOperationError):
        metadata.parse_array(changed(filters=[{"id": "delta"}])).element()
    with pytest.raises(MetadataError):
        metadata.parse_array(changed(dtype="<f2")).element()


def test_consolidated_documents_and_manifests():
    raw = '{"metadata": {".zgroup": {"zarr_format": 2}, "t/.zarray": {}, "g/a/.zarray": {}, "g/.zgroup": {}, "g/h/.zgroup": {}, ".x/y": {}}}'
    c = metadata.Consolidated(raw)
    assert c.list_children() == ["t", "g"] and c.list_children("g") == ["a", "h"] and c.has("t/.zarray") and c.get("no") is None
    for bad in ("{}", "[]", "x", '{"metadata": 3}'):
        with pytest.raises(MetadataError):
            metadata.Consolidated(bad)
    refs = metadata.parse_manifest('{"version": 1, "refs": {"a": "text", "b": ["u"], "c": ["u", 1, 2]}}')
    assert list(refs) == ["a", "b", "c"]
    for bad in ('{"version": 2, "refs": {}}', '{"version": 1}', '{"version": 1, "refs": {"a": ["u", 1]}}', '{"version": 1, "refs": {"a": 5}}', '{"version": 1, "refs": {"a": ["u", "1", 2]}}', "no"):
        with pytest.raises(MetadataError):
            metadata.parse_manifest(bad)


@pytest.mark.parametrize("inner", ["lz4", "zstd", "snappy", "zlib"])
@pytest.mark.parametrize("shuffle", ["byte", "bit", "none"])
def test_blosc_frames(inner, shuffle):
    for n in (1, 100, 3000):
        data = np.arange(n, dtype="<f8").tobytes() + b"abc"
        assert blosc1.decode(fixtures.blosc_frame(data, 8, inner, shuffle, 1000)) == data
        for item in (2, 4, 8, 16, 32):
            assert blosc1.decode(fixtures.blosc_frame(data, item, inner, shuffle, 4096, split=True)) == data


def test_blosc_special_frames():
    copied = struct.pack("<BBBBIII", 2, 1, blosc1.COPIED, 4, 5, 5, 21) + b"hello"
    assert blosc1.decode(copied) == b"hello"
    split = [struct.pack("<i", 256) + bytes([i]) * 256 for i in range(4)]  # split streams, stored plain
    frame = struct.pack("<BBBBIII", 2, 1, blosc1.SHUFFLE | 4 << 5, 4, 1024, 1024, 20 + 1040) + struct.pack("<i", 20) + b"".join(split)
    assert blosc1.decode(frame) == bytes(range(4)) * 256
    literal_then_match = bytes([2]) + b"abc" + bytes([(3 << 5) | 0, 2])  # three literals, then five bytes from three back
    assert blosc1._blosclz(literal_then_match, 8) == b"abcabcab"
    for bad in (b"", frame[:30], struct.pack("<BBBBIII", 2, 1, 7 << 5, 4, 5, 5, 16)):
        with pytest.raises(CodecError):
            blosc1.decode(bad)


def test_codec_registry():
    registry = codecs.codec_registry
    assert registry.has("zlib") and registry.has("blosc") and not registry.has("nope")
    with pytest.raises(CodecError, match="Available: "):
        registry.get({"id": "nope"})
    with pytest.raises(CodecError):
        registry.get({"id": "gzip"})(b"not gzip")
    mine = codecs.CodecRegistry()
    mine.register("x", lambda config: lambda data: data[::-1])
    assert mine.get({"id": "x"})(b"ab") == b"ba" and list(mine.custom()) == ["x"]


def test_retry_policy():
    def http(code):
        return urllib.error.HTTPError("u", code, "m", {}, None)

    wrapped = StoreError("outer")
    wrapped.__cause__ = ConnectionResetError()
    for error in (http(503), http(429), TimeoutError(), BrokenPipeError(), socket.gaierror(socket.EAI_AGAIN, "x"), urllib.error.URLError(ConnectionRefusedError()), wrapped):
        assert retry.is_retryable(error)
    for error in (http(404), http(403), ValueError(), None):
        assert not retry.is_retryable(error)
    calls, seen = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionResetError("gone")
        return 5

    assert retry.with_retries(flaky, 3, Hooks(retry=seen.append), base=0.1) == 5 and [e["attempt"] for e in seen] == [1, 2]
    with pytest.raises(RetryExhaustedError, match="3 attempt"):
        retry.with_retries(lambda: (_ for _ in ()).throw(TimeoutError("slow")), 2, base=0.1)
    with pytest.raises(KeyError):
        retry.with_retries(lambda: {}[1], 5)
    assert all(0 <= retry.full_jitter_ms(n) <= min(10_000, 100 * 2**n) for n in range(12))


def test_limiter_is_fair_and_never_stuck():
    limiter, order = ByteLimiter(10), []
    limiter.acquire(float("inf"))
    limiter.acquire(-1)
    limiter.acquire(99)  # clamps to the capacity
    assert limiter.available == 0
    threads = []
    for n in range(5):
        t = threading.Thread(target=lambda n=n: (limiter.acquire(10), order.append(n), limiter.release(10)))
        t.start()
        threads.append(t)
        time.sleep(0.02)
    limiter.release(99)
    for t in threads:
        t.join(5)
    assert order == list(range(5)) and limiter.available == 10


def test_hooks_never_raise():
    fire(lambda e: 1 / 0, lambda: {})
    fire(None, lambda: 1 / 0)
    assert MissingChunkError("a/0").key == "a/0"
