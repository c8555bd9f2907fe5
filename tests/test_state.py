import struct
import zlib

import numpy as np
import pytest

from loomspan.functions import images as I
from loomspan.functions import providers as M
from loomspan.operators import limits as L
from loomspan.operators import state as S
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stamps_merge_by_key(spark):
    meta = spark.createDataFrame([("a", {"x": "1", "y": "1"}), ("b", {"x": "1"}), ("c", None)], "k string, meta map<string,string>")
    stamps = spark.createDataFrame([("a", {"y": "2", "z": "2"}), ("d", {"z": "2"}), ("c", {"z": "2"})], "k string, meta map<string,string>")
    assert {r.k: r.meta for r in S.stamped(meta, stamps, "k").collect()} == {"a": {"x": "1", "y": "2", "z": "2"}, "b": {"x": "1"}, "c": {"z": "2"}, "d": {"z": "2"}}
    assert rows(S.stamped(meta.limit(0), stamps.limit(0), "k"), "k") == []


def test_layouts(spark):
    flags = spark.createDataFrame([(True, False, False), (False, True, False), (True, True, True), (False, False, True)], "w boolean, p boolean, s boolean")
    got = [tuple(r.l) for r in flags.select(S.layout(F.col("w"), F.col("p"), F.col("s")).alias("l")).collect()]
    assert got == [("flat", "move"), ("unstamped", "stamp"), ("current", "none"), ("absent", "skip")]


def test_a_block_ends_its_batch_and_an_error_does_not(spark):
    df = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("a", 3, "blocked"), ("a", 4, "ok"), ("b", 1, None), ("b", 2, "ok")], "batch string, place int, outcome string")
    assert rows(S.stopped_at_block(df, "batch", "place", "outcome").filter("NOT tried"), "batch", "place") == [("a", 4)]


def test_feeds_go_on_from_their_token(spark):
    pages = spark.createDataFrame([("f", n, n != 2) for n in range(4)] + [("g", 0, True), ("h", 0, False)], "feed string, page int, ok boolean")
    none = spark.createDataFrame([], "feed string, token int")
    kept, state = S.resumed(pages, none)
    assert rows(kept, "feed", "page") == [("f", 0), ("f", 1), ("g", 0)]
    assert rows(state, "feed", "token", "complete") == [("f", 2, False), ("g", None, True), ("h", 0, False)]
    healed = pages.withColumn("ok", F.lit(True))
    again, end = S.resumed(healed, state.filter("token IS NOT NULL"))
    assert rows(again.filter("feed <> 'g'"), "feed", "page") == [("f", 2), ("f", 3), ("h", 0)] and end.filter("NOT complete").isEmpty()
    assert S.resumed(healed, state, force=True)[0].count() == 6


def test_an_index_is_replaced_where_it_is_stale(spark):
    index = spark.createDataFrame([("v", 1, "old"), ("w", 1, "w"), ("gone", 1, "x")], "video_id string, last_updated int, checksum string")
    now = spark.createDataFrame([("v", 2, "new"), ("w", 1, "w"), ("y", 1, "y")], "video_id string, last_updated int, checksum string")
    want = [("v", "new"), ("w", "w"), ("y", "y")]
    assert rows(S.rebuilt_index(index, now, built_with=1, version=1), "video_id", "checksum") == want
    assert rows(S.rebuilt_index(index, now, built_with=1, version=2), "video_id", "checksum") == want


def test_caches_and_expansion(spark):
    chunks = spark.createDataFrame([("v", 1, "a"), ("v", 2, "b"), ("v", 3, None)], "v string, n int, t string")
    cache = chunks.filter("n = 1").select("v", "n", F.sha2("t", 256).alias("digest"), F.lit(1).alias("version"))
    assert rows(S.uncached(chunks, cache, ["v", "n"], "t", 1), "n") == [(2,), (3,)] and S.uncached(chunks, cache, ["v", "n"], "t", 2).count() == 3
    tops = spark.createDataFrame([("t", False), ("u", None), ("w", True)], "thread_id string, complete boolean")
    there = spark.createDataFrame([("t", "r1"), ("w", "r2")], "thread_id string, comment_id string")
    fetched = spark.createDataFrame([("t", "r1"), ("t", "r3")], "thread_id string, comment_id string")
    assert rows(S.expanded(tops, there, fetched), "thread_id", "present", "complete") == [("t", 2, True), ("u", 0, False), ("w", 1, True)]


def test_unknown_names_say_what_there_is(spark):
    with pytest.raises(L.UnknownBucket, match="unknown bucket 'x'; there are data_api"):
        L.spec_of(L.LIMITS, "x")
    with pytest.raises(ValueError, match="unknown profile 'x'; there are analyst, default"):
        M.profile_of("x")


def test_pipeline(spark):
    df = spark.createDataFrame([("v", "Why it broke", "see https://a.test and https://b.test"), ("w", "How to", None)], "id string, title string, text string")
    got = {r.id: r for r in M.extracted(df, "id", "title", "text", profile="analyst").collect()}
    assert got["v"].extraction.formats == ["commentary"] and [s.url for s in got["v"].extraction.sources] == ["https://a.test", "https://b.test"]
    assert got["v"].traced and got["v"].trace == "https://a.test\nhttps://b.test" and got["v"].evaluation.verdict == "discard"
    assert not got["w"].traced and got["w"].trace is None and got["w"].evaluation.coverage == "minimal"


def encoded(pixels, kind):
    """A PNG of which every line has the same filter, computed one byte at a time."""
    h, w, n = pixels.shape
    flat, out = pixels.reshape(h, w * n).astype(int), b""
    for y in range(h):
        line = [kind]
        for x in range(w * n):
            left, up = (flat[y, x - n] if x >= n else 0), (flat[y - 1, x] if y else 0)
            corner = flat[y - 1, x - n] if y and x >= n else 0
            p = left + up - corner
            near = min((left, up, corner), key=lambda v: abs(p - v))
            line.append((flat[y, x] - [0, left, up, (left + up) // 2, near][kind]) % 256)
        out += bytes(line)
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pngs_are_read_whatever_their_filter(kind, channels):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9, channels)).astype(np.uint8)
    assert (I.png_pixels(encoded(pixels, kind)) == pixels.reshape(-1, channels)).all()


def test_palettes(spark):
    assert I.palette_counts(I.png_pixels(I.striped_png(1))) == [400] and I.palette_counts(I.png_pixels(I.striped_png(3))) == [140, 140, 120]
    assert sum(I.palette_counts(I.png_pixels(I.striped_png(5)))) == 400 and len(I.palette_counts(I.png_pixels(I.striped_png(5)))) == 4
    df = spark.createDataFrame([(bytearray(I.striped_png(2)),), (bytearray(b"no image"),), (None,), (bytearray(I.striped_png(2)[:60]),)], "c binary")
    assert [r.n for r in df.select(I.colors_of(F.col("c")).alias("n")).collect()] == [[200, 200], None, None, None]
