import datetime as dt
import random

import pytest

from loomspan.functions import values as V
from loomspan.operators import blocks as B
from loomspan.operators import changes as C
from loomspan.operators import chapters as H
from loomspan.operators import limits as L
from loomspan.operators import media as M
from loomspan.operators import parsing as P
from loomspan.operators import quality as Q
from loomspan.session import shared_folder
from pyspark.sql import functions as F


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def test_numbered_in_blocks_equals_plain_rank(spark):
    rnd = random.Random(0)
    rows = [(f"g{rnd.randrange(3)}", rnd.choice([None, *range(50)]), f"t{n:03d}") for n in range(300)]
    out = Q.numbered(spark.createDataFrame(rows, "g string, p int, t string"), "g", "p", "t", block=7).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {(r.t, r["rank"], r["size"]) for r in out if r.g == g} == {(t, n, len(mine)) for n, (_, _, t) in enumerate(mine)}


def test_relevance_of_eighteen(spark):
    rows = [(f"c{n:02d}", "v", None, n) for n in range(18)]
    out = Q.relevance(spark.createDataFrame(rows, "comment_id string, video_id string, parent_id string, ordinal int")).orderBy("rank").collect()
    assert [r.points for r in out] == [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]


def test_blocks(spark):
    def split(text):
        return spark.createDataFrame([(text,)], "x string").select(B.split_blocks(F.col("x")).alias("b")).collect()[0].b

    assert split("short one\nshort two\nrest\n\nmore") == ["short one", "short two", "rest", "more"]
    assert split("x" * 130 + "\nsecond\n----\na\nb") == ["x" * 130 + "\nsecond", "----", "a\nb"]
    assert split("x" * 130 + "\n\nHeader\n====\nline a\nline b\n***\nend") == ["x" * 130, "Header", "====", "line a\nline b", "***", "end"]
    assert split("x" * 130 + "\n====\nHeader\n----\nline a\nline b") == ["x" * 130, "====", "Header\n----\nline a\nline b"]
    assert split("x" * 130 + "\n#a #b\ntail") == ["x" * 130, "#a #b", "tail"] and split("") == [] and split(None) is None


def test_boilerplate_is_removed_but_prose_and_times_stay(spark):
    body = "https://x.test follow\n\nplain words repeated\n\n0:00 https://x.test start\n\n====\n\n"
    rows = [(f"v{n}", "c", body + f"own text {n} https://x.test/{n}") for n in range(3)] + [("w", None, body), ("z", "c", None)]
    df = spark.createDataFrame(rows, "video_id string, channel_id string, description string")
    got = {r.video_id: r.description for r in B.strip_boilerplate(df).collect()}
    assert got["v0"] == "plain words repeated\n\n0:00 https://x.test start\n\n====\n\nown text 0 https://x.test/0"
    assert got["w"].startswith("https://x.test follow") and got["z"] is None
    assert {r.video_id: r.unique_length for r in B.unique_length(df).collect()}["v0"] == len("own text 0 https://x.test/0")


def test_lists_and_refresh(spark):
    assert C.merge_ordered(["a", "b", "c"], ["b", "x", "c", "d"]) == ["a", "b", "x", "c", "d"] and C.merge_ordered(None, ["a", "a"]) == ["a"]
    assert C.drops_anything(["a", "b"], ["a"]) and not C.drops_anything(["a"], ["z", "a"])
    make = lambda rows: spark.createDataFrame(rows, "g string, v string, t timestamp_ntz")
    old, new = make([("g", "a", at(1)), ("g", "b", at(5)), ("h", "c", at(9))]), make([("g", "b", at(5)), ("g", "d", at(8))])
    assert sorted(r.v for r in C.refreshed_uploads(old, new, "g", "t").collect()) == ["a", "b", "c", "d"]


def test_versions_weeks_and_edits(spark):
    rows = [("v", n, t, at(n * 86400)) for n, t in enumerate(["a", "a", "b", None, "c"])]
    df = spark.createDataFrame(rows, "id string, n int, title string, t timestamp_ntz")
    assert [(r.version, r.title) for r in C.versions_archived(df, ["id"], ["t"], ["title"]).orderBy("version").collect()] == [(1, "a"), (2, "b"), (3, None)]
    assert [r.n for r in C.consecutive(df, ["id"], ["t"], ["title"]).filter("changed").orderBy("n").collect()] == [2, 3, 4]
    weekly = C.weekly_archive(df, ["id"], ["t"], ["title"], "t").collect()
    assert [(r.week, r.title) for r in weekly] == [(1, "a")]
    up = C.upsert(spark.createDataFrame([("a", 1, at(1), at(2)), ("b", 1, at(1), at(2))], "id string, n int, f timestamp_ntz, l timestamp_ntz"), spark.createDataFrame([("a", 2, at(4), at(5))], "id string, n int, f timestamp_ntz, l timestamp_ntz"), "id", "l", first="f", last="l")
    assert sorted((r.id, r.n, r.f, r.l) for r in up.collect()) == [("a", 2, at(1), at(5)), ("b", 1, at(1), at(2))]


def test_budget_and_pages(spark):
    rows = [("g", n, n % 3 == 0) for n in range(12)]
    df = spark.createDataFrame(rows, "g string, n int, w boolean")
    assert sorted(r.n for r in C.within_budget(df, ["g"], ["n"], "w", 2).collect()) == [0, 1, 2, 3]
    assert sorted(r.n for r in C.whole_pages(df.withColumn("p", F.floor(F.col("n") / 5)), ["g"], "p", 6).collect()) == list(range(10))


def test_gate():
    g = L.Gate((((60, 3),), None))
    for t in range(3):
        assert g.free_at(t * 10**6, 1) == t * 10**6
        g.admit(t * 10**6, 1, 0)
    assert g.free_at(10 * 10**6, 1) == 60 * 10**6 + 1 and g.free_at(61 * 10**6, 1) == 61 * 10**6
    assert g.free_at(0, 4) is None
    day = L.Gate((((86400, 5),), "America/Los_Angeles"))
    us = int(dt.datetime(2025, 3, 15, 12, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    day.admit(us, 5, 0)
    midnight = int(dt.datetime(2025, 3, 16, 7, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    assert day.free_at(us, 1) == midnight


def test_replay_never_exceeds_a_window(spark):
    rnd = random.Random(3)
    rows = [(n, rnd.choice("ab"), at(rnd.randrange(400)), rnd.choice([1, 2]), rnd.randrange(2000)) for n in range(150)]
    log = spark.createDataFrame(rows, "id long, bucket string, requested_at timestamp_ntz, cost long, held_ms long")
    specs = {b: (((10, 3), (60, 8)), None) for b in "ab"}
    got = L.replay(log, specs).collect()
    cost = {r[0]: r[3] for r in rows}
    assert len(got) == 150 and all(g.admitted_at is not None for g in got)
    for b in "ab":
        mine = [(g.admitted_at, cost[g.id]) for g in got if g.bucket == b]
        for t, _ in mine:
            for seconds, most in specs[b][0]:
                assert sum(c for x, c in mine if t - dt.timedelta(seconds=seconds) <= x <= t) <= most


def test_window_usage_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(n, rnd.choice("ab"), at(rnd.randrange(3 * 86400)), 1 + n % 3, rnd.choice(["ok", None, "abandoned"])) for n in range(200)]
    out = L.window_usage(spark.createDataFrame(rows, "id long, bucket string, requested_at timestamp_ntz, cost long, outcome string"), (3600, 86400)).collect()
    assert len(out) == 200
    for r in out:
        for n in (3600, 86400):
            assert r[f"used_{n}"] == sum(c for _, b, t, c, o in rows if b == r.bucket and o != "abandoned" and r.requested_at - dt.timedelta(seconds=n) <= t <= r.requested_at)


def test_chapters(spark):
    text = "▶ 0:00 - Intro\n[5:30] Middle\n(1:02:03)\nThe end\nno time\n• 2:00: x"
    got = spark.createDataFrame([(text,)], "x string").select(H.chapter_marks(F.col("x")).alias("c"), H.rewritten_marks(F.lit("0:00 A\n1:05 B")).alias("r")).collect()[0]
    assert [(c.offset, c.title) for c in got.c] == [(0, "Intro"), (330, "Middle"), (3723, "The end"), (120, "x")]
    assert got.r == "[ts 0] 0:00 A\n[ts 65] 1:05 B"
    df = spark.createDataFrame([("v", s) for s in (0, 299, 300, 330, 600, 10**6)], "k string, s int")
    chapters = spark.createDataFrame([("v", 0), ("v", 300), ("v", 600)], "k string, offset int")
    assert {r.s: r.chapter_no for r in H.chapter_at(df, chapters, "k", "s").collect()} == {0: 0, 299: 0, 300: 1, 330: 1, 600: 2, 10**6: 2}


def test_greedy_chapter_merge():
    assert H.merge_chapters([(10, 2, "a"), (100, 3, "b"), (110, 2, "c")], [(0, "Start"), (105, "Mid"), (400, "Far")], None) == ([(0, 2, "Start"), (100, 3, "b"), (110, 2, "Mid")], [(400, "Far")])
    assert H.merge_chapters([], [(0, "S"), (95, "E")], 100) == ([(0, 2, "S"), (100, 2, "E")], [])
    assert H.merge_chapters([(20, 2, "a"), (180, 2, "b")], [], 200) == ([(0, 2, "a"), (200, 2, "b")], [])
    assert H.merge_chapters([(20, 2, "a")], [], 30) == ([(0, 2, "a")], [])
    # A heading made for a bookend may be taken again.
    assert H.merge_chapters([(500, 2, "x")], [(0, "S"), (20, "T")], None) == ([(0, 2, "T"), (500, 2, "x")], [])


def test_chunks(spark):
    chunks = [("v", 0, "0: a\n5: b\n9: c"), ("v", 1, "5: b\n9: c\n## head\n12: d"), ("v", 2, "no second"), ("v", 3, "")]
    out = H.trimmed_chunks(spark.createDataFrame(chunks, "k string, n int, t string"), "k", "n", "t").orderBy("n").collect()
    assert [r.t for r in out] == ["0: a", "5: b\n9: c\n12: d", "no second", ""]
    rows = H.chunk_windows(spark.range(800).select(F.col("id").cast("int").alias("p")), "p").groupBy("chunk_no").count().collect()
    assert {r.chunk_no: r["count"] for r in rows} == {0: 400, 1: 400, 2: 60}


def test_parsing(spark):
    text = "junk\n=== Any Name ===\na\n```\n## SPEAKERS\nAnn | host\nBob | guest | tall | extra\nOTHER:\nENTITIES:\nann | person |\n=== SPEAKERS ===\nCid"
    row = spark.createDataFrame([(text,)], "x string").select(P.sections(F.col("x")).alias("s"), P.extraction(F.col("x")).alias("e")).collect()[0]
    assert row.s == {"ANY_NAME": "a", "ENTITIES": "ann | person |", "SPEAKERS": "Cid"}
    assert row.e.speakers == [("Cid", "", "")] and row.e.entities[0].category == "person" and row.e.episode is None and row.e.sources == []
    e = spark.createDataFrame([("COVERAGE: Partial\nGAPS:\n- one\ntwo\nVALUE: insight: 4\nVERDICT: please score",)], "x string").select(P.evaluation(F.col("x")).alias("e")).collect()[0].e
    assert (e.coverage, e.gaps, e.insight, e.novelty, e.verdict) == ("partial", ["one", "two"], 4, None, "score")
    p = spark.createDataFrame([("A_B: 1\nx\nA_B: 2",)], "x string").select(P.prefixed(F.col("x")).alias("p")).collect()[0].p
    assert p == {"a_b": "2"}


def test_media(spark):
    rows = [("k", "/a", 2, True, False), ("k", "/b", 1, False, True), ("k", "/c", 3, True, None), ("k", "/a", 9, True, True)]
    df = M.distinct_pointers(spark.createDataFrame(rows, "k string, path string, added int, exists boolean, has_video boolean"), "k").withColumn("has_audio", F.lit(True))
    assert sorted((r.path, r.to_probe) for r in df.collect()) == [("/a", False), ("/b", True), ("/c", False)]
    assert [r.path for r in M.usable_pointer(df, "k", video=True, audio=False).collect()] == ["/c"]
    s = spark.createDataFrame([([("audio", "aac", None, None, 2), ("video", "h264", 640, 480, None)], [90, 8, 2])], "s array<struct<codec_type:string,codec_name:string,width:int,height:int,channels:int>>, c array<bigint>")
    r = s.select(M.probe(F.col("s")).alias("p"), M.significant_colors(F.col("c")).alias("n")).collect()[0]
    assert (r.p.video_codec, r.p.audio_codec, r.p.width, r.n) == ("h264", "aac", 640, 2)


def test_content_hash_ignores_the_order_of_lists_and_maps(spark):
    schema = "k string, n int, tags array<string>, m map<string,struct<url:string>>, s struct<a:array<int>>"
    rows = [("a", 1, ["x", "y"], {"p": ("1",), "q": ("2",)}, ([1, 2],)), ("a", 2, ["y", "x"], {"q": ("2",), "p": ("1",)}, ([2, 1],)), ("a", 3, ["y"], {"q": ("2",), "p": ("1",)}, ([2, 1],)), ("a", 4, None, None, None), ("a", 5, None, None, None)]
    out = C.consecutive(spark.createDataFrame(rows, schema), ["k"], ["n"], ["tags", "m", "s"]).orderBy("n").collect()
    assert [r.changed for r in out] == [None, False, True, True, False]


def test_unknown_schema_versions_fail(spark):
    rows = [("a", v, "7", "b", None) for v in (None, 0, 1, 2)]
    schema = "channel_id string, schema_version int, video_count string, banner_external_url string, status string"
    out = V.migrated(spark.createDataFrame(rows, schema)).collect()
    assert [(r.schema_version, r.migrated, r.uploads_count) for r in out] == [(2, True, "7")] * 3 + [(2, False, "7")]
    with pytest.raises(Exception, match="unknown schema version: 3"):
        V.migrated(spark.createDataFrame([("a", 3, "7", "b", None)], schema)).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def plain_tail(lines, oldest, offset):
    for i, t in enumerate(list(reversed(lines))[offset:], start=offset):
        if t <= oldest:
            return lines[len(lines) - i :] if i else lines
    return lines


def test_log_tail_against_a_plain_loop(spark):
    rnd = random.Random(2)
    for _ in range(6):
        times = sorted(rnd.randrange(20) for _ in range(rnd.choice([0, 1, 5, 12])))
        df = spark.createDataFrame([(n, t) for n, t in enumerate(times)], "n int, t int")
        for oldest in (-1, 7, 30):
            for offset in (0, 2):
                got = [r.t for r in C.log_tail(df, ["n"], "t", str(oldest), offset).orderBy("n").collect()]
                assert got == plain_tail(times, oldest, offset)
