import datetime as dt

import pytest

from loomspan.functions import text as X
from loomspan.functions import values as V
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize("text,n", [("", 0), ("  ", 0), ("abc", 1), ("One. Two! Three?", 3), ("v1.2 is out", 1), ("...", 1), ("A.\nB.", 2)])
def test_sentence_count(spark, text, n):
    assert one(spark, X.sentence_count, text) == n


def test_ratios(spark):
    assert one(spark, X.caps_ratio, "Hello world") == pytest.approx(0.1)
    assert one(spark, X.punctuation_ratio, "hi, there") == pytest.approx(1 / 9)
    assert one(spark, X.type_token_ratio, "the The cat") == pytest.approx(2 / 3)
    assert one(spark, X.emoji_density, "😀a") == 0.5 and one(spark, X.emoji_density, "") == 0.0
    assert one(spark, X.mid_sentence_caps_ratio, "We met Black Isle there. The Brotherhood of Steel won.") == pytest.approx(4 / 10)


def test_timestamps(spark):
    got = one(spark, X.timestamps, "at 5:30, 1:02:30 and 7:75 or 99:59")
    assert [(t.seconds, t.text) for t in got] == [(330, "5:30"), (3750, "1:02:30"), (5999, "99:59")]


@pytest.mark.parametrize("length,points", [(0, -5), (60, -5), (160, 0), (200, 1), (600, 5), (70, -4.5), (250, 1.5), (9000, 5)])
def test_effort(spark, length, points):
    assert one(spark, X.effort_points, length, "int") == points


@pytest.mark.parametrize("handle,n", [("alice1985", 0), ("JonasL", 0), ("VanillaSpooks", 0), ("docweidner", 0), ("user1234567", 1), ("user1234abc", 1), ("xJdkfknBzq", 2), ("abcfghjklm", 2), (None, 0)])
def test_botlike(spark, handle, n):
    assert len(one(spark, lambda c: X.botlike_reasons(F.coalesce(c, F.lit(""))), handle)) == n


def test_predicates(spark):
    assert one(spark, X.is_anti, "ALL CAPS SHOUTING") and one(spark, X.is_anti, "😀😀") and one(spark, X.is_anti, "https://x.test/a ") and not one(spark, X.is_anti, "nice video!") and not one(spark, X.is_anti, "")
    assert one(spark, X.is_mention, "​@x hi") and not one(spark, X.is_mention, "hi @x")
    assert one(spark, X.display_length, "see https://example.com/a/very/long/path now") == 4 + 20 + 4
    assert one(spark, X.is_hashtags, " #a #b ") and not one(spark, X.is_hashtags, "#a b")
    assert one(spark, X.is_separator, "----") and one(spark, X.is_separator, "") and not one(spark, X.is_separator, "-a-")
    assert one(spark, X.has_citation, "According to him") and not one(spark, X.has_citation, '"quoted"')


@pytest.mark.parametrize("iso,clock", [("PT5M30S", "5:30"), ("PT1H2M3S", "1:02:03"), ("PT0S", "0:00"), ("PT2H", "2:00:00"), (None, "0:00"), ("soon", "0:00")])
def test_durations(spark, iso, clock):
    assert one(spark, lambda c: V.clock(V.duration_seconds(c)), iso) == clock


def test_values(spark):
    assert [one(spark, V.to_bool, x) for x in ("Yes", "on", "no", " ", None)] == [True, True, False, None, None]
    assert [one(spark, V.to_int, x) for x in (" 7 ", "x", "", None)] == [7, None, None, None]
    assert one(spark, V.topic_category, "https://en.x.org/wiki/Video_game_culture") == "Video game culture"
    assert one(spark, V.one_line, "\ta\nb ") == "a b"
    assert [one(spark, V.age_label, n, "int") for n in (5, 40, 400, 730)] == ["5d", "1mo", "1y 1mo", "2y"]
    assert [one(spark, V.span_label, n, "int") for n in (59, 61, 3660, 90000)] == ["59s", "1m 1s", "1h 1m", "1d 1h"]
    assert [one(spark, lambda c: V.raise_effort(c, F.lit(2)), x) for x in ("none", "high", "other")] == ["low", "high", None]
    assert [one(spark, V.id_type, x) for x in ("UC" + "a" * 22, "PLabc", "abcdefghijk", "PLabcdefghi", "?")] == ["channel", "playlist", "video", "playlist", "unknown"]
    assert one(spark, V.handle_key, "@Name") == "name"
    assert [one(spark, V.detail_level, n, "int") for n in (600, 601, 3601, None)] == ["short", "medium", "long", "medium"]
    assert [one(spark, lambda c: V.call_cost(c, {"search": 100}), x) for x in ("search", "other")] == [100, 1]
    assert one(spark, V.error_label, "Timeout") == "error:Timeout"


def test_coerce(spark):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("b", T.BooleanType()), T.StructField("t", T.TimestampType()), T.StructField("s", T.StringType()), T.StructField("gone", T.StringType())])
    r = V.coerce(spark.createDataFrame([("4", "1", "2025-03-15T12:00:00Z", "  ", "extra")], "n string, b string, t string, s string, other string"), schema).collect()[0]
    assert (r.n, r.b, r.s, r.gone) == (4, True, None, None) and r.t == dt.datetime(2025, 3, 15, 12) and "other" not in r.__fields__
