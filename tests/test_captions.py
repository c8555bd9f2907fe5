import pytest

from loomspan.operators.captions import captions, in_seconds
from loomspan.plans.transcripts import QUERIES

from .conftest import SF


@pytest.mark.parametrize("chunk", [
    "5: Hi all\n65: bye", "0:05 | Hi all\n1:05 | bye", "[0:05] Hi all\n[1:05] bye", "(5.0 s) Hi all\n(65.5 s) bye", "0:05 Hi\nall\n1:05 bye",
    "1\n00:00:05,000 --> 00:00:07,000\nHi all\n\n2\n00:01:05,500 --> 00:01:09,000\nbye",
])
def test_every_notation(chunk):
    assert in_seconds(chunk) == "5: Hi all\n65: bye"


def test_text_without_marks_stays():
    assert in_seconds("no marks") == "no marks" and in_seconds("") == "" and in_seconds(None) is None


@pytest.mark.parametrize("name", ["chunk_merge_trim", "last_paragraphs"])
def test_all_chunks_are_read(spark, name):
    rows = spark.read.parquet(f"{SF}/transcripts.parquet").filter("transcript_chunk IS NOT NULL").select("video_id", "chunk_id").distinct()
    assert sorted(map(repr, QUERIES[name](spark, SF).select("video_id", "chunk_id").collect())) == sorted(map(repr, rows.collect()))


def test_all_videos_are_interleaved(spark):
    rows = spark.read.parquet(f"{SF}/transcripts.parquet").filter("transcript_chunk != ''").select("video_id").distinct()
    assert {r.video_id for r in rows.collect()} <= {r.video_id for r in QUERIES["interleave_headings"](spark, SF).filter("is_text = 1").select("video_id").distinct().collect()}


def test_last_mark_after_a_pause_stays():
    assert captions("0:05 one\n0:09 two\n3:00 after the music") == [(5000, "one"), (9000, "two"), (180000, "after the music")]
    assert captions("0:05 one\n59:00 was when\n0:09 two") == [(5000, "one 59:00 was when"), (9000, "two")]
