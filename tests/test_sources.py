import json

from loomspan.functions.providers import asked, conversed
from loomspan.sources import mirror as S
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_documents_logs_files_and_pages(spark, tmp_path):
    docs = tmp_path / "docs" / "ab"
    docs.mkdir(parents=True)
    (docs / "a.json").write_text(json.dumps({"id": "a", "n": 1, "extra": 2}, indent=1))
    (docs / "b.json").write_text("{broken")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in S.read_documents(spark, str(tmp_path / "docs"), schema).collect()] == [("a", 1)]
    log = tmp_path / "log"
    S.append_log(spark.createDataFrame([("x",)], "id string").withColumn("at", F.lit("2025-01-01 10:00:00").cast("timestamp_ntz")), str(log), "at", "id")
    S.append_log(spark.createDataFrame([("y",)], "id string").withColumn("at", F.lit("2025-01-02 10:00:00").cast("timestamp_ntz")), str(log), "at", "id")
    assert sorted(r.id for r in S.read_log(spark, str(log)).collect()) == ["x", "y"]
    (tmp_path / "files").mkdir()
    for name in ("vid1.mp4", "vid1.txt", "vid2.mkv"):
        (tmp_path / "files" / name).write_bytes(b"12")
    assert [r.path.rsplit("/", 1)[-1] for r in S.find_files(spark, str(tmp_path / "files"), "vid1").collect()] == ["vid1.mp4"]
    feed = tmp_path / "feeds" / "f"
    feed.mkdir(parents=True)
    (feed / "first.json").write_text(json.dumps({"etag": "e1", "items": [1, 2], "nextPageToken": "t2"}))
    (feed / "t2.json").write_text(json.dumps({"etag": "e2", "items": [3]}))
    got = sorted((r.page, r.position, r.item) for r in S.read_pages(spark, str(tmp_path / "feeds")).collect())
    assert got == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3")]
    assert S.read_pages(spark, str(tmp_path / "feeds"), "e1").collect() == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2024), ("b", 2025)], "id string, y int").withColumn("at", F.make_timestamp_ntz(F.col("y"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    out = str(tmp_path / "years")
    S.write_by_year(rows, out, "at")
    S.write_by_year(rows.filter("id = 'b'").withColumn("id", F.lit("c")), out, "at")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "c"]
    S.archive_removed(rows, rows.filter("id = 'a'").withColumn("removed_at", F.col("at")), "id", str(tmp_path / "active"), str(tmp_path / "gone"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "active")).collect()] == ["b"] and spark.read.parquet(str(tmp_path / "gone")).count() == 1
    S.write_documents(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_providers(spark):
    rows = spark.createDataFrame([("k", 1, "um, hello"), ("k", 2, None), ("k", 3, "uh yes")], "k string, n int, p string")
    assert [r.answer for r in asked(rows, "k", "p").collect()] == ["hello", None, "yes"]
    assert [r.answer for r in conversed(rows, "k", "n", "p").orderBy("n").collect()] == ["hello", None, "yes"]
