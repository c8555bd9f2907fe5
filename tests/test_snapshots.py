import datetime as dt

from loomspan.operators.snapshots import snapshot_changes

SCHEMA = "key string, snap date, items array<string>, v int, idx int, digest string"


def changes(spark, rows):
    df = spark.createDataFrame([(k, d and dt.date(2025, 1, d), i, v, 0, "") for k, d, i, v in rows], SCHEMA)
    out = snapshot_changes(df, key="key", snapshot="snap", content="items", version="v")
    return sorted((r.snap.day, r.key, r.change) for r in out.collect())


def test_added_removed_changed(spark):
    rows = [
        ("a", 1, ["x", "y"], 1), ("a", 2, ["y", "x"], 1), ("a", 5, None, 1), ("a", 9, ["y", "x"], 1),
        ("b", 1, None, 1), ("b", 2, ["x"], 1), ("b", 5, [], 1),
        ("c", 1, ["x"], 1), ("c", 5, ["z"], 1), ("c", 9, ["x"], 1),
    ]
    assert changes(spark, rows) == [
        (2, "a", "changed"), (2, "c", "removed"), (5, "b", "changed"), (5, "c", "added"), (9, "b", "removed"), (9, "c", "changed"),
    ]


def test_stale_repeated_null_and_empty(spark):
    rows = [("a", 1, ["x"], 2), ("a", 1, ["old"], 1), ("a", 1, ["x"], 2), ("a", 2, ["x"], None), ("a", 2, ["y"], 1), (None, 2, ["q"], 1), ("a", None, ["q"], 1)]
    assert changes(spark, rows) == [(2, "a", "changed")]
    assert changes(spark, []) == []
    assert changes(spark, [("a", 1, ["x"], 1)]) == []
    assert changes(spark, [("a", 1, ["x", "y"], 1), ("a", 2, ["x,y"], 1)]) == [(2, "a", "changed")]
