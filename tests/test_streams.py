import pytest

from loomspan.plans.flows import QUERIES
from pyspark.sql import functions as F

from .conftest import SF


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The events in no order over some hundreds of files."""
    folder = str(tmp_path_factory.mktemp("scattered"))
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartitionByRange(330, F.rand(7)).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_usage", "stream_admission"])
def test_many_files_give_the_same(spark, scattered, name):
    want = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    assert want and sorted(map(repr, QUERIES[name](spark, scattered).collect())) == want


def test_admission_does_not_depend_on_arrow_batches(spark, scattered):
    want = sorted(map(repr, QUERIES["stream_admission"](spark, SF).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(repr, QUERIES["stream_admission"](spark, scattered).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
