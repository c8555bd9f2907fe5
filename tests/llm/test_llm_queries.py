import pytest

from loomspan.llm import plans

from ..test_queries import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)
