"""Paging guards."""

import pytest

from papyra.operators import lookup as LK


def test_page_guards(spark):
    df = spark.range(100).toDF("k")
    assert [r.k for r in LK.page(df, ["k"], 10, 5).collect()] == [10, 11, 12, 13, 14]
    assert LK.page(df, ["k"], 0, 0).count() == 0
    with pytest.raises(ValueError):
        LK.page(df, ["k"], -1, 5)
