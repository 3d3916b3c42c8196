"""Queries whose Python functions take whole texts get few of them at once."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

NAMES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize("name", ["b8_upright_names", "b9_plain_latex", "b12_place_formulas", "h4_word_error_rate"])
def test_texts_go_to_python_in_short_batches(spark, name):
    import __spark_entry__

    before = {n: spark.conf.get(n, None) for n in NAMES}
    try:
        for n in NAMES:
            spark.conf.unset(n)
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        sizes = F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "long")
        many = spark.range(0, 3000, 1, 1)
        assert many.select(sizes("id").alias("n")).agg(F.max("n")).collect()[0][0] == 1000
        long = many.where("id < 100").select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
        assert long.select(sizes("t").alias("n")).agg(F.max("n")).collect()[0][0] <= 17
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
