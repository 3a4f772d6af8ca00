import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quinhao import session
from quinhao.functions.money import half_even
from quinhao.functions.periods import bounds, in_month_of, in_period, month_name
from quinhao.session import fresh_path, release, shared_folder, stored


def test_half_even_is_numpy_rounding(spark):
    values = [0.125, 0.375, 0.575, 1.005, 2.675, 100.125, -0.125, 1e9 + 0.005, 24.36, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(half_even(F.col("x"))).collect()]
    assert got == list(np.round(values, 2))


def test_bounds():
    assert bounds(202102) == (dt.date(2021, 2, 1), dt.date(2021, 3, 1))
    assert bounds(202112) == (dt.date(2021, 12, 1), dt.date(2022, 1, 1))
    with pytest.raises(ValueError):
        bounds(202113)


def test_in_period_is_half_open_and_drops_nulls(spark):
    moments = ["2021-02-28 23:59:59", "2021-03-01", "2021-03-31 23:59:59", "2021-04-01", None]
    df = spark.createDataFrame([(m,) for m in moments], "m string")
    df = df.select(F.col("m").cast("timestamp_ntz").alias("d"))
    assert df.where(in_period(F.col("d"), 202103)).count() == 2
    assert df.where(in_period(F.col("d"), None)).count() == 4
    assert df.where(in_month_of(F.col("d"), dt.date(2021, 3, 15))).count() == 2


def test_month_of_today(spark):
    df = spark.sql("SELECT CAST(current_date() AS TIMESTAMP_NTZ) AS d")
    df = df.union(df.select(F.add_months("d", -1).cast("timestamp_ntz")))
    assert df.where(in_month_of(F.col("d"), None)).count() == 1


def test_month_name(spark):
    df = spark.sql("SELECT 202103 AS p UNION ALL SELECT 199912").select(month_name(F.col("p")))
    assert {r[0] for r in df.collect()} == {"Março", "Dezembro"}


def test_stored_tables_are_in_the_shared_folder_and_go(spark):
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(28,2)) AS a, 'x' AS b, CAST(NULL AS INT) AS c")
    with stored(df, "t") as there:
        (file,) = there.inputFiles()
        assert there.dtypes == df.dtypes and there.collect() == df.collect()
        assert shared_folder(spark).split(":")[-1] in file
        assert os.path.exists(file.removeprefix("file:").replace("///", "/"))
    assert not os.path.exists(file.removeprefix("file:").replace("///", "/"))


def test_release_removes_what_was_left(spark):
    mine = [fresh_path(spark, "left") for _ in range(2)]
    for path in mine:
        spark.range(3).write.parquet(path)
    others = session._made[spark.sparkContext.applicationId][:-2]
    session._made[spark.sparkContext.applicationId] = mine[:]
    release(spark)
    session._made[spark.sparkContext.applicationId] = others
    assert not any(os.path.exists(path.removeprefix("file:")) for path in mine)
