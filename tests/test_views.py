import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from bridge import registry, views
from daybefore.functions import scores


def test_skater_log_tasks_grow_with_the_lines(spark, tmp_path, monkeypatch):
    """Past some lines a task, joining and adding up the log takes more tasks, for the same rows."""
    at = dt.datetime(2020, 1, 1)
    orders = [(k, k % 97 if k % 11 else None, "F", 1000.0 + k, at + dt.timedelta(days=k % 700), "1-URGENT") for k in range(300)]
    lines = [(k, k * 7 + n, (k + n) % 13, n, float(n)) for k in range(300) for n in [*range(1, 6), 5]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "LINES", 1 << 40)
    few = views.Views(spark, str(tmp_path)).skaters
    monkeypatch.setattr(views, "LINES", 100)
    many = views.Views(spark, str(tmp_path)).skaters
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count()
    assert many.rdd.getNumPartitions() == 18 > few.rdd.getNumPartitions()


def test_rounding_by_arithmetic_equals_round(spark):
    rng = np.random.default_rng(3)
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1 / 128, -1 / 128, 0.0084375, -3e-9, 5e-7, 1e9, 999999.9, -1e20,
              *(rng.choice([-1, 1], 20_000) * 10.0 ** rng.uniform(-12, 12, 20_000)).tolist(), *(rng.integers(-9999, 9999, 5_000) / 128).tolist()]
    x = F.col("x").cast("float").cast("double")
    got = spark.createDataFrame([(v,) for v in values], "x double").select(F.round(x, 6).alias("want"), registry.round_six(x).alias("got"))
    assert [tuple(map(str, r)) for r in got.collect() if str(r["want"]) != str(r["got"])] == []


def test_grids_leave_python_without_a_row_each(spark):
    """Arrays go to Spark as one Arrow list; rows without a rate have neither grid nor figures."""
    df = spark.createDataFrame([(1, 2.5, 3.0, 0.2), (2, None, 3.0, 0.2), (3, 1.0, float("nan"), None)], "k long, h double, a double, s double")
    got = {r["k"]: r for r in scores.score_distribution(df, "h", "a", "s").collect()}
    assert len(got[1]["grid"]) == 121 and abs(sum(got[1]["grid"]) - 1) < 1e-12 and got[1]["most_likely_home"] in range(11)
    assert all(got[k][c] is None for k in (2, 3) for c in ("grid", "p_home_win", "p_tie", "expected_away", "most_likely_home"))


def test_the_skater_log_writes_no_other_table(spark, monkeypatch):
    """Queries on skaters alone don't compute the standings."""
    from bridge import views
    kept = []
    monkeypatch.setattr(views, "written", lambda df: kept.append(df.columns) or df)
    log = views.Views(spark, "/root/testdata/sf0.001").skater_log
    assert len(kept) == 1 and "toi_sec" in kept[0] and "rolling_toi_sec" in log.columns
