"""Rows with nulls stay in, and a goals model keeps its shared term when saved and loaded."""

from pyspark.sql import functions as F

from daybefore.plans import ml
from daybefore.sources import scans


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(1, 2019), (2, None), (3, 2020)], "id int, season int")
    assert {r["id"] for r in scans.excluding(df, "season", [2020]).collect()} == {1, 2}
    train, test = scans.holdout(df, "season", 2020)
    assert {r["id"] for r in train.collect()} == {1, 2} and {r["id"] for r in test.collect()} == {3}


def test_goals_payload_round_trip(spark, tmp_path):
    rows = [(i, float(i % 5), float(i % 3), i % 4, (i * 7) % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y double, home_score int, away_score int")
    model = ml.fit_goals(df, ["x", "y"], fixed_lambda3=0.25)
    payload = ml.Payload(model, ["x", "y"], "goals")
    assert payload.lambda3 == 0.25
    payload.save(spark, str(tmp_path / "p"))
    again = ml.load_payload(spark, str(tmp_path / "p"))
    assert again.lambda3 == 0.25
    both = model.rates(df).select("id", "lambda_home", "lambda3").join(
        again.model.rates(df).select("id", F.col("lambda_home").alias("h"), F.col("lambda3").alias("l")), "id").collect()
    assert all(abs(r["lambda_home"] - r["h"]) < 1e-12 and r["lambda3"] == r["l"] for r in both)
