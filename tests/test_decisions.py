"""The running table of decisions against one pass over the log."""

import random

from pyspark.sql import functions as F

from veritrail.plans import decisions as D
from veritrail.plans.review import latest_decision

LOG = "case_id long, claim_id long, decision string, note string, at long"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("updated_at", F.timestamp_seconds("at")).drop("at")


def shown(df):
    return sorted(tuple(x) for x in df.select("case_id", "claim_id", "decision", "note", "updated_at").collect())


def test_any_split_of_the_log(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(D, "FULL", 3)
    rng = random.Random(7)
    rows = [(rng.randint(1, 3), rng.randint(1, 40), rng.choice(["EDIT", "HOLD", "NONE"]), rng.choice("abc"), rng.randint(1, 9)) for _ in range(300)]
    rng.shuffle(rows)
    table = D.DecisionTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    cuts = [0, 1, 40, 41, 120, 200, 299, 300]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        table.merge(log_of(spark, rows[a:b]), k + 1)
        assert shown(table.current()) == shown(latest_decision(log_of(spark, rows[:b])))
    before = shown(table.current())
    table.merge(log_of(spark, [(1, 1, "DELETE", "z", 99)]), 5)  # a batch that was there already
    assert shown(table.current()) == before
    table.merge(log_of(spark, rows[:50]), 20)  # decisions that come twice, late
    assert shown(table.current()) == before


def test_a_batch_touches_its_buckets_alone(spark, tmp_path):
    table = D.DecisionTable(spark, str(tmp_path / "t"))
    table.merge(log_of(spark, [(1, k, "EDIT", "", 1) for k in range(200)]), 1)
    table.merge(log_of(spark, [(1, 5, "HOLD", "", 2)]), 2)
    assert spark.read.parquet(str(tmp_path / "t/rows/version=2")).count() < 20
    assert spark.read.parquet(str(tmp_path / "t/heads/version=2")).count() == 1
    # a version that was not finished is no version
    spark.read.parquet(str(tmp_path / "t/rows/version=2")).write.parquet(str(tmp_path / "t/rows/version=3"))
    assert table._last() == 2 and table.current().count() == 200


def test_a_stream_that_is_stopped_and_goes_on(spark, tmp_path):
    rows = [(1, k % 50, "EDIT" if k % 2 else "HOLD", str(k), k * 7 % 100) for k in range(200)]
    table = D.DecisionTable(spark, str(tmp_path / "t"))
    schema = log_of(spark, rows[:1]).schema
    for part in range(2):
        for k in range(3):
            log_of(spark, rows[part * 100 + k :: 3][:33]).coalesce(1).write.parquet(str(tmp_path / f"log/{part}-{k}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
        table.follow(stream, str(tmp_path / "c")).awaitTermination()
        whole = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(str(tmp_path / "log"))
        assert shown(table.current()) == shown(latest_decision(whole))
