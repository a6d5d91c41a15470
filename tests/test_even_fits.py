"""Fits read the rows of a larger table in equal tasks."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import learners, parallel


class Noted:
    """Stands for an estimator; keeps how many rows each task had."""

    def __init__(self):
        self.sizes = []

    def copy(self):
        return self

    def fit(self, df):
        self.sizes.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return SimpleNamespace(transform=lambda rows: rows.withColumn("rawPrediction", F.array(F.lit(0.5), F.col("x"))))


def uneven(spark):
    rows = spark.range(1200).coalesce(1).union(spark.range(1200, 1203).coalesce(1))
    return rows.selectExpr("id", "double(id % 7) AS x", "int(id % 2) AS y")


def test_rows_of_a_fit_are_in_equal_tasks(spark, monkeypatch):
    monkeypatch.setattr(parallel, "FEW_ROWS", 100)
    monkeypatch.setattr(learners, "vector_to_array", lambda v: v)
    plain, folds = Noted(), Noted()
    learners.plain_model(uneven(spark), plain, "y")
    model = learners.calibrated_model(uneven(spark), folds, "y", ["id"], folds=3)
    for sizes, rows in [(plain.sizes[0], 1203), *[(s, 802) for s in folds.sizes]]:
        assert abs(sum(sizes) - rows) <= 2 and len(sizes) > 1 and max(sizes) < 1.5 * min(sizes)
    assert len(folds.sizes) == 3 and model(uneven(spark)).count() == 1203


@pytest.mark.parametrize("rows, parts", [(50, 1), (101, None)])
def test_only_larger_tables_are_dealt_out(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(parallel, "FEW_ROWS", 100)
    df = spark.range(rows).coalesce(1)
    got = parallel.even(df)
    assert (got is df) == (parts == 1) and sorted(r.id for r in got.collect()) == list(range(rows))


def test_forest_keeps_the_nodes_of_its_rows(spark):
    assert learners.forest().getCacheNodeIds() and not learners.forest(cacheNodeIds=False).getCacheNodeIds()
