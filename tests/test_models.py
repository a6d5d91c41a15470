"""Metrics, splits, ranks, sampling, preparation and learners."""

import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalog import learner_queries
from tidemark.catalog.registry import QUERIES
from tidemark.operators import evaluation, learners, preparation, running, splits
from tidemark.operators.clustering import density_clusters
from tidemark.plans import experiments


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, score double, y int")


def test_metrics_with_ties_and_one_class(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.8, 1), ("a", 0.4, 0), ("a", 0.3, 1), ("a", 0.1, 0),
            ("b", 0.5, 1), ("b", 0.7, 1), ("c", 0.5, 1), ("c", 0.5, 0), (None, 0.5, 1)]
    got = {r.g: r for r in evaluation.ranking_metrics(scored(spark, rows), "score", "y", ["g"]).collect()}
    assert set(got) == {"a", "c"}
    assert abs(got["a"].auroc - 6.5 / 9) < 1e-12 and abs(got["a"].auprc - (1 + 2 / 3 + 3 / 5) / 3) < 1e-12
    assert got["c"].auroc == 0.5 and got["c"].auprc == 0.5 and got["c"].brier == 0.25
    assert abs(got["a"].spec_at_sens - 1 / 3) < 1e-12


def test_metrics_of_one_large_group_match_brute_force(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(1500)]
    got = {r.g: r for r in evaluation.ranking_metrics(scored(spark, rows), "score", "y", ["g"], slots=7).collect()}
    for g in "ab":
        pos = [s for k, s, y in rows if k == g and y]
        neg = [s for k, s, y in rows if k == g and not y]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert abs(got[g].auroc - wins / len(pos) / len(neg)) < 1e-9


def test_sensitivity_reached_exactly(spark):
    rows = [("a", 1 - i / 100, 1) for i in range(9)] + [("a", 0.5, 0), ("a", 0.4, 1), ("a", 0.3, 0)]
    got = evaluation.ranking_metrics(scored(spark, rows), "score", "y").first()
    assert got.spec_at_sens == 1.0


def test_percentiles_and_ranks_survive_any_slots(spark):
    rng = random.Random(2)
    data = [(i, float(rng.choice([1, 1, 1, 2, 7, rng.randint(0, 50)]))) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(data, "i long, x double")
    values = sorted(x for _, x in data if x is not None)

    def linear(q):
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    for slots in (1, 3, 40):
        row = running.exact_percentiles(df, ["x"], {"a": 0.1, "b": 0.5, "c": 0.97, "d": 1.0}, slots).first()
        assert all(abs(row[n] - linear(q)) < 1e-9 for n, q in (("a", 0.1), ("b", 0.5), ("c", 0.97), ("d", 1.0)))
    ranked = running.hash_ranked(df, 5, ["i"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 502))


def test_sample_is_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "i")
    one = {r.i for r in running.hash_sample(df, 100, 42, ["i"]).collect()}
    two = {r.i for r in running.hash_sample(df.repartition(13), 100, 42, ["i"]).collect()}
    assert one == two and len(one) == 100
    assert running.hash_sample(df, 9999, 42, ["i"]).count() == 5000


def test_cutoff_and_fraction_splits(spark):
    df = spark.createDataFrame([(1, 2180), (2, 2181), (3, None)], "id long, y int")
    assert {r.id: r.side for r in splits.split_by_cutoff(df, "y", 2180).collect()} == {1: "train", 2: "test"}
    rng = random.Random(4)
    for years in ([2000] * 37, [2000 + rng.randint(0, 3) for _ in range(101)]):
        rows = list(zip(rng.sample(range(1000), len(years)), years))
        got = splits.split_by_fraction(spark.createDataFrame(rows, "id long, y int"), "y", "id", 0.8).collect()
        want = {i for _, i in sorted((y, i) for i, y in rows)[: int(0.8 * len(rows))]}
        assert {r.id for r in got if r.side == "train"} == want and len(got) == len(rows)


def test_stratified_sides_are_complete(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "id long, y int")
    got = splits.stratified_split(df, "y", ["id"]).collect()
    assert len({r.id for r in got}) == 200
    assert sum(r.side == "test" and r.y == 1 for r in got) == 5 and sum(r.side == "test" and r.y == 0 for r in got) == 15
    folds = splits.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r.y == 1} == {10}


def test_preparation(spark):
    rows = [(1, "1", 5.0, "a"), (2, "x", 5.0, None), (3, "3", 5.0, "b"), (4, None, 5.0, "a")]
    train = spark.createDataFrame(rows, "id long, n string, c double, k string")
    ready = preparation.Preparation(["n", "c"], ["k"]).fit(train)
    assert ready.medians == {"n": 2.0, "c": 5.0}
    test = spark.createDataFrame([(9, "2", 6.0, "never seen")], "id long, n string, c double, k string")
    vector = ready.apply(test).select(vector_to_array("features").alias("v")).first().v
    assert vector == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_risk_coverage_keeps_ties(spark):
    rows = [("a", 0.5, 1)] * 5 + [("a", 0.1, 0)] * 5
    got = {r.coverage: r.n for r in evaluation.risk_coverage(scored(spark, rows), "score", "y").collect()}
    assert got == {1.0: 10, 0.9: 10, 0.8: 10, 0.7: 10, 0.6: 10}


def toy(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, x, z, int(x + 0.3 * rng.gauss(0, 1) > 0.5)))
    df = spark.createDataFrame(rows, "id long, x double, z double, y int")
    return preparation.Preparation(["x", "z"], []).fit(df).apply(df)


def test_calibrated_models_and_importance(spark):
    df = toy(spark)
    train, test = df.filter("id < 300"), df.filter("id >= 300")
    for method, model in (("sigmoid", learners.logistic(weightCol="weight")),
                          ("isotonic", learners.forest(weightCol="weight", numTrees=5, maxDepth=3))):
        out = learners.calibrated_scores(train, test, model, "y", ["id"], method, 2)
        assert out.count() == 100 and out.filter(~F.col("score").between(0, 1)).count() == 0
        assert evaluation.ranking_metrics(out, "score", "y").first().auroc > 0.8
    fitted = learners.boosted(maxIter=5, maxDepth=2).fit(train.withColumn("label", F.col("y").cast("double")))
    loss = {r.feature: r.importance for r in learners.permutation_importance(fitted, test, "y", ["x", "z"], ["id"]).collect()}
    assert loss["x"] > 0.1 and abs(loss["z"]) < 0.1


def test_clusters_and_noise(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() * 2, rng.random() * 2]) for i in range(60)] + [(100 + i, [10 + rng.random(), 10.0]) for i in range(20)]
    rows += [(200, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "id long, at array<double>")
    got = {r.id: r.topic for r in density_clusters(df, "at", 1.0, 3, 10).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[100 + i] for i in range(20)} == {1} and got[200] == -1


def test_registered_models_run_the_operators_own_settings(monkeypatch):
    called = {}
    monkeypatch.setattr(learner_queries, "split_table", lambda *a: "split")
    monkeypatch.setattr(learner_queries, "cut_lineage", lambda df: df)
    monkeypatch.setattr(experiments, "prepared_sides", lambda *a: ("train", "test", "preparation"))
    monkeypatch.setattr(experiments, "model_comparison", lambda df: df)
    for name in ("subgroup_trends", "model_predictions", "selective_prediction", "importance"):
        monkeypatch.setattr(experiments, name, lambda *a, name=name, **kw: called.setdefault(name, []).append((a, kw)))
    for name in ("subgroup_trends", "model_predictions", "model_compare", "selective_prediction", "perm_importance"):
        QUERIES[name](None, None)
    assert called.pop("subgroup_trends")[0][1] == {}
    assert called == {
        "model_predictions": [(("train", "test"), {})] * 2,
        "selective_prediction": [(("split",), {})],
        "importance": [(("train", "test", "preparation"), {})],
    }


def test_jobs_run_together_and_keep_their_order(spark):
    import threading

    from tidemark.operators.learners import together

    gate = threading.Barrier(3, timeout=60)  # opens only when all three run

    def count(n):
        gate.wait()
        return spark.range(n).count()

    assert together([lambda n=n: count(n) for n in (5, 3, 9)]) == [5, 3, 9] and together([]) == []


def test_importance_scores_every_case_once(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT

    df = toy(spark, 60)
    scored_rows = spark.sparkContext.accumulator(0)

    class Counted:
        def transform(self, cases):
            def score(v):
                scored_rows.add(1)
                p = 1 / (1 + 2.718 ** -float(v[0]))
                return Vectors.dense([1 - p, p])

            return cases.withColumn("probability", F.udf(score, VectorUDT())("features"))

    got = learners.permutation_importance(Counted(), df, "y", ["x", "z"], ["id"]).collect()
    assert {r.feature: r.importance > 0.1 for r in got} == {"x": True, "z": False}
    assert scored_rows.value == 60 * 3


def test_predictions_fit_their_models_together_and_deal_out_the_scoring(spark, monkeypatch):
    import threading

    gate = threading.Barrier(3, timeout=60)  # opens only when all three kinds are being fitted

    def fitted(output):
        gate.wait()
        return lambda df: df.withColumn(output, F.lit(0.5))

    monkeypatch.setattr(learners, "plain_model", lambda train, estimator, label, output: fitted(output))
    monkeypatch.setattr(learners, "calibrated_model", lambda *a, output, **kw: fitted(output))
    test = spark.range(20).selectExpr("id AS stay_id", f"0 AS {experiments.TARGET}").coalesce(1)
    got = experiments.model_predictions(test, test)
    assert got.columns == ["stay_id", "target", "pred_logistic", "pred_random", "pred_xgboost"] and got.count() == 20
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
