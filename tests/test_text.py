"""Text expressions, rules, relabelling and topic operators on hand-made rows."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from tidemark import clinical_values as values
from tidemark.functions import text as tx
from tidemark.operators import aggregates, topics
from tidemark.operators.graph import connected_components
from tidemark.operators.relabel import relabel
from tidemark.operators.rules import substring_label, word_label
from tidemark.operators.sweep import combination_metrics, composite_score, topic_stats
from tidemark.operators.topics import heterogeneity, jaccard_pairs, merge_map, stop_words, topic_keywords
from tidemark.plans.complaints import label_topics


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")


def run(df, column):
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("raw,want", [
    ("CP", "chest pain"), ("cpr", "cpr"), (" sob cp cp cp ", "shortness of breath chest pain chest pain chest pain"),
    ("n/v/d", "nausea and vomiting/d"), ("precp écp cpé cp_", "precp écp cpé cp_"), ("H/A, s/p fall", "headache, status post fall"),
    (" pe ", "pulmonary embolism"), ("", ""), ("ha ha", "headache headache"), ("meds/med", "medications/medication"),
])
def test_expansion(spark, raw, want):
    assert run(texts(spark, raw), tx.expand_abbreviations(F.col("t"), values.ABBREVIATIONS)) == [want]


def test_fixed_lists():
    assert len(values.ABBREVIATIONS) == 59 and len(values.ROW_OVERRIDES) == 34 and len(values.SWEEP_OVERRIDES) == 64
    assert len(values.COHORT_SUBGROUPS) == 13 and len(values.NUMERIC_FEATURES) == 23
    assert len(values.SWEEP_SIZES) * len(values.SWEEP_SAMPLES) == 169


def test_defaults_and_cleaning(spark):
    df = texts(spark, None, "  ", "___", "___ pain", " a  b ")
    assert run(df, tx.default_text(F.col("t"))) == ["unknown", "unknown", "___", "___ pain", "a  b"]
    assert run(df, tx.prepare_text(F.col("t"))) == ["unknown", "unknown", "unknown", "pain", "a b"]
    keys = texts(spark, "___, __", "a, ___ b, c", "")
    assert run(keys, tx.clean_keywords(F.col("t"))) == ["general", "a, b, c", "general"]


def test_rules_take_the_first_match(spark):
    df = texts(spark, "heart failure", "fallopian fall", "", None, "Chest Pain and fever")
    groups = [("ENT", ["ear"]), ("Cardiac", ["heart"])]
    assert run(df, substring_label(F.col("t"), groups)) == ["ENT", None, None, None, None]
    got = run(df, word_label(F.col("t"), values.ROW_OVERRIDES, "none"))
    assert got == ["none", "Trauma/Injury", "none", "none", "Cardiac"]


def test_ngrams_and_words(spark):
    df = texts(spark, "A big dog, a dog", "one", "").select("i", tx.words(F.col("t")).alias("w"))
    assert run(df, tx.ngrams(F.col("w"))) == [["big", "dog", "dog", "big dog", "dog dog", "big dog dog"], ["one"], []]
    assert stop_words(["no", "the"], ["no"], ["pt"]) == ["pt", "the"]


def test_modes_break_ties_by_value(spark):
    rows = [(1, t) for t in "bbaac"] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, t string")
    assert [r.t for r in aggregates.modal_values(df, "g", "t", 2).orderBy("rank").collect()] == ["a", "b"]


def test_relabel_is_idempotent_and_keeps_confidence(spark):
    rows = [(0, "leg ache", "x"), (0, "leg ache", "x"), (0, "chest pain", "x"), (1, "heart thing", "x"), (-1, "fever", "x"),
            (-1, "other", "x"), (2, "zz", "x")]
    df = spark.createDataFrame(rows, "topic int, t string, lab string")
    groups = [("Cardiac", ["heart"])]
    got = relabel(df, "topic", "t", "lab", values.ROW_OVERRIDES, groups)
    found = {(r.topic, r.t): (r.lab, r.lab_confidence, r.lab_orig) for r in got.collect()}
    assert found[0, "leg ache"] == ("Cardiac", "high", "x") and found[1, "heart thing"] == ("Cardiac", "medium", "x")
    assert found[-1, "fever"] == ("Infectious", "noise", "x") and found[-1, "other"] == ("Other/Unclassified", "noise", "x")
    assert found[2, "zz"] == ("Other/Unclassified", "low", "x")
    again = relabel(got.select("topic", "t", "lab"), "topic", "t", "lab", values.ROW_OVERRIDES, groups)
    assert sorted((r.topic, r.t, r.lab) for r in again.collect()) == sorted((r.topic, r.t, r.lab) for r in got.collect())


def word_sets(spark, sets):
    return spark.createDataFrame([(t, sorted(w)) for t, w in sets.items()], "topic int, words array<string>")


def test_jaccard_pairs_match_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    pool = ["common"] + [f"w{i}" for i in range(9)]
    sets = {i: set(rng.sample(pool, rng.randint(1, 5))) | ({"common"} if i % 3 else set()) for i in range(40)}
    sets = {t: set(sorted(w)[:5]) for t, w in sets.items()}
    for threshold in (0.3, 0.5, 0.8):
        want = {
            (a, b) for a, b in itertools.combinations(sets, 2)
            if min(len(sets[a]), len(sets[b])) >= 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
        }
        got = {(r.t1, r.t2) for r in jaccard_pairs(word_sets(spark, sets), threshold).collect()}
        assert got == want


def test_merge_modes(spark):
    sets = word_sets(spark, {0: {"aa", "bb"}, 1: {"aa", "bb", "cc", "dd"}, 2: {"cc", "dd"}, 3: {"zz"}, 4: {"xx", "yy"}})
    sizes = spark.createDataFrame([(0, 5), (1, 7), (2, 9), (3, 1), (4, 2)], "topic int, n long")
    chain = {r.topic: r.merged_topic for r in merge_map(sets, sizes).collect()}
    assert chain == {0: 2, 1: 2, 3: -1}
    hop = {r.topic: r.merged_topic for r in merge_map(sets, sizes, transitive=False).collect()}
    assert hop == {0: 1, 1: 2, 3: -1}
    alone = word_sets(spark, {0: {"aa", "bb"}, 3: {"zz"}})
    assert {r.topic: r.merged_topic for r in merge_map(alone, sizes, transitive=False).collect()} == {3: -1}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 61), *range(100, 141)]], "node long")
    got = {r.node: r.root for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 140)) and got[140] == 140


def test_split_share_and_noise(spark):
    df = spark.createDataFrame([(0, -1)] * 1 + [(0, 0), (0, 1)] + [(t, 0) for t in range(1, 18)], "topic int, sub int")
    targets = topics.oversized_topics(df, "topic", 0.15)
    assert [(r.topic, r.n) for r in targets.collect()] == [(0, 3)]
    moved = sorted(r.topic for r in topics.apply_split(df, "topic", "sub", targets).collect())
    assert moved == [-1, *range(1, 20)]


def test_heterogeneity_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (-1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [2.0, 2.0])],
                               "topic int, v array<double>")
    got = {r.topic: r.heterogeneity for r in heterogeneity(df, "topic", "v").collect()}
    assert got == {0: 1.0, 1: 0.0, -1: None, 2: 0.0}


def test_phrase_needs_fifty_rows(spark):
    rows = [("c", 0 if i else -1, "L", "p49") for i in range(49)] + [("c", 1 if i else -1, "L", "p50") for i in range(50)] + [
        ("c", 2, "L", "good") for _ in range(60)]
    df = spark.createDataFrame(rows, "combo_id string, topic int, lab string, t string")
    phrases = ["p49", "p50", "good"]
    m = combination_metrics(topic_stats(df, ["combo_id"], "topic", "lab", "t", phrases), ["combo_id"], phrases).first()
    assert (m.n_critical_covered, m.missing_ccs, m.mean_cohesion) == (1, "p50", 1.0)


def test_score_penalties(spark):
    base = dict(n_critical_missing=0, noise_ratio=0.3, other_ratio=0.1, n_topics=30, size_cv=2.0)
    cases = [({}, 100.0), ({"n_critical_missing": 2}, 80.0), ({"noise_ratio": 0.4}, 90.0), ({"other_ratio": 0.2}, 93.0),
             ({"n_topics": 20}, 97.0), ({"n_topics": 170}, 99.0), ({"size_cv": 3.5}, 98.5), ({"n_critical_missing": 12}, 0.0)]
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases],
                               "n_critical_missing long, noise_ratio double, other_ratio double, n_topics long, size_cv double")
    assert [r.s for r in df.select(composite_score().alias("s")).collect()] == [s for _, s in cases]


def test_topics_whose_words_all_fall_to_the_limits(spark):
    rows = [(i, 0, "fever cough") for i in range(4)] + [(i, 1, "ankle twist") for i in range(4, 7)] + [(7, 2, "rash")]
    df = spark.createDataFrame(rows, "id int, cc_topic int, text string")
    vectors = spark.createDataFrame([("ankle", [1.0, 0.0]), ("twist", [0.0, 1.0]), ("fever", [1.0, 0.0])], "word string, vector array<double>")
    got, top = label_topics(df, "text", stop=["rash"], min_topics=1, max_share=0.9, vectors=vectors)
    by_id = {r.id: (r.cc_topic, r.cc_keywords, r.cc_heterogeneity) for r in got.collect()}
    assert by_id[7] == (-1, "Noise/Outlier", None)
    assert by_id[0][0] == 0 and "fever" in by_id[0][1] and by_id[0][2] == 0.0
    assert by_id[5][0] == 1 and by_id[5][2] == 1.0
    listed = topic_keywords(top, topics=df.select(F.col("cc_topic").alias("topic")))
    assert {r.topic: r.keywords for r in listed.collect()}[2] == "general"


def test_parts_of_a_split_topic_take_no_id_that_was_merged_away(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.topics import apply_split

    rows = [(i, 0, i % 2) for i in range(6)] + [(6, 1, None), (7, -1, None)]
    df = spark.createDataFrame(rows, "id int, topic int, sub int")
    targets = spark.createDataFrame([(0, 6)], "topic int, n long")
    parts = lambda above: {r["topic"] for r in apply_split(df, "topic", "sub", targets, above).collect()}
    assert parts(None) == {2, 3, 1, -1} and parts(F.lit(2)) == {3, 4, 1, -1}


ODD_TEXTS = ["CP n/v/d ha HA_ \U00010400cp cp\U00010400 \U00010400 si", "n/v h/a-ha", "İcp ha ſob sob", "", None, "cp", "É cp écp",
             "a b c", "x/y b"]


def test_only_pairs_that_apply_are_replaced(spark):
    """The same texts as by every pair in turn, without a pattern run per pair."""
    def one_by_one(text, pairs):
        return tx.strip(reduce(lambda acc, p: F.regexp_replace(acc, tx.whole_word(p[0]), p[1]), pairs, F.lower(text)))

    odd = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    # a long form with a later short form, one with an earlier one, short forms with other characters
    for pairs in (values.ABBREVIATIONS, [("a", "b x"), ("b", "c a"), ("c", "b"), ("x/y", "a b"), ("si", "-")], [("ha", "cp"), ("cp", "x"), ("cp", "y")]):
        pairs = [p for p in pairs if p[0] != p[1]]
        got = odd.select(tx.expand_abbreviations(F.col("t"), pairs).alias("a"), one_by_one(F.col("t"), pairs).alias("b"))
        assert all(r["a"] == r["b"] for r in got.collect())
    plan = odd.select(tx.expand_abbreviations(F.col("t"), values.ABBREVIATIONS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 3  # once in the plan, once in the column's name


def test_patterns_run_only_near_a_phrase(spark):
    """A plain search stands before every pattern and loses no match of any case."""
    phrases = ["kiss pain", "ill", "os"]
    texts = ["KIſS pain", "Kiss pİin", "kıſſ paın", "İll", "iLL", "xill", "oſ", "pos", "nothing", "", None]
    odd = spark.createDataFrame([(t,) for t in texts], "t string")
    got = odd.select(tx.has_whole_word(F.col("t"), phrases).alias("a"), F.col("t").rlike(tx.any_whole_word(phrases)).alias("b")).collect()
    assert [bool(r["a"]) for r in got] == [bool(r["b"]) for r in got] and sum(bool(r["b"]) for r in got) >= 5
    plan = odd.select(word_label(F.col("t"), [(p, "x") for p in phrases]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan


def test_long_runs_are_counted_only_where_their_parts_are_common(spark, monkeypatch):
    import random
    import re
    from collections import Counter

    from tidemark.operators import topics

    rng = random.Random(5)
    texts = [(t, " ".join(f"w{min(rng.randint(1, 40), rng.randint(1, 40))}" for _ in range(rng.randint(0, 30)))) for t in range(7) for _ in range(6)]
    texts += [(t, f"Same three{t} words") for t in range(7)] + [(0, None), (1, ""), (None, "same words w1 w2"), (2, "w1")]
    want = Counter()
    for t, text in texts:
        own = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w != "w3"]
        want.update((t, " ".join(own[i : i + n])) for n in (1, 2, 3) for i in range(len(own) - n + 1))
    spread = Counter(term for _, term in want)
    passed, count = [], topics._per_topic
    monkeypatch.setattr(topics, "_per_topic", lambda terms, least: (passed.append(terms.count()), count(terms, least))[1])
    df = spark.createDataFrame(texts, "t int, x string")
    got = topics.term_counts(df, "t", "x", ["w3"], 3, 4).collect()
    assert {(r.topic, r.term): (r.n, r.n_topics) for r in got} == {k: (n, spread[k[1]]) for k, n in want.items() if spread[k[1]] >= 4}
    assert len(got) == len({(r.topic, r.term) for r in got}) and all(r.n_all == sum(n for k, n in want.items() if k[1] == r.term) for r in got)
    longest = sum(n for k, n in want.items() if k[1].count(" ") == 2)
    assert len(passed) == 3 and passed[2] < longest / 2
