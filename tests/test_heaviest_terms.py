"""The heaviest terms of topics, which are found without counting every run, against those of all counts."""

import random

import pytest

from tidemark.operators import topics
from tidemark.plans.complaints import label_topics


@pytest.mark.parametrize("n_topics, n_words, longest, share", [
    (1, 9, 3, 0.95), (2, 30, 3, 0.6), (25, 40, 3, 0.9), (25, 400, 2, 1.0),
])
def test_heaviest_terms_are_those_of_all_counts(spark, n_topics, n_words, longest, share):
    """Also with a topic that is null, texts that are null or empty, equal weights, and topics of few words."""
    rng = random.Random(n_topics * n_words)
    rows = [(90, "solo"), (91, "w1 w2")]
    for _ in range(60 * n_topics):
        t = min(int(rng.expovariate(4 / n_topics)), n_topics - 1)
        own = [f"w{min(int(rng.paretovariate(0.7)) + t * (rng.random() < 0.5), n_words)}" for _ in range(rng.choice([0, 1, 2, 12, 30]))]
        rows.append((None if rng.random() < 0.02 else t - 1, None if rng.random() < 0.05 else " ".join(own)))
    df = spark.createDataFrame(rows, "t int, x string")
    counts = topics.term_counts(df, "t", "x", ["w3"], longest, 1, share)
    of_all = topics.top_words(topics.topic_word_weights(counts), 6).collect()
    assert sorted(topics.heaviest_terms(df, "t", "x", 6, ["w3"], longest, share).collect()) == sorted(of_all)


def test_labels_count_only_runs_that_can_be_among_the_heaviest(spark, monkeypatch):
    rng = random.Random(11)
    rows = [
        (t, " ".join([f"t{t}x{j}" for j in range(6)] + [f"r{rng.randrange(5000)}" for _ in range(20)]))
        for t, n in enumerate([150, 100, 50, 4]) for _ in range(n)
    ]
    df = spark.createDataFrame(rows, "cc_topic int, x string")
    counted = []
    plain = topics._per_topic

    def noted(terms, least):
        counted.append(terms)
        return plain(terms, least)

    monkeypatch.setattr(topics, "_per_topic", noted)
    top = label_topics(df, "x", min_topics=1, stop=[])[1].collect()
    # all runs of the topic's own six words weigh the same
    own = sorted(" ".join(f"t0x{j}" for j in range(i, i + n)) for n in (1, 2, 3) for i in range(7 - n))
    assert [r.term for r in sorted(top) if r.topic == 0] == own[:10]
    runs = sum(c.filter("term LIKE '% %'").count() for c in counted)
    assert 0 < runs < 304 * 20  # of 304 * 49
