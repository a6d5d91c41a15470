"""Jaccard pairs of sets of any size equal those found by comparing all."""

import random

import pytest

from tidemark.operators.topics import jaccard_pairs


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_no_pair_is_lost(spark, threshold):
    r = random.Random(2)
    sets = [(i, sorted(r.sample("abcdefghijklmnop", r.randrange(2, 13)))) for i in range(60)]
    want = {
        (a, b)
        for a, x in sets
        for b, y in sets
        if a < b and len({*x} & {*y}) >= threshold * len({*x} | {*y}) - 1e-12
    }
    got = jaccard_pairs(spark.createDataFrame(sets, "topic int, words array<string>"), threshold)
    assert {(p["t1"], p["t2"]) for p in got.collect()} == want
