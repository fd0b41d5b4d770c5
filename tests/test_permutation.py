"""Permutation tests by convolution equal the enumeration of all relabelings."""

from itertools import permutations, product

import numpy as np
import pytest

from gatelight.operators import permutation

ORDERS = list(permutations(range(3)))
rng = np.random.default_rng(12)


def stats(block):
    return [float(block[a] - (block[b] + block[c]) / 2) for a, b, c in ORDERS]


DESIGNS = {"noise": rng.normal(size=(6, 3)), "clear": rng.normal(size=(6, 3)) + [4, 0, 0], "short": rng.normal(size=(2, 3)) + [1, 0, 0], "one": np.array([[3.0, 1.0, 2.0]]), "same": np.ones((4, 3)), "ties": np.array([[1.0, 0, 0], [0, 1, 0], [1, 1, 0]])}


@pytest.mark.parametrize("n_ranges", [None, 9])
def test_equals_enumeration(spark, n_ranges):
    rows = [(g, k, stats(b)) for g, blocks in DESIGNS.items() for k, b in enumerate(blocks)] + [("empty", 0, []), ("null", 0, None), ("one", 9, None)]
    found = {r.g: r for r in permutation.p_values(spark.createDataFrame(rows, "g string, k int, x array<double>"), ["g"], ["k"], "x", n_ranges).collect()}
    assert set(found) == set(DESIGNS)
    for g, blocks in DESIGNS.items():
        own = [stats(b) for b in blocks]
        sums = [sum(s) for s in product(*own)]
        observed = sum(s[0] for s in own)
        expected = np.mean([abs(s) >= abs(observed) - 1e-6 for s in sums])
        assert abs(found[g].p_value - expected) < 1e-9 and abs(found[g].observed - observed) < 1e-9 and (found[g].blocks, found[g].relabelings) == (len(own), len(sums)), g


def test_twenty_blocks(spark):
    """Signs of twenty equal differences: a binomial tail, over two to the twentieth relabelings."""
    rows = [("a", k, [1.0, -1.0] if k < 15 else [-1.0, 1.0]) for k in range(20)]
    row = permutation.p_values(spark.createDataFrame(rows, "g string, k int, x array<double>"), ["g"], ["k"], "x").collect()[0]
    assert abs(row.p_value - 2 * 21700 / 2**20) < 1e-12 and row.relabelings == 2**20


def test_empty(spark):
    assert permutation.p_values(spark.createDataFrame([], "g string, k int, x array<double>"), ["g"], ["k"], "x").count() == 0
