import math
import random
from collections import Counter
from itertools import combinations

import pytest

from orderlines.operators.agreement import agreement


def measured(spark, rows, types="a string, b int"):
    return {r["measure"]: r["value"] for r in agreement(spark.createDataFrame(rows, types), "a", "b").collect()}


def brute(rows):
    """Every pair of rows is looked at; information from the shares."""
    pairs = list(combinations(rows, 2))
    both = sum(x[0] == y[0] and x[1] == y[1] for x, y in pairs)
    left, right = (sum(x[k] == y[k] for x, y in pairs) for k in (0, 1))
    agree = sum((x[0] == y[0]) == (x[1] == y[1]) for x, y in pairs)
    chance = left * right / len(pairs)
    n = len(rows)
    cells, first, second = Counter(rows), Counter(a for a, _ in rows), Counter(b for _, b in rows)
    shared = sum(c / n * math.log(c * n / (first[a] * second[b])) for (a, b), c in cells.items())
    entropy = lambda counts: -sum(c / n * math.log(c / n) for c in counts.values())
    chi = sum((cells[a, b] - first[a] * second[b] / n) ** 2 / (first[a] * second[b] / n) for a in first for b in second)
    return {
        "rand": agree / len(pairs),
        "adjusted_rand": (both - chance) / ((left + right) / 2 - chance),
        "mutual_information": shared,
        "normalized_information": 2 * shared / (entropy(first) + entropy(second)),
        "homogeneity": shared / entropy(first),
        "completeness": shared / entropy(second),
        "purity": sum(max(c for (_, y), c in cells.items() if y == b) for b in second) / n,
        "inverse_purity": sum(max(c for (x, _), c in cells.items() if x == a) for a in first) / n,
        "cramers_v": math.sqrt(chi / n / (min(len(first), len(second)) - 1)),
    }


@pytest.mark.parametrize("noise", [0.0, 0.2, 1.0])
def test_measures_by_pair_counting(spark, noise):
    rng = random.Random(1)
    rows = []
    for _ in range(150):
        group = rng.randrange(4)
        rows.append((f"s{group}", group if rng.random() >= noise else rng.randrange(3)))
    assert measured(spark, rows) == pytest.approx(brute(rows), abs=1e-9)


def test_equal_groupings_agree_fully(spark):
    assert all(v == pytest.approx(1) for k, v in measured(spark, [("x", 1), ("x", 1), ("y", 2)] * 5).items() if k != "mutual_information")
    assert set(measured(spark, [("x", 1)] * 6).values()) == {0.0, 1.0}
    assert measured(spark, [("x", 1)])["adjusted_rand"] == 1.0


def test_rows_without_a_label_and_no_rows(spark):
    rows = [("x", 1), ("y", 2), ("y", 1)]
    assert measured(spark, rows + [(None, 1), ("x", None)]) == measured(spark, rows)
    assert measured(spark, []) == measured(spark, [(None, None)]) == {}
