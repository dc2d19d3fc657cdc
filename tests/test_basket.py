import itertools
import random
from decimal import Decimal

import pytest

from orderlines.operators import basket


def lines_of(spark, rows):
    return spark.createDataFrame(
        [(o, p, Decimal(q)) for o, p, q in rows], "order_id string, product_name string, quantity decimal(18,4)"
    )


def brute_force(rows, support, lift):
    """Rules counted straight from the orders."""
    amounts = {}
    for order, product, quantity in rows:
        amounts[order, product] = amounts.get((order, product), 0) + quantity
    orders = {order for order, _, _ in rows}
    held = {o: {p for (x, p), q in amounts.items() if x == o and q > 0} for o in orders}
    products = sorted({p for items in held.values() for p in items})
    n = len(orders)

    def count(items):
        return sum(1 for have in held.values() if set(items) <= have)

    rules = {}
    for size in range(2, len(products) + 1):
        for items in itertools.combinations(products, size):
            both = count(items)
            if both / n < support:
                continue
            for k in range(1, size):
                for left in itertools.combinations(items, k):
                    right = tuple(p for p in items if p not in left)
                    value = both * n / (count(left) * count(right))
                    if value >= lift:
                        rules[left, right] = (both / n, both / count(left), value)
    return rules


def found_rules(spark, rows, support, lift):
    itemsets = basket.frequent_itemsets(lines_of(spark, rows).repartition(5), support)
    return {
        (tuple(r["antecedent"]), tuple(r["consequent"])): (r["support"], r["confidence"], r["lift"])
        for r in basket.association_rules(itemsets, lift).collect()
    }


def test_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (str(o), p, rng.choice([0, 1, 2]))
        for o in range(60)
        for p in rng.sample("abcdef", rng.randint(1, 5))
    ]
    expected = brute_force(rows, 0.1, 1.0)
    found = found_rules(spark, rows, 0.1, 1.0)
    assert max(len(a) + len(c) for a, c in expected) >= 3
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values)


def test_support_of_seven_in_a_hundred_is_reached(spark):
    rows = [(str(o), p, 1) for o in range(7) for p in "abc"] + [(str(o), "z", 0) for o in range(7, 100)]
    found = found_rules(spark, rows, 0.07, 1.0)
    assert len(found) == 12  # two per pair, six for the triple
    assert all(support == pytest.approx(0.07) for support, _, _ in found.values())


def test_least_count_is_exact():
    for n in range(1, 400):
        for support in (0.01, 0.07, 0.1, 0.29, 1 / 3):
            least = basket.smallest_count(support, n)
            assert least / n >= support and (least == 1 or (least - 1) / n < support)


def test_nothing_frequent(spark):
    rows = [(str(o), f"p{o}", 1) for o in range(10)]
    rules = basket.mine_rules(lines_of(spark, rows), min_support=0.5)
    assert rules.collect() == [] and rules.columns[-1] == "recommendation"


def test_very_long_order_does_not_grow_the_baskets(spark):
    rows = [("big", f"p{i}", 1) for i in range(2000)] + [(str(o), p, 1) for o in range(50) for p in ("p1", "p2")]
    itemsets = basket.frequent_itemsets(lines_of(spark, rows), 0.5)
    assert {tuple(r["items"]): r["freq"] for r in itemsets.collect()} == {("p1",): 51, ("p2",): 51, ("p1", "p2"): 51}


def test_text_of_rules(spark):
    rows = [(str(o), p, 1) for o in range(2) for p in "ab"] + [(str(o), "c", 1) for o in range(2, 8)]
    row = basket.mine_rules(lines_of(spark, rows), 0.2).first()
    assert row["lift"] == 4.0 and row["recommendation"] == "强烈建议将「a」+「b」组合为套餐，Lift=4.0"


# ---- pair rules on their own path -------------------------------------------------------------


def rule_rows(df):
    return sorted(tuple(r) for r in df.collect())


def pairs_by_hand(lines, min_support, min_lift=1.0):
    """Rules between single items from all pairs of every basket."""
    from collections import Counter
    from itertools import combinations

    baskets, orders = {}, set()
    for order, product, quantity in lines:
        if order is not None and product is not None:
            orders.add(order)
            baskets.setdefault(order, Counter())[product] += quantity
    sets = [sorted(p for p, q in basket.items() if q > 0) for basket in baskets.values()]
    n = len(orders)
    single, both = Counter(p for s in sets for p in s), Counter(c for s in sets for c in combinations(s, 2))
    rules = []
    for (a, b), freq in both.items():
        lift = freq * n / (single[a] * single[b])
        if freq / n >= min_support and lift >= min_lift:
            rules += [(a, b, freq / n, freq / single[a], lift), (b, a, freq / n, freq / single[b], lift)]
    return sorted(rules)


def test_pair_rules_by_hand_with_long_baskets(spark, monkeypatch):
    import random

    import pytest

    from orderlines.operators import basket

    monkeypatch.setattr(basket, "TILE", 4)
    rng = random.Random(3)
    lines = [(f"o{o}", f"p{rng.randrange(12):02d}", rng.choice([1, 2, 0, -1])) for o in range(80) for _ in range(rng.choice([1, 3, 6]))]
    lines += [("giant", f"p{i:02d}", 1) for i in range(40)] + [("o1", None, 1), (None, "p01", 1), ("gone", "p01", -1)]
    df = spark.createDataFrame(lines, "order_id string, product_name string, quantity int")
    for support in (0.02, 0.03):
        found, wanted = rule_rows(basket.pair_rules(df, support, 0.5)), pairs_by_hand(lines, support, 0.5)
        assert [r[:2] for r in found] == [r[:2] for r in wanted] and len(wanted) > 5
        assert [x for r in found for x in r[2:]] == pytest.approx([x for r in wanted for x in r[2:]])


def test_pair_rules_equal_the_mined_ones_and_need_no_mining(spark, monkeypatch):
    from pyspark.sql import functions as F

    from orderlines.operators import basket

    lines = spark.createDataFrame([(f"o{i}", p, 1) for i in range(30) for p in "abc"[: 1 + i % 3]], "order_id string, product_name string, quantity int")
    rules = basket.association_rules(basket.frequent_itemsets(lines, 0.2), 0.0, size=2)
    mined = rules.select(F.element_at("antecedent", 1), F.element_at("consequent", 1), F.round("support", 9), F.round("confidence", 9), F.round("lift", 9))
    monkeypatch.setattr(basket, "FPGrowth", None)
    counted = basket.pair_rules(lines, 0.2, 0.0)
    assert rule_rows(counted.select("antecedent", "consequent", *[F.round(c, 9) for c in ("support", "confidence", "lift")])) == rule_rows(mined)


def test_pair_rules_of_nothing(spark):
    from orderlines.operators import basket

    assert basket.pair_rules(spark.createDataFrame([], "order_id string, product_name string, quantity int")).count() == 0


# ---- itemsets counted size by size ------------------------------------------------------------


def test_itemsets_are_counted_without_trees_in_memory(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(str(o), p, rng.choice([0, 1, 2])) for o in range(120) for p in rng.sample("abcdefgh", rng.randint(1, 8))]
    rows += [(f"copy {o}", p, 1) for o in range(40) for p in "bdfh"] + [("big", f"p{i}", 1) for i in range(300)]
    for support in (0.05, 0.3, 0.999):
        mined = basket.frequent_itemsets(lines_of(spark, rows), support, tree=True)
        expected = sorted(map(tuple, mined.collect()))
        with monkeypatch.context() as without:
            without.setattr(basket, "FPGrowth", None)
            counted = basket.frequent_itemsets(lines_of(spark, rows).repartition(3), support)
        assert sorted(map(tuple, counted.collect())) == expected
        assert counted.dtypes == mined.dtypes
        assert support != 0.05 or max(len(items) for items, _, _ in expected) >= 4


def test_equal_baskets_are_one_row(spark, monkeypatch):
    """The rows that the counting carries on grow with the different baskets, not with the orders."""
    sizes = []

    def counted(df, name):
        kept = materialize(df, name)
        if name == "set-rests":
            sizes.append(kept.count())
        return kept

    materialize = basket.materialize
    monkeypatch.setattr(basket, "materialize", counted)
    for orders in (10, 200):
        basket.frequent_itemsets(lines_of(spark, [(str(o), p, 1) for o in range(orders) for p in "abc"]), 0.5)
    assert sizes == [2, 1, 0] * 2
