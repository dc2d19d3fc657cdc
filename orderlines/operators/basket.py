"""Items bought together: frequent itemsets and association rules."""

from __future__ import annotations

from math import ceil

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlines.functions.storage import marked, materialize, settle

ITEMSETS = T.StructType(
    [
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("freq", T.LongType()),
        T.StructField("orders", T.LongType()),
    ]
)


def order_items(lines: DataFrame) -> DataFrame:
    """Distinct ``(order_id, product_name)``, with whether the summed quantity is positive."""
    return (
        lines.where(F.col("order_id").isNotNull() & F.col("product_name").isNotNull())
        .groupBy("order_id", "product_name")
        .agg((F.coalesce(F.sum("quantity"), F.lit(0)) > 0).alias("bought"))
    )


def bought_items(items: DataFrame) -> DataFrame:
    """The order by product matrix in sparse form: one row per cell that is set."""
    return items.where("bought").drop("bought")


def baskets(bought: DataFrame, frequent: DataFrame) -> DataFrame:
    """Frequent items of each order as a sorted array."""
    return (
        bought.join(frequent, "product_name", "left_semi")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_set("product_name")).alias("items"))
    )


def smallest_count(min_support: float, orders: int) -> int:
    """The least number of orders whose share of all orders reaches ``min_support``."""
    count = max(1, ceil(min_support * orders))
    while count > 1 and (count - 1) / orders >= min_support:
        count -= 1
    while count / orders < min_support:
        count += 1
    return count


def frequent_itemsets(lines: DataFrame, min_support: float = 0.01, tree: bool = False, by_order: bool = False) -> DataFrame:
    """Itemsets of any size in at least ``min_support`` of all orders: sorted items, freq, orders.

    Orders whose items all cancel out still count as orders. Rare items cannot be part of a
    frequent set, so they are dropped before an order's items are gathered: an array then holds at
    most (mean basket size / ``min_support``) items, however many an order lists.

    Sets are counted size by size over the merged baskets (``counted_itemsets``). ``tree`` mines them by FP-growth
    instead, which pays where baskets share long runs of items; its trees are held in memory, and grow with the
    number of different baskets.

    The distinct items of the orders are written, since they are read three times. Lines ``by_order`` lie in a table of
    ``write_bucketed``: they give these items without a shuffle, and are read instead.
    """
    spark = lines.sparkSession
    mark = marked(spark)
    items = order_items(lines) if by_order else materialize(order_items(lines), "order-items")
    orders = items.agg(F.count_distinct("order_id")).first()[0]
    if orders == 0:
        return spark.createDataFrame([], ITEMSETS)
    least = smallest_count(min_support, orders)
    bought = bought_items(items)
    single = bought.groupBy("product_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    mine = _tree_itemsets if tree else counted_itemsets
    found = mine(bought, single, least).select("items", "freq", F.lit(orders).cast("long").alias("orders"))
    return settle(found, "itemsets", mark)


def counted_itemsets(bought: DataFrame, single: DataFrame, least: int) -> DataFrame:
    """``items`` (sorted) and ``freq`` of all sets in at least ``least`` orders, counted size by size.

    Items get numbers, the rarest first, and equal baskets become one row with their number. For each frequent set
    of k items, rows hold what follows its last item in the baskets that have it (``rest``); the items of ``rest`` that are
    frequent there make the sets of k + 1, and only these are carried on. Equal rows merge after each step, and all
    counts merge before the shuffle, so the work is one row per basket and frequent set in it, spread by set and rest.
    """
    single = materialize(
        single.orderBy("n", "product_name").select(F.monotonically_increasing_id().alias("code"), "product_name", "n"), "frequent-items"
    )
    gathered = (
        bought.join(single.select("product_name", "code"), "product_name")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list("code")).alias("rest"))
        .groupBy("rest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sets = single.select(F.array("code").alias("codes"), "n")
    rows = _carried_on(gathered.withColumn("codes", F.array().cast("array<bigint>")))
    while True:
        rows = materialize(rows, "set-rests")
        longer = materialize(
            rows.select("codes", F.explode("rest").alias("code"), "n")
            .groupBy("codes", "code")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least),
            "longer-sets",
        )
        if longer.isEmpty():
            break
        sets = sets.unionByName(longer.select(F.concat("codes", F.array("code")).alias("codes"), "n"))
        follow = longer.groupBy("codes").agg(F.collect_list("code").alias("follow")).where(F.size("follow") > 1)
        rows = _carried_on(rows.join(follow, "codes").withColumn("rest", F.array_intersect("rest", "follow")))
    return (
        sets.select("codes", "n", F.explode("codes").alias("code"))
        .join(single.select("code", "product_name"), "code")
        .groupBy("codes", "n")
        .agg(F.array_sort(F.collect_list("product_name")).alias("items"))
        .select("items", F.col("n").alias("freq"))
    )


def _carried_on(rows: DataFrame) -> DataFrame:
    """Rows of the sets one longer: each item of ``rest`` that has followers joins ``codes``."""
    return (
        rows.where(F.size("rest") > 1)
        .select("codes", "rest", "n", F.explode(F.sequence(F.lit(1), F.size("rest") - 1)).alias("at"))
        .select(
            F.concat("codes", F.array(F.element_at("rest", F.col("at")))).alias("codes"),
            F.expr("slice(rest, at + 1, size(rest))").alias("rest"),
            "n",
        )
        .groupBy("codes", "rest")
        .agg(F.sum("n").alias("n"))
    )


def _tree_itemsets(bought: DataFrame, single: DataFrame, least: int) -> DataFrame:
    """The sets of ``counted_itemsets`` by FP-growth."""
    gathered = baskets(bought, single.select("product_name")).select("items").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = gathered.count()
        if size < least:
            return bought.sparkSession.createDataFrame([], ITEMSETS).drop("orders")
        # FP-growth rounds share times size up; half an order less keeps rounding from adding one.
        miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size, minConfidence=1.0)
        found = miner.fit(gathered).freqItemsets
        return materialize(
            found.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")), "mined-sets"
        )
    finally:
        gathered.unpersist()


def association_rules(
    itemsets: DataFrame, min_lift: float = 1.0, size: int | None = None
) -> DataFrame:
    """Every split of every itemset into antecedent and consequent, with its measures.

    All parts of a frequent set are frequent, so both supports are found among the itemsets.
    ``size`` restricts the rules to itemsets of that many items.
    """
    sets = itemsets.where(F.size("items") >= 2)
    if size is not None:
        sets = sets.where(F.size("items") == size)
    splits = _splits(sets)
    left = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("left_freq"))
    right = itemsets.select(F.col("items").alias("consequent"), F.col("freq").alias("right_freq"))
    freq, orders = F.col("freq").cast("double"), F.col("orders").cast("double")
    confidence = freq / F.col("left_freq")
    return (
        splits.join(left, "antecedent")
        .join(right, "consequent")
        .select(
            "antecedent",
            "consequent",
            (freq / orders).alias("support"),
            confidence.alias("confidence"),
            (freq * orders / (F.col("left_freq").cast("double") * F.col("right_freq").cast("double"))).alias("lift"),
        )
        .where(F.col("lift") >= min_lift)
    )


# Items of one tile: a basket's pairs are made tile against tile, at most TILE x TILE in one row.
TILE = 64


def pair_counts(gathered: DataFrame) -> DataFrame:
    """Baskets per pair ``(a, b)`` of their items with a < b; ``items`` are sorted arrays.

    A basket is cut into tiles of TILE items. Those of one tile give their pairs at once; longer ones become a row
    per pair of tiles, dealt out anew, so a basket of any length is spread over tasks and
    no row holds more than TILE squared pairs. Counts merge before the shuffle.
    """
    tiles = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("items") - 1) / TILE).cast("int")),
        lambda n: F.slice("items", n * TILE + 1, TILE),
    )
    short = gathered.where(F.size("items").between(2, TILE)).select(F.col("items").alias("left"), F.col("items").alias("right"))
    cut = gathered.where(F.size("items") > TILE).select(tiles.alias("tiles"))
    placed = cut.select("tiles", F.posexplode("tiles").alias("at", "left"))
    long = placed.select("left", F.explode(F.slice("tiles", F.col("at") + 1, F.size("tiles"))).alias("right"))
    long = long.repartition(F.xxhash64("left", "right"))
    pairs = F.flatten(
        F.transform("left", lambda a: F.transform(F.filter("right", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return short.unionByName(long).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))


def pair_rules(lines: DataFrame, min_support: float = 0.01, min_lift: float = 1.0) -> DataFrame:
    """Rules between two single items, from counted pairs: antecedent, consequent, support, confidence, lift.

    The same as the rules of size 2 among all itemsets, without mining these. Items below the support are
    dropped first, so a basket holds at most (mean basket size / ``min_support``) of them.
    """
    items = materialize(order_items(lines), "order-items")
    orders = items.agg(F.count_distinct("order_id")).first()[0]
    least = smallest_count(min_support, orders) if orders else 1
    bought = bought_items(items)
    single = materialize(
        bought.groupBy("product_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "frequent-items"
    )
    counted = pair_counts(baskets(bought, single.select("product_name"))).where(F.col("freq") >= least)
    both = counted.unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "freq"))
    left = single.select(F.col("product_name").alias("a"), F.col("n").cast("double").alias("left_freq"))
    right = single.select(F.col("product_name").alias("b"), F.col("n").cast("double").alias("right_freq"))
    freq, total = F.col("freq").cast("double"), F.lit(float(orders))
    return (
        both.join(left, "a")
        .join(right, "b")
        .select(
            F.col("a").alias("antecedent"),
            F.col("b").alias("consequent"),
            (freq / total).alias("support"),
            (freq / F.col("left_freq")).alias("confidence"),
            (freq * total / (F.col("left_freq") * F.col("right_freq"))).alias("lift"),
        )
        .where(F.col("lift") >= min_lift)
    )


def _splits(sets: DataFrame) -> DataFrame:
    """Rows ``(antecedent, consequent)`` of each set: one per bit mask over its items.

    The mask is made of two halves, exploded one after the other, so no row holds an array of all
    masks of a long itemset.
    """
    low_bits = F.floor(F.size("items") / 2).cast("int")
    high_bits = F.size("items") - low_bits

    def masks(bits: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), bits).cast("int") - 1))

    chosen = F.expr(
        "filter(items, (x, i) -> CASE WHEN i < low_bits THEN getbit(low, i)"
        " ELSE getbit(high, i - low_bits) END = 1)"
    )
    return (
        sets.withColumn("low_bits", low_bits)
        .withColumn("high", masks(high_bits))
        .withColumn("low", masks(low_bits))
        .withColumn("antecedent", chosen)
        .where(F.size("antecedent").between(1, F.size("items") - 1))
        .withColumn("consequent", F.array_except("items", "antecedent"))
        .select("antecedent", "consequent", "freq", "orders")
    )


def top_rules(rules: DataFrame, top_n: int = 30) -> DataFrame:
    """The strongest rules as text, rounded, with a recommendation."""
    best = rules.orderBy(
        F.desc("lift"),
        F.desc("confidence"),
        F.desc("support"),
        F.array_join("antecedent", " + "),
        F.array_join("consequent", " + "),
    ).limit(top_n)
    return best.select(
        F.array_join("antecedent", " + ").alias("antecedent"),
        F.array_join("consequent", " + ").alias("consequent"),
        F.round("support", 4).alias("support"),
        F.round("confidence", 4).alias("confidence"),
        F.round("lift", 2).alias("lift"),
    ).withColumn("recommendation", recommendation())


def mine_rules(
    lines: DataFrame, min_support: float = 0.01, min_lift: float = 1.0, top_n: int = 30, by_order: bool = False
) -> DataFrame:
    """Order lines to the strongest association rules."""
    return top_rules(association_rules(frequent_itemsets(lines, min_support, by_order=by_order), min_lift), top_n)


def recommendation() -> Column:
    """Advice by rounded lift: 3, 2 and 1.5 are the steps."""
    # The texts of the advice.
    lift = F.col("lift")
    level = (
        F.when(lift >= 3, "强烈建议").when(lift >= 2, "建议").when(lift >= 1.5, "可考虑").otherwise("弱关联")
    )
    return F.concat(
        level,
        F.lit("将「"),
        F.col("antecedent"),
        F.lit("」+「"),
        F.col("consequent"),
        F.lit("」组合为套餐，Lift="),
        lift.cast("string"),
    )


def strength() -> Column:
    """Grade of a rule in the diagnosis, by rounded lift."""
    # The texts of the grades.
    lift = F.col("lift")
    return F.when(lift >= 3, "★★★ 强关联").when(lift >= 2, "★★☆ 中等关联").otherwise("★☆☆ 弱关联")
