"""Products sold together (C13) and recurring product sets (C14)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_folder, scratch_path

# Codes of an order from which on it is first cut to those that recur, where such orders make more pairs than there are lines.
SHORT_BASKET = 16
# All larger sets are counted at once where these are at most so many times the next level's, and no more than 2 to this power a row.
AT_ONCE, AT_ONCE_CODES = 8, 16
# Sets that one task makes and counts, on the average.
TASK_SETS = 2_000_000


def orders_with_n_lines(lines: DataFrame, n: int = 2, status: str | None = "F",
                        order_id: str = "ordernumber", status_col: str = "status") -> DataFrame:
    """Order ids with exactly ``n`` lines of the given status (derived table + outer filter)."""
    src = lines.where(F.col(status_col) == status) if status is not None else lines
    return (src.groupBy(order_id).agg(F.count(F.lit(1)).alias("rn"))
               .where(F.col("rn") == n).select(order_id))


def lines_of_n_line_orders(lines: DataFrame, n: int = 2, status: str | None = "F",
                           order_id: str = "ordernumber", status_col: str = "status") -> DataFrame:
    """All lines (any status) of those orders: ``where id in (subquery)`` = left semi join."""
    ids = orders_with_n_lines(lines, n, status, order_id, status_col)
    return lines.join(ids, order_id, "left_semi")


def order_code_lists(lines: DataFrame, n: int = 2, status: str | None = "F",
                     order_id: str = "ordernumber", code: str = "productcode",
                     status_col: str = "status", sep: str = ",") -> DataFrame:
    """Every distinct order with the comma list of its codes when it qualifies, else NULL.

    Codes inside a list are sorted (numerically when the code is numeric), so equal
    product sets give equal strings. One pass: each order's lines of the given status are
    counted and its codes listed in the same aggregate (one group per order).
    """
    counted = F.count_if(F.col(status_col) == status) if status is not None else F.count(F.lit(1))
    orders = lines.groupBy(order_id).agg(counted.alias("_n"), F.array_sort(F.collect_list(code)).alias("_codes"))
    text = F.array_join(F.transform("_codes", lambda c: c.cast("string")), sep)
    return (orders.select(order_id, F.when(F.col("_n") == n, text).alias("product_codes"))
                  .orderBy(F.desc_nulls_last("product_codes"), order_id))


def code_set_frequency(code_lists: DataFrame, order_id: str = "ordernumber") -> DataFrame:
    """How many orders share each product set (C14): (product_codes, n_orders)."""
    return (code_lists.where(F.col("product_codes").isNotNull())
                      .groupBy("product_codes").agg(F.count(order_id).alias("n_orders"))
                      .orderBy(F.desc("n_orders"), "product_codes"))


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where it lies."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _pairs(size: Column) -> Column:
    return size.cast("double") * (size - 1) / 2


def _dealt(groups: DataFrame, made: float | None) -> DataFrame:
    """The groups over as many tasks as the sets they make ask for: few files hold them."""
    tasks = math.ceil((made or 0) / TASK_SETS)
    return groups.repartition(tasks, "basket") if tasks > 1 else groups


def _followed(groups: DataFrame) -> DataFrame:
    """Each set with the codes after its own in its group: a group's sets differ in the last code only."""
    each = groups.select("basket", "n", "codes", F.posexplode("sets").alias("at", "parent"))
    return each.select("basket", "n", "parent", F.slice("codes", F.col("at") + 2, F.size("codes")).alias("after"))


def _extended(groups: DataFrame) -> DataFrame:
    """Each basket's sets of one code more."""
    return _followed(groups).select("basket", "n", "parent", F.explode("after").alias("code"))


def _subsets(codes: str) -> Column:
    """All subsets of an array in its order, without the empty one."""
    every = F.aggregate(codes, F.array(F.slice(codes, 1, 0)), lambda made, c: F.concat(made, F.transform(made, lambda s: F.array_append(s, c))))
    return F.slice(every, 2, F.size(every))


def _rest(groups: DataFrame, last: DataFrame, min_orders: int) -> DataFrame:
    """All recurring sets larger than the last level's: every set that a group can still make, counted."""
    found = _followed(groups).select("n", "parent", F.explode(_subsets("after")).alias("more"))
    rest = _counted(found, min_orders, "parent", "more").join(last.select(F.col("set").alias("parent"), "codes"), "parent")
    return rest.select(F.concat("codes", "more").alias("codes"), "n")


def _grouped(held: DataFrame) -> DataFrame:
    """A basket's sets (parent, code, set) by what they have before the last code: (basket, n, codes, sets), side by side in order."""
    each = held.groupBy("basket", "n", "parent").agg(F.array_sort(F.collect_list(F.struct("code", "set"))).alias("s"))
    return each.where(F.size("s") > 1).select("basket", "n", F.col("s.code").alias("codes"), F.col("s.set").alias("sets"))


def _counted(found: DataFrame, min_orders: int, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") >= min_orders)


def _mined(lines: DataFrame, min_orders: int, order_id: str, code: str,
           singles: bool = True) -> tuple[DataFrame | None, list[DataFrame], int]:
    """The recurring codes (code, n), the recurring sets by size from 2 on, each (codes, n), n: orders
    that hold them, and the number of orders. The codes are left out without ``singles``.

    Level by level: a set can only recur if all its parts do, so each basket's recurring sets make
    sets of one code more, those are counted, and the ones that recur stay with their baskets for
    the next level. A set goes by the number of the set before its last code, and that code.
    Once the sets that can still be made are few, they are counted at once.
    Orders of the same codes are one basket, weighted by their number.
    """
    spark = lines.sparkSession
    items = F.array_sort(F.collect_set(code)).alias("items")
    orders = lines.where(F.col(code).isNotNull()).groupBy(order_id).agg(items)
    baskets, path = _stored(orders.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
                            .withColumn("basket", F.monotonically_increasing_id()), "baskets")
    size = F.size("items")
    total, codes, pairs, of_long = baskets.agg(F.sum("n"), F.sum(size), F.sum(_pairs(size)), F.sum(
        F.when(size > SHORT_BASKET, _pairs(size)).otherwise(0))).first()
    cut = (of_long or 0) > (codes or 0)
    groups = baskets.select("basket", "n", F.col("items").alias("codes"), F.col("items").alias("sets"))
    one = None
    if singles or cut:
        one = _stored(_counted(baskets.select("n", F.explode("items").alias("code")), min_orders, "code"), "recurring")[0]
    if cut:
        long = F.size("codes") > SHORT_BASKET
        held = groups.where(long).select("basket", "n", F.explode("codes").alias("code")).join(one, "code", "left_semi")
        groups = groups.where(~long).unionByName(_grouped(held.select("basket", "n", F.lit(0).alias("parent"), "code", F.col("code").alias("set"))))
    levels = []
    while True:
        found = _extended(_dealt(groups, pairs))
        level = _counted(found, min_orders, "parent", "code")
        if levels:
            level = level.join(levels[-1].select(F.col("set").alias("parent"), "codes"), "parent").withColumn("codes", F.array_append("codes", F.col("code")))
        else:
            level = level.withColumn("codes", F.array("parent", "code"))
        levels.append(_stored(level.withColumn("set", F.monotonically_increasing_id()), "recurring")[0])
        held = found.join(levels[-1].select("parent", "code", "set"), ["parent", "code"])
        groups, held_path = _stored(_grouped(held), "held")
        delete_folder(spark, path)
        size = F.size("codes")
        longest, pairs, every = groups.agg(F.max(size), F.sum(_pairs(size)), F.sum(F.pow(F.lit(2.0), size) - size - 1)).first()
        sets = [x.select("codes", "n") for x in levels]
        if longest is None:
            delete_folder(spark, held_path)
            return one, sets, total or 0
        if longest <= AT_ONCE_CODES and every <= AT_ONCE * pairs:
            rest = _stored(_rest(_dealt(groups, every), levels[-1], min_orders), "recurring")[0]
            delete_folder(spark, held_path)
            return one, [*sets, rest], total or 0
        path = held_path


def _text(codes: str, sep: str) -> Column:
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), sep)


def recurring_sets(lines: DataFrame, min_orders: int = 2, order_id: str = "ordernumber", code: str = "productcode",
                   sep: str = ",") -> DataFrame:
    """Every set of two or more codes, of any size, that at least ``min_orders`` orders hold together:
    (product_codes, n_codes, n_orders, support).

    Mined level by level with joins and aggregates that spill, a fixed number of shuffles a
    level; only sums and largest sizes pass through the driver, and no task holds more than one
    order's codes, or the sets of ``AT_ONCE_CODES`` of them. Sets of three codes or more are tried
    only where the parts of the last level counted recur; pairs in orders of more than
    ``SHORT_BASKET`` codes, where these make many, where both codes do. Orders may have any number of lines; a code
    counts once per order.
    """
    _, levels, total = _mined(lines, min_orders, order_id, code, singles=False)
    sets = functools.reduce(DataFrame.union, levels)
    return sets.select(_text("codes", sep).alias("product_codes"), F.size("codes").alias("n_codes"), F.col("n").alias("n_orders"),
                       (F.col("n") / F.lit(max(total, 1))).alias("support"))


def product_rules(lines: DataFrame, min_orders: int = 2, order_id: str = "ordernumber", code: str = "productcode",
                  sep: str = ",") -> DataFrame:
    """Rules from each recurring set to each of its codes: (antecedent, consequent, confidence, lift, support)."""
    single, levels, total = _mined(lines, min_orders, order_id, code)
    orders = F.lit(max(total, 1))
    larger = functools.reduce(DataFrame.union, levels)
    sets = larger.union(single.select(F.array("code").alias("codes"), "n"))
    each = larger.select("codes", "n", F.explode("codes").alias("consequent"))
    each = each.select(F.array_remove("codes", F.col("consequent")).alias("antecedent"), "consequent", "n")
    whole = sets.select(F.col("codes").alias("antecedent"), F.col("n").alias("n_antecedent"))
    one = single.select(F.col("code").alias("consequent"), F.col("n").alias("n_consequent"))
    rules = each.join(whole, "antecedent").join(one, "consequent")
    confidence = F.col("n") / F.col("n_antecedent")
    return rules.select(_text("antecedent", sep).alias("antecedent"), "consequent", confidence.alias("confidence"),
                        (confidence / (F.col("n_consequent") / orders)).alias("lift"), (F.col("n") / orders).alias("support"))
