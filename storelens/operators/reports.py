"""Store reports R1-R14 over order, line, customer and product tables.

Each report is a declarative DataFrame plan.  Aggregates are pushed below
joins by hand where Catalyst cannot (it does not move an aggregate through a
join), so the large side is combined map-side before any shuffle and hot keys
collapse to one row per task before they travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from storelens.functions.money import money, net_price, to_double
from storelens.functions.windows import top_k_per_group
from storelens.operators.contracts import enum_rank


def order_value(lines: DataFrame, unit_price="l_extendedprice", quantity="l_quantity",
                delivery="l_tax", keys=("l_orderkey", "l_linenumber")) -> DataFrame:
    """Unit price x quantity + delivery, in exact decimals (projection only)."""
    value = money(unit_price) * F.col(quantity).cast("int") + money(delivery)
    return lines.select(*keys, to_double(value).alias("order_value"))


def revenue_by_category(lines: DataFrame, parts: DataFrame, category="p_type") -> DataFrame:
    """R2: revenue per category; lines are pre-aggregated per part before the join."""
    per_part = (lines.groupBy("l_partkey")
                .agg(F.sum(net_price()).alias("rev"), F.count(F.lit(1)).alias("n")))
    joined = per_part.join(parts.select("p_partkey", category),
                           per_part.l_partkey == parts.p_partkey)
    return (joined.groupBy(category)
            .agg(to_double(F.sum("rev")).alias("revenue"), F.sum("n").alias("n_lines")))


def orders_by_status(orders: DataFrame, status="o_orderpriority", declared=None) -> DataFrame:
    """Count and share per status, with the declared-order rank of the status."""
    counts = orders.groupBy(status).agg(F.count(F.lit(1)).alias("n_orders"))
    # one row per enum value: the empty-partition window is over a handful of rows
    total = F.sum("n_orders").over(Window.partitionBy())
    out = counts.withColumn("share", F.col("n_orders") / total)
    if declared is not None:
        out = out.withColumn("status_rank", enum_rank(F.col(status), declared))
    return out


def orders_per_customer(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Order count per customer, zero for customers without orders (left join)."""
    per_cust = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    joined = customers.select("c_custkey").join(
        per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def customers_without_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """R5 (anti): customers with no order in ``orders``."""
    return customers.select("c_custkey").join(
        orders.select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def customers_with_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """R5 (semi): customers with at least one order in ``orders``."""
    return customers.select("c_custkey").join(
        orders.select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def spend_per_customer(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Exact spend per customer: lines -> order (map-side combined) -> customer."""
    per_order = lines.groupBy("l_orderkey").agg(F.sum(net_price()).alias("order_rev"))
    # the aggregate is already hash-partitioned on l_orderkey, so the join
    # reuses that exchange for this side
    joined = per_order.join(orders.select("o_orderkey", "o_custkey"),
                            F.col("l_orderkey") == F.col("o_orderkey"))
    return (joined.groupBy("o_custkey")
            .agg(F.sum("order_rev").alias("spend"), F.count(F.lit(1)).alias("n_orders")))


def top_customers_by_spend(customers: DataFrame, orders: DataFrame, lines: DataFrame,
                           k: int = 10) -> DataFrame:
    """The k customers with the highest spend; ties go to the smaller key.

    The top-k runs as TakeOrderedAndProject (k rows per task, then one merge);
    only those k rows meet the customer table, as a broadcast of k rows.
    """
    top = (spend_per_customer(orders, lines)
           .orderBy(F.col("spend").desc(), F.col("o_custkey").asc())
           .limit(k))
    named = customers.select("c_custkey", "c_name").join(
        F.broadcast(top), F.col("c_custkey") == F.col("o_custkey"))
    return named.select("c_custkey", "c_name", to_double(F.col("spend")).alias("spend"),
                        "n_orders")


def revenue_by_province(customers: DataFrame, orders: DataFrame, lines: DataFrame,
                        nations: DataFrame, regions: DataFrame) -> DataFrame:
    """Revenue per nation and region; how the dimension tables join is the planner's choice by size."""
    per_cust = spend_per_customer(orders, lines)
    per_nation = (per_cust.join(customers.select("c_custkey", "c_nationkey"),
                                F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy("c_nationkey").agg(F.sum("spend").alias("rev")))
    dims = (nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name"))
    return (per_nation.join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("r_name", "n_name", to_double(F.col("rev")).alias("revenue")))


def monthly_orders(orders: DataFrame, ts="o_orderdate", amount="o_totalprice") -> DataFrame:
    """Orders and value per month, running total and month-on-month change.

    The window runs over the aggregated months (one row each), never raw rows.
    """
    per_month = (orders.groupBy(F.date_format(ts, "yyyy-MM").alias("month"))
                 .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(money(amount)).alias("value")))
    w = Window.orderBy("month")
    return per_month.select(
        "month", "n_orders", to_double(F.col("value")).alias("value"),
        F.sum("n_orders").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_orders"),
        to_double(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("running_value"),
        (F.col("n_orders") - F.lag("n_orders").over(w)).alias("mom_change"))


def child_before_parent(lines: DataFrame, orders: DataFrame, child_ts="l_shipdate",
                        parent_ts="o_orderdate") -> DataFrame:
    """Child rows dated before their parent (equi-join plus theta filter)."""
    joined = lines.select("l_orderkey", "l_linenumber", child_ts).join(
        orders.select("o_orderkey", parent_ts), F.col("l_orderkey") == F.col("o_orderkey"))
    return (joined.where(F.col(child_ts) < F.col(parent_ts))
            .select("l_orderkey", "l_linenumber",
                    F.datediff(F.to_date(parent_ts), F.to_date(child_ts)).cast("long").alias("days_before")))


def free_delivery_share(lines: DataFrame, group="l_returnflag", fee="l_discount") -> DataFrame:
    """Share of lines without a fee (conditional aggregate)."""
    free = F.when(F.col(fee) == 0, 1).otherwise(0)
    return lines.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(free).alias("n_free"),
        (F.sum(free) / F.count(F.lit(1))).alias("free_share"))


def top_products_per_category(lines: DataFrame, parts: DataFrame, k: int = 5,
                              category="p_type") -> DataFrame:
    """Dense rank of products by revenue inside each category, top k ranks.

    Revenue is aggregated per product first, so the ranking sees one row per
    product, and a large category reaches its final window pre-cut (see
    :func:`top_k_per_group`), so it is not ranked whole in one task.
    """
    per_part = lines.groupBy("l_partkey").agg(F.sum(net_price()).alias("rev"))
    joined = per_part.join(parts.select("p_partkey", "p_name", category),
                           F.col("l_partkey") == F.col("p_partkey"))
    ranked = top_k_per_group(joined, [category], [F.col("rev").desc()], k, out="rnk",
                             method="dense_rank", salt_by=["p_partkey"])
    return ranked.select(category, "p_partkey", "p_name",
                         to_double(F.col("rev")).alias("revenue"), "rnk")


def status_payment_rollup(orders: DataFrame, a="o_orderstatus", b="o_orderpriority",
                          amount="o_totalprice") -> DataFrame:
    """Subtotals per (a, b), per a, and the grand total (ROLLUP)."""
    return (orders.rollup(a, b)
            .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_orders"),
                 to_double(F.sum(money(amount))).alias("value")))


def distinct_buyers_per_category(lines: DataFrame, parts: DataFrame, orders: DataFrame,
                                 category="p_type", approx: bool = False) -> DataFrame:
    """Distinct customers per category (exact, or HyperLogLog++ at scale)."""
    pairs = (lines.select("l_orderkey", "l_partkey")
             .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
             .join(parts.select("p_partkey", category), F.col("l_partkey") == F.col("p_partkey")))
    agg = (F.approx_count_distinct("o_custkey") if approx else F.count_distinct("o_custkey"))
    return pairs.groupBy(category).agg(agg.alias("n_buyers"))


SKETCH_LG_K = 14


def buyer_sketches(lines: DataFrame, parts: DataFrame, orders: DataFrame, category="p_type", ts="o_orderdate",
                   lg_k: int = SKETCH_LG_K) -> DataFrame:
    """R13 to store: a distinct-count sketch of the customers per category and month.

    A sketch takes at most about 2**``lg_k`` bytes, whatever it counts, and sketches of new months are
    appended to the stored ones.
    """
    pairs = (lines.select("l_orderkey", "l_partkey")
             .join(orders.select("o_orderkey", "o_custkey", F.date_format(ts, "yyyy-MM").alias("month")), F.col("l_orderkey") == F.col("o_orderkey"))
             .join(parts.select("p_partkey", category), F.col("l_partkey") == F.col("p_partkey")))
    return pairs.groupBy(category, "month").agg(F.hll_sketch_agg("o_custkey", lg_k).alias("sketch"))


def distinct_in_spans(sketches: DataFrame, spans: dict[str, tuple[str, str]], category="p_type") -> DataFrame:
    """Estimated distinct customers per category in each span of months (first, last), from stored sketches alone.

    Merging sketches loses nothing against one sketch of all rows; the estimate's relative standard error is
    1.04 / sqrt(2**lg_k) at most (0.8 % for 14), and small counts are exact.
    """
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.lit(a).alias("a"), F.lit(z).alias("z")) for n, (a, z) in spans.items()]))
    rows = sketches.select("*", named.alias("s")).where(F.col("month").between(F.col("s.a"), F.col("s.z")))
    return rows.groupBy(category, F.col("s.span").alias("span")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_buyers"))


def customers_by_type_and_status(customers: DataFrame, kind="c_mktsegment",
                                 balance="c_acctbal") -> DataFrame:
    """Customers per account type, pivoted by status (sign of the balance).

    A null balance is in neither column.  Pivot values are listed, so Spark runs no extra job to discover them.
    """
    status = F.when(F.col(balance) < 0, "negative").when(F.col(balance) >= 0, "non_negative")
    return (customers.withColumn("status", status)
            .groupBy(kind).pivot("status", ["negative", "non_negative"]).count()
            .na.fill(0, ["negative", "non_negative"]))
