"""Registered report (R1-R14) and contract (T1-T10) queries on the driver tables.

Stand-ins (see FIXTURES.md): ``lineitem`` for order lines, ``orders`` for
order heads, ``customer`` for customers, ``part`` for products and categories.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import contracts as T
from storelens.operators import reports as R
from storelens.plans.registry import query
from storelens.session import cut_lineage, drop_scratch, scratch_path
from storelens.sources.snapshots import SnapshotTable

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
Q1_1997 = ("1997-01-01", "1997-04-01")

MONEY_SQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


def _quarter(orders):
    lo, hi = Q1_1997
    return orders.where((F.col("o_orderdate") >= F.lit(lo).cast("timestamp_ntz"))
                        & (F.col("o_orderdate") < F.lit(hi).cast("timestamp_ntz")))


QUARTER_SQL = "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'"


# ---------------------------------------------------------------- reports

@query("r01_order_value", f"""
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS INTEGER)
            + CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS order_value
FROM lineitem""")
def r01(t):
    return R.order_value(t.lineitem)


@query("r02_revenue_by_category", f"""
SELECT p_type, CAST(SUM({MONEY_SQL}) AS DOUBLE) AS revenue, COUNT(*) AS n_lines
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def r02(t):
    return R.revenue_by_category(t.lineitem, t.part)


@query("r03_orders_by_status", f"""
SELECT o_orderpriority, n_orders, n_orders / SUM(n_orders) OVER () AS share,
       CAST(list_position({PRIORITIES!r}, o_orderpriority) AS BIGINT) AS status_rank
FROM (SELECT o_orderpriority, COUNT(*) AS n_orders FROM orders GROUP BY o_orderpriority)""")
def r03(t):
    return R.orders_by_status(t.orders, "o_orderpriority", PRIORITIES)


@query("r04_orders_per_customer", """
SELECT c_custkey, COUNT(o_orderkey) AS n_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey""")
def r04(t):
    return R.orders_per_customer(t.customer, t.orders)


@query("r05_customers_without_orders", f"""
SELECT c_custkey FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {QUARTER_SQL})""")
def r05a(t):
    return R.customers_without_orders(t.customer, _quarter(t.orders))


@query("r05_customers_with_orders", f"""
SELECT c_custkey FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {QUARTER_SQL})""")
def r05b(t):
    return R.customers_with_orders(t.customer, _quarter(t.orders))


SPEND_SQL = f"""
SELECT o_custkey, SUM({MONEY_SQL}) AS spend, COUNT(DISTINCT o_orderkey) AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"""


@query("r06_top_customers", f"""
SELECT c_custkey, c_name, CAST(spend AS DOUBLE) AS spend, n_orders
FROM ({SPEND_SQL}) s JOIN customer ON c_custkey = o_custkey
ORDER BY s.spend DESC, c_custkey LIMIT 10""")
def r06(t):
    return R.top_customers_by_spend(t.customer, t.orders, t.lineitem, k=10)


@query("r07_revenue_by_province", f"""
SELECT r_name, n_name, CAST(SUM(spend) AS DOUBLE) AS revenue
FROM ({SPEND_SQL}) s JOIN customer ON c_custkey = o_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name""")
def r07(t):
    return R.revenue_by_province(t.customer, t.orders, t.lineitem, t.nation, t.region)


@query("r08_monthly_orders", """
SELECT month, n_orders, CAST(value AS DOUBLE) AS value,
       CAST(SUM(n_orders) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_orders,
       CAST(SUM(value) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_value,
       n_orders - LAG(n_orders) OVER (ORDER BY month) AS mom_change
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n_orders,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS value
      FROM orders GROUP BY 1)""")
def r08(t):
    return R.monthly_orders(t.orders)


@query("r09_child_before_parent", """
SELECT l_orderkey, l_linenumber, date_diff('day', l_shipdate::DATE, o_orderdate::DATE) AS days_before
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def r09(t):
    return R.child_before_parent(t.lineitem, t.orders)


@query("r10_free_delivery_share", """
SELECT l_returnflag, COUNT(*) AS n_lines,
       CAST(SUM(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_free,
       SUM(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) / COUNT(*) AS free_share
FROM lineitem GROUP BY l_returnflag""")
def r10(t):
    return R.free_delivery_share(t.lineitem)


@query("r11_top_products_per_category", f"""
SELECT p_type, p_partkey, p_name, CAST(rev AS DOUBLE) AS revenue, rnk FROM (
  SELECT p_type, p_partkey, p_name, rev,
         DENSE_RANK() OVER (PARTITION BY p_type ORDER BY rev DESC) AS rnk
  FROM (SELECT l_partkey, SUM({MONEY_SQL}) AS rev FROM lineitem GROUP BY l_partkey)
  JOIN part ON l_partkey = p_partkey)
WHERE rnk <= 5""")
def r11(t):
    return R.top_products_per_category(t.lineitem, t.part, k=5)


@query("r12_status_rollup", """
SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS gid,
       COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def r12(t):
    return R.status_payment_rollup(t.orders)


@query("r13_distinct_buyers", """
SELECT p_type, COUNT(DISTINCT o_custkey) AS n_buyers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY p_type""")
def r13(t):
    return R.distinct_buyers_per_category(t.lineitem, t.part, t.orders)


SPANS = {"all": ("0000-00", "9999-99"), "1994": ("1994-01", "1994-12"), "1995-1996": ("1995-01", "1996-12")}
# three standard errors of the estimate
SKETCH_BOUND = 3 * 1.04 / 2 ** (R.SKETCH_LG_K / 2)


@query("r13_sketched_spans", f"""
SELECT p_type, span, COUNT(DISTINCT o_custkey) AS n_exact, true AS within_bound
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN (VALUES {", ".join(f"('{n}', '{a}', '{z}')" for n, (a, z) in SPANS.items())}) s(span, a, z)
  ON strftime(o_orderdate, '%Y-%m') BETWEEN a AND z
GROUP BY p_type, span""")
def r13_sketched(t):
    """R13 from stored sketches by category and month, merged for three spans, beside the exact counts."""
    path = scratch_path(t.spark, "r13-sketches")
    stored = SnapshotTable(t.spark, path)
    stored.save(R.buyer_sketches(t.lineitem, t.part, t.orders))
    estimates = R.distinct_in_spans(stored.read(), SPANS)
    exact = None
    for name, (a, z) in SPANS.items():
        within = t.orders.where(F.date_format("o_orderdate", "yyyy-MM").between(a, z))
        one = R.distinct_buyers_per_category(t.lineitem, t.part, within).select("p_type", F.lit(name).alias("span"), F.col("n_buyers").alias("n_exact"))
        exact = one if exact is None else exact.unionByName(one)
    out = cut_lineage(exact.join(estimates, ["p_type", "span"], "left").select(
        "p_type", "span", "n_exact", F.coalesce(F.abs(F.col("n_buyers") - F.col("n_exact")) <= F.lit(SKETCH_BOUND) * F.col("n_exact"),
                                                F.lit(False)).alias("within_bound")))
    drop_scratch(path)
    return out


@query("r14_customers_by_type_status", """
SELECT c_mktsegment, COUNT(*) FILTER (WHERE c_acctbal < 0) AS negative,
       COUNT(*) FILTER (WHERE NOT c_acctbal < 0) AS non_negative
FROM customer GROUP BY c_mktsegment""")
def r14(t):
    return R.customers_by_type_and_status(t.customer)


# ---------------------------------------------------------------- contracts

def _lines_with_nulls(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.expr("nullif(l_discount, 0)").alias("l_discount"),
                             F.expr("nullif(l_returnflag, 'R')").alias("l_returnflag"))


@query("t01_check_not_null", """
SELECT 'not_null' AS rule, l_orderkey, l_linenumber, 'l_discount' AS "column", CAST(NULL AS VARCHAR) AS value
FROM lineitem WHERE nullif(l_discount, 0) IS NULL
UNION ALL
SELECT 'not_null', l_orderkey, l_linenumber, 'l_returnflag', NULL
FROM lineitem WHERE nullif(l_returnflag, 'R') IS NULL""")
def t01(t):
    return T.check_not_null(_lines_with_nulls(t), ["l_orderkey", "l_linenumber"],
                            ["l_discount", "l_returnflag"])


NOW = "2026-01-01 00:00:00"


@query("t02_fill_defaults", f"""
SELECT o_orderkey, COALESCE(nullif(o_orderpriority, '5-LOW'), '3-MEDIUM') AS o_orderpriority,
       strftime(COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END,
                         TIMESTAMP '{NOW}'), '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM orders""")
def t02(t):
    src = t.orders.select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderdate")).alias("o_orderdate"))
    out = T.fill_defaults(src, {"o_orderpriority": "3-MEDIUM", "o_orderdate": "CURRENT_TIMESTAMP"}, now=NOW)
    return out.select("o_orderkey", "o_orderpriority",
                      F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


@query("t03_check_unique", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def t03(t):
    return T.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


DECLARED_4 = PRIORITIES[:4]


@query("t04_check_enum", f"""
SELECT 'enum' AS rule, o_orderkey, 'o_orderpriority' AS "column", o_orderpriority AS value
FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN {tuple(DECLARED_4)!r}""")
def t04(t):
    return T.check_enum(t.orders, "o_orderkey", "o_orderpriority", DECLARED_4)


@query("t04_enum_rank", f"""
SELECT o_orderkey, CAST(list_position({PRIORITIES!r}, o_orderpriority) AS BIGINT) AS priority_rank
FROM orders""")
def t04b(t):
    return t.orders.select("o_orderkey", T.enum_rank(F.col("o_orderpriority"), PRIORITIES).alias("priority_rank"))


@query("t05_check_width", """
SELECT rule, p_partkey, "column", value FROM (
  SELECT 'width' AS rule, p_partkey, 'p_name' AS "column", p_name AS value FROM part WHERE length(p_name) > 10
  UNION ALL
  SELECT 'range', p_partkey, 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part
  WHERE p_retailprice IS NOT NULL AND TRY_CAST(p_retailprice AS DECIMAL(5,2)) IS NULL)""")
def t05(t):
    return T.check_width(t.part, "p_partkey", {"p_name": "varchar(10)", "p_retailprice": "decimal(5,2)"})


# names differing in case alone: every second segment in lower case
CASED_SQL = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || CAST(c_custkey % 100 AS STRING)"


@query("t03_check_unique_ci", f"""
SELECT lower({CASED_SQL}) AS k, COUNT(*) AS n_rows FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1""")
def t03_ci(t):
    named = t.customer.select(F.expr(CASED_SQL).alias("k"))
    found = T.check_unique(named, "k", "UNICODE_CI")
    return found.select(F.lower(F.collate("k", "UTF8_BINARY")).alias("k"), "n_rows")


ORDERS_AS_DECLARED = [
    "o_orderkey AS id_zamowienia",
    "CASE WHEN o_orderkey % 100 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS id_klienta",
    "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'ZA-' || CAST(o_orderkey - o_orderkey % 8 AS STRING) END AS numer_zamowienia",
    "o_orderpriority AS status_zamowienia", "o_orderstatus AS produkt_nazwa",
    "CAST(CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice * 1000000 ELSE o_totalprice END AS DECIMAL(18,2)) AS cena_jednostkowa",
    "CASE WHEN o_orderkey % 60 = 0 THEN NULL WHEN o_orderkey % 61 = 0 THEN repeat('kategoria ', 6) ELSE 'Moda' END AS kategoria",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'Czek' ELSE 'BLIK' END AS metoda_platnosci"]


@query("t10_contract_report", f"""
WITH o AS (SELECT {', '.join(ORDERS_AS_DECLARED)} FROM orders)
SELECT 'not_null' AS rule, CAST(id_zamowienia AS VARCHAR) AS "key", 'numer_zamowienia' AS "column", NULL AS value FROM o WHERE numer_zamowienia IS NULL
UNION ALL SELECT 'enum', CAST(id_zamowienia AS VARCHAR), 'status_zamowienia', status_zamowienia FROM o
UNION ALL SELECT 'enum', CAST(id_zamowienia AS VARCHAR), 'metoda_platnosci', metoda_platnosci FROM o WHERE metoda_platnosci = 'Czek'
UNION ALL SELECT 'not_null', CAST(id_zamowienia AS VARCHAR), 'kategoria', NULL FROM o WHERE kategoria IS NULL
UNION ALL SELECT 'width', CAST(id_zamowienia AS VARCHAR), 'kategoria', kategoria FROM o WHERE length(kategoria) > 50
UNION ALL SELECT 'range', CAST(id_zamowienia AS VARCHAR), 'cena_jednostkowa', CAST(cena_jednostkowa AS VARCHAR) FROM o
  WHERE cena_jednostkowa IS NOT NULL AND TRY_CAST(cena_jednostkowa AS DECIMAL(10,2)) IS NULL
UNION ALL SELECT 'unique', numer_zamowienia, 'numer_zamowienia', CAST(COUNT(*) AS VARCHAR) FROM o
  WHERE numer_zamowienia IS NOT NULL GROUP BY numer_zamowienia HAVING COUNT(*) > 1
UNION ALL SELECT 'foreign_key', CAST(id_zamowienia AS VARCHAR), 'id_klienta', CAST(id_klienta AS VARCHAR) FROM o
  WHERE id_klienta NOT IN (SELECT c_custkey FROM customer)""")
def t_contract(t):
    """The declared order contract over the orders table, all rules in one report."""
    orders = t.orders.selectExpr(*ORDERS_AS_DECLARED)
    return T.check_contract(orders, T.ORDER_CONTRACT, {"customers": t.customer.select(F.col("c_custkey").alias("id_klienta"))})


# orphans: every hundredth order points past the last customer
SHIFTED_KEY_SQL = "CASE WHEN o_orderkey % 100 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END"


@query("t06_check_fk", f"""
SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, {SHIFTED_KEY_SQL} AS o_custkey FROM orders)
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def t06(t):
    orders = t.orders.select("o_orderkey", F.expr(SHIFTED_KEY_SQL).alias("o_custkey"))
    return T.check_fk(orders, t.customer, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("t07_cascade_delete", """
WITH d AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal < 0)
SELECT 'parent' AS table_name, COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE k IS NULL) AS rows_after,
       COUNT(k) AS rows_deleted FROM customer LEFT JOIN d ON c_custkey = k
UNION ALL
SELECT 'child', COUNT(*), COUNT(*) FILTER (WHERE k IS NULL), COUNT(k) FROM orders LEFT JOIN d ON o_custkey = k""")
def t07(t):
    return T.cascade_delete_counts(t.customer, t.orders, t.customer.where("c_acctbal < 0"),
                                   "c_custkey", "o_custkey")


@query("t07_cascade_delete_children", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def t07b(t):
    _, child = T.cascade_delete(t.customer, t.orders, t.customer.where("c_acctbal < 0"),
                                "c_custkey", "o_custkey")
    return child.select("o_orderkey", "o_custkey")


def _rekey_mapping(t):
    return (t.customer.where(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").alias("old_key"), (F.col("c_custkey") + 10_000_000).alias("new_key")))


@query("t08_cascade_update", """
SELECT o_orderkey, COALESCE(new_key, o_custkey) AS o_custkey FROM orders
LEFT JOIN (SELECT c_custkey AS old_key, c_custkey + 10000000 AS new_key FROM customer
           WHERE c_mktsegment = 'BUILDING') m ON o_custkey = old_key""")
def t08(t):
    _, child = T.cascade_update(t.customer, t.orders, _rekey_mapping(t), "c_custkey", "o_custkey")
    return child.select("o_orderkey", "o_custkey")


@query("t09_assign_ids", """
SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey)
       + (SELECT MAX(o_orderkey) FROM orders WHERE o_orderstatus <> 'P') AS new_id
FROM orders WHERE o_orderstatus = 'P'""")
def t09(t):
    current = t.orders.where("o_orderstatus <> 'P'").agg(F.max("o_orderkey")).first()[0] or 0
    pending = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return T.assign_ids(pending, ["o_orderdate", "o_orderkey"], start=current).select("o_orderkey", "new_id")


@query("t10_order_number", """
SELECT o_orderkey, printf('ZA-%d-%d', year(o_orderdate), 1000 + o_orderkey) AS order_number FROM orders""")
def t10(t):
    return t.orders.select("o_orderkey", T.order_number(F.col("o_orderkey"), F.year("o_orderdate"))
                           .alias("order_number"))
