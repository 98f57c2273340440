"""Registered seed queries (S6 with G1-G6): one seeded customer per driver
customer key and one seeded order per driver order key."""

from __future__ import annotations

from storelens.operators.contracts import ACCOUNT_STATUSES, ACCOUNT_TYPES, ORDER_STATUSES, PAYMENT_METHODS
from storelens.plans.registry import query
from storelens.sources import seed as G

SEED = 42
NOW_US = 1_767_225_600_000_000  # 2026-01-01 00:00:00 UTC
YEAR = 2026


def _h(key: str, col: str) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws('-', CAST({key} AS VARCHAR), '{col}', '{SEED}')), 1, 8))"
            " AS BIGINT)")


def _uniform(h: str, values) -> str:
    lst = ", ".join(f"'{v}'" for v in values)
    return f"[{lst}][({h}) % {len(values)} + 1]"


def _weighted(h: str, values, weights) -> str:
    total, acc, whens = sum(weights), 0, []
    for v, w in zip(values, weights):
        acc += w
        whens.append(f"WHEN ({h}) % {total} < {acc} THEN {v!r}")
    return "CASE " + " ".join(whens) + " END"


def _ts(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S')"


CUSTOMERS_SQL = f"""
SELECT CAST(c_custkey AS BIGINT) AS id_klienta, 'Imie' || CAST(c_custkey AS VARCHAR) AS imie,
       'Nazwisko' || CAST(c_custkey AS VARCHAR) AS nazwisko,
       'klient' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       printf('+48 %09d', {_h('c_custkey', 'telefon')} % 1000000000) AS telefon,
       'Miasto' || CAST({_h('c_custkey', 'miasto')} % 100 AS VARCHAR) AS miasto,
       {_uniform(_h('c_custkey', 'wojewodztwo'), G.PROVINCES)} AS wojewodztwo,
       {_ts(f"{NOW_US} - ({_h('c_custkey', 'data_rejestracji')} % {G.REGISTRATION_DAYS} + 1) * {G.DAY_US}")} AS data_rejestracji,
       {_uniform(_h('c_custkey', 'typ_konta'), ACCOUNT_TYPES)} AS typ_konta,
       {_weighted(_h('c_custkey', 'status_konta'), ACCOUNT_STATUSES, G.ACCOUNT_STATUS_WEIGHTS)} AS status_konta
FROM customer"""


def _catalogue_sql(hc: str, hp: str):
    cats = list(G.CATALOGUE)
    cat = _uniform(hc, cats)
    names = " ".join(f"WHEN '{c}' THEN {_uniform(hp, [p[0] for p in G.CATALOGUE[c]])}" for c in cats)
    prices = " ".join(f"WHEN '{c}' THEN {_uniform(hp, [p[1] for p in G.CATALOGUE[c]])}" for c in cats)
    return cat, f"CASE {cat} {names} END", f"CAST(CASE {cat} {prices} END AS DECIMAL(10,2))"


_CAT, _NAME, _PRICE = _catalogue_sql(_h("o_orderkey", "kategoria"), _h("o_orderkey", "produkt"))

ORDERS_SQL = f"""
WITH pos AS (SELECT CAST(c_custkey AS BIGINT) AS id_klienta, ROW_NUMBER() OVER (ORDER BY c_custkey) AS p FROM customer),
o AS (
SELECT CAST(o_orderkey AS BIGINT) AS id_zamowienia,
       {_h('o_orderkey', 'id_klienta')} % (SELECT COUNT(*) FROM customer) + 1 AS p,
       printf('ZA-%d-%d', {YEAR}, 1000 + o_orderkey) AS numer_zamowienia,
       {_ts(f"{NOW_US} - ({_h('o_orderkey', 'dni')} % {G.ORDER_DAYS} + 1) * {G.DAY_US} - ({_h('o_orderkey', 'godziny')} % {G.ORDER_HOURS + 1}) * {G.HOUR_US}")} AS data_zamowienia,
       {_weighted(_h('o_orderkey', 'status_zamowienia'), ORDER_STATUSES, G.ORDER_STATUS_WEIGHTS)} AS status_zamowienia,
       {_NAME} AS produkt_nazwa, {_CAT} AS kategoria, {_PRICE} AS cena_jednostkowa,
       CAST({_weighted(_h('o_orderkey', 'ilosc'), G.QUANTITIES, G.QUANTITY_WEIGHTS)} AS INTEGER) AS ilosc,
       CAST(CASE WHEN {_h('o_orderkey', 'koszt_dostawy')} % 2 = 0 THEN '0.00' ELSE '{G.DELIVERY_FEE}' END AS DECIMAL(6,2))
         AS koszt_dostawy,
       {_uniform(_h('o_orderkey', 'metoda_platnosci'), PAYMENT_METHODS)} AS metoda_platnosci
FROM orders)
SELECT id_zamowienia, id_klienta, numer_zamowienia, data_zamowienia, status_zamowienia, produkt_nazwa,
       kategoria, cena_jednostkowa, ilosc, koszt_dostawy, metoda_platnosci
FROM o JOIN pos USING (p)"""

# money leaves the registered query as double (exact decimal -> nearest double)
ORDERS_OUT_SQL = f"""
SELECT * REPLACE (CAST(cena_jednostkowa AS DOUBLE) AS cena_jednostkowa,
                  CAST(koszt_dostawy AS DOUBLE) AS koszt_dostawy)
FROM ({ORDERS_SQL})"""


@query("s06_seed_customers", CUSTOMERS_SQL)
def s06a(t):
    return G.seed_customers(t.customer, "c_custkey", SEED, NOW_US)


def _orders(t):
    return G.seed_orders(t.orders, "o_orderkey", t.customer, "c_custkey", SEED, NOW_US, YEAR)


@query("s06_seed_orders", ORDERS_OUT_SQL)
def s06b(t):
    o = _orders(t)
    return o.withColumns({c: o[c].cast("double") for c in ("cena_jednostkowa", "koszt_dostawy")})


STATUS_SHARES = ", ".join(
    f"('{v}', {w / sum(G.ORDER_STATUS_WEIGHTS)!r})" for v, w in zip(ORDER_STATUSES, G.ORDER_STATUS_WEIGHTS))


@query("g06_distribution_check", f"""
WITH s AS ({ORDERS_SQL}),
c AS (SELECT status_zamowienia, COUNT(*) AS observed FROM s GROUP BY 1),
st(status_zamowienia, expected_share) AS (VALUES {STATUS_SHARES})
SELECT st.status_zamowienia, CAST(expected_share AS DOUBLE) AS expected_share, COALESCE(observed, 0) AS observed,
       COALESCE(observed, 0) / SUM(COALESCE(observed, 0)) OVER () AS observed_share
FROM st LEFT JOIN c USING (status_zamowienia)""")
def g06(t):
    return G.distribution_check(_orders(t), "status_zamowienia", ORDER_STATUSES, G.ORDER_STATUS_WEIGHTS)


PRIORITY_WEIGHTS = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 1, "4-NOT SPECIFIED": 1, "5-LOW": 1}


@query("g06_priority_distribution", f"""
WITH c AS (SELECT o_orderpriority, COUNT(*) AS observed FROM orders GROUP BY 1),
st(o_orderpriority, expected_share) AS (VALUES {", ".join(f"('{v}', {w / sum(PRIORITY_WEIGHTS.values())!r})" for v, w in PRIORITY_WEIGHTS.items())})
SELECT st.o_orderpriority, CAST(expected_share AS DOUBLE) AS expected_share, COALESCE(observed, 0) AS observed,
       COALESCE(observed, 0) / SUM(COALESCE(observed, 0)) OVER () AS observed_share
FROM st LEFT JOIN c USING (o_orderpriority)""")
def g06_priority(t):
    """G6 on a column of the given tables."""
    return G.distribution_check(t.orders, "o_orderpriority", list(PRIORITY_WEIGHTS), list(PRIORITY_WEIGHTS.values()))
