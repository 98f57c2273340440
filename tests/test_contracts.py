from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from storelens.operators import contracts as T
from tests.conftest import rows


def test_not_null_one_pass(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, None), (3, None, None)], "id int, x int, y string")
    out = T.check_not_null(df, "id", ["x", "y"])
    assert rows(out, "id", "column") == [(1, "x"), (2, "y"), (3, "x"), (3, "y")]


def test_fill_defaults_treats_null_as_omitted(spark):
    df = spark.createDataFrame([(1, None, None), (2, "Premium", 3)], "id int, typ_konta string, ilosc int")
    out = T.fill_defaults(df, {"typ_konta": "Standard", "ilosc": 1})
    assert rows(out) == [(1, "Standard", 1), (2, "Premium", 3)]


def test_unique_nulls_never_conflict_and_collation(spark):
    df = spark.createDataFrame([("a@x.pl",), ("A@x.pl",), (None,), (None,), ("b@x.pl",)], "email string")
    assert T.check_unique(df, "email").count() == 0
    ci = T.check_unique(df, "email", collation="UNICODE_CI")
    assert [r.n_rows for r in ci.collect()] == [2]


def test_enum_and_rank(spark):
    df = spark.createDataFrame([(1, "Nowe"), (2, "Zwrot"), (3, "nowe"), (4, None)], "id int, s string")
    bad = T.check_enum(df, "id", "s", T.ORDER_STATUSES)
    assert rows(bad, "id", "value") == [(3, "nowe")]
    ranks = df.select("id", T.enum_rank(F.col("s"), T.ORDER_STATUSES).alias("r"))
    assert rows(ranks) == [(1, 1), (2, 7), (3, 0), (4, None)]


def test_width_counts_code_points_and_decimal_range(spark):
    df = spark.createDataFrame([(1, "Łódź", 9999.99), (2, "Łódźx", 10000.0), (3, None, None)],
                               "id int, miasto string, cena double")
    out = T.check_width(df, "id", {"miasto": "varchar(4)", "cena": "decimal(6,2)"})
    assert rows(out, "id", "rule", "column") == [(2, "range", "cena"), (2, "width", "miasto")]


def test_fk_and_cascades(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "c_id long")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, 4), (13, None)], "o_id long, c_id long")
    assert rows(T.check_fk(child, parent, "c_id", "c_id"), "o_id") == [(12,)]
    deleted = spark.createDataFrame([(2,), (2,)], "c_id long")
    p, c = T.cascade_delete(parent, child, deleted, "c_id", "c_id")
    assert rows(p) == [(1,), (3,)] and rows(c, "o_id") == [(10,), (12,), (13,)]
    counts = T.cascade_delete_counts(parent, child, deleted, "c_id", "c_id")
    assert rows(counts) == [("child", 4, 3, 1), ("parent", 3, 2, 1)]
    mapping = spark.createDataFrame([(1, 100)], "old_key long, new_key long")
    p2, c2 = T.cascade_update(parent, child, mapping, "c_id", "c_id")
    assert rows(p2) == [(2,), (3,), (100,)]
    assert rows(c2, "o_id", "c_id")[0] == (10, 100)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=300, unique=True), st.integers(0, 50))
def test_assign_ids_dense_and_ordered(spark, keys, start):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    out = T.assign_ids(df, "k", start=start, num_partitions=4)
    got = rows(out, "k", "new_id")
    assert got == [(k, start + i + 1) for i, k in enumerate(sorted(keys))]


def test_order_number(spark):
    df = spark.createDataFrame([(0, 2026), (5, 2025)], "i long, y int")
    out = df.select(T.order_number(F.col("i"), F.col("y")).alias("n"))
    assert rows(out) == [("ZA-2025-1005",), ("ZA-2026-1000",)]


def test_a_declared_contract_in_one_report(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id_klienta long")
    df = spark.createDataFrame([(1, 1, "ZA-1", "x", 1.0, None), (2, 9, "za-1", "x", 1.0, "Nowe"), (3, 2, None, None, 2.0, "Inne")],
                               "id_zamowienia long, id_klienta long, numer_zamowienia string, produkt_nazwa string, "
                               "cena_jednostkowa double, status_zamowienia string").withColumn("metoda_platnosci", F.lit(None).cast("string"))
    got = rows(T.check_contract(df, T.ORDER_CONTRACT, {"customers": parents}), "rule", "column", "value")
    assert sorted(map(str, got)) == sorted(map(str, [
        ("enum", "status_zamowienia", "Inne"), ("foreign_key", "id_klienta", "9"), ("not_null", "numer_zamowienia", None),
        ("not_null", "produkt_nazwa", None), ("unique", "numer_zamowienia", "2")]))


def test_a_repeated_old_key_multiplies_nothing(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    child = spark.createDataFrame([(10, 1), (11, 1)], "c long, k long")
    mapping = spark.createDataFrame([(1, 7), (1, 5)], "old_key long, new_key long")
    p, c = T.cascade_update(parent, child, mapping, "k", "k")
    assert rows(p) == [(2,), (5,)] and rows(c) == [(10, 5), (11, 5)]


def test_widths_keys_and_categories_are_part_of_the_contracts(spark):
    customers = spark.createDataFrame(
        [(1, "a" * 60, "n", "A@b"), (1, "b", "n", "a@B"), (None, "c", None, "e" * 101)], "id_klienta long, imie string, nazwisko string, email string")
    report = lambda df: [tuple(r) for r in df.select("rule", "key", "column", "value").collect()]
    got = report(T.check_contract(customers, T.CUSTOMER_CONTRACT))
    assert sorted(map(str, got)) == sorted(map(str, [
        ("width", "1", "imie", "a" * 60), ("primary_key", "1", "id_klienta", "2"), ("primary_key", None, "id_klienta", None),
        ("not_null", None, "nazwisko", None), ("width", None, "email", "e" * 101), ("unique", "A@b", "email", "2")]))
    orders = spark.createDataFrame([(1, 1, "ZA-1", "x", None, "123456789.5", None, "99999"), (2, 1, "ZA-2", "x", "k" * 51, "1", 2, None)],
                                   "id_zamowienia long, id_klienta long, numer_zamowienia string, produkt_nazwa string, kategoria string, "
                                   "cena_jednostkowa string, ilosc int, koszt_dostawy string")
    orders = orders.withColumn("cena_jednostkowa", F.col("cena_jednostkowa").cast("decimal(18,2)")).withColumn("koszt_dostawy", F.col("koszt_dostawy").cast("decimal(18,2)"))
    got = report(T.check_contract(orders, T.ORDER_CONTRACT, {"customers": customers.select("id_klienta")}))
    assert sorted(map(str, got)) == sorted(map(str, [
        ("not_null", "1", "kategoria", None), ("range", "1", "cena_jednostkowa", "123456789.50"), ("range", "1", "koszt_dostawy", "99999.00"),
        ("width", "2", "kategoria", "k" * 51)]))
