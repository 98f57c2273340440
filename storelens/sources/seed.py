"""Seed tables for the shop schema (S6, G1-G6) at any size.

Every column is a function of the row key and a seed, through one hash per
column that other engines also compute (md5 of ``id-column-seed``, first 8
hex digits), so a seeded table is reproducible and needs no driver-side
random state.  Keys come from a DataFrame, so the work is as distributed as
the key table.  Foreign keys are drawn as a dense customer position
``h % n`` and joined back: no collect of the customer keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from storelens.functions.times import ntz_from_us
from storelens.operators.contracts import (ACCOUNT_STATUSES, ACCOUNT_TYPES, ORDER_STATUSES,
                                           PAYMENT_METHODS, assign_ids, order_number)

US = 1_000_000
DAY_US = 86_400 * US
HOUR_US = 3_600 * US

# Fixed values from the reference seeder: provinces, weights, product catalogue.
PROVINCES = [
    "Mazowieckie", "Małopolskie", "Wielkopolskie", "Śląskie", "Dolnośląskie",
    "Pomorskie", "Łódzkie", "Zachodniopomorskie", "Kujawsko-Pomorskie",
    "Lubelskie", "Podkarpackie", "Opolskie", "Lubuskie", "Podlaskie",
    "Świętokrzyskie", "Warmińsko-Mazurskie",
]
ACCOUNT_STATUS_WEIGHTS = [90, 5, 5]
ORDER_STATUS_WEIGHTS = [10, 20, 15, 20, 25, 5, 5]
QUANTITIES = [1, 2, 3]
QUANTITY_WEIGHTS = [85, 12, 3]
DELIVERY_FEE = "14.99"
REGISTRATION_DAYS = 730
ORDER_DAYS = 180
ORDER_HOURS = 23
CATALOGUE = {
    "Elektronika": [
        ("Smartfon 5G 128GB", "1499.99"), ("Słuchawki bezprzewodowe ANC", "299.00"),
        ("Ładowarka indukcyjna 15W", "79.90"), ("Telewizor 55 cali 4K SmartTV", "2499.00"),
        ("Konsola do gier NextGen", "2199.00"), ("Powerbank 20000mAh", "119.00"),
        ("Myszka bezprzewodowa ergonomiczna", "149.00"), ("Klawiatura mechaniczna RGB", "249.00"),
    ],
    "Moda": [
        ("Koszulka bawełniana męska", "59.99"), ("Sukienka letnia w kwiaty", "129.90"),
        ("Buty sportowe do biegania", "349.00"), ("Kurtka zimowa puchowa", "450.00"),
        ("Skórzany pasek do spodni", "89.00"), ("Ciepła bluza z kapturem", "159.00"),
        ("Skarpetki bambusowe 5-pak", "39.99"), ("Okulary przeciwsłoneczne UV400", "79.00"),
    ],
    "Dom i Ogród": [
        ("Kosiarka spalinowa z napędem", "1250.00"), ("Zestaw garnków stalowych (10 el.)", "399.00"),
        ("Wiertarka udarowa 800W", "189.00"), ("Nowoczesna lampa stojąca", "149.90"),
        ("Ergonomiczny fotel biurowy", "549.00"), ("Zestaw narzędzi ogrodowych", "99.00"),
        ("Patelnia nieprzywierająca 28cm", "85.00"), ("Koc puszysty mikrofibra", "69.90"),
    ],
    "Motoryzacja": [
        ("Wycieraczki samochodowe komplet", "65.00"), ("Olej silnikowy 5W30 5L", "179.00"),
        ("Opony zimowe komplet 16 cali", "1150.00"), ("Wideorejestrator jazdy FullDH", "249.00"),
        ("Pokrowce na fotele samochodowe", "139.00"), ("Zestaw kluczy nasadowych", "320.00"),
        ("Szampon samochodowy z woskiem", "29.90"), ("Alkomat elektrochemiczny", "199.00"),
    ],
    "Książki i Rozrywka": [
        ("Powieść kryminalna (Bestseller)", "39.90"), ("Podręcznik: Python od podstaw", "69.00"),
        ("Biografia znanego sportowca", "45.00"), ("Gra planszowa strategiczna", "149.00"),
        ("Komiks Uniwersum polskie wydanie", "59.90"), ("Puzzle 1000 elementów Krajobraz", "34.90"),
    ],
}


def col_hash(key: Column, column: str, seed: int) -> Column:
    """Non-negative 32-bit hash of (key, column, seed): md5, first 8 hex digits."""
    text = F.concat_ws("-", key.cast("string"), F.lit(column), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform_choice(h: Column, values: Sequence) -> Column:
    """G1: ``values[h % n]``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int"))


def weighted_choice(h: Column, values: Sequence, weights: Sequence[int]) -> Column:
    """Cumulative thresholds on ``h % total``."""
    total = sum(weights)
    r = h % total
    out, acc = None, 0
    for v, w in zip(values, weights):
        acc += w
        out = F.when(r < acc, F.lit(v)) if out is None else out.when(r < acc, F.lit(v))
    return out


def _ts_text(us: Column) -> Column:
    return F.date_format(ntz_from_us(us), "yyyy-MM-dd HH:mm:ss")


def seed_customers(keys: DataFrame, key: str, seed: int, now_us: int) -> DataFrame:
    """One customer per key row (``klienci`` columns)."""
    k = F.col(key)

    def h(c):
        return col_hash(k, c, seed)

    days = h("data_rejestracji") % REGISTRATION_DAYS + 1
    return keys.select(
        k.cast("long").alias("id_klienta"),
        F.concat(F.lit("Imie"), k.cast("string")).alias("imie"),
        F.concat(F.lit("Nazwisko"), k.cast("string")).alias("nazwisko"),
        F.concat(F.lit("klient"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.format_string("+48 %09d", h("telefon") % 1_000_000_000).alias("telefon"),
        F.concat(F.lit("Miasto"), (h("miasto") % 100).cast("string")).alias("miasto"),
        uniform_choice(h("wojewodztwo"), PROVINCES).alias("wojewodztwo"),
        _ts_text(F.lit(now_us) - days * DAY_US).alias("data_rejestracji"),
        uniform_choice(h("typ_konta"), ACCOUNT_TYPES).alias("typ_konta"),
        weighted_choice(h("status_konta"), ACCOUNT_STATUSES, ACCOUNT_STATUS_WEIGHTS).alias("status_konta"),
    )


def _catalogue_columns(h_cat: Column, h_prod: Column):
    """G1, two steps: category uniformly, then a product of that category."""
    cats = list(CATALOGUE)
    cat = uniform_choice(h_cat, cats)
    name, price = None, None
    for c in cats:
        names = uniform_choice(h_prod, [p[0] for p in CATALOGUE[c]])
        prices = uniform_choice(h_prod, [p[1] for p in CATALOGUE[c]])
        name = F.when(cat == c, names) if name is None else name.when(cat == c, names)
        price = F.when(cat == c, prices) if price is None else price.when(cat == c, prices)
    return cat, name, price.cast("decimal(10,2)")


def seed_orders(keys: DataFrame, key: str, customers: DataFrame, customer_key: str, seed: int,
                now_us: int, year: int) -> DataFrame:
    """One order per key row (``zamowienia`` columns).

    G5: the customer is the ``h % n``-th customer in key order; customer
    positions are dense ids from :func:`assign_ids` (no collect).
    """
    k = F.col(key)

    def h(c):
        return col_hash(k, c, seed)

    pos = assign_ids(customers.select(customer_key), [customer_key], start=0, id_col="__pos")
    n = customers.count()
    cat, name, price = _catalogue_columns(h("kategoria"), h("produkt"))
    days = h("dni") % ORDER_DAYS + 1
    hours = h("godziny") % (ORDER_HOURS + 1)
    orders = keys.select(
        k.cast("long").alias("id_zamowienia"),
        (h("id_klienta") % n + 1).alias("__pos"),
        order_number(k.cast("long"), F.lit(year)).alias("numer_zamowienia"),
        _ts_text(F.lit(now_us) - days * DAY_US - hours * HOUR_US).alias("data_zamowienia"),
        weighted_choice(h("status_zamowienia"), ORDER_STATUSES, ORDER_STATUS_WEIGHTS).alias("status_zamowienia"),
        name.alias("produkt_nazwa"), cat.alias("kategoria"), price.alias("cena_jednostkowa"),
        weighted_choice(h("ilosc"), QUANTITIES, QUANTITY_WEIGHTS).cast("int").alias("ilosc"),
        F.when(h("koszt_dostawy") % 2 == 0, F.lit("0.00")).otherwise(F.lit(DELIVERY_FEE))
         .cast("decimal(6,2)").alias("koszt_dostawy"),
        uniform_choice(h("metoda_platnosci"), PAYMENT_METHODS).alias("metoda_platnosci"),
    )
    out = orders.join(pos.select("__pos", F.col(customer_key).cast("long").alias("id_klienta")), "__pos")
    return out.drop("__pos")


def distribution_check(df: DataFrame, col: str, values: Sequence, weights: Sequence[int]) -> DataFrame:
    """Observed count and share per value against the stated weights."""
    spark = df.sparkSession
    total_w = sum(weights)
    stated = spark.createDataFrame([(v, w / total_w) for v, w in zip(values, weights)],
                                   f"{col} string, expected_share double")
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("observed"))
    from pyspark.sql import Window
    share = F.col("observed") / F.sum("observed").over(Window.partitionBy())
    return (F.broadcast(stated).join(counts, col, "left").na.fill(0, ["observed"])
            .withColumn("observed_share", share))
