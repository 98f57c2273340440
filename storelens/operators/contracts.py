"""Table contracts T1-T10: the DDL rules of the shop schema as data jobs.

Parquet keeps no NOT NULL, UNIQUE, ENUM, width or foreign-key rule, so each
rule is a job that returns violations ``(rule, <key columns>, column, value)``
or the repaired table.  Every check is a single pass or a single shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from storelens.session import cut_lineage

# Fixed values of the shop schema (must equal the reference DDL).
ACCOUNT_TYPES = ["Standard", "Premium", "Firma"]
ACCOUNT_STATUSES = ["Aktywne", "Zablokowane", "Niezweryfikowane"]
ORDER_STATUSES = ["Nowe", "Oplacone", "W realizacji", "Wyslane", "Dostarczone", "Anulowane", "Zwrot"]
PAYMENT_METHODS = ["BLIK", "Karta", "Przelew", "Za pobraniem"]
CUSTOMER_DEFAULTS = {"typ_konta": "Standard", "status_konta": "Aktywne"}
ORDER_DEFAULTS = {"status_zamowienia": "Nowe", "ilosc": 1, "koszt_dostawy": 0.00,
                  "metoda_platnosci": "BLIK"}
TIMESTAMP_DEFAULTS = {"data_rejestracji", "data_zamowienia"}  # DEFAULT CURRENT_TIMESTAMP
ORDER_NUMBER_BASE = 1000  # numbers are ZA-{year}-{1000 + i}


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _violations(df: DataFrame, key, checks: Sequence[Column]) -> DataFrame:
    """Explode per-column check structs (rule, column, value, bad) in one pass."""
    keys = _keys(key)
    exploded = df.select(*keys, F.inline(F.array(*checks)))
    return exploded.where("bad").select("rule", *keys, "column", "value")


def check_not_null(df: DataFrame, key, cols: Sequence[str]) -> DataFrame:
    """One violation row per (row, column) that is null."""
    return _violations(df, key, _null_checks(cols))


def _null_checks(cols: Sequence[str], rule: str = "not_null") -> list[Column]:
    return [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"),
                     F.lit(None).cast("string").alias("value"), F.col(c).isNull().alias("bad"))
            for c in cols]


def fill_defaults(df: DataFrame, defaults: Mapping[str, object], now=None) -> DataFrame:
    """A null in a defaulted column is treated as omitted and gets the default.

    A default of ``"CURRENT_TIMESTAMP"`` takes ``now`` (an argument, so runs repeat).
    """
    out = df
    for c, value in defaults.items():
        if value == "CURRENT_TIMESTAMP":
            fill = F.lit(now).cast(df.schema[c].dataType)
        else:
            fill = F.lit(value).cast(df.schema[c].dataType)
        out = out.withColumn(c, F.coalesce(F.col(c), fill))
    return out


def check_unique(df: DataFrame, cols: Sequence[str] | str, collation: str | None = None) -> DataFrame:
    """Key values held by more than one row.  NULL keys never conflict.

    With ``collation`` (e.g. ``UNICODE_CI``) the key compares under it, as
    the database's case-insensitive collation does.  Which of the spellings stands for
    the others is not fixed (``check_contract`` reports the least).
    """
    cols = _keys(cols)
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    if collation:
        strings = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
        keyed = keyed.select(*[F.collate(F.col(c), collation).alias(c) if c in strings else F.col(c)
                               for c in cols])
    return keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def enum_rank(c: Column, values: Sequence[str]) -> Column:
    """T4: 1-based declaration index of the value (ENUM sort order); 0 when absent."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def check_enum(df: DataFrame, key, col: str, values: Sequence[str]) -> DataFrame:
    """T4: non-null values outside the declared list."""
    return _violations(df, key, [_enum_check(col, values)])


def _enum_check(col: str, values: Sequence[str]) -> Column:
    bad = F.col(col).isNotNull() & ~F.col(col).isin(list(values))
    return F.struct(F.lit("enum").alias("rule"), F.lit(col).alias("column"), F.col(col).cast("string").alias("value"), bad.alias("bad"))


def check_width(df: DataFrame, key, specs: Mapping[str, str]) -> DataFrame:
    """T5: ``varchar(n)`` length (code points) and ``decimal(p,s)`` range checks.

    ``try_cast`` yields null on overflow instead of raising under ANSI mode.
    """
    return _violations(df, key, _width_checks(specs))


def _width_checks(specs: Mapping[str, str]) -> list[Column]:
    checks = []
    for c, spec in specs.items():
        spec = spec.strip().lower()
        if spec.startswith("varchar"):
            n = int(spec[spec.index("(") + 1:spec.index(")")])
            bad = F.length(F.col(c)) > n
            rule = "width"
        elif spec.startswith("decimal"):
            bad = F.col(c).isNotNull() & F.col(c).try_cast(spec).isNull()
            rule = "range"
        else:
            raise ValueError(f"unsupported spec {spec!r}")
        checks.append(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"),
                               F.col(c).cast("string").alias("value"),
                               F.coalesce(bad, F.lit(False)).alias("bad")))
    return checks


def check_fk(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Child rows whose non-null key has no parent (anti join)."""
    return child.where(F.col(child_col).isNotNull()).join(
        parent.select(F.col(parent_col).alias("__pk")), F.col(child_col) == F.col("__pk"), "left_anti")


def cascade_delete(parent: DataFrame, child: DataFrame, deleted: DataFrame, parent_col: str,
                   child_col: str, deleted_col: str | None = None):
    """Drop the deleted parents and, by cascade, their children.

    Returns ``(parent_left, child_left)``; both are anti joins against the
    deleted-key table.
    """
    dk = deleted.select(F.col(deleted_col or parent_col).alias("__dk")).where("__dk is not null")
    parent_left = parent.join(dk, F.col(parent_col) == F.col("__dk"), "left_anti")
    child_left = child.join(dk, F.col(child_col) == F.col("__dk"), "left_anti")
    return parent_left, child_left


def cascade_delete_counts(parent: DataFrame, child: DataFrame, deleted: DataFrame,
                          parent_col: str, child_col: str) -> DataFrame:
    """T7 summary: rows before, after and removed, per table."""
    dk = deleted.select(F.col(parent_col).alias("__dk")).where("__dk is not null").distinct()

    def summary(name, df, col):
        # one pass: mark rows whose key is deleted, count both kinds
        marked = df.select(col).join(dk, F.col(col) == F.col("__dk"), "left")
        return marked.agg(
            F.count(F.lit(1)).alias("rows_before"),
            F.count(F.when(F.col("__dk").isNull(), 1)).alias("rows_after"),
            F.count("__dk").alias("rows_deleted")).select(F.lit(name).alias("table_name"), "*")

    return summary("parent", parent, parent_col).unionByName(summary("child", child, child_col))


def cascade_update(parent: DataFrame, child: DataFrame, mapping: DataFrame, parent_col: str,
                   child_col: str, old_col: str = "old_key", new_col: str = "new_key"):
    """Re-key parents and, by cascade, their children: ``coalesce(new, old)``.

    An old key mapped twice takes its least new key, so no row is multiplied.
    Duplicate new keys are reported by :func:`check_unique` on the result.
    """
    m = mapping.groupBy(F.col(old_col).alias("__old")).agg(F.min(new_col).alias("__new"))

    def rekey(df, col):
        cols = [F.coalesce("__new", F.col(col)).alias(col) if c == col else F.col(c) for c in df.columns]
        return df.join(m, F.col(col) == F.col("__old"), "left").select(*cols)

    return rekey(parent, parent_col), rekey(child, child_col)


def assign_ids(df: DataFrame, order_by: Sequence[str] | str, start=None, id_col: str = "new_id",
               num_partitions: int | None = None) -> DataFrame:
    """Consecutive ids in ``order_by`` order, continuing after ``start``.

    No single-partition window: rows are range-partitioned by the (unique)
    order key, sorted inside each partition, numbered by position, and the
    result is checkpointed, because a recomputed range split may differ.
    Per-partition counts (one row per partition) give the offsets, which are
    broadcast back.  ``start`` is the current maximum id (default 0).
    """
    keys = _keys(order_by)
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = (df.repartitionByRange(int(n), *keys).sortWithinPartitions(*keys)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    ranged = ranged.select("*", F.shiftright("__mid", 33).alias("__pid"),
                           (F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("__pos"))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    base = F.lit(0 if start is None else start).cast("long")
    out = ranged.join(F.broadcast(offsets), "__pid")
    return out.select(*df.columns, (base + F.col("__off") + F.col("__pos") + 1).alias(id_col))


def order_number(i, year) -> Column:
    """``ZA-{year}-{1000 + i}``."""
    i = F.col(i) if isinstance(i, str) else i
    year = F.col(year) if isinstance(year, str) else year
    return F.format_string("ZA-%d-%d", year.cast("int"), (F.lit(ORDER_NUMBER_BASE) + i).cast("long"))


# ------------------------------------------------------------------ declared contracts

@dataclass(frozen=True)
class Contract:
    """The declared rules of one table (T1-T6): what a DDL statement says."""

    key: str
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    unique_collation: str = "UNICODE_CI"
    enums: Mapping[str, Sequence[str]] = field(default_factory=dict)
    widths: Mapping[str, str] = field(default_factory=dict)
    foreign_keys: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> (parent table, its key)
    defaults: Mapping[str, object] = field(default_factory=dict)


#: The two tables of the shop (fixed values: keys, columns, widths, lists and defaults of the reference DDL).
CUSTOMER_CONTRACT = Contract(
    "id_klienta", not_null=("imie", "nazwisko", "email"), unique=("email",),
    enums={"typ_konta": ACCOUNT_TYPES, "status_konta": ACCOUNT_STATUSES},
    widths={"imie": "varchar(50)", "nazwisko": "varchar(50)", "email": "varchar(100)", "telefon": "varchar(20)",
            "miasto": "varchar(50)", "wojewodztwo": "varchar(50)"},
    defaults={**CUSTOMER_DEFAULTS, "data_rejestracji": "CURRENT_TIMESTAMP"})
ORDER_CONTRACT = Contract(
    "id_zamowienia", not_null=("id_klienta", "numer_zamowienia", "produkt_nazwa", "kategoria", "cena_jednostkowa", "ilosc"),
    unique=("numer_zamowienia",),
    enums={"status_zamowienia": ORDER_STATUSES, "metoda_platnosci": PAYMENT_METHODS},
    widths={"numer_zamowienia": "varchar(30)", "produkt_nazwa": "varchar(150)", "kategoria": "varchar(50)",
            "cena_jednostkowa": "decimal(10,2)", "koszt_dostawy": "decimal(6,2)"},
    foreign_keys={"id_klienta": ("customers", "id_klienta")},
    defaults={**ORDER_DEFAULTS, "data_zamowienia": "CURRENT_TIMESTAMP"})


def check_contract(df: DataFrame, contract: Contract, parents: Mapping[str, DataFrame] | None = None, now=None) -> DataFrame:
    """All violations of a contract in one report ``(rule, key, column, value)``.

    Defaults are filled first (T2), so a null in a column with a default is no
    violation.  ``key`` is the row's key as text, or the repeated value (of several
    spellings the least) for the unique and primary-key rules.  Rules of columns that
    ``df`` does not have are left out.  All rules of single rows are checked in one pass; each
    unique rule, and the primary key, is one aggregation.
    """
    has = set(df.columns)
    df = fill_defaults(df, {c: v for c, v in contract.defaults.items() if c in has}, now)
    checks = _null_checks([contract.key], "primary_key") + _null_checks([c for c in contract.not_null if c in has])
    checks += [_enum_check(c, values) for c, values in contract.enums.items() if c in has]
    checks += _width_checks({c: spec for c, spec in contract.widths.items() if c in has})
    found = df.select(F.col(contract.key).cast("string").alias("key"), F.inline(F.array(*checks))).where("bad")
    out = found.select("rule", "key", "column", "value")
    for col, rule in [(contract.key, "primary_key"), *[(c, "unique") for c in contract.unique if c in has]]:
        kept = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("text"))
        grouped = kept.groupBy(F.collate("text", contract.unique_collation if rule == "unique" else "UTF8_BINARY").alias("k"))
        dup = grouped.agg(F.min("text").alias("key"), F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionAll(dup.select(F.lit(rule).alias("rule"), "key", F.lit(col).alias("column"), F.col("n").cast("string").alias("value")))
    for col, (table, parent_key) in contract.foreign_keys.items():
        bad = check_fk(df, parents[table], col, parent_key)
        row = bad.select(F.lit("foreign_key").alias("rule"), F.col(contract.key).cast("string").alias("key"), F.lit(col).alias("column"),
                         F.col(col).cast("string").alias("value"))
        out = out.unionAll(row)
    return out
