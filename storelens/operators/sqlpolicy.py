"""Statement policy and query access, Q1-Q7, over whole statement logs.

The reference screens one model-written statement at a time; here the same
rules run as column expressions over a log of statements, and reads/edits run
as Spark plans over registered tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import PySparkException

from storelens.functions.text import col_of, py_strip

# Fixed values (must equal the reference): the screened words and the reply
# templates of the database helper.
WRITE_WORDS = ["DELETE", "UPDATE", "INSERT", "DROP", "ALTER"]
FENCE_OPEN = "```sql"
FENCE = "```"
MSG_REFUSED = "Odmowa dostępu. Niedozwolone polecenie"
MSG_EMPTY = "Wykonano zapytanie: {sql}, ale baza jest pusta lub nic nie pasuje."
MSG_ERROR = "BŁĄD MySQL: {err} | Próbowano wykonać: {sql}"


def clean_statement(c) -> Column:
    """Q1: drop "```sql", then "```" (case-sensitive), then strip whitespace."""
    s = F.replace(col_of(c), F.lit(FENCE_OPEN), F.lit(""))
    s = F.replace(s, F.lit(FENCE), F.lit(""))
    return py_strip(s)


def write_words(c) -> Column:
    """Q2: the screened words found as case-insensitive substrings, in list order."""
    up = F.upper(col_of(c))
    hits = F.array(*[F.when(up.contains(w), F.lit(w)) for w in WRITE_WORDS])
    return F.filter(hits, lambda x: x.isNotNull())


def is_write(c) -> Column:
    """Q2: true when any screened word occurs (false positives kept on purpose)."""
    up = F.upper(col_of(c))
    out = None
    for w in WRITE_WORDS:
        out = up.contains(w) if out is None else (out | up.contains(w))
    return out


def decide(df: DataFrame, sql: str = "statement", is_admin: str = "is_admin") -> DataFrame:
    """Q3: the policy decision for every statement of a log.

    guest + write -> refused; guest + read -> customer login, rows;
    admin + write -> root login, commit, affected count; admin + read -> root
    login, rows.  ``admin_read_as_write`` flags the reference defect where an
    admin read that merely contains a write word takes the commit branch.
    """
    cleaned = clean_statement(sql)
    w = is_write(cleaned)
    admin = F.coalesce(F.col(is_admin), F.lit(False))
    return df.select(
        "*",
        cleaned.alias("clean_sql"),
        w.alias("is_write"),
        F.when(~admin & w, F.lit("refused")).when(w, F.lit("commit")).otherwise(F.lit("rows")).alias("action"),
        F.when(~admin & w, F.lit(None).cast("string")).when(admin, F.lit("root"))
         .otherwise(F.lit("customer")).alias("login"),
        (admin & w & _starts_as_read(cleaned)).alias("admin_read_as_write"),
    )


def _starts_as_read(c: Column) -> Column:
    """The statement begins with SELECT or WITH (case-insensitive)."""
    head = F.upper(F.substring(c, 1, 6))
    return head.startswith("SELECT") | head.startswith("WITH")


#: functions that reach outside the registered tables, and names put together at run time; comments may part a name from its bracket
_REACHING = ("java_method", "try_reflect", "reflect")
_OUTSIDE = re.compile(rf"`?\b({'|'.join(_REACHING)}|identifier)\b`?(\s|/\*.*?\*/|--[^\n]*\n)*\(", re.IGNORECASE | re.DOTALL)
_RELATION = re.compile(r"'UnresolvedRelation \[(.*?)\]")
_CTE = re.compile(r"CTE \[(.*?)\]")


def _relations(spark: SparkSession, body: str) -> set[str]:
    """Names of the relations a statement reads, from its parsed plan (nothing is
    resolved or run); a name inside a text literal only adds to them."""
    plan = spark.sql(f"EXPLAIN EXTENDED SELECT * FROM (\n{body}\n)").first()[0]
    parsed = plan.split("== Analyzed Logical Plan ==")[0]
    own = {n.strip().lower() for names in _CTE.findall(parsed) for n in names.split(",")}
    return {n.strip().lower() for n in _RELATION.findall(parsed)} - own


def _not_for_guests(*_values) -> str:
    raise ValueError("not for guests")


def _reading_session(spark: SparkSession, tables: Mapping[str, DataFrame], guest: bool) -> tuple[SparkSession, list[str]]:
    """A session of its own in which the tables, and no other temporary views, have names.

    A guest's session reads no files by path, and the functions that call Java are replaced there by ones that raise.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        try:
            if own.conf.get(key, None) != value:
                own.conf.set(key, value)
        except PySparkException:  # a setting of the whole application
            pass
    passed = []
    for name, df in tables.items():
        passed.append(f"read_{uuid.uuid4().hex}")
        df.createGlobalTempView(passed[-1])
        own.sql(f"CREATE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.`{passed[-1]}`")
    if guest:
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        for function in _REACHING:
            own.udf.register(function, _not_for_guests)
    return own, passed


def run_read(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], is_admin: bool = False,
             guest_tables: Sequence[str] | None = None):
    """Q4: run one read over registered tables.

    Returns ``(outcome, DataFrame | None, message)`` with outcome one of
    ``refused``, ``rows``, ``empty``, ``error``.  The statement is cleaned
    (Q1) and screened (Q2).  A final ``;`` is dropped and the text wrapped as
    ``select * from (...)``, so commands that the screen misses (TRUNCATE,
    CREATE) fail to parse instead of running.

    Every read has a session of its own in which only its tables have names, so reads at the
    same time don't meet, and views of the caller's session are neither seen nor touched.  A
    guest reads the permitted tables alone: a statement is refused that names another
    relation that exists, calls Java, puts a name together at run time, or, once it is
    analysed, would read a file that belongs to none of the permitted tables.
    Run-time errors are the error outcome too.  Emptiness is tested with
    ``limit(1)``, never a full count.
    """
    clean = _clean_py(sql)
    if _is_write_py(clean) and not is_admin:
        return "refused", None, MSG_REFUSED
    permitted = tables if is_admin or guest_tables is None else {
        k: v for k, v in tables.items() if k in set(guest_tables)}
    body = clean[:-1] if clean.endswith(";") else clean
    passed: list[str] = []
    try:
        own, passed = _reading_session(spark, permitted, not is_admin)
        if not is_admin:
            others = _relations(own, body) - {k.lower() for k in permitted}
            if _OUTSIDE.search(body) or any(_there(spark, name, tables) for name in others):
                return "refused", None, MSG_REFUSED
        result = own.sql(f"select * from (\n{body}\n)")
        if not is_admin:
            theirs = {f for df in permitted.values() for f in df.inputFiles()}
            if not theirs.issuperset(result.inputFiles()):
                return "refused", None, MSG_REFUSED
        empty = len(result.limit(1).collect()) == 0
    except PySparkException as err:
        first = next((x.strip() for x in str(err).splitlines() if x.strip()), type(err).__name__)
        return "error", None, MSG_ERROR.format(err=first, sql=clean)
    finally:
        for name in passed:
            spark.catalog.dropGlobalTempView(name)
    if empty:
        return "empty", result, MSG_EMPTY.format(sql=clean)
    return "rows", result, None


def _there(spark: SparkSession, name: str, tables: Mapping[str, DataFrame]) -> bool:
    """Whether a relation's name means something: a table of the mapping, a view, a
    catalog table, or a name of several parts (a path or another schema)."""
    return "," in name or name in {k.lower() for k in tables} or _is_view(spark, name) or spark.catalog.tableExists(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name == name.lower() for t in spark.catalog.listTables())


def _clean_py(sql: str) -> str:
    return sql.replace(FENCE_OPEN, "").replace(FENCE, "").strip()


def _is_write_py(sql: str) -> bool:
    up = sql.upper()
    return any(w in up for w in WRITE_WORDS)


def top_n(df: DataFrame, order_by: Sequence, n: int = 10) -> DataFrame:
    """Q5: at most ``n`` rows in a defined order (an order key is required)."""
    if not order_by:
        raise ValueError("top_n needs an order key so the result is defined")
    return df.orderBy(*order_by).limit(n)


def phrase_match(c, phrase: str, mode: str = "collation") -> Column:
    """Q6: ``LIKE '%phrase%'`` semantics; ``%``/``_`` in the phrase are literal.

    ``collation``: case- and accent-insensitive (``UNICODE_CI_AI``), the
    database's ``utf8mb4_unicode_ci`` stand-in; ``lower``: case-insensitive
    on lower case; ``exact``: binary.
    """
    col = col_of(c)
    if mode == "collation":
        return F.collate(col, "UNICODE_CI_AI").contains(F.lit(phrase))
    if mode == "lower":
        return F.lower(col).contains(F.lit(phrase.lower()))
    if mode == "exact":
        return col.contains(F.lit(phrase))
    raise ValueError(mode)


def phrase_filter(df: DataFrame, col: str, phrase: str, mode: str = "collation") -> DataFrame:
    """Q6: rows whose column contains the phrase."""
    return df.where(phrase_match(col, phrase, mode))


def insert_rows(table: DataFrame, rows: DataFrame, is_admin: bool = True):
    """Q7: append rows; returns ``(new_table, affected)`` (affected: one row of ``outcome``,
    modified or refused, and ``affected_rows``)."""
    if not is_admin:
        return table, _refused_frame(table)
    return table.unionByName(rows), _count_frame(rows)


def update_where(table: DataFrame, predicate: Column, assignments: Mapping[str, Column],
                 is_admin: bool = True):
    """Q7: set columns where the predicate holds; a null predicate changes nothing.

    ``affected`` counts rows whose value really changes.
    """
    if not is_admin:
        return table, _refused_frame(table)
    hit = F.coalesce(predicate, F.lit(False))
    out = table.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments
                         else F.col(c) for c in table.columns])
    changed = None
    for c, v in assignments.items():
        d = ~F.col(c).eqNullSafe(v)
        changed = d if changed is None else (changed | d)
    return out, _count_frame(table.where(hit & changed))


def delete_where(table: DataFrame, predicate: Column, is_admin: bool = True):
    """Q7: delete rows where the predicate is true (null keeps the row)."""
    if not is_admin:
        return table, _refused_frame(table)
    hit = F.coalesce(predicate, F.lit(False))
    return table.where(~hit), _count_frame(table.where(hit))


def _count_frame(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("affected_rows")).select(F.lit("modified").alias("outcome"), "affected_rows")


def _refused_frame(df: DataFrame) -> DataFrame:
    """The outcome of an edit that a guest may not make: told from an edit of no rows."""
    return df.sparkSession.range(1).select(F.lit("refused").alias("outcome"), F.lit(0).cast("long").alias("affected_rows"))
