from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from storelens.operators import sqlpolicy as Q
from storelens.functions.text import PY_WHITESPACE
from tests.conftest import rows

STATEMENTS = [
    "```sql\nSELECT 1\n```", "```SQL\nSELECT 1```", "select updated_at from t", "TRUNCATE t",
    "dRoP table t", "\t\n  SELECT 2;\n ", "", "Insert into x values (1)",
]


def _py_clean(s):
    return s.replace("```sql", "").replace("```", "").strip()


def test_clean_and_screen_match_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STATEMENTS)], "i int, s string")
    out = df.select("i", Q.clean_statement("s").alias("c"), Q.is_write("s").alias("w"),
                    F.array_join(Q.write_words("s"), ",").alias("words"))
    got = {r.i: (r.c, r.w, r.words) for r in out.collect()}
    for i, s in enumerate(STATEMENTS):
        words = [w for w in Q.WRITE_WORDS if w in s.upper()]
        assert got[i] == (_py_clean(s), bool(words), ",".join(words))
    assert got[1][0] == "SQL\nSELECT 1"           # upper-case fence word stays
    assert got[2][1] is True and got[3][1] is False  # false positive kept, TRUNCATE not caught


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(PY_WHITESPACE) + list("ab`sql ")), max_size=12))
def test_strip_equals_python_strip(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(Q.clean_statement("s").alias("c")).first().c
    assert got == _py_clean(s)


def test_decide_matrix(spark):
    df = spark.createDataFrame([("select 1", False), ("delete from t", False), ("delete from t", True),
                                ("select 1", True), ("select updated_at from t", True)],
                               "statement string, is_admin boolean")
    out = rows(Q.decide(df), "statement", "is_admin", "action", "login")
    assert out == [("delete from t", False, "refused", None), ("delete from t", True, "commit", "root"),
                   ("select 1", False, "rows", "customer"), ("select 1", True, "rows", "root"),
                   ("select updated_at from t", True, "commit", "root")]


def test_run_read_outcomes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    tables = {"klienci": t}
    o, df, _ = Q.run_read(spark, "```sql\nSELECT * FROM klienci ORDER BY id LIMIT 1;\n```", tables)
    assert o == "rows" and [r.id for r in df.collect()] == [1]
    o, _, msg = Q.run_read(spark, "SELECT * FROM klienci WHERE id > 5", tables)
    assert o == "empty" and "ale baza jest pusta" in msg
    assert Q.run_read(spark, "DELETE FROM klienci", tables)[0] == "refused"
    assert Q.run_read(spark, "TRUNCATE klienci", tables)[0] == "error"   # not caught, but cannot run
    assert Q.run_read(spark, "SELEC nope", tables)[0] == "error"
    assert Q.run_read(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a", tables)[0] == "rows"


def test_phrase_modes(spark):
    df = spark.createDataFrame([(1, "Łódź"), (2, "ŚLĄSKIE"), (3, "100%_ok"), (4, "lodz")], "id int, t string")
    assert rows(Q.phrase_filter(df, "t", "lodz"), "id") == [(1,), (4,)]
    assert rows(Q.phrase_filter(df, "t", "śląskie", "lower"), "id") == [(2,)]
    assert rows(Q.phrase_filter(df, "t", "%_", "exact"), "id") == [(3,)]
    assert rows(Q.phrase_filter(df, "t", "0%", "collation"), "id") == [(3,)]


def test_top_n_requires_order(spark):
    df = spark.range(30)
    assert [r.id for r in Q.top_n(df, [F.col("id").desc()], 10).collect()] == list(range(29, 19, -1))
    try:
        Q.top_n(df, [], 10)
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_edits_and_counts(spark):
    t = spark.createDataFrame([(1, "Nowe"), (2, "Zwrot"), (3, None)], "id int, s string")
    out, n = Q.update_where(t, F.col("id") >= 2, {"s": F.lit("Zwrot")})
    assert rows(out) == [(1, "Nowe"), (2, "Zwrot"), (3, "Zwrot")] and n.first().affected_rows == 1
    out, n = Q.delete_where(t, F.col("s") == "Nowe")   # null predicate keeps row 3
    assert rows(out, "id") == [(2,), (3,)] and n.first().affected_rows == 1
    out, n = Q.insert_rows(t, spark.createDataFrame([(4, "Nowe")], "id int, s string"))
    assert out.count() == 4 and n.first().affected_rows == 1
    out, n = Q.delete_where(t, F.lit(True), is_admin=False)
    assert out.count() == 3 and n.first().affected_rows == 0


def test_guest_reads_nothing_but_the_permitted_tables(spark):
    import os
    import tempfile

    tables = {"klienci": spark.createDataFrame([(1,)], "id int"), "zam": spark.createDataFrame([(2,)], "id int")}
    assert Q.run_read(spark, "SELECT * FROM klienci", tables, is_admin=True)[0] == "rows"
    guest = lambda sql: Q.run_read(spark, sql, tables, guest_tables=["zam"])[0]
    assert guest("SELECT * FROM zam") == "rows"
    assert guest("WITH a AS (SELECT id FROM zam) SELECT * FROM a JOIN zam USING (id)") == "rows"
    assert guest("SELECT * FROM klienci") == "refused"                      # a view that an admin read used
    assert guest("SELECT * FROM zam WHERE id IN (SELECT id FROM klienci)") == "refused"
    path = os.path.join(tempfile.mkdtemp(prefix="storelens-guard-"), "t")
    tables["zam"].write.parquet(path)
    assert guest(f"SELECT * FROM parquet.`{path}`") == "refused"
    assert guest("SELECT java_method('java.lang.System', 'nanoTime')") == "refused"
    assert guest("SELECT `reflect` ('java.lang.System', 'nanoTime')") == "refused"


def test_views_are_left_as_they_were(spark):
    spark.range(7).createOrReplaceTempView("zam")
    Q.run_read(spark, "SELECT * FROM zam", {"zam": spark.range(1)})
    assert spark.table("zam").count() == 7
    spark.catalog.dropTempView("zam")
    Q.run_read(spark, "SELECT * FROM zam", {"zam": spark.range(1)})
    assert not any(t.name == "zam" for t in spark.catalog.listTables())


def test_run_time_errors_and_comments(spark):
    tables = {"t": spark.createDataFrame([(1, 0)], "a int, b int")}
    outcome, _, message = Q.run_read(spark, "SELECT 1/0", tables)
    assert outcome == "error" and message.startswith("BŁĄD MySQL: [")
    assert Q.run_read(spark, "SELECT a / b FROM t", tables)[0] == "error"
    assert Q.run_read(spark, "SELECT a FROM t -- all of them", tables)[0] == "rows"


def test_a_refused_edit_is_told_from_an_edit_of_no_rows(spark):
    t = spark.createDataFrame([(1, "Nowe")], "id int, s string")
    assert tuple(Q.delete_where(t, F.lit(True), is_admin=False)[1].first()) == ("refused", 0)
    assert tuple(Q.delete_where(t, F.lit(False))[1].first()) == ("modified", 0)


def test_guests_reach_nothing_outside_their_tables(spark):
    import os
    import tempfile

    spark.range(3).createOrReplaceTempView("leftover")
    spark.range(3).createOrReplaceGlobalTempView("leftover_everywhere")
    folder = os.path.join(tempfile.mkdtemp(prefix="storelens-guard-"), "t")
    spark.range(5).write.parquet(folder)
    zam = spark.read.parquet(folder).withColumn("v", F.col("id") + 1)
    guest = lambda sql: Q.run_read(spark, sql, {"zam": zam}, guest_tables=["zam"])[0]
    assert guest("select sum(v) from zam") == "rows"
    assert guest("with a as (with b as (select id from zam) select * from b) select * from a where id in (select max(v) - 1 from zam)") == "rows"
    for sql in ("select java_method /* c */ ('java.lang.System','getProperty','user.home')", "select reflect\n-- x\n('java.lang.System','nanoTime')",
                "select * from identifier('left' || 'over')", "select * from IDENTIFIER /* */ ('zam')", "select * from leftover",
                "select * from zam where id in (select id from leftover)", f"select * from parquet.`{folder}`", "select * from global_temp.leftover_everywhere",
                "with a as (select * from leftover) select * from a", "with leftover2 as (select 1) select * from leftover2 join leftover"):
        assert guest(sql) == "refused", sql
    # a name that nobody has is an error like any other
    assert guest("select * from nothing_of_that_name") == "error"
    assert spark.table("leftover").count() == 3
    spark.catalog.dropTempView("leftover")
    spark.catalog.dropGlobalTempView("leftover_everywhere")


def test_the_screen_is_not_the_only_guard(spark):
    """Without the look at the text, the session itself still holds: functions are replaced, views unseen, files closed."""
    spark.range(3).createOrReplaceTempView("leftover")
    own, passed = Q._reading_session(spark, {"zam": spark.range(2)}, guest=True)
    for sql in ("select java_method('java.lang.System', 'nanoTime')", "select * from leftover", "select * from parquet.`/tmp`"):
        try:
            own.sql(sql).collect()
            raise AssertionError(sql)
        except Exception as e:
            assert not isinstance(e, AssertionError), sql
    assert own.sql("select count(*) from zam").first()[0] == 2
    for name in passed:
        spark.catalog.dropGlobalTempView(name)
    spark.catalog.dropTempView("leftover")
    assert spark.sql("select reflect('java.lang.Math', 'abs', 5)").first()[0] == "5"  # the caller's session is as it was


def test_two_reads_at_once_do_not_meet(spark):
    from concurrent.futures import ThreadPoolExecutor

    def read(n):
        outcome, df, _ = Q.run_read(spark, "select sum(id) as s from t", {"t": spark.range(n)})
        return outcome, df.first().s

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(read, range(2, 10)))
    assert got == [("rows", n * (n - 1) // 2) for n in range(2, 10)]
