"""Host-level quality rules, in DataFrame functions only.

Every document is measured once; rule failures are counted per host, failure
rates are shrunk with a beta prior fitted over all hosts, and a host whose
shrunk rate passes a limit for any rule is rejected.  Host verdicts are joined
back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import WORD_RE, checkpointed
from storelens.llm.shrinkage import moments

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A host is rejected when its shrunk failure rate of one rule passes this share.
MAX_FAILURE_RATE = 0.5

#: The rules: name -> failure test over the measured columns.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "odd_word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Windows are compared by a 64-bit hash of their three words, sorted with
    their places; equal neighbours are repeats.
    """

    def of(w: Column) -> Column:
        windows = F.array_sort(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
        return _let(windows, covered)

    def covered(s: Column) -> Column:
        hash_at = lambda i: F.get(s, i).getField("h")
        repeated = F.filter(s, lambda x, i: F.coalesce(x["h"] == hash_at(i - 1), F.lit(False))
                            | F.coalesce(x["h"] == hash_at(i + 1), F.lit(False)))
        places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        total = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                            lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"),
                                                    (p + 3).alias("end")))
        return total.getField("n").cast("long")

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(of(words))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with one struct column ``m`` of the measures.

    A null text counts as empty: no words, all measures 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(t: Column) -> Column:
        bare = F.translate(t, WHITE, "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
        return F.struct(
            _let(F.regexp_extract_all(t, F.lit(WORD_RE), F.lit(0)),
                 lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                           (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))

    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(*kept, _let(text, of).alias("m"))


def judge_hosts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """One row per document: its id, host, measures, ``base_failed``, ``kept``.

    Measures are written once to the shared checkpoint folder (narrow rows, no
    text) and read for both the host counts and the final rows.  Counts are
    partial-aggregated, so a host with a third of all rows costs one row per
    task; the join back leaves skew splitting to AQE.  A null host is a host of
    its own.  An empty table gives no rows.
    """
    rows = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                               F.col(text_col).alias("text")))
    rows = checkpointed(rows.select("doc_id", "host", "m.w.n_words", "m.word_chars", "m.n_symbols",
                                    "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words"))
    hosts = (rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"),
                                      *[F.sum(F.when(F.expr(test), 1).otherwise(0)).alias(rule) for rule, test in RULES.items()]))
    prior = moments(hosts, list(RULES), "n_docs")
    shrunk = {rule: (F.col(rule) + F.lit(m * k)) / (F.col("n_docs") + F.lit(k)) for rule, (m, k) in prior.items()}
    verdict = hosts.select(F.col("host").alias("judged_host"),
                           (F.greatest(*shrunk.values()) > MAX_FAILURE_RATE).alias("host_rejected"))
    joined = rows.join(verdict, F.col("host").eqNullSafe(F.col("judged_host")), "left")
    base = F.expr(f"({RULES['too_short']}) or ({RULES['repetitive']})")
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
                         base.alias("base_failed"), (~base & ~F.col("host_rejected")).alias("kept"))
