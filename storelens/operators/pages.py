"""Short-phrase search over a table of web pages (V9).

The reference sends keywords to a web search and reads back the best text;
here a table of pages is searched for a table of phrases at once.  Pages are
stripped of script, style, comments and tags, cut into terms, and
pre-aggregated to ``(page, term, tf)`` postings, so a page contributes one
row per distinct term, never one per occurrence.
Ranking (ours): distinct query terms hit, then total hits, then page id.

A plain join of query terms to postings would emit every (phrase, page) pair
sharing a common word ("the" is in most pages and most phrases).  The
search is instead the threshold algorithm (Fagin et al., 2001), run for all
phrases at once in rounds: a round reads only the ``depth`` best postings of
each query term (by tf, then page), scores those candidate pages exactly,
and bounds every unseen page by the postings just below the depth.  A phrase
whose k-th candidate beats that bound strictly (or whose terms' lists are
exhausted) is final; the others go to the next round with eight times the
depth.  The result equals the exhaustive ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from storelens.functions.text import col_of
from storelens.functions.windows import top_k_per_group
from storelens.session import cut_lineage

# Patterns without backreferences or look-around (same text in Java and RE2).
SCRIPT_RE = r"(?is)<script[^>]*>.*?</script>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style>"
COMMENT_RE = r"(?s)<!--.*?-->"
TAG_RE = r"<[^>]*>"
TERM_SPLIT_RE = r"[^\p{L}\p{N}]+"


def page_text(html) -> Column:
    """Visible text of an HTML page (tags replaced by a space)."""
    t = F.regexp_replace(col_of(html), SCRIPT_RE, " ")
    t = F.regexp_replace(t, STYLE_RE, " ")
    t = F.regexp_replace(t, COMMENT_RE, " ")
    return F.regexp_replace(t, TAG_RE, " ")


def terms(text) -> Column:
    """Lower-case terms of a text (letters and digits), empty strings dropped."""
    return F.filter(F.split(F.lower(col_of(text)), TERM_SPLIT_RE), lambda x: x != "")


def page_postings(pages: DataFrame, page_id: str = "page_id", html: str = "html",
                  wanted: DataFrame | None = None) -> DataFrame:
    """(page_id, term, tf): map-side combined per page; with ``wanted`` (a
    ``term`` column) only for those terms."""
    found = pages.select(page_id, F.explode(terms(page_text(html))).alias("term"))
    if wanted is not None:
        found = found.join(wanted, "term", "left_semi")
    return (found.groupBy(page_id, "term").agg(F.count(F.lit(1)).alias("tf")))


def page_search(pages: DataFrame, phrases: DataFrame, k: int = 3, page_id: str = "page_id",
                html: str = "html", phrase_id: str = "phrase_id", phrase: str = "phrase",
                depth: int | None = None) -> DataFrame:
    """V9: the k best pages per phrase: ``(phrase_id, page_id, n_terms, hits, rank)``.

    ``depth`` is the first round's postings per term (default ``max(64, 4k)``);
    each further round reads eight times as many.
    The phrases' own postings and their terms are written once to the checkpoint folder and
    reread by every round; each round's final phrases are written there too.
    """
    # distinct (phrase, term) pairs: a phrase id given twice counts each term once
    q = cut_lineage(phrases.select(phrase_id, F.explode(F.array_distinct(terms(phrase))).alias("term"))
                    .distinct())
    post = cut_lineage(page_postings(pages, page_id, html, q.select("term").distinct()))
    d = depth or max(64, 4 * k)
    pending = q.select(phrase_id).distinct()
    finals = []
    while True:
        qp = q.join(pending, phrase_id, "left_semi")
        # the d + 1 best postings of every pending term; Spark cuts each term
        # to d + 1 rows per map task before the exchange, so a common term
        # never travels whole
        lists = top_k_per_group(post.join(qp.select("term").distinct(), "term", "left_semi"), ["term"],
                                [F.col("tf").desc(), F.col(page_id)], d + 1, out="__pos")
        # at most d + 1 rows per pending phrase and term; a phrase none of
        # whose terms occurs in any page has no match and drops out here
        reach = qp.join(lists, "term")
        below = F.col("__pos") == d + 1
        # an unseen page scores at most (unexhausted terms, sum of their next tf)
        bound = reach.groupBy(phrase_id).agg(
            F.count(F.when(below, 1)).alias("__bx"),
            F.coalesce(F.sum(F.when(below, F.col("tf"))), F.lit(0)).alias("__by"))
        cand = reach.where(~below).select(phrase_id, page_id).distinct()
        scored = (cand.join(qp, phrase_id).join(post, ["term", page_id])
                  .groupBy(phrase_id, page_id)
                  .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("hits")))
        order = [F.col("n_terms").desc(), F.col("hits").desc(), F.col(page_id)]
        ranked = top_k_per_group(scored, [phrase_id], order, k)
        kth = ranked.where(F.col("rank") == k).select(phrase_id, F.col("n_terms").alias("__kx"),
                                                      F.col("hits").alias("__ky"))
        # fewer than k candidates (no k-th row) is final only once all lists are read
        done = F.coalesce((F.col("__bx") == 0) | (F.col("__kx") > F.col("__bx"))
                          | ((F.col("__kx") == F.col("__bx")) & (F.col("__ky") > F.col("__by"))), F.lit(False))
        status = bound.join(kth, phrase_id, "left").select(phrase_id, done.alias("__done"))
        # one written table per round: the status of every pending phrase with
        # its ranked rows (none when it has no candidate yet)
        rnd = cut_lineage(status.join(ranked, phrase_id, "left"))
        finals.append(rnd.where(F.col("__done") & F.col(page_id).isNotNull()).drop("__done"))
        pending = rnd.where(~F.col("__done")).select(phrase_id).distinct()
        if not pending.limit(1).count():
            break
        d *= 8
    out = finals[0]
    for f in finals[1:]:
        out = out.unionByName(f)
    return out
