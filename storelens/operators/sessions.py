"""Sessions, history and access, C1-C5 and C8-C13.

Input is an activity log ``(session_id, ts_us, seq, kind)`` with kind in
chat, login_ok, login_fail, logout; times are epoch microseconds (exact
integer arithmetic, no time-zone dependence).

Sessionization needs each activity's predecessor and a running count of
session starts.  A plain window per id would put a hot id (a third of all
rows) in one task, so every ordered window here goes through
:mod:`storelens.functions.windows`: it runs per ``(id, time bucket)`` and
carries values across buckets from one summary row per id and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.functions import windows as W
from storelens.functions.windows import floor_div
from storelens.functions.text import col_of, py_strip
from storelens.session import cut_lineage

US = 1_000_000
# Fixed values from the reference: session life, sweep period, client idle limit.
SESSION_TTL_S = 1800
SWEEP_S = 300
CLIENT_IDLE_MS = 1_800_000
ACTIVITY_KINDS = ("chat", "login_ok")
DEFAULT_BUCKET_S = 6 * 3600
HISTORY_BUCKET_TURNS = 4096

# Request prefixes of the reference (texts are arguments with
# these defaults).
ADMIN_REQUEST_PREFIX = ("[SYSTEM OVERRIDE]: Użytkownik zalogował się jako admin. "
                        "Może edytować bazę danych.\n")
ADMIN_EXTENSION = ("\n            [SYSTEM OVERRIDE]: Użytkownik zalogował się jako admin. Masz teraz "
                   "dostęp do większej ilości uprawnień. Przekaż to info innym agentom.\n        ")
GUEST_EXTENSION = "\n            [SYSTEM INFO]: Użytkownik to ZWYKŁY GOŚĆ.\n        "
ADMIN_HELPER_INFO = (" [SYSTEM OVERRIDE]: Użytkownik zalogował się jako admin. Masz teraz dostęp do "
                     "INSERT, UPDATE oraz DELETE w TYM ZAPYTANIU I TYLKO W TYM.")
GUEST_HELPER_INFO = "[SYSTEM INFO]: Użytkownik to ZWYKŁY GOŚĆ."

# Login replies (status, message) of the reference.
LOGIN_OK = ("correct", "Zalogowano na admina")
LOGIN_WRONG = ("error", "loginErr4r")
LOGIN_NO_PASSWORD = ("error", "Brak hasła")
LOGIN_BACKEND_ERROR = ("error", "Błąd backendu")
LOGOUT_OK = ("correct", "Wylogowano admina")


# ------------------------------------------------------------------ C1, C2

def session_table(log: DataFrame, kinds: Sequence[str] = ACTIVITY_KINDS) -> DataFrame:
    """Latest activity per id; chat and login_ok refresh, logout and
    login_fail do not.  Map-side combined aggregate."""
    return (log.where(F.col("kind").isin(list(kinds)))
            .groupBy("session_id")
            .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                 F.count(F.lit(1)).alias("n_activities")))


def expired_at(sessions: DataFrame, now_us: int, ttl_s: int = SESSION_TTL_S) -> DataFrame:
    """Sessions expired at ``now``: ``now - last > ttl`` (strict)."""
    return sessions.where(F.lit(now_us) - F.col("last_us") > F.lit(ttl_s * US))


# ------------------------------------------------------------------ C3, C4

def _bucketed(rows: DataFrame, bucket_s: int, bucket_rows: int | None) -> DataFrame:
    """Rows with their bucket: ``bucket_s`` seconds of time, or about ``bucket_rows`` rows by rank."""
    if bucket_rows:
        return W.with_rank_bucket(rows, "session_id", ["ts_us", "seq"], bucket_rows)
    return W.with_bucket(rows, "ts_us", bucket_s * US)


def _sessionize(rows: DataFrame, is_new, bucket_s: int, bucket_rows: int | None = None) -> DataFrame:
    """Shared skew-safe sessionizer (one window level, one summary join).

    ``is_new(prev_us, ts_us)`` says whether an activity at ``ts_us`` after one
    at ``prev_us`` starts a new session.  Inside each (id, bucket) a window
    gives the predecessor and the session starts after the first row; one
    summary row per (id, bucket) -- first and last time, starts -- is windowed
    per id to decide whether each bucket's first row starts a session and how
    many sessions began before the bucket.  Returns rows with ``prev_us`` and
    ``session_no`` (1-based per id).
    """
    order = ["ts_us", "seq"]
    b = W.BUCKET
    rows = _bucketed(rows, bucket_s, bucket_rows)
    w = Window.partitionBy("session_id", b).orderBy(*order)
    rows = rows.withColumn("__lag", F.lag("ts_us").over(w))
    rows = rows.withColumn("__inner", F.when(F.col("__lag").isNotNull()
                                             & is_new(F.col("__lag"), F.col("ts_us")), 1).otherwise(0))
    summary = rows.groupBy("session_id", b).agg(
        F.min("ts_us").alias("__first"), F.max("ts_us").alias("__last"), F.sum("__inner").alias("__n_inner"))
    wb = Window.partitionBy("session_id").orderBy(b)
    summary = summary.withColumn("__prev_last", F.lag("__last").over(wb))
    summary = summary.withColumn(
        "__first_new", F.when(F.col("__prev_last").isNull() | is_new(F.col("__prev_last"), F.col("__first")), 1)
        .otherwise(0))
    summary = summary.select(
        "session_id", b, "__prev_last", "__first_new",
        F.coalesce(F.sum(F.col("__n_inner") + F.col("__first_new")).over(
            wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rows = rows.join(summary, ["session_id", b])
    rows = rows.withColumn("prev_us", F.coalesce("__lag", "__prev_last")).withColumn(
        "__new", F.when(F.col("__lag").isNull(), F.col("__first_new")).otherwise(F.col("__inner")))
    running = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session_no", (F.col("__base") + running).cast("long")).drop(
        b, "__lag", "__inner", "__prev_last", "__first_new", "__base", "__new")


def sessionize(log: DataFrame, ttl_s: int = CLIENT_IDLE_MS // 1000, kinds: Sequence[str] = ("chat",),
               bucket_s: int = DEFAULT_BUCKET_S, bucket_rows: int | None = None) -> DataFrame:
    """C3, client rule: a new session when the gap between activities exceeds
    ``ttl`` (a gap of exactly ``ttl`` stays in the session).  With ``bucket_rows`` no window holds
    more than about that many rows, however many one id has in however short a time."""
    rows = log.where(F.col("kind").isin(list(kinds))).select("session_id", "ts_us", "seq", "kind")
    return _sessionize(rows, lambda a, b: (b - a) > F.lit(ttl_s * US), bucket_s, bucket_rows)


def sweep_after(a: Column, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S, t0_us: int = 0) -> Column:
    """The first sweep strictly after ``a + ttl``: the moment a session whose
    last activity is ``a`` is removed.  Sweeps run at ``t0 + k * sweep``."""
    return F.lit(t0_us) + F.lit(sweep_s * US) * (
        floor_div(a + F.lit(ttl_s * US) - F.lit(t0_us), sweep_s * US) + 1)


def sessionize_swept(log: DataFrame, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S,
                     t0_us: int = 0, kinds: Sequence[str] = ACTIVITY_KINDS,
                     bucket_s: int = DEFAULT_BUCKET_S, bucket_rows: int | None = None) -> DataFrame:
    """C4, server rule: a session ends at the first sweep after expiry, so
    activity between expiry and that sweep revives it.  When an activity
    falls exactly on a sweep, the sweep goes first.  ``bucket_rows`` as in ``sessionize``."""
    rows = log.where(F.col("kind").isin(list(kinds))).select("session_id", "ts_us", "seq", "kind")
    return _sessionize(rows, lambda a, b: b >= sweep_after(a, ttl_s, sweep_s, t0_us), bucket_s, bucket_rows)


def session_spans(sessionized: DataFrame, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S,
                  t0_us: int = 0) -> DataFrame:
    """One row per session of C4 with its removal sweep."""
    spans = sessionized.groupBy("session_id", "session_no").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("n_activities"))
    return spans.withColumn("removed_us", sweep_after(F.col("last_us"), ttl_s, sweep_s, t0_us))


def sweep_counts(sessionized: DataFrame, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S,
                 t0_us: int = 0) -> DataFrame:
    """Number of sessions removed by each sweep."""
    spans = session_spans(sessionized, ttl_s, sweep_s, t0_us)
    return spans.groupBy("removed_us").agg(F.count(F.lit(1)).alias("n_removed"))


# ------------------------------------------------------------------ C8

def role_as_of(log: DataFrame, ttl_s: int = SESSION_TTL_S, sweep_s: int = SWEEP_S,
               t0_us: int = 0, bucket_s: int = DEFAULT_BUCKET_S, bucket_rows: int | None = None) -> DataFrame:
    """Admin flag in effect at each chat.  ``bucket_rows`` as in ``sessionize``.

    login_ok sets the flag (and is activity), logout clears it (and is not
    activity), a new session starts as guest.  A logout belongs to the
    session of the latest earlier activity; before any session it changes
    nothing.  An as-of join written as windows.
    """
    order = ["ts_us", "seq"]
    b = W.BUCKET
    act = sessionize_swept(log, ttl_s, sweep_s, t0_us, ACTIVITY_KINDS, bucket_s, bucket_rows) \
        .select("session_id", "ts_us", "seq", "kind", "session_no")
    act = cut_lineage(act)  # one reliable write; the steps below read it, not its lineage
    outs = log.where(F.col("kind") == "logout").select(
        "session_id", "ts_us", "seq", "kind", F.lit(None).cast("long").alias("session_no"))
    both = _bucketed(act.unionByName(outs), bucket_s, bucket_rows)
    flag = F.when(F.col("kind") == "login_ok", True).when(F.col("kind") == "logout", False)
    w = Window.partitionBy("session_id", b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__sess_in", F.last("session_no", ignorenulls=True).over(w)).withColumn("__flag", flag)
    # per (id, bucket): its last session and its last flag event with the
    # session that event fell in (null = before the bucket's first activity)
    summary = both.groupBy("session_id", b).agg(
        F.max("session_no").alias("__last_sess"),
        F.max(F.when(F.col("__flag").isNotNull(),
                     F.struct("ts_us", "seq", "__sess_in", "__flag"))).alias("__lf"))
    wb = Window.partitionBy("session_id").orderBy(b)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__carry_sess", F.last("__last_sess", ignorenulls=True).over(before))
    summary = summary.withColumn("__lf_sess", F.coalesce(F.col("__lf.__sess_in"), F.col("__carry_sess")))
    last_flag = F.last(F.when(F.col("__lf").isNotNull(), F.struct(F.col("__lf_sess").alias("s"),
                                                                   F.col("__lf.__flag").alias("f"))),
                       ignorenulls=True).over(before)
    summary = summary.select("session_id", b, "__carry_sess", last_flag.alias("__cf"))
    summary = summary.select("session_id", b, "__carry_sess",
                             F.when(F.col("__cf.s") == F.col("__carry_sess"), F.col("__cf.f")).alias("__carry_flag"))
    both = both.join(summary, ["session_id", b]).withColumn("sess", F.coalesce("__sess_in", "__carry_sess"))
    both = both.where(F.col("sess").isNotNull())  # a logout before any session changes nothing
    ws = Window.partitionBy("session_id", b, "sess").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    in_bucket = F.last("__flag", ignorenulls=True).over(ws)
    carried = F.when(F.col("sess") == F.col("__carry_sess"), F.col("__carry_flag"))
    both = both.withColumn("is_admin", F.coalesce(in_bucket, carried, F.lit(False)))
    return both.where(F.col("kind") == "chat").select(
        "session_id", "seq", "ts_us", F.col("sess").alias("session_no"), "is_admin")


# ------------------------------------------------------------------ C9, C10

def _turn_struct():
    return F.struct(F.col("turn"), F.col("role"), F.col("text"))


def _render(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")


def history_before(turns: DataFrame, conv: str = "conv_id", last_n: int | None = None,
                   bucket_turns: int = HISTORY_BUCKET_TURNS) -> DataFrame:
    """The ordered transcript before each turn (unbounded, as in the
    reference; ``last_n`` bounds it to the last n earlier turns).

    Unbounded output is quadratic in a conversation's length by nature; each
    window partition is one conversation, processed as a sorted stream.
    With ``last_n`` no conversation is one task: see :func:`_history_last_n`.
    """
    if last_n is None:
        w = Window.partitionBy(conv).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        hist = F.collect_list(_turn_struct()).over(w)
    else:
        if last_n < 1:
            raise ValueError("last_n must be at least 1")
        turns, hist = _history_last_n(turns, conv, last_n, bucket_turns)
    return turns.select(conv, "turn", F.size(hist).alias("n_before"), hist.alias("history")) \
        .withColumn("history_text", _render(F.col("history")))


def _history_last_n(turns: DataFrame, conv: str, last_n: int, bucket_turns: int):
    """The last ``last_n`` earlier turns per turn, windowed per (conversation,
    bucket of ``bucket_turns`` turn numbers).  The turns a bucket's first rows
    need from before it come from the tails (last ``last_n`` turns) of at most
    ``last_n`` earlier non-empty buckets, windowed per conversation over one
    summary row per bucket."""
    b = W.BUCKET
    rows = turns.withColumn(b, floor_div(F.col("turn"), bucket_turns))
    w = Window.partitionBy(conv, b).orderBy("turn")
    rows = rows.withColumn("__in", F.collect_list(_turn_struct()).over(w.rowsBetween(-last_n, -1)))
    tails = (rows.withColumn("__tail", F.collect_list(_turn_struct()).over(w.rowsBetween(-(last_n - 1), 0)))
             .withColumn("__last", F.lead("turn").over(w).isNull())
             .where("__last").select(conv, b, "__tail"))
    wb = Window.partitionBy(conv).orderBy(b).rowsBetween(-last_n, -1)
    carry = tails.select(conv, b, F.flatten(F.collect_list("__tail").over(wb)).alias("__carry"))
    rows = rows.join(carry, [conv, b])
    full = F.concat(F.coalesce(F.col("__carry"), F.array().cast(rows.schema["__in"].dataType)), F.col("__in"))
    hist = F.slice(full, F.greatest(F.size(full) - F.lit(last_n) + 1, F.lit(1)), last_n)
    return rows.drop(b), hist


def transcript(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The full ordered transcript per conversation."""
    return (turns.groupBy(conv)
            .agg(F.array_sort(F.collect_list(_turn_struct())).alias("turns"))
            .select(conv, F.size("turns").alias("n_turns"), "turns",
                    _render(F.col("turns")).alias("transcript_text")))


def transcript_rows(turns: DataFrame, conv: str = "conv_id", bucket_turns: int = HISTORY_BUCKET_TURNS) -> DataFrame:
    """C9/C10 without a whole conversation in one group: each turn's line and the
    place ``start`` where it begins in its conversation's transcript.

    The transcript is the lines in turn order, and the history before a turn
    (C9) is the transcript's first ``start`` characters (less the last line
    break), so the output is linear in the input.  Sums run per (conversation,
    bucket of ``bucket_turns`` turn numbers) and carry over from one summary row
    per bucket.
    """
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    rows = turns.select(conv, "turn", line.alias("line"),
                        F.coalesce(F.length(line) + 1, F.lit(0)).cast("long").alias("__n"),
                        floor_div(F.col("turn"), bucket_turns).alias(W.BUCKET))
    rows = W.running_sum_across(rows, conv, ["turn"], "__n", "__end")
    return rows.select(conv, "turn", (F.col("__end") - F.col("__n")).alias("start"), "line")


# ------------------------------------------------------------------ C11-C13

def prefix_request(text, is_admin, admin_prefix: str = ADMIN_REQUEST_PREFIX,
                   admin_extension: str = ADMIN_EXTENSION,
                   guest_extension: str = GUEST_EXTENSION) -> Column:
    """C11: role extension + newline + (admin prefix for admins) + request."""
    admin = F.coalesce(col_of(is_admin), F.lit(False))
    body = F.when(admin, F.concat(F.lit(admin_prefix), col_of(text))).otherwise(col_of(text))
    ext = F.when(admin, F.lit(admin_extension)).otherwise(F.lit(guest_extension))
    return F.concat(ext, F.lit("\n"), body)


def prefix_helper_request(text, is_admin, admin_info: str = ADMIN_HELPER_INFO,
                          guest_info: str = GUEST_HELPER_INFO) -> Column:
    """C11, helper level: the database helper puts its own role note directly
    before the text it receives (no separator)."""
    admin = F.coalesce(col_of(is_admin), F.lit(False))
    return F.concat(F.when(admin, F.lit(admin_info)).otherwise(F.lit(guest_info)), col_of(text))


def client_address(forwarded, peer) -> Column:
    """First item of the forwarded list, else the peer, whitespace-stripped."""
    return py_strip(F.split(F.coalesce(col_of(forwarded), col_of(peer)), ",", -1)[0])


def admin_allowed(access: DataFrame, allowed: DataFrame, forwarded: str = "forwarded",
                  peer: str = "peer", address_col: str = "address") -> DataFrame:
    """Flag (not filter) each access by membership of its client address
    in the allow-list; AQE broadcasts the list when its measured size allows."""
    lst = allowed.select(py_strip(F.col(address_col)).alias("__a")).distinct()
    out = access.withColumn("client_ip", client_address(forwarded, peer))
    out = out.join(lst, F.col("client_ip") == F.col("__a"), "left")
    return out.withColumn("is_admin_control_allowed", F.col("__a").isNotNull()).drop("__a")


def login_outcome(password_configured, check_ok) -> Column:
    """The reply status and message of one login attempt."""
    conf = col_of(password_configured)
    ok = col_of(check_ok)

    def pick(i):
        return (F.when(~F.coalesce(conf, F.lit(False)), F.lit(LOGIN_NO_PASSWORD[i]))
                .when(ok.isNull(), F.lit(LOGIN_BACKEND_ERROR[i]))
                .when(ok, F.lit(LOGIN_OK[i])).otherwise(F.lit(LOGIN_WRONG[i])))

    return F.struct(pick(0).alias("status"), pick(1).alias("message"))


def login_summary(attempts: DataFrame) -> DataFrame:
    """Attempts per reply (correct, wrong password, no password, backend error)."""
    o = login_outcome("password_configured", "check_ok")
    return (attempts.select(o["status"].alias("status"), o["message"].alias("message"))
            .groupBy("status", "message").agg(F.count(F.lit(1)).alias("n_attempts")))


def logout_summary(attempts: DataFrame, known: DataFrame, session: str = "session_id", ok: str = "ok") -> DataFrame:
    """Logout attempts per reply.  A logout of a known id is confirmed, one of an
    unknown id gets no reply, and a backend failure is an error for either."""
    k = known.select(F.col(session).alias("__k")).distinct()
    failed = ~F.coalesce(F.col(ok), F.lit(False))
    replied = attempts.join(k, F.col(session) == F.col("__k"), "left").where(failed | F.col("__k").isNotNull())
    pick = lambda i: F.when(failed, F.lit(LOGIN_BACKEND_ERROR[i])).otherwise(F.lit(LOGOUT_OK[i]))
    return replied.select(pick(0).alias("status"), pick(1).alias("message")).groupBy("status", "message").agg(
        F.count(F.lit(1)).alias("n_attempts"))
