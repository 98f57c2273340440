import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from storelens.operators import sessions as C
from tests.conftest import rows

US = C.US


def _log(spark, events):
    """events: (session_id, ts_seconds, seq, kind)"""
    return spark.createDataFrame([(s, int(t * US), q, k) for s, t, q, k in events],
                                 "session_id long, ts_us long, seq long, kind string")


def test_client_rule_gaps(spark):
    ev = [(1, 0, 1, "chat"), (1, 1799, 2, "chat"), (1, 3599, 3, "chat"), (1, 5400, 4, "chat"),
          (1, 7201, 5, "chat"), (1, 7300, 6, "login_ok")]
    out = C.sessionize(_log(spark, ev), bucket_s=3600)
    assert rows(out, "seq", "session_no") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)]


def _simulate(events, ttl=1800, sweep=300, t0=0):
    """Direct simulation of the server: dict of born times, sweeps every 300 s."""
    born, count, out = {}, {}, {}
    events = sorted(events, key=lambda e: (e[1], e[2]))
    next_sweep = t0 + sweep
    for sid, ts, seq, kind in events:
        while next_sweep <= ts:  # a sweep at the same instant goes first
            for k in [k for k, b in born.items() if next_sweep - b > ttl]:
                del born[k]
            next_sweep += sweep
        if sid not in born:
            count[sid] = count.get(sid, 0) + 1
        born[sid] = ts
        out[seq] = count[sid]
    return out


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_swept_rule_equals_simulation(spark, seed):
    rnd = random.Random(seed)
    ev, seq = [], 0
    for sid in range(3):
        t = rnd.randint(0, 600)
        for _ in range(rnd.randint(1, 25)):
            t += rnd.choice([1, 60, 299, 300, 1500, 1799, 1800, 1801, 1900, 2100, 2400, 5000])
            seq += 1
            ev.append((sid, t, seq, "chat"))
    out = C.sessionize_swept(_log(spark, ev), bucket_s=2000)
    got = {r.seq: r.session_no for r in out.collect()}
    assert got == _simulate(ev)


def test_expired_and_sweep_counts(spark):
    log = _log(spark, [(1, 0, 1, "chat"), (2, 1000, 2, "chat"), (2, 1200, 3, "logout")])
    sessions = C.session_table(log)
    assert rows(C.expired_at(sessions, 2799 * US), "session_id") == [(1,)]
    assert rows(C.expired_at(sessions, 1800 * US), "session_id") == []   # strict
    counts = C.sweep_counts(C.sessionize_swept(log))
    assert rows(counts) == [(2100 * US, 1), (3000 * US, 1)]


def test_role_as_of(spark):
    ev = [(1, 100, 1, "logout"),          # before any session: nothing
          (1, 200, 2, "chat"), (1, 300, 3, "login_ok"), (1, 400, 4, "chat"),
          (1, 500, 5, "logout"), (1, 600, 6, "chat"), (1, 700, 7, "login_fail"), (1, 800, 8, "chat"),
          (1, 900, 9, "login_ok"),
          (1, 9000, 10, "chat"),          # after expiry: new session starts as guest
          (2, 50, 11, "chat"), (2, 60, 12, "login_ok"), (2, 5000, 13, "logout"), (2, 9000, 14, "chat")]
    out = C.role_as_of(_log(spark, ev), bucket_s=1000)
    assert rows(out, "seq", "is_admin") == [(2, False), (4, True), (6, False), (8, False), (10, False),
                                            (11, False), (14, False)]


def test_history_transcript_prefix(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
                                   (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    h = {(r.conv_id, r.turn): (r.n_before, r.history_text) for r in C.history_before(turns).collect()}
    assert h[(1, 0)] == (0, "") and h[(1, 2)] == (2, "user: a\nassistant: b")
    assert C.history_before(turns, last_n=1).where("turn = 2").first().history_text == "assistant: b"
    tr = C.transcript(turns).where("conv_id = 1").first()
    assert tr.n_turns == 3 and tr.transcript_text == "user: a\nassistant: b\nuser: c"
    req = spark.createDataFrame([("q", True), ("q", False)], "t string, a boolean").select(
        C.prefix_request("t", "a").alias("r")).collect()
    assert {r.r for r in req} == {C.ADMIN_EXTENSION + "\n" + C.ADMIN_REQUEST_PREFIX + "q",
                                  C.GUEST_EXTENSION + "\nq"}
    helper = spark.createDataFrame([("q", True), ("q", None)], "t string, a boolean").select(
        C.prefix_helper_request("t", "a").alias("r")).collect()
    assert {r.r for r in helper} == {C.ADMIN_HELPER_INFO + "q", C.GUEST_HELPER_INFO + "q"}


def test_admin_allowed_and_logins(spark):
    access = spark.createDataFrame([(1, " 10.0.0.1 , 10.0.0.2", "9.9.9.9"), (2, None, "10.0.0.1"),
                                    (3, None, "10.0.0.9"), (4, "\t10.0.0.1\n", "x")],
                                   "id int, forwarded string, peer string")
    allowed = spark.createDataFrame([("10.0.0.1",)], "address string")
    out = C.admin_allowed(access, allowed)
    assert rows(out, "id", "client_ip", "is_admin_control_allowed") == [
        (1, "10.0.0.1", True), (2, "10.0.0.1", True), (3, "10.0.0.9", False), (4, "10.0.0.1", True)]
    attempts = spark.createDataFrame([(True, True), (True, False), (False, True), (True, None)],
                                     "password_configured boolean, check_ok boolean")
    summary = rows(C.login_summary(attempts))
    assert summary == [("correct", "Zalogowano na admina", 1), ("error", "Brak hasła", 1),
                       ("error", "Błąd backendu", 1), ("error", "loginErr4r", 1)]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.integers(1, 5))
def test_bounded_history_across_buckets_equals_plain_window(spark, seed, last_n, bucket_turns):
    """Sparse turn numbers and tiny buckets: history must come from earlier
    buckets, sometimes from several; the result equals one plain window."""
    from pyspark.sql import Window
    rnd = random.Random(seed)
    rows_ = []
    for conv in range(4):
        turn = 0
        for _ in range(rnd.randint(0, 15)):
            turn += rnd.randint(1, 7)
            rows_.append((conv, turn, rnd.choice(["user", "assistant"]), f"t{conv}-{turn}"))
    turns = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_before, r.history_text)
           for r in C.history_before(turns, last_n=last_n, bucket_turns=bucket_turns).collect()}
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last_n, -1)
    hist = F.collect_list(F.struct("turn", "role", "text")).over(w)
    plain = turns.select("conv_id", "turn", F.size(hist).alias("n"), hist.alias("h"))
    exp = {(r.conv_id, r.turn): (r.n, "\n".join(f"{x.role}: {x.text}" for x in r.h)) for r in plain.collect()}
    assert got == exp


def test_transcript_rows_place_every_line(spark):
    data = [(c, t, "user" if t % 2 else "assistant", f"tekst {c} {t}" * (t % 3)) for c in range(3) for t in range(25)]
    turns = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    whole = {r.conv_id: r.transcript_text for r in C.transcript(turns).collect()}
    for r in C.transcript_rows(turns, bucket_turns=4).collect():
        assert whole[r.conv_id][r.start:r.start + len(r.line)] == r.line
