import datetime as dt

from weirstone.streaming import log as L

T0 = dt.datetime(2024, 1, 1)
ROWS = [("s", 1, "a", "1", 0, False), ("s", 1, "a", "1", 1, False), ("s", 1, "a", "2", 2, False), ("s", 1, "b", "3", 3, True), ("s", 1, "c", "4", 4, False), ("s", 2, "d", "5", 5, False), ("t", 1, "a", "1", 0, False)]
WANT = {("s", 1, "a", "1", "accepted"): 1, ("s", 1, "a", "1", "repeated"): 1, ("s", 1, "a", "2", "conflict"): 1, ("s", 1, "b", "3", "accepted"): 1, ("s", 1, "c", "4", "late"): 1, ("s", 2, "d", "5", "accepted"): 1, ("t", 1, "a", "1", "accepted"): 1}
SCHEMA = "session_id string, turn_number bigint, event_key string, data string, at timestamp, closes boolean"


def _frame(spark, rows):
    return spark.createDataFrame([(s, n, k, d, T0 + dt.timedelta(seconds=t), c) for s, n, k, d, t, c in rows], SCHEMA)


def _count(rows):
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_replay(spark):
    assert _count(L.replay(_frame(spark, ROWS)).collect()) == WANT


def test_any_log_in_any_batches(spark):
    """Replay and the stream's step agree on random logs, whatever the micro-batches."""
    import random

    rng = random.Random(3)
    rows = []
    for s in range(40):
        n = rng.randrange(1, 12)
        rows += [(f"s{s}", t, rng.choice("abcd"), rng.choice(["1", "2", None]), i, rng.random() < 0.2) for t in range(rng.randrange(1, 70, 17)) for i in range(n)]
    want = {}
    for s, t in {r[:2] for r in rows}:
        mine = sorted([r for r in rows if r[:2] == (s, t)], key=lambda r: r[4])
        closed, known, at = False, {}, 0
        while at < len(mine):
            size = rng.randrange(1, 4)
            closed, out = L.step(closed, known, [(k, d, c) for _, _, k, d, _, c in mine[at : at + size]])
            for k, d, o in out:
                want[s, t, k, d, o] = want.get((s, t, k, d, o), 0) + 1
            at += size
    assert _count(L.replay(_frame(spark, rows)).collect()) == want and {o for *_, o in want} == {"accepted", "repeated", "conflict", "late"}


def test_stream_agrees_with_replay(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(0, len(ROWS), 3):
        _frame(spark, ROWS[i : i + 3]).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        q = L.append(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert _count(spark.read.parquet(str(tmp_path / "out")).collect()) == WANT


def test_turns(spark):
    got = {(r.session_id, r.turn_number): (r.number, r.before_cutoff, r.after_cutoff, r.events) for r in L.turns(_frame(spark, ROWS)).collect()}
    assert got == {("s", 1): (1, 0, 2, 2), ("s", 2): (2, 2, None, 1), ("t", 1): (1, 0, None, 1)}


def test_active_sessions(spark):
    rows = [("u", "a", 0, False), ("u", "a", 1, True), ("u", "a", 2, False), ("u", "b", 3, True), ("u", "a", 4, False), ("u", "a", 5, True), ("v", "a", 9, True)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, at int, starts boolean")
    assert [r.active for r in L.active_sessions(df).orderBy("at").collect()] == [False, True, True, True, False, True, True]
