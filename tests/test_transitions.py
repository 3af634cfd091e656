"""Guarded transitions: rules one by one, and streams against tables over a restart."""

import random

import pytest

from pactline.streaming import transitions as t


@pytest.mark.parametrize(
    "events, states",
    [
        ("uploaded started finished approved", [t.UPLOADED, t.RUNNING, t.REVIEW, t.APPROVED]),
        ("approved started edited", [None, None, None]),
        ("uploaded approved finished edited", [t.UPLOADED, t.UPLOADED, t.UPLOADED, t.UPLOADED]),
        ("uploaded uploaded started failed approved started finished", [t.UPLOADED, t.UPLOADED, t.RUNNING, t.FAILED, t.FAILED, t.RUNNING, t.REVIEW]),
        ("uploaded started finished approved edited deleted edited uploaded", [t.UPLOADED, t.RUNNING, t.REVIEW, t.APPROVED, t.APPROVED, None, None, t.UPLOADED]),
        ("x uploaded", [None, t.UPLOADED]),
    ],
)
def test_job(events, states):
    state, got = None, []
    for event in events.split():
        ok, new = t.job(state, {"event": event})
        assert ok or new == state
        state = new
        got.append(state)
    assert got == states


def test_session_tokens_work_once():
    step, log, state = t.session(100), [], None
    for at, event, token, shown, device in [
        (0, "refresh", "a", "z", 1), (1, "login", "a", None, 1), (2, "refresh", "b", "a", 2), (3, "refresh", "c", "a", 1), (4, "refresh", "d", "b", 1), (105, "refresh", "e", "d", 1),
        (106, "login", "f", None, None), (107, "refresh", "g", "f", 1), (108, "refresh", "h", "f", 1), (109, "login", "i", None, 1), (110, "logout", None, None, 1), (111, "refresh", "j", "i", 1),
    ]:
        ok, state = step(state, {"at": at * 1_000_000, "event": event, "token": token, "shown": shown, "device": device})
        log.append(ok)
    assert log == [False, True, True, False, True, False, True, False, False, True, True, False] and state is None


def test_stream_agrees_with_table_over_a_restart(spark, tmp_path):
    for k, v in t.STATE_STORE.items():
        spark.conf.set(k, v)
    r = random.Random(4)
    rows = [(k, r.choice([1, 2, 3, 4]), r.choice([*t.JOB, "x", None])) for k in range(240)]
    schema = "at long, doc long, event string"
    want = {(x.at, x.accepted, x.state) for x in t.settled(spark.createDataFrame(rows, schema).repartition(3), "doc", ["at"], t.job).collect()}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in (0, 80, 160):  # the query ends and starts again from its checkpoint each time
        spark.createDataFrame(rows[lo : lo + 80], schema).coalesce(1).write.mode("append").parquet(source)
        stream = t.settled_stream(spark.readStream.schema(schema).parquet(source), "doc", ["at"], t.job)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert {(x.at, x.accepted, x.state) for x in spark.read.parquet(out).collect()} == want
    assert t.settled(spark.createDataFrame([], schema), "doc", ["at"], t.job).count() == 0
