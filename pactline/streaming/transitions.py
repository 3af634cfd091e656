"""Guarded transitions of contracts and sessions, over tables and over streams.

A machine has a state for each key, a small JSON value, and a step that takes the state and an
event and says whether the event is accepted and what the next state is; a refused event
changes nothing. Over a table, rows are dealt out by key, sorted, and read with the state of one
key in hand; over a stream, the same step runs on state that Spark keeps with its checkpoint.
A stream takes the events of a key in the order of their arrival (and sorts those that arrive
in one micro-batch); it agrees with the table where no event arrives after a later one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: fixed values: the states of a contract
UPLOADED, RUNNING, REVIEW, FAILED, APPROVED = "YUKLENDI", "ISLENIYOR", "INCELENMEYI_BEKLIYOR", "HATA", "ONAYLANDI"
EXISTING = (UPLOADED, RUNNING, REVIEW, FAILED, APPROVED)
#: for each event: the states in which it is accepted (null: there is no contract), and the next state (``same``: as it was)
JOB = {
    "uploaded": ((None,), UPLOADED), "started": (EXISTING, RUNNING), "finished": ((RUNNING,), REVIEW), "failed": ((RUNNING,), FAILED),
    "approved": ((REVIEW,), APPROVED), "edited": ((UPLOADED, RUNNING, REVIEW, FAILED), "same"), "deleted": (EXISTING, None),
}
Step = Callable[[Any, dict], tuple[bool, Any]]


def job(state: str | None, event: dict) -> tuple[bool, str | None]:
    """A contract from upload to approval; an unknown event is refused. Only what awaits review is approved, and what is approved is not edited."""
    allowed, following = JOB.get(event["event"], ((), None))
    ok = state in allowed
    return ok, following if ok and following != "same" else state


def session(ttl: int) -> Step:
    """A session's refresh tokens: each works once, within ``ttl`` seconds, for the newest one alone.

    ``login`` starts a session with the event's ``token``; ``refresh`` shows the token ``shown``
    and gets the new one; one that was used before, or another's, is refused; a session without a
    ``device`` ends at its first refresh, which is refused; ``logout`` ends it.
    """

    def step(state: dict | None, event: dict) -> tuple[bool, dict | None]:
        new = {"token": event["token"], "until": event["at"] + ttl * 1_000_000, "device": event["device"]}
        if event["event"] == "login":
            return True, new
        if state is None or event["event"] not in ("refresh", "logout"):
            return False, state
        if event["event"] == "logout":
            return True, None
        if event["shown"] != state["token"] or event["at"] >= state["until"]:
            return False, state
        if state["device"] is None:
            return False, None
        return True, new | {"device": state["device"]}

    return step


def _shown(state: Any) -> str | None:
    return None if state is None else state if isinstance(state, str) else json.dumps(state, sort_keys=True)


def settled(events: DataFrame, key: str, order: list[str], step: Step) -> DataFrame:
    """``events`` with ``accepted``, and ``state`` after the event (a text or JSON; null for none)."""

    def run(batches):
        current, state, first = None, None, True
        for batch in batches:
            accepted, states = [], []
            for row in batch.to_pylist():
                if first or row[key] != current:
                    current, state, first = row[key], None, False
                ok, state = step(state, row)
                accepted.append(ok)
                states.append(_shown(state))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(states, pa.string())], [*batch.schema.names, "accepted", "state"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in events.dtypes) + ", accepted boolean, state string"
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class _Settling(StatefulProcessor):
    """Keeps the state of each key as one JSON text."""

    def __init__(self, order: list[str], step: Step):
        self.order, self.step = order, step

    def init(self, handle) -> None:
        self.kept = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues):
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        accepted, states = [], []
        for row in arrived.astype(object).where(arrived.notna(), None).to_dict("records"):
            ok, state = self.step(state, row)
            accepted.append(ok)
            states.append(_shown(state))
        self.kept.update((json.dumps(state),))
        yield arrived.assign(accepted=accepted, state=states)

    def close(self) -> None:
        pass


#: what a session needs so that Spark keeps the state of ``settled_stream``
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def settled_stream(events: DataFrame, key: str, order: list[str], step: Step) -> DataFrame:
    """``settled`` over a stream. The session needs the settings of ``STATE_STORE``; a query that is restarted from its checkpoint goes on where it was."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in events.dtypes) + ", accepted boolean, state string"
    return events.groupBy(key).transformWithStateInPandas(_Settling(order, step), schema, "Append", "None")
