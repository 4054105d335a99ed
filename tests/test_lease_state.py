"""Waiting messages go to the state, and come from it, by the batch."""

import pandas as pd

from lodestone.streaming.leases import LeaseStream


class State:
    def __init__(self):
        self.rows, self.calls = [], 0

    def appendList(self, rows):
        self.rows, self.calls = self.rows + rows, self.calls + 1

    def put(self, rows):
        self.rows, self.calls = list(rows), self.calls + 1

    def get(self):
        self.calls += 1
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def clear(self):
        self.rows, self.calls = [], self.calls + 1

    update = put

    def exists(self):
        return bool(self.rows)


class Job(State):
    def update(self, row):
        self.rows = row


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Job())

    def getListState(self, name, schema):
        return self.states.setdefault(name, State())

    registerTimer = lambda self, at: self.timers.append(at)


def test_a_batch_of_messages_is_one_call_and_repeats_are_one():
    handle, stream = Handle(), LeaseStream(10, 0, 3)
    stream.init(handle)
    rows = pd.DataFrame({"at_us": [3000, 1000, 3000, 90_000], "id": [2, 1, 2, 3], "agent_id": ["a"] * 4, "kind": ["beat", "claim", "beat", "beat"], "attempt": [None] * 4})
    list(stream.handleInputRows(("j",), iter([rows]), None))
    waiting = handle.states["waiting"]
    assert waiting.calls == 1 and handle.timers == [1]
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 50})()
    (out,) = stream.handleExpiredTimer(("j",), now, None)
    assert list(out["result"]) == ["claimed", "extended", "queued"] and waiting.calls == 3
    assert [r[:2] for r in waiting.rows] == [(90_000, 3)] and handle.timers[-1] == 90
