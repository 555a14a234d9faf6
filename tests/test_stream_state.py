"""What stateful streams hold and ask of the state, without a stream."""

import tracemalloc
from types import SimpleNamespace

import pandas as pd

from millrace.sources import stitching
from millrace.streaming import jobs


class State:
    """A value or map of the state, with the calls that all of them got."""

    calls = 0

    def __init__(self):
        self.held = {}

    def __getattr__(self, name):
        def call(*args):
            State.calls += 1
            if name in ("exists", "containsKey"):
                return args in self.held
            if name in ("get", "getValue"):
                return self.held[args]
            self.held[args[:-1]] = args[-1]

        return call


HANDLE = SimpleNamespace(getValueState=lambda *a: State(), getMapState=lambda *a: State(), getListState=lambda *a: State(), registerTimer=lambda t: None, deleteTimer=lambda t: None)
TIMES = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)


def test_a_busy_hour_is_not_held_whole():
    at = pd.Timestamp("2026-01-01 05:00:00")
    frames = lambda: (pd.DataFrame({"at": at + pd.to_timedelta(range(b * 2000, b * 2000 + 2000), unit="ms"), "key": range(2000), "title": "x" * 50}) for b in range(199, -1, -1))
    cap = jobs.HourlyCap(2)
    cap.init(HANDLE)
    tracemalloc.start()
    out = pd.concat(list(cap.handleInputRows(("g", at.value // 3_600_000_000_000), frames(), TIMES)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(out["kind"], out["at"])) == [("sent", at), ("sent", at + pd.Timedelta(milliseconds=1)), ("notice", at + pd.Timedelta(milliseconds=2))]
    assert most < 4_000_000


def test_waiting_lines_are_not_appended_one_list_after_the_other():
    """20 frames of a server go to the state as one table for each slice of time."""
    at = pd.Timestamp("2026-01-01 05:00:00")
    frames = (pd.DataFrame({"row_id": range(b * 500, b * 500 + 500), "at": at + pd.to_timedelta(range(0, 10_000, 20), unit="s"), "thread": "t", "user_ctx": None, "entry_type": "info", "request_id": None}) for b in range(20))
    s = stitching.Stitcher()
    s.init(HANDLE)
    State.calls = 0
    assert list(s.handleInputRows(("s",), frames, TIMES)) == []
    assert State.calls <= 6 and len(s.waiting.held) == 3
