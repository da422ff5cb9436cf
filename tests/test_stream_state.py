"""State of the stream dedupe: keys of a bucket are read and written in one go, and given out as one by one."""

import random

import pandas as pd

from casewell.streaming import stream


class Kept:
    """List state and handle in one: what is held, calls, and timers."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, set()

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def get(self):
        return iter(self.rows)


class Handle(Kept):
    def __init__(self):
        super().__init__()
        self.states = {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_is_written_in_one_go_and_each_key_follows_its_horizon():
    draw, handle, first = random.Random(5), Handle(), stream.FirstByTime(1000)
    first.init(handle)
    rows = [(f"k{draw.randrange(300)}", draw.randrange(0, 9_000_000), i) for i in range(3000)] + [("k1", 5_000_000, 90), ("k1", 5_000_000, 89)]
    got = []
    for at in (3000, 6000, 9000, 20_000):  # batches in order of time, shuffled inside, each followed by the watermark
        batch = [r for r in rows if (at - 3000 if at < 20_000 else 9000) * 1000 <= r[1] < at * 1000]
        draw.shuffle(batch)
        before = handle.calls + handle.states["waiting"].calls
        parts = [pd.DataFrame(batch[i::2], columns=["dedupe_key", "time_us", "id"]) for i in range(2)]
        list(first.handleInputRows((0,), iter(parts), None))
        assert handle.calls + handle.states["waiting"].calls - before <= 2
        for due in sorted(t for t in handle.timers if t <= at):
            handle.timers.discard(due)
            got += [tuple(r) for part in first.handleExpiredTimer((0,), Watermark(at), None) for r in part.itertuples(index=False)]
    want, last = [], {}
    for k, t, i in sorted(rows):
        if k not in last or t >= last[k] + 1_000_000:
            want.append((k, t, i))
            last[k] = t
    assert sorted(got) == want
    assert not handle.states["waiting"].rows and not handle.states["last"].rows
