"""Keyed state of the online job: decisions for one key, and the job from topics to tables."""

import pandas as pd
from test_streaming import options, record_sizes, send_events, send_tx, statuses  # noqa: F401

import txtrail
from txtrail.options import ANY, EXPECTED_COUNT, KEYED_STATE, QUIESCENT, TrailOptions
from txtrail.streaming import keyed


class State:
    """What Spark keeps for one key."""

    def __init__(self):
        self.get, self.exists, self.now, self.timer = None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists, self.timer = None, False, None

    def setTimeoutTimestamp(self, at):
        assert at > self.now
        self.timer = at


class Key:
    def __init__(self, completeness, expected=None, grace=3, quiet=10, lookback=100, keep=50):
        self.state = State()
        self.judge = keyed._judge(completeness, expected or {}, grace * 1000, quiet * 1000, lookback * 1000, keep * 1000)

    def send(self, now, *contexts):
        """Events for None, notices for a context; returns (context, outcome, n_events)."""
        self.state.now = now * 1000
        rows = pd.DataFrame(
            {
                "context": pd.Series(contexts, dtype=object),
                "time": pd.to_datetime([None if c is None else 7 for c in contexts], unit="s"),
                "arrived": pd.to_datetime([now] * len(contexts), unit="s"),
            }
        )
        found = [f for f in self.judge(("g",), iter([rows] if contexts else []), self.state)]
        return [tuple(r) for f in found for r in f[["context", "outcome", "n_events"]].itertuples(index=False)]


def test_any_event_completes_and_late_events_do_after_pending():
    key = Key(ANY)
    assert key.send(0, "1..", "1..", "2..") == []
    assert key.state.timer == 3000
    assert key.send(3) == [("1..", "pending", 0), ("2..", "pending", 0)]
    assert key.state.timer == 100_000
    assert key.send(40, None, None) == [("1..", "record", 2), ("2..", "record", 2)]
    # a notice that comes behind its events
    assert key.send(60, "3..") == [("3..", "record", 2)]
    key.send(90)
    assert not key.state.exists


def test_notice_expires_once_with_the_lookback():
    key = Key(ANY)
    key.send(0, "1..")
    assert key.send(100) == [("1..", "pending", 0), ("1..", "expired", 0)]
    assert not key.state.exists


def test_expected_counts_by_context_type():
    key = Key(EXPECTED_COUNT, {"1": 3})
    assert key.send(0, "1..", "2..", None) == [("2..", "record", 1)]
    assert key.send(1, None) == []
    assert key.send(2, None) == [("1..", "record", 3)]


def test_quiescence_waits_for_the_last_event():
    key = Key(QUIESCENT, grace=30)
    assert key.send(0, "1..", None) == []
    assert key.state.timer == 10_000
    assert key.send(8, None) == []
    assert key.send(17) == []
    assert key.send(18) == [("1..", "record", 2)]


def test_job_over_keyed_state(spark, options):  # noqa: F811
    options = TrailOptions(**{**vars(options), "online": KEYED_STATE})
    trail = txtrail.build(spark, options)
    send_events(spark, options, "a", "a", "b")
    send_tx(spark, options, ("a", "1.x."), ("a", "1.y."), ("b", "1.."), ("late", "1.."))
    trail.run_available()
    assert record_sizes(spark, options) == [("a", "1.x.", 2), ("a", "1.y.", 2), ("b", "1..", 1)]
    # started again: the state still holds the open notice, its events come now
    send_events(spark, options, "late")
    trail.run_available()
    assert record_sizes(spark, options)[-1] == ("late", "1..", 1)
    assert statuses(spark, options) == {("a", 2), ("b", 2), ("late", 2)}


def test_gtids_of_a_bucket_are_judged_by_themselves():
    state, judge = State(), keyed._judge_bucket(ANY, {}, 3000, 10_000, 100_000, 50_000)

    def send(now, *messages):
        state.now = now * 1000
        rows = pd.DataFrame(
            {
                "gtid": pd.Series([g for g, _ in messages], dtype=object),
                "context": pd.Series([c for _, c in messages], dtype=object),
                "time": pd.to_datetime([None if c is None else 7 for _, c in messages], unit="s"),
                "arrived": pd.to_datetime([now] * len(messages), unit="s"),
            }
        )
        found = judge((0,), iter([rows] if messages else []), state)
        return sorted(tuple(r) for f in found for r in f[["gtid", "context", "outcome", "n_events"]].itertuples(index=False))

    assert send(0, ("a", "1.."), ("b", "1.."), ("a", None)) == [("a", "1..", "record", 1)]
    assert send(2, ("c", "1..")) == []
    assert state.timer == 3000
    assert send(4) == [("b", "1..", "pending", 0)]
    assert state.timer == 5000
    assert send(6, ("b", None), ("a", "2..")) == [("a", "2..", "record", 1), ("b", "1..", "record", 1), ("c", "1..", "pending", 0)]
    # the counts of a and b go first, c stays open until the lookback has passed
    assert state.timer == 50_000
    assert send(102) == [("c", "1..", "expired", 0)]
    assert not state.exists
