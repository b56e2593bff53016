"""The stateful stream over polls: restarts, late and repeated pages, ties, bad pages, and a property on the state step."""

import itertools
import json

import pandas as pd
import pytest
from pyspark.sql.streaming.query import StreamingQueryException

from repolens.streaming import polls as P


class State:
    """The part of a group state that the step uses."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return 0


def item(number, status, minute, attempt=None, repo="r", started="2024-01-01T00:00:00Z"):
    run = {"run_number": number, "name": "w", "status": status, "run_started_at": started,
           "repository": {"name": repo}, "triggering_actor": {"login": "u"}}
    if minute is not None:
        run["updated_at"] = f"2024-01-01T00:{minute:02d}:00Z"
    return run | ({"run_attempt": attempt} if attempt else {})


def land(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"total_count": len(items), "workflow_runs": list(items)}))


def replay(spark, base):
    P.start_run_changes(spark, str(base / "landing"), str(base / "log"), str(base / "state")).awaitTermination(120)
    return P.read_changes(spark, str(base / "log"))


def opened(log):
    return sorted((r.workflow, r.title, r.status) for r in P.open_runs(log, "2024-02-01 00:00:00").collect())


def test_restarts_late_pages_and_reruns(spark, tmp_path):
    landing = tmp_path / "landing"
    named = lambda n, *a, **k: item(n, *a, **k) | {"display_title": str(n)}
    land(landing, "a.json", named(1, "queued", 1), named(2, "queued", 1), named(3, "completed", 1))
    log = replay(spark, tmp_path)
    assert opened(log) == [("w", "1", "queued"), ("w", "2", "queued")]
    land(landing, "b.json", named(1, "completed", 9), named(3, "queued", 5, attempt=2))
    land(landing, "c.json", named(2, "in_progress", 7), named(2, "in_progress", 7))
    log = replay(spark, tmp_path)
    assert opened(log) == [("w", "2", "in_progress"), ("w", "3", "queued")]
    before = log.count()
    land(landing, "d.json", named(1, "in_progress", 4), named(2, "queued", 1), named(3, "completed", 8, attempt=1))  # all of it old
    log = replay(spark, tmp_path)
    assert opened(log) == [("w", "2", "in_progress"), ("w", "3", "queued")] and log.count() == before
    assert replay(spark, tmp_path).count() == before  # nothing new has landed
    newest = {r.run_number: (r.status, str(r.updated_at), str(r.run_started_at)) for r in P.current_runs(log).collect()}
    assert newest[1] == ("completed", "2024-01-01 00:09:00", "2024-01-01 00:00:00")


def test_missing_values_empty_pages_and_no_pages(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    assert opened(replay(spark, tmp_path)) == []
    land(landing, "a.json")
    land(landing, "b.json", item(None, None, None, started=None), item(5, None, None), item(6, "queued", None, repo=None))
    (landing / "c.json").write_text("{}")
    log = replay(spark, tmp_path)
    got = P.current_runs(log).collect()
    assert {(r.repo, r.run_number, r.status, str(r.run_started_at)) for r in got} == {
        ("r", None, "", "None"), ("r", 5, "", "2024-01-01 00:00:00"), (None, 6, "queued", "2024-01-01 00:00:00")}
    assert P.open_runs(log, "2024-02-01 00:00:00").count() == 3


def test_a_page_cut_short_ends_the_stream(spark, tmp_path):
    land(tmp_path / "landing", "a.json", item(1, "queued", 1))
    (tmp_path / "landing" / "b.json").write_text('{"total_count": 1, "workflow_runs": [{"run_num')
    with pytest.raises(StreamingQueryException):
        replay(spark, tmp_path)


def frame(*states):
    rows = [("r", 1, attempt, at, status == "completed", status, None, "w", "b", "t", None, "u", 10 + at) for attempt, at, status in states]
    return pd.DataFrame(rows, columns=[*P.FIELDS, "landed"])


def test_any_order_and_split_of_pages_ends_in_the_same_state():
    states = [(1, 1, "queued"), (1, 5, "in_progress"), (1, 5, "completed"), (2, 6, "queued")]
    for order in itertools.permutations(states):
        for cut in range(len(order) + 1):
            state, out = State(), []
            for part in (order[:cut], order[cut:]):
                if part:
                    out += [f for f in P.newest_of(("r", 1), iter([frame(*part)]), state)]
            assert state.get == (2, 6, False, "queued") and tuple(out[-1].iloc[0][["attempt", "status"]]) == (2, "queued")


def test_finished_runs_time_out_and_open_ones_stay():
    state = State()
    assert len(list(P.newest_of(("r", 1), iter([frame((1, 1, "queued"))]), state))) == 1 and state.timeout is None
    assert len(list(P.newest_of(("r", 1), iter([frame((1, 2, "completed"))]), state))) == 1 and state.timeout == 13
    state.hasTimedOut = True
    assert list(P.newest_of(("r", 1), iter([]), state)) == [] and not state.exists


def test_a_block_is_one_call_and_its_runs_leave_one_by_one(spark, tmp_path):
    run = lambda n, at, status: ("r", n, 1, at, status == "completed", status, None, "w", "b", "t", None, "u", 10 + at)
    rows = lambda *runs: iter([pd.DataFrame([run(*r) for r in runs], columns=[*P.FIELDS, "landed"])])
    state = State()
    (first,) = P.newest_in_block(("r", 0), rows((1, 1, "queued"), (2, 1, "completed"), (None, 1, "queued"), (1, 0, "queued")), state)
    assert sorted(first["run_number"].dropna()) == [1, 2] and len(first) == 3 and state.timeout == 12
    assert list(P.newest_in_block(("r", 0), rows((1, 0, "completed"), (2, 1, "completed")), state)) == []
    (second,) = P.newest_in_block(("r", 0), rows((1, 5, "completed")), state)
    assert second["status"].tolist() == ["completed"] and state.timeout == 12
    state.getCurrentWatermarkMs, state.hasTimedOut = lambda: 13, True
    assert list(P.newest_in_block(("r", 0), iter([]), state)) == [] and state.timeout == 16
    assert sorted(r[0] or 0 for r in json.loads(state.get[0])) == [0, 1]  # run 2 left, the run without a number is open
    # a thousand runs of one repository are called block by block, with the results of single runs
    for n in range(4):
        land(tmp_path / "landing", f"{n}.json", *[item(i, ("queued", "completed")[i % 2], 1) for i in range(n * 250, n * 250 + 250)])
    stream = P.run_changes_stream(spark, str(tmp_path / "landing"))
    assert "block" in stream._jdf.queryExecution().analyzed().toString()
    log = replay(spark, tmp_path)
    assert log.count() == 1000 and P.open_runs(log, "2024-02-01 00:00:00").count() == 500
