"""Streams with state: guarded steps, liveness and file changes, in any cut into batches and under replays."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aiscope.streaming import events as S
from aiscope.streaming import guarded, liveness

MINUTE = 60_000_000


def cut(tmp_path, name, rows, parts):
    """Rows as JSON files, one for each micro-batch, in order."""
    folder = tmp_path / name
    folder.mkdir()
    size = -(-len(rows) // parts)
    for i in range(parts):
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(map(json.dumps, rows[i * size : (i + 1) * size])))
        import os

        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def run(spark, tmp_path, name, frame, schema):
    S.into_table(frame, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"), mode="append").awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / f"{name}-out")).collect()


def stamp(minute):
    return f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00Z"


@pytest.mark.parametrize("parts", [1, 4])
def test_liveness_in_any_cut(spark, tmp_path, parts):
    rng = random.Random(7)
    beats = {a: sorted(rng.sample(range(600), rng.randrange(1, 60))) for a in range(8)}
    rows = sorted(((m, a) for a, ms in beats.items() for m in ms))
    rows = [{"agent_id": a, "ts": stamp(m)} for m, a in rows] + [{"agent_id": None, "ts": stamp(3)}, {"agent_id": 1, "ts": None}]
    rows += [{"agent_id": 99, "ts": stamp(700)}]
    for i in range(0, len(rows) - 2, 2):  # out of order, but within the lateness
        rows[i], rows[i + 1] = rows[i + 1], rows[i]
    path = cut(tmp_path, "beats", rows, parts)
    stream = spark.readStream.schema("agent_id long, ts timestamp").option("maxFilesPerTrigger", 1).json(path)
    found = {(r.agent_id, int(r.us // MINUTE) - 28401120, r.state) for r in run(spark, tmp_path, "beats", liveness.agent_liveness(stream, "30 minutes", "60 minutes").select("agent_id", F.unix_micros("at").alias("us"), "state"), "agent_id long, us long, state string")}
    expected = set()
    for a, ms in beats.items():
        for k, m in enumerate(ms):
            if k == 0 or m - ms[k - 1] > 30:
                expected.add((a, m, "alive"))
            if k == len(ms) - 1 or ms[k + 1] - m > 30:
                expected.add((a, m + 30, "missed"))
    assert found == {x for x in expected if x[1] < 640}
    assert {s for _, _, s in found} == {"alive", "missed"}


def simulated(listed):
    """(minute, change) by walking through the listings of one file: minute -> version."""
    out, seen, version, changed, pending, told = [], None, None, None, None, False
    for m in range(20):
        if m in listed:
            if seen is None:
                version, changed, pending = listed[m], m, "created"
            elif listed[m] != version:
                version, changed, pending = listed[m], m, pending or "modified"
            seen = m
            if pending and m - changed >= 2:
                out.append((m, pending))
                pending, told = None, True
        elif seen is not None:
            if told:
                out.append((seen + 1, "deleted"))
            seen, pending, told = None, None, False
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_file_changes_in_any_cut(spark, tmp_path, parts):
    rng = random.Random(3)
    trees = {f"f{i}": {m: rng.choice("aab") for m in range(20) if rng.random() < 0.85} for i in range(40)}
    rows = [{"path": p, "version": t[m], "seen_at": stamp(m)} for m in range(20) for p, t in trees.items() if m in t]
    rows += [{"path": "last", "version": "a", "seen_at": stamp(23)}]
    stream = spark.readStream.schema("path string, version string, seen_at timestamp").option("maxFilesPerTrigger", 1).json(cut(tmp_path, "listings", rows, parts))
    changes = liveness.file_changes(stream, "1 minute", "2 minutes", "1 minute").select("path", F.unix_micros("at").alias("us"), "change")
    found = {(r.path, int(r.us // MINUTE) - 28401120, r.change) for r in run(spark, tmp_path, "listings", changes, "path string, us long, change string")}
    expected = {(p, m, c) for p, t in trees.items() for m, c in simulated(t)}
    ended = {(p, max(t) + 1, "deleted") for p, t in trees.items() if max(t) == 19 and simulated(t) and simulated(t)[-1][1] != "deleted"}
    assert found - ended == expected and {c for _, _, c in found} == {"created", "modified", "deleted"}


def test_file_changes_keep_a_state_for_each_group_of_files(spark, tmp_path):
    rows = [{"path": f"f{i}", "version": None if i % 3 else "a", "seen_at": stamp(m)} for m in range(8) for i in range(30) if m < 2 + i % 4]
    rows += [{"path": "last", "version": "a", "seen_at": stamp(12)}]
    stream = spark.readStream.schema("path string, version string, seen_at timestamp").option("maxFilesPerTrigger", 1).json(cut(tmp_path, "groups", rows, 3))
    changes = liveness.file_changes(stream, "1 minute", "1 minute", "1 minute", groups=2)
    query = changes.writeStream.format("memory").queryName("groups").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(states) <= 2
    found = {(r.path, r.change) for r in spark.table("groups").collect()}
    assert found == {(f"f{i}", c) for i in range(30) for c in ("created", "deleted")}


def test_bad_rows_alone_go(spark):
    def half(frame):
        return frame[frame["n"] % 2 == 0]

    def strict(frame):
        if frame["n"].isin([10, 200, 202]).any():
            raise ValueError("no\nsuch")
        frame["m"] = frame["n"] * 10
        return frame

    calls = []

    def counted(frame):
        calls.append(len(frame))
        return strict(frame)

    frame = pd.DataFrame({"n": range(1000)})
    passed, failed = guarded.isolate(frame, [("half", half), ("strict", counted)], ["n", "m"])
    assert sorted(x for p in passed for x in p["n"]) == [n for n in range(0, 1000, 2) if n not in (10, 200, 202)]
    assert sorted(failed) == [(10, "strict", "ValueError: no\nsuch"), (200, "strict", "ValueError: no\nsuch"), (202, "strict", "ValueError: no\nsuch")]
    assert len(calls) < 80
    rows = spark.range(1000).select(F.col("id").alias("n"), F.lit("é").alias("t")).repartition(3)
    found = guarded.guarded(rows, [("half", half), ("strict", strict)], "n long, m long").collect()
    bad = [r for r in found if r.failed_step]
    assert len(found) == 500 and sorted(json.loads(r.input)["n"] for r in bad) == [10, 200, 202] and json.loads(bad[0].input)["t"] == "é"
    assert all(r.m == 10 * r.n and r.error is None for r in found if not r.failed_step)


def test_steps_that_do_not_keep_to_rows(spark):
    one = pd.DataFrame({"n": [1, 2]})
    for step in (lambda f: pd.concat([f, f]), lambda f: f.reset_index(drop=True).set_index(pd.Index([7] * len(f))), lambda f: None):
        passed, failed = guarded.isolate(one, [("s", step)], ["n"])
        assert not passed and [f[1] for f in failed] == ["s", "s"]
    assert [f[1] for f in guarded.isolate(one, [("s", lambda f: f.drop(columns="n"))], ["n"])[1]] == ["result", "result"]
    assert guarded.isolate(one.iloc[:0], [], ["n"]) == ([], [])
    with pytest.raises(ValueError):
        guarded.guarded(spark.range(1), [], "error string")


def test_both_sinks_of_a_stream(spark, tmp_path):
    rows = [{"n": n} for n in range(40)]
    stream = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).json(cut(tmp_path, "rows", rows, 4))

    def step(frame):
        if (frame["n"] == 13).any():
            raise KeyError("13")
        return frame

    out = str(tmp_path / "out")
    for _ in range(2):  # once more from the start: the same folders are written again
        guarded.guarded_sinks(stream, [("step", step)], "n long", out, str(tmp_path / f"cp{_}")).awaitTermination()
    done = spark.read.parquet(out)
    assert done.where("quarantined = 'true'").select("failed_step", "batch_id").collect() == [("step", 1)]
    assert done.where("quarantined = 'false'").count() == 39


def test_many_bad_rows_cost_one_call():
    calls = []

    def odd(row):
        if row["n"] % 3 == 0:
            raise ValueError(row["n"])
        return {**row, "m": row["n"] * 10} if row["n"] % 3 == 1 else None

    def counted(frame):
        calls.append(len(frame))
        return guarded.by_row(odd)(frame)

    frame = pd.DataFrame({"n": range(3000)})
    passed, failed = guarded.isolate(frame, [("odd", counted)], ["n", "m"])
    assert calls == [3000]
    assert [m for p in passed for m in p["m"]] == [10 * n for n in range(1, 3000, 3)] and failed == [(n, "odd", f"ValueError: {n}") for n in range(0, 3000, 3)]

    def last(frame):
        if frame["n"].isin([5, 9]).any():
            raise KeyError("x")
        return frame

    before = []
    passed, failed = guarded.isolate(frame.iloc[:64], [("seen", lambda f: before.append(len(f)) or f), ("last", last)], ["n"])
    assert before == [64] and [f[0] for f in failed] == [5, 9] and sum(map(len, passed)) == 62
    assert guarded.isolate(frame.iloc[:3:3], [("odd", guarded.by_row(odd))], ["n", "m"]) == ([], [(0, "odd", "ValueError: 0")])
