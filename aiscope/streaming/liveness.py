"""Streams that tell of what does not happen: agents that fall silent, files that are gone.

Both keep a little state for each key and let event time decide.  Rows are held
until the watermark has passed them and then go through in order, so results
depend on the rows alone, not on how they were cut into batches or on replays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aiscope.streaming.events import LATENESS


def _micros(interval: str) -> int:
    found = pd.Timedelta(interval)
    if found <= pd.Timedelta(0):
        raise ValueError(f"{interval!r} is no length of time")
    return found // pd.Timedelta("1us")


def _passed(at: int, watermark: int) -> bool:
    """Is a moment in microseconds before the watermark, which counts in milliseconds?"""
    return at // 1000 < watermark


def _wait(state: GroupState, values: tuple, moments: list[int], watermark: int) -> None:
    state.update(values)
    state.setTimeoutTimestamp(max(min(moments) // 1000, watermark))


def agent_liveness(beats: DataFrame, missed_after: str = "3 minutes", lateness: str = LATENESS, agent: str = "agent_id", time: str = "ts") -> DataFrame:
    """``agent_id, at, state`` of a stream of heartbeats: ``alive`` at the first beat and at the first after a silence, ``missed`` when none has come for ``missed_after``.

    A silence is told by a timer of event time, without another beat of that
    agent.  Beats later than ``lateness`` are left out, as are null agents and
    times; an agent that has fallen silent keeps no state.
    """
    limit = _micros(missed_after)
    rows = beats.select(F.col(agent).alias("agent_id"), F.col(time).cast("timestamp").alias("_ts")).where("agent_id is not null and _ts is not null")
    rows = rows.withWatermark("_ts", lateness).withColumn("_us", F.unix_micros("_ts"))
    kind = rows.schema["agent_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = sorted([*waiting, *(int(x) for frame in frames for x in frame["_us"])])
        watermark = state.getCurrentWatermarkMs()
        out: list[tuple[int, str]] = []
        done = 0
        for at in waiting:
            if not _passed(at, watermark):
                break
            done += 1
            if last is not None and at - last > limit:
                out.append((last + limit, "missed"))
                last = None
            if last is None:
                out.append((at, "alive"))
            last = max(at, last or at)
        waiting = waiting[done:]
        if last is not None and _passed(last + limit, watermark) and not (waiting and waiting[0] <= last + limit):
            out.append((last + limit, "missed"))
            last = None
        moments = [*waiting[:1], *([last + limit] if last is not None else [])]
        if moments:
            _wait(state, (last, waiting), moments, watermark)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"agent_id": [key[0]] * len(out), "_at": [a for a, _ in out], "state": [s for _, s in out]})

    found = rows.groupBy("agent_id").applyInPandasWithState(step, f"agent_id {kind}, _at long, state string", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("agent_id", F.timestamp_micros("_at").alias("at"), "state")


def file_changes(listings: DataFrame, every: str = "2 seconds", quiet: str = "2 seconds", lateness: str = LATENESS, groups: int = 4096) -> DataFrame:
    """``path, at, change`` from a stream of whole listings ``path, version, seen_at``, taken ``every`` so often.

    ``created`` and ``modified`` come once a file's version (its time and
    length, say) has stayed the same for ``quiet``, and tell of all that changed
    before; ``deleted`` comes ``every`` after the last listing that has the file,
    once one and a half such lengths have passed.  A file that goes before it
    was quiet has never been there.

    Every listing names all files, so files are kept by a hash of their path in
    ``groups`` states: a call of Python for each group, not for each file.
    """
    interval, calm = _micros(every), _micros(quiet)
    rows = listings.select("path", F.col("version").cast("string").alias("version"), F.col("seen_at").cast("timestamp").alias("_ts")).where("path is not null and _ts is not null")
    rows = rows.withWatermark("_ts", lateness).withColumn("_us", F.unix_micros("_ts")).withColumn("_g", F.pmod(F.xxhash64("path"), F.lit(groups)))

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by path: seen, version, changed, pending, told, and the rows that wait
        files = {path: (*one, list(zip(times, versions))) for path, *one, times, versions in zip(*state.get)} if state.exists else {}
        for f in frames:
            for path, at, version in zip(f["path"].tolist(), f["_us"].tolist(), f["version"].tolist()):
                if path not in files:
                    files[path] = (None, None, None, None, False, [])
                files[path][-1].append((at, version))
        watermark = state.getCurrentWatermarkMs()
        out: list[tuple[str, int, str]] = []
        kept, moments = [], []
        for path, (seen, version, changed, pending, told, waiting) in files.items():
            waiting.sort(key=lambda x: (x[0], x[1] or ""))
            done = 0
            for at, now in waiting:
                if not _passed(at, watermark):
                    break
                done += 1
                if seen is not None and 2 * (at - seen) > 3 * interval:
                    if told:
                        out.append((path, seen + interval, "deleted"))
                    seen, pending, told = None, None, False
                if seen is None:
                    version, changed, pending = now, at, "created"
                elif now != version:
                    version, changed, pending = now, at, pending or "modified"
                seen = at
                if pending and at - changed >= calm:
                    out.append((path, at, pending))
                    pending, told = None, True
            waiting = waiting[done:]
            last = None if seen is None else seen + interval * 3 // 2
            if last is not None and _passed(last, watermark) and not (waiting and waiting[0][0] <= last):
                if told:
                    out.append((path, seen + interval, "deleted"))
                seen, pending, told, last = None, None, False, None
            if waiting or last is not None:
                kept.append((path, seen, version, changed, pending, told, [t for t, _ in waiting], [v for _, v in waiting]))
                moments += [t for t, _ in waiting[:1]] + ([last] if last is not None else [])
        if kept:
            _wait(state, tuple(map(list, zip(*kept))), [min(moments)], watermark)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["path", "_at", "change"])

    state = "path array<string>, seen array<long>, version array<string>, changed array<long>, pending array<string>, told array<boolean>, times array<array<long>>, versions array<array<string>>"
    found = rows.groupBy("_g").applyInPandasWithState(step, "path string, _at long, change string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("path", F.timestamp_micros("_at").alias("at"), "change")
