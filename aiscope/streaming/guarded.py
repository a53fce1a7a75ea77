"""Middleware whose failures stay with the row that causes them.

A step is a function on a pandas frame that works row by row: it may change
columns and drop rows.  A whole batch goes through all steps at once; only if
one raises is the batch halved before that step, until the rows that raise are
alone.  A step that can tell its bad rows raises :class:`BadRows` and costs one
call a batch however many they are; :func:`by_row` makes one from a function of
a single row.  Bad rows become quarantined rows with the step, the error and
their input as JSON, so a bad row neither fails nor loses its batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from aiscope.streaming.events import _run

Step = tuple[str, Callable[[pd.DataFrame], pd.DataFrame]]
FAILURE = ("failed_step", "error", "input")


class BadRows(Exception):
    """Raised by a step that knows its bad rows: their errors by label, and the frame of all others."""

    def __init__(self, errors: dict[object, Exception], rest: pd.DataFrame):
        super().__init__(f"{len(errors)} rows")
        self.errors, self.rest = errors, rest


def by_row(change: Callable[[dict], dict | None]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A step from a function of one row, which gives it back, changed or not, or None to drop it; what raises for a row stays with it."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        kept, errors = {}, {}
        for label, row in zip(frame.index, frame.to_dict("records")):
            try:
                out = change(row)
                if out is not None:
                    kept[label] = dict(out)
            except Exception as cause:
                errors[label] = cause
        rest = pd.DataFrame(list(kept.values()), index=list(kept), dtype=object).infer_objects() if kept else frame.iloc[:0]
        if errors:
            raise BadRows(errors, rest)
        return rest

    return step


def _after(frame: pd.DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame]) -> tuple[pd.DataFrame, dict[object, Exception]]:
    """The frame after a step, and the errors of the rows that the step says are bad."""
    errors = {}
    try:
        out = step(frame.copy())
    except BadRows as bad:
        out, errors = bad.rest, bad.errors
    labels = set(frame.index)
    if not isinstance(out, pd.DataFrame) or out.index.has_duplicates or not labels.issuperset(out.index) or not labels.issuperset(errors) or not errors.keys().isdisjoint(out.index):
        raise TypeError("a step must return some of the rows that it is given")
    return out, errors


def isolate(frame: pd.DataFrame, steps: list[Step], columns: list[str]) -> tuple[list[pd.DataFrame], list[tuple[object, str, str]]]:
    """Frames that passed, and (label, step, error) of each row that did not.

    For b bad rows of n, a step that only raises is called some b log n times
    and the steps before it once; one that raises :class:`BadRows`, once.
    """
    passed, failed, waiting = [], [], [(frame, frame, 0)]
    fail = lambda label, step, cause: failed.append((label, step, f"{type(cause).__name__}: {cause}"))
    while waiting:
        given, part, at = waiting.pop()
        name = "result"
        try:
            while len(part) and at < len(steps):
                name, step = steps[at]
                part, errors = _after(part, step)
                for label, cause in errors.items():
                    fail(label, name, cause)
                at, name = at + 1, "result"
            if not len(part):
                continue
            missing = [c for c in columns if c not in part.columns]
            if missing:
                raise KeyError(f"columns {missing}")
            passed.append(part[columns])
        except Exception as cause:
            if len(part) == 1:
                fail(part.index[0], name, cause)
                continue
            half = len(part) // 2
            for piece in (part.iloc[half:], part.iloc[:half]):
                own = given.loc[piece.index]
                # which columns there are may depend on the rows, so a result is tried again from the start
                waiting.append((own, own, 0) if name == "result" else (own, piece, at))
    return passed, failed


def guarded(rows: DataFrame, steps: list[Step], schema: str) -> DataFrame:
    """``rows`` after the steps, in the columns of ``schema``, and ``failed_step, error, input`` which are null for rows that passed.

    A quarantined row has nulls in the columns of ``schema``; rows that a step
    drops are in neither part.
    """
    out = StructType.fromDDL(schema)
    columns = out.fieldNames()
    if set(columns) & set(FAILURE):
        raise ValueError(f"columns named {', '.join(FAILURE)} are taken")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            passed, failed = isolate(batch, steps, columns)
            parts = [p.assign(**dict.fromkeys(FAILURE)) for p in passed]
            if failed:
                inputs = [json.dumps(row, default=str, ensure_ascii=False) for row in batch.loc[[label for label, _, _ in failed]].to_dict("records")]
                parts.append(pd.DataFrame({**{c: [None] * len(failed) for c in columns}, "failed_step": [s for _, s, _ in failed], "error": [e for _, _, e in failed], "input": inputs}, dtype=object))
            for part in parts:
                yield part[[*columns, *FAILURE]]

    return rows.mapInPandas(run, f"{schema}, failed_step string, error string, input string")


def guarded_sinks(rows: DataFrame, steps: list[Step], schema: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a stream through guarded steps into ``path``: one write a batch, with a folder each for passed and quarantined rows.

    A batch has a folder of its own, which a replay replaces, and steps run once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        done = guarded(batch, steps, schema).withColumn("quarantined", F.col("failed_step").isNotNull())
        done.write.mode("overwrite").partitionBy("quarantined").parquet(f"{path}/batch_id={batch_id}")

    return _run(rows, each, checkpoint, "append", every)
