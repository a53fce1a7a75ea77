"""Hard negatives against brute force and SQL."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from aiscope.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label long"


def reference(rows, anchor, count=5):
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    place = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for k, (i, v, label) in enumerate(usable):
        if not anchor(i):
            continue
        scored = [(j, max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), other) for n, (j, w, other) in enumerate(usable) if n != k and len(w) == len(v)]
        for positive, p, _ in sorted((x for x in scored if x[2] == label), key=place)[:count]:
            found = sorted((x for x in scored if x[2] != label and 80 * p <= 100 * x[1] <= 100 * p), key=place)[:count]
            out += [(i, positive, rank, j, p, s) for rank, (j, s, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    found = queries.QUERIES["op13_hard_negatives"](spark, sf)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(found) == sorted(con.execute(queries.ORACLES["op13_hard_negatives"]).fetchall(), key=str) != []


def test_edges(spark):
    """Nulls, infinities, zeros, several lengths, no components, great components, repeated rows and anchors, ties, a hot vector, few rows of a label."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(120)] + [(1000, [0.5] * 8, 0)] * 3
    rows += [(2000, None, 1), (2010, [1.0] * 8, None), (2020, [1.0] * 7 + [None], 1), (2030, [math.inf] + [1.0] * 7, 1), (2040, [math.nan] * 8, 1), (None, [0.5] * 8, 1), (None, [0.25] * 8, 0), (3000, [0.0] * 8, 2), (3001, [-0.5] * 8, 0)]
    rows += [(4000 + i, [], i % 2) for i in range(12)] + [(5000 + i, [1e6 * (i + 1), -3.0], i % 2) for i in range(9)] + [(6000 + i, [1e300, 1.0, 1e17 * i], i % 2) for i in range(9)] + [(7000, [1.0] * 5, 77)]
    rows += [(8000 + i, (rng.normal(size=4) + 4).tolist(), i % 9) for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)) == reference(rows, lambda i: i is not None and i % 10 == 0)


def test_empty_and_clashing(spark):
    assert got(negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True))) == []
    assert got(negatives.hard_negatives(spark.createDataFrame([(1, None, 1)], SCHEMA), F.lit(True))) == []
    frame = spark.createDataFrame([("a", [1.0, 0.5], 1, 0, 0), ("b", [1.0, 0.5], 1, 0, 0), ("c", [0.9, 0.5], 2, 0, 0)], SCHEMA.replace("long", "string", 1) + ", _key int, _Angles int")
    assert [r[:4] for r in got(negatives.hard_negatives(frame, F.col("vec_id") == "a"))] == [("a", "b", 1, "c")]


def test_all_buckets_answer_where_there_are_too_many_to_summarise(spark, sf, monkeypatch):
    vectors = negatives.mislabelled(spark.read.parquet(f"{sf}/embeddings.parquet"))
    one = got(negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0))
    monkeypatch.setattr(negatives, "SUMMARIES", 0)
    assert one == got(negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0))


def test_bounds_hold_and_spare_runs():
    """No score is outside its bounds; on clustered vectors most runs are left out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    matrix = np.floor(256 * (centres[rng.integers(12, size=4000)] + rng.normal(size=(4000, 16)) * 0.05))
    matrix[:5] = 0
    references = negatives.directions(list(matrix[::20]), 16)
    norms, angle = negatives.angles(matrix, references)
    runs = negatives.Runs(np.arange(4000), list(range(4000)), np.zeros(4000, dtype=np.int64), matrix, norms, angle.astype(np.float32).astype(float))
    low, high = runs.bounds(angle[:200].astype(np.float32), norms[:200])
    real = matrix[:200] @ runs.matrix.T
    run = np.repeat(np.arange(len(runs.start)), runs.size)
    assert (real >= low[:, run]).all() and (real <= high[:, run]).all()
    top = np.sort(real, axis=1)[:, -20]
    assert (high[5:] >= top[5:, None]).mean() < 0.3
