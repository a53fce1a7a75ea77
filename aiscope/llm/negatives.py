"""Hard negatives of anchor vectors, found by angles to reference directions.

Every row stores its angles to a few reference directions.  By the triangle
inequality for angles, the angle between an anchor and a row lies between the
greatest difference of their angles to one reference and the least sum; its
cosine times both norms, widened by a slack for rounding, bounds their score.
Rows are laid out by label, nearest reference and angle, so that runs of
neighbouring rows have narrow intervals: a run gets integer scores only if its
bounds overlap the window of scores that an anchor still asks for.

The rows are dealt to buckets of equal size.  An anchor goes to the buckets
whose bounds overlap its window, each bucket answers with its best few, and the
best of these are kept: first for positives, then, in the windows that these
open, for negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aiscope.llm.graph import cut

#: Reference directions, and the rows (by least hash) among which they are chosen.
REFERENCES, REFERENCE_SAMPLE = 16, 2048
#: Components of a bucket's vectors; rows of a run; anchors scored together.
BUCKET_COMPONENTS, RUN, TOGETHER = 1 << 22, 32, 64
#: Bucket summaries are broadcast for up to so many buckets (some 20 MB); beyond that anchors go to all buckets.
SUMMARIES = 1 << 16
#: Angles are stored in 32 bits; scores are integers.
SLACK = 2e-5
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def mislabelled(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding``, the label moved on by one modulo 10 where 7 divides the id."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label).alias("label"), "embedding")


def integers(column: pa.Array) -> list[np.ndarray]:
    """floor(256 * x) of each vector, as doubles that are whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def by_length(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    sizes = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.array([vectors[i] for i in at]).reshape(len(at), size)


def directions(sample: list[np.ndarray], size: int, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other among the sample's of this length, farthest first; random ones if there are too few."""
    own = [v / n for v in sample if len(v) == size and 0 < (n := np.linalg.norm(v)) < np.inf]
    own = np.array(own).reshape(len(own), size)
    chosen = []
    if len(own):
        nearest = np.full(len(own), -2.0)
        at = 0
        for _ in range(min(count, len(own))):
            chosen.append(own[at])
            nearest = np.maximum(nearest, own @ own[at])
            at = int(np.argmin(nearest))
            if nearest[at] > 1 - 1e-9:
                break
    more = np.random.default_rng(size).standard_normal((count, size))
    for v in more[len(chosen) :]:
        chosen.append(v / max(np.linalg.norm(v), 1e-300))
    return np.array(chosen).reshape(count, size)


def angles(matrix: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows, and their angles to the references; a right angle for a row of zeros, whose scores are zero anyway.

    Norms are cut off where products would overflow; their scores are beyond 64 bits long before.
    """
    scale = np.abs(matrix).max(axis=1, initial=0)  # else squares of great components overflow
    unit = matrix / np.where(scale, scale, 1)[:, None]
    length = np.linalg.norm(unit, axis=1)
    cosine = np.where(length[:, None] > 0, unit @ references.T / np.where(length, length, 1)[:, None], 0)
    return np.minimum(scale * length, 1e150), np.arccos(np.clip(cosine, -1, 1))


def score_bounds(anchor_angles, anchor_norms, low, high, least_norm, most_norm) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with each run, from the run's intervals of angles and norms."""
    nearest = np.zeros((len(anchor_angles), len(low)))
    farthest = np.full_like(nearest, np.pi)
    for r in range(anchor_angles.shape[1]):
        own = anchor_angles[:, r, None]
        np.maximum(nearest, np.maximum(own - high[None, :, r], low[None, :, r] - own), out=nearest)
        np.minimum(farthest, np.minimum(own + high[None, :, r], 2 * np.pi - own - low[None, :, r]), out=farthest)
    size = anchor_norms[:, None] * most_norm[None, :]
    small = anchor_norms[:, None] * least_norm[None, :]
    top, bottom = np.cos(nearest), np.cos(np.maximum(farthest, nearest))
    most = np.where(top > 0, size, small) * top
    least = np.where(bottom > 0, small, size) * bottom
    ends = -(2.0**63), 2.0**63  # where scores end
    return np.clip(np.floor(least - SLACK * size - 1), *ends), np.clip(np.ceil(most + SLACK * size + 1), *ends)


def scores(anchors: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products as 64-bit integers; ``bound`` is on the product of norms, and so on every partial sum."""
    if bound < 2**24:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(anchors) @ whole(rows).T, LEAST, MOST).astype(np.int64) if rows.shape[1] else np.zeros((len(anchors), len(rows)), dtype=np.int64)


class Runs:
    """Rows of one length by label, nearest reference and angle, in runs of one label with their intervals."""

    def __init__(self, keys, ids, labels, matrix, norms, angle):
        cell = angle.argmin(axis=1) if angle.shape[1] else np.zeros(len(angle), dtype=np.int64)
        order = np.lexsort((angle[np.arange(len(angle)), cell], cell, labels))
        self.keys, self.ids, self.labels, self.matrix = keys[order], [ids[i] for i in order.tolist()], labels[order], matrix[order]
        norms, angle = norms[order], angle[order]
        new = np.concatenate(([True], self.labels[1:] != self.labels[:-1]))
        first = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.start = np.flatnonzero(place % RUN == 0)
        self.size = np.diff(np.append(self.start, len(order)))
        self.label = self.labels[self.start]
        self.low, self.high = np.minimum.reduceat(angle, self.start), np.maximum.reduceat(angle, self.start)
        self.least, self.most = np.minimum.reduceat(norms, self.start), np.maximum.reduceat(norms, self.start)

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """Places of all rows of the wanted runs."""
        return np.flatnonzero(np.repeat(wanted, self.size))

    def bounds(self, angle: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(angle, norms, self.low, self.high, self.least, self.most)


def first_of(score: np.ndarray, ids: list, count: int) -> np.ndarray:
    """Places of the first ``count`` rows by score, then id; a null id comes last."""
    if len(score) > count:
        least = np.partition(score, len(score) - count)[len(score) - count]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return np.array(sorted(at.tolist(), key=lambda i: (-score[i], ids[i] is None, 0 if ids[i] is None else ids[i]))[:count], dtype=np.int64)


def positives_in(runs: Runs, keys, labels, matrix, norms, angle, count: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, row, score): the first other rows of each anchor's label."""
    low, high = runs.bounds(angle, norms)
    same = runs.label[None, :] == labels[:, None]
    # the bounds of runs with count + 1 rows together tell how high the count-th score is at least
    order = np.argsort(np.where(same, -low, np.inf), axis=1, kind="stable")
    rows = np.cumsum(np.where(np.take_along_axis(same, order, 1), runs.size[order], 0), axis=1)
    enough = rows > count
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
    floor = np.where(at >= 0, np.take_along_axis(low, np.take_along_axis(order, np.maximum(at, 0)[:, None], 1), 1)[:, 0], -np.inf)
    wanted = same & (high >= floor[:, None])
    for some in range(0, len(keys), TOGETHER):
        part = slice(some, some + TOGETHER)
        at = runs.rows(wanted[part].any(axis=0))
        if not len(at):
            continue
        found = scores(matrix[part], runs.matrix[at], norms[part].max() * runs.most.max())
        for k in range(len(found)):
            mine = np.flatnonzero((runs.labels[at] == labels[some + k]) & (runs.keys[at] != keys[some + k]))
            ids = [runs.ids[i] for i in at[mine].tolist()]
            for i in first_of(found[k][mine], ids, count).tolist():
                yield some + k, int(at[mine[i]]), int(found[k][mine[i]])


def negatives_in(runs: Runs, labels, matrix, norms, angle, windows: list[np.ndarray], count: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, row, score): the first rows of other labels in each of an anchor's windows (least, greatest score)."""
    low, high = runs.bounds(angle, norms)
    wanted = np.zeros(low.shape, dtype=bool)
    for k, own in enumerate(windows):
        wanted[k] = ((high[k][None, :] >= own[:, :1]) & (low[k][None, :] <= own[:, 1:])).any(axis=0)
    wanted &= runs.label[None, :] != labels[:, None]
    for some in range(0, len(labels), TOGETHER):
        part = slice(some, some + TOGETHER)
        at = runs.rows(wanted[part].any(axis=0))
        if not len(at):
            continue
        found = scores(matrix[part], runs.matrix[at], norms[part].max() * runs.most.max())
        for k in range(len(found)):
            own = windows[some + k]
            mine = np.flatnonzero((runs.labels[at] != labels[some + k]) & (found[k] >= own[:, 0].min()) & (found[k] <= own[:, 1].max()))
            score = found[k][mine]
            for w, (least, most) in enumerate(own.tolist()):
                inside = mine[(score >= least) & (score <= most)]
                ids = [runs.ids[i] for i in at[inside].tolist()]
                for i in first_of(found[k][inside], ids, count).tolist():
                    yield some + k, w, int(at[inside[i]]), int(found[k][inside[i]])


def _stored(batches: Iterator[pa.RecordBatch], sample: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds each row's norm, nearest reference and angles."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = integers(batch.column("_vector"))
        norms, cell, near = np.zeros(len(vectors)), np.zeros(len(vectors), dtype=np.int32), np.zeros(len(vectors))
        stored = np.zeros((len(vectors), REFERENCES), dtype=np.float32)
        for at, matrix in by_length(vectors):
            references = known.setdefault(matrix.shape[1], directions(sample, matrix.shape[1]))
            norms[at], stored[at] = angles(matrix, references)
            cell[at] = stored[at].argmin(axis=1)
            near[at] = stored[at].min(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * REFERENCES, pa.int32()), pa.array(stored.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), pa.array(cell), pa.array(near), lists], names=[*batch.schema.names, "_norm", "_cell", "_near", "_angles"])


def _angle_rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), REFERENCES)


def _routed(batches: Iterator[pa.RecordBatch], buckets: int, summaries: dict[str, np.ndarray] | None, negative: bool) -> Iterator[pa.RecordBatch]:
    """The buckets of each anchor, as the list ``_to``."""
    for batch in batches:
        n = batch.num_rows
        if summaries is None:
            to = [np.arange(buckets)] * n
        else:
            label = np.array(batch.column("_label").to_pylist(), dtype=np.int64)
            norms, angle = batch.column("_norm").to_numpy(), _angle_rows(batch.column("_angles"))
            s = summaries
            if negative:
                low, high = score_bounds(angle, norms, s["low"], s["high"], s["least"], s["most"])
                good = np.zeros(low.shape, dtype=bool)
                for k, own in enumerate(batch.column("_windows").to_pylist()):
                    own = np.array(own, dtype=np.float64).reshape(-1, 2)
                    good[k] = ((high[k][None, :] >= own[:, :1]) & (low[k][None, :] <= own[:, 1:])).any(axis=0)
                good &= ~((s["first"] == s["last"])[None, :] & (s["first"][None, :] == label[:, None]))
            else:
                good = (s["first"][None, :] <= label[:, None]) & (label[:, None] <= s["last"][None, :])
            to = [s["bucket"][np.flatnonzero(row)] for row in good]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in to]))), pa.int32()), pa.array(np.concatenate([*to, np.zeros(0)]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_to"])


def _answered(batches: Iterator[pa.RecordBatch], negative: bool, count: int) -> Iterator[pa.RecordBatch]:
    """A bucket's rows come first, then its anchors: each batch of anchors is answered from the rows kept."""
    kept: list[pa.RecordBatch] = []
    runs: dict[int, Runs] | None = None
    for batch in batches:
        kinds = batch.column("_kind").to_numpy()
        n = int((kinds == 0).sum())
        if n:
            kept.append(batch.slice(0, n))
        if n == batch.num_rows:
            continue
        if runs is None:
            runs, rows = {}, pa.Table.from_batches(kept).combine_chunks().to_batches() if kept else []
            kept = []
            for table in rows:
                keys, ids, labels = table.column("_key").to_numpy(), table.column("_id").to_pylist(), table.column("_label").to_numpy()
                norms, angle = table.column("_norm").to_numpy(), _angle_rows(table.column("_angles"))
                for at, matrix in by_length(integers(table.column("_vector"))):
                    runs[matrix.shape[1]] = Runs(keys[at], [ids[i] for i in at.tolist()], labels[at], matrix, norms[at], angle[at])
        asked = batch.slice(n)
        keys, labels, norms, angle = asked.column("_key").to_numpy(), asked.column("_label").to_numpy(), asked.column("_norm").to_numpy(), _angle_rows(asked.column("_angles"))
        windows = [np.array(w or [], dtype=np.int64).reshape(-1, 2) for w in asked.column("_windows").to_pylist()]
        found: list[tuple] = []
        for at, matrix in by_length(integers(asked.column("_vector"))):
            own = runs.get(matrix.shape[1])
            if own is None:
                continue
            if negative:
                hits = negatives_in(own, labels[at], matrix, norms[at], angle[at], [windows[i] for i in at.tolist()], count)
                found += [(int(keys[at[k]]), w, own.ids[row], score) for k, w, row, score in hits]
            else:
                hits = positives_in(own, keys[at], labels[at], matrix, norms[at], angle[at], count)
                found += [(int(keys[at[k]]), 0, own.ids[row], score) for k, row, score in hits]
        if found:
            a, b, c, d = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, asked.schema.field("_id").type), pa.array(d, pa.int64())], names=["_key", "_window", "_found", "_score"])


class VectorIndex:
    """All usable rows with their angles, in buckets; written once, read by both searches."""

    def __init__(self, vectors: DataFrame, anchor: Column, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding"):
        spark = vectors.sparkSession
        vector = F.col(vector_column)
        usable = F.col(label_column).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        rows = vectors.select(F.col(id_column).alias("_id"), F.col(label_column).cast("long").alias("_label"), F.coalesce(anchor, F.lit(False)).alias("_anchor"), vector.alias("_vector"), usable.alias("_usable")).where("_usable").drop("_usable")
        if not rows.schema["_vector"].dataType.simpleString() == "array<float>":
            rows = rows.withColumn("_vector", F.col("_vector").cast("array<double>"))
        sample = rows.select("_vector", F.xxhash64("_vector", "_id").alias("_hash")).orderBy("_hash").limit(REFERENCE_SAMPLE).collect()
        known = spark.sparkContext.broadcast([np.floor(np.array(r._vector, dtype=np.float64) * 256) for r in sample])
        n, widest = rows.agg(F.count(F.lit(1)), F.max(F.size("_vector"))).first()
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * max(widest or 1, REFERENCES) // BUCKET_COMPONENTS))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        stored = rows.mapInArrow(lambda batches: _stored(batches, known.value), f"{fields}, _norm double, _cell int, _near double, _angles array<float>")
        stored = stored.repartitionByRange(self.buckets, "_label", "_cell", "_near", F.xxhash64("_id", "_vector"))
        self.rows = cut(stored.select("*", F.spark_partition_id().alias("_bucket"), F.monotonically_increasing_id().alias("_key")))
        # the plan may have been given more partitions than asked for
        self.buckets = max(self.buckets, self.rows.rdd.getNumPartitions())
        self.shared = spark.sparkContext.broadcast(self._summaries())

    def _summaries(self) -> dict[str, np.ndarray] | None:
        """Intervals of each bucket's labels, norms and angles, if there are few enough buckets to broadcast them."""
        if self.buckets > SUMMARIES:
            return None
        each = [f(F.col("_angles")[r]).alias(f"{name}{r}") for r in range(REFERENCES) for f, name in ((F.min, "low"), (F.max, "high"))]
        found = self.rows.groupBy("_bucket").agg(F.min("_label").alias("first"), F.max("_label").alias("last"), F.min("_norm").alias("least"), F.max("_norm").alias("most"), *each).collect()
        out = {n: np.array([row[n] for row in found]) for n in ("first", "last", "least", "most")} | {"bucket": np.array([row._bucket for row in found], dtype=np.int64)}
        return out | {side: np.array([[row[f"{side}{r}"] for r in range(REFERENCES)] for row in found], dtype=np.float64).reshape(len(found), REFERENCES) for side in ("low", "high")}

    def ask(self, anchors: DataFrame, negative: bool, count: int) -> DataFrame:
        """``_key, _window, _found, _score``: each bucket's first rows for the anchors that it is asked by."""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
        buckets, shared = self.buckets, self.shared
        routed = anchors.mapInArrow(lambda batches: _routed(batches, buckets, shared.value, negative), f"{fields}, _to array<int>")
        asked = routed.withColumn("_bucket", F.explode("_to")).drop("_to").withColumn("_kind", F.lit(1))
        rows = self.rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name == "_windows" else F.col(f.name) for f in anchors.schema], "_bucket", F.lit(0).alias("_kind"))
        dealt = rows.unionByName(asked).repartitionById(self.buckets, F.col("_bucket")).sortWithinPartitions("_kind")
        kind = self.rows.schema["_id"].dataType.simpleString()
        return dealt.mapInArrow(lambda batches: _answered(batches, negative, count), f"_key long, _window int, _found {kind}, _score long")


def hard_negatives(vectors: DataFrame, anchor: Column, count: int = 5, least_percent: int = 80, most_percent: int = 100, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` is true.

    A score is the inner product of the vectors' components times 256, rounded
    down.  An anchor's positives are the first ``count`` other rows of its label
    by score; its negatives, for each positive, the first ``count`` rows of other
    labels with scores from ``least_percent`` to ``most_percent`` of the
    positive's.  Ties go to the smaller id, null ids come last.

    Rows with a null label or vector, or a null or non-finite component, take no
    part.  Repeated rows count one by one, and repeated anchors answer one by
    one.  Vectors of different lengths are never compared; those of no
    components score 0.  Scores beyond 64 bits are cut off at the ends.  An
    anchor without positives, or a positive without negatives, has no row; an
    empty table gives none.  Other columns may have any name.
    """
    index = VectorIndex(vectors, anchor, id_column, label_column, vector_column)
    slim = ["_key", "_label", "_vector", "_norm", "_angles", "_id"]
    anchors = index.rows.where("_anchor").select(*slim, F.lit(None).cast("array<array<bigint>>").alias("_windows"))
    first = lambda *by: Window.partitionBy(*by).orderBy(F.col("_score").desc(), F.col("_found").asc_nulls_last())
    positives = index.ask(anchors, False, count).withColumn("_place", F.row_number().over(first("_key"))).where(F.col("_place") <= count)
    positives = cut(positives.select("_key", F.col("_found").alias("_positive"), F.col("_score").alias("_positive_score"), "_place"))
    whole = F.col("_positive_score").cast("decimal(20,0)")
    # the least and greatest whole scores s with least_percent * p <= 100 * s <= most_percent * p
    least, most = F.ceil(whole * least_percent / 100).cast("long"), F.floor(whole * most_percent / 100).cast("long")
    opened = positives.where(least <= most).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_place", least.alias("least"), most.alias("most")))).alias("_all"))
    opened = opened.select(F.col("_key").alias("_of"), F.transform("_all", lambda x: F.array(x["least"], x["most"])).alias("_windows"), F.transform("_all", lambda x: x["_place"]).alias("_places"))
    asking = anchors.drop("_windows").join(opened, F.col("_key") == F.col("_of")).select(*slim, "_windows")
    found = index.ask(asking, True, count).withColumn("rank", F.row_number().over(first("_key", "_window"))).where(F.col("rank") <= count)
    found = found.join(opened.select("_of", "_places"), F.col("_key") == F.col("_of")).withColumn("_of_place", F.col("_places")[F.col("_window")]).drop("_of", "_places")
    named = anchors.select(F.col("_key").alias("_anchor_key"), F.col("_id").alias("anchor_id"))
    positives = positives.join(named, F.col("_key") == F.col("_anchor_key")).select(F.col("_key").alias("_of"), "_place", "anchor_id", F.col("_positive").alias("positive_id"), F.col("_positive_score").alias("positive_score"))
    both = found.join(positives, (F.col("_key") == F.col("_of")) & (F.col("_of_place") == F.col("_place")))
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("_found").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score"))
