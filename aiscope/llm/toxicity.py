"""Toxicity scores by weak supervision.

Voters are lexicons and patterns: a fixed word list, lexicons of words, of
prefixes and of prefixes that a text has twice, induced from a bounded sample of
labelled rows, and shape patterns.  A generative model with one hidden class
explains the votes of all documents: expectation-maximisation on the counts of
vote patterns (at most 2**voters rows) estimates each voter's accuracy.  The
class of the sampled labelled rows is known, and they weigh as much as all
others together, whatever the size of the table.  Voters that still agree within a
class are taken as correlated and share one weight.  A linear classifier is
trained on the posterior labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aiscope.llm.graph import cut
from aiscope.llm.words import LOWER, Block, blocks, mix, span_hashes, split_words

#: The most labelled rows that lexicons, and the most rows that the classifier, are fitted on.
FIT_ROWS = 20_000
#: An induced entry occurs in at least so many distinct toxic texts, and toxic texts are at least this share of its texts.
MIN_TOXIC_TEXTS, MIN_TOXIC_SHARE = 6, 0.75
PREFIXES = (4, 5, 6, 7)  # bytes
#: Prefixes that count as entries of their own where a text has two or more words with them: one such word may stand in a clean text by chance.
TWICE = (5, 6, 7)

# Fixed seed lexicon; no word that is common in another language ("die").
SEED_WORDS = "idiot idiots moron morons loser losers stupid pathetic worthless scum trash disgusting clown clowns dumb ugly garbage filthy vermin imbecile jerk bastard bitch asshole fuck fucking shit whore slut retard retarded".split()
# Fixed words of the second person, for the address pattern.
ADDRESS_WORDS = "you your youre u ur yourself".split()

STOPS = np.ones(256, dtype=bool)  # words here are runs of ASCII letters and bytes of other scripts
STOPS[65:91] = STOPS[97:123] = STOPS[128:] = False

KINDS = ("word", *[f"prefix{k}" for k in PREFIXES], *[f"twice{k}" for k in TWICE])
VOTERS = ("seed", "word", *[f"prefix{k}" for k in PREFIXES], "twice", "address", "repeated", "dense")


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    return np.sort(span_hashes(data, start, start + lengths))


SEED, ADDRESS = _hashes_of(SEED_WORDS), _hashes_of(ADDRESS_WORDS)


def _units(block: Block) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The row of each word, and for each kind of entry (rows, hashes)."""
    words = split_words(block, STOPS)
    if not len(words.start):
        empty = np.zeros(0, dtype=np.int64)
        return empty, {k: (empty, empty.astype(np.uint64)) for k in KINDS}
    data = LOWER[block.data]
    out = {"word": (words.row, span_hashes(data, words.start, words.end))}
    for size in PREFIXES:
        long = words.end - words.start > size
        start = words.start[long]
        row, value = words.row[long], span_hashes(data, start, start + size)
        out[f"prefix{size}"] = (row, value)
        if size in TWICE:
            with np.errstate(over="ignore"):
                _, place, n = np.unique(mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            again = n[place] > 1
            out[f"twice{size}"] = (row[again], value[again])
    return words.row, {k: out[k] for k in KINDS}


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (text, kind, entry) of labelled rows."""
    for block in blocks(batches, "text"):
        toxic = block.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        _, units = _units(block)
        for kind, (name, (row, value)) in enumerate(units.items()):
            pair = np.unique(np.stack((row, value.view(np.int64))), axis=1) if len(row) else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(pair.shape[1], kind, dtype=np.int32)), pa.array(pair[1]), pa.array(toxic[pair[0]].astype(np.int32))], names=["kind", "entry", "toxic"])


def induce_lexicons(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Word and prefix lexicons from ``labelled(text binary, toxic)``; equal texts count once."""
    entries = labelled.dropDuplicates(["text"]).mapInArrow(_entry_batches, "kind int, entry long, toxic int")
    share = F.col("t") / F.col("n")
    counted = entries.groupBy("kind", "entry").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    counted = counted.where((F.col("t") >= MIN_TOXIC_TEXTS) & (share >= MIN_TOXIC_SHARE)).select("kind", "entry").toArrow()  # bounded by the words of FIT_ROWS texts
    kinds, entry = counted.column("kind").to_numpy(), counted.column("entry").to_numpy().astype(np.int64).view(np.uint64)
    return {name: np.sort(entry[kinds == kind]) for kind, name in enumerate(KINDS)}


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def _marks(table: np.ndarray) -> np.ndarray:
    marks = np.zeros(1 << 16, dtype=bool)
    marks[(table >> np.uint64(48)).astype(np.int64)] = True
    return marks


def _hits(blocks_of: Iterator[Block], lexicons: dict[str, np.ndarray]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Of each block the words of its texts and the hits of each voter."""
    marks = {name: _marks(table) for name, table in lexicons.items()}

    def member(name: str, values: np.ndarray) -> np.ndarray:
        hit = marks[name][(values >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = _member(values[at], lexicons[name])
        return hit

    for block in blocks_of:
        n = block.rows.num_rows
        every, units = _units(block)
        hits = {}
        toxic_word = member("seed", units["word"][1])
        hits["seed"] = np.bincount(every[toxic_word], minlength=n)
        any_hit = toxic_word.copy()
        for name, (row, value) in units.items():
            found = member(name, value)
            hits[name] = np.bincount(row[found], minlength=n)
            if name == "word":
                any_hit |= found
        addressed = member("address", units["word"][1])
        beside = np.zeros(len(every), dtype=bool)  # a toxic word within three words after an address
        for lag in (1, 2, 3):
            beside[lag:] |= addressed[:-lag] & any_hit[lag:] & (every[lag:] == every[:-lag])
        n_words = np.bincount(every, minlength=n)
        hits["twice"] = np.max([hits.pop(f"twice{k}") for k in TWICE], axis=0)
        strongest = np.max(list(hits.values()), axis=0)
        hits["address"] = np.bincount(every[beside], minlength=n)
        hits["repeated"] = np.where(strongest >= 3, strongest, 0)
        hits["dense"] = np.where(strongest * 50 > n_words, strongest, 0)
        yield block, n_words, np.column_stack([hits[v] for v in VOTERS])


def _hit_batches(batches: Iterator[pa.RecordBatch], lexicons: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block, n_words, hits in _hits(blocks(batches, "text"), lexicons):
        yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(n_words, pa.int64()), *[pa.array(h, pa.int64()) for h in hits.T]], names=["id", "n_words", *VOTERS])


def voter_hits(docs: DataFrame, lexicons: dict[str, np.ndarray], id_column: str, text_column: str) -> DataFrame:
    """``id, n_words`` and the hits of each voter for every row."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_words long, " + ", ".join(f"{v} long" for v in VOTERS)
    return source.mapInArrow(lambda batches: _hit_batches(batches, shared.value), schema)


@dataclass
class LabelModel:
    """P(vote | class) of each voter, its share of a correlated group's weight, and P(toxic)."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    slope: float = 1.0  # of the calibration by labelled rows
    offset: float = 0.0

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        hit = np.log(self.toxic) - np.log(self.clean)
        miss = np.log1p(-self.toxic) - np.log1p(-self.clean)
        return np.log(self.prior / (1 - self.prior)) + np.where(votes, hit, miss) @ self.weight

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(votes) + self.offset, -40, 40)))

    def calibrate(self, votes: np.ndarray, known: np.ndarray) -> None:
        """Fit slope and offset to the numbers of labelled clean and toxic rows of each pattern: correlated voters share a weight, which makes odds too small."""
        x = np.column_stack([self.log_odds(votes), np.ones(len(votes))])
        n, toxic = known.sum(axis=1), known[:, 1]
        at = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            gradient = x.T @ (toxic - n * p) - 0.1 * (at - [1.0, 0.0])
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            step = np.linalg.solve(curve, gradient)
            at = at + step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = max(float(at[0]), 0.05), float(at[1])


def correlated_groups(votes: np.ndarray, counts: np.ndarray, excess: float = 1.5) -> np.ndarray:
    """The group of each voter; voters that agree more than the hidden class explains are in one.

    With one hidden class the covariance of two voters is a product of their
    strengths.  A strength is the lower quartile over triplets of voters, which
    correlated pairs can only raise; a pair whose covariance exceeds the product
    is correlated.
    """
    n, m = max(counts.sum(), 1), votes.shape[1]
    centred = votes - counts @ votes / n
    cov = (centred * counts[:, None]).T @ centred / n
    strength = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        triplets = [cov[i, j] * cov[i, k] / cov[j, k] for j in others for k in others if j < k and cov[j, k] > 1e-9]
        strength[i] = np.sqrt(max(np.quantile(triplets, 0.25) if triplets else cov[i, i], 0))
    group = np.arange(m)
    for i in range(m):
        for j in range(i):
            if cov[i, j] > excess * strength[i] * strength[j] + 3 * np.sqrt(max(cov[i, i] * cov[j, j], 0) / n):
                group[group == group[i]] = group[j]
    return group


def fit_label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60, correlated: float = 0.3, known: np.ndarray | None = None) -> LabelModel:
    """Estimate the label model from distinct vote patterns (rows of booleans) and their counts.

    ``known`` has the numbers of labelled clean and toxic rows of each pattern;
    the counts are scaled to their sum.

    Each member of a correlated group weighs one part of it.  Starts from
    voters that are right more often than not.  After a first fit, voters whose
    votes still correlate by over ``correlated`` within the toxic class join
    groups too, and the fit runs again.
    """
    m = votes.shape[1]
    if known is None or not known.sum():
        known = np.zeros((len(votes), 2))
    else:
        counts = counts * (known.sum() / max(counts.sum(), 1))
    active = counts @ votes > 0 if len(counts) else np.zeros(m, dtype=bool)  # a voter that never votes says nothing
    group = correlated_groups(votes, counts)
    model = LabelModel(float(np.clip(prior, 0.01, 0.5)), np.full(m, 0.7), np.full(m, 0.02), np.ones(m))
    n = max(counts.sum(), 1)
    for fit in range(2):
        model.weight = np.where(active, [1 / max(np.sum(active & (group == g)), 1) for g in group], 0.0)
        for _ in range(rounds):
            p = model.posterior(votes) * counts
            p, q = p + known[:, 1], counts - p + known[:, 0]
            model.toxic = np.clip((p @ votes + 1) / (p.sum() + 2), 1e-4, 1 - 1e-4)
            model.clean = np.clip((q @ votes + 0.01) / (q.sum() + 2), 1e-7, 0.5)
            model.prior = float(np.clip(p.sum() / (n + known.sum()), 1e-3, 0.5))
        if fit == 0:
            p = model.posterior(votes) * counts + known[:, 1]
            centred = votes - model.toxic
            spread = np.sqrt(np.maximum(p @ centred**2, 1e-9))
            left = (centred * p[:, None]).T @ centred / np.outer(spread, spread)
            for i in range(m):
                for j in range(i):
                    if active[i] and active[j] and abs(left[i, j]) > correlated:
                        group[group == group[i]] = group[j]
    if known.sum():
        model.calibrate(votes, known)
    return model


def _design(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Features of the linear classifier: whether and how often each voter hits, and the rate of hits."""
    top = hits.max(axis=1)
    return np.column_stack([np.minimum(hits, 1), np.log1p(hits), top / np.maximum(n_words, 1), np.ones(len(hits))])


def fit_classifier(hits: np.ndarray, n_words: np.ndarray, target: np.ndarray, penalty: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method with a ridge."""
    x = _design(hits, n_words)
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (target - p) - ridge * weights
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        weights += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _linear(weights: np.ndarray) -> Column:
    m = len(VOTERS)
    total = F.lit(float(weights[-1]))
    for i, voter in enumerate(VOTERS):
        hits = F.col(voter)
        total = total + F.least(hits, F.lit(1)) * float(weights[i]) + F.log1p(hits) * float(weights[m + i])
    return total + F.greatest(*VOTERS) / F.greatest("n_words", F.lit(1)) * float(weights[2 * m])


def remainder(id_column: Column, divisor: int) -> Column:
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(divisor))


def bounded_sample(frame: DataFrame, key: Column, rows: int, most: int) -> DataFrame:
    """At most ``most`` of a frame's ``rows`` rows, by a hash of the key; all of them where they are no more.

    The hash leaves about 95 % of the bound, so that neither a task nor the
    driver is sent more than it keeps.
    """
    if rows <= most:
        return frame
    return frame.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * 0.95 * most / rows)).limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[dict[str, np.ndarray], np.ndarray, DataFrame]:
    """Lexicons, the classifier's weights, and the voters' hits on every row, which are kept in the shared folder."""
    known = labels.select(F.col("doc_id").cast("string").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("_id"), 3) != 1))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = cut(bounded_sample(known, F.col("_id"), known.count(), FIT_ROWS))
    prior = known.agg(F.avg("toxic")).first()[0]
    source = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("binary").alias("text"))
    labelled = source.join(F.broadcast(known), F.col("id") == F.col("_id")).select("text", "toxic")  # at most FIT_ROWS labels
    lexicons = induce_lexicons(labelled) | {"seed": SEED, "address": ADDRESS}
    hits = cut(voter_hits(docs, lexicons, id_column, text_column))

    pattern = sum((F.least(v, F.lit(1)) * (1 << i) for i, v in enumerate(map(F.col, VOTERS))), F.lit(0))
    open_rows = hits.where(F.coalesce(remainder(F.col("id"), 3) != 1, F.lit(True)))
    patterns = open_rows.groupBy(pattern.alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 2**len(VOTERS) rows
    codes = patterns.column("p").to_numpy().astype(np.int64)
    counts = patterns.column("n").to_numpy().astype(np.float64)
    bits = lambda c: ((c[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    seen = hits.join(F.broadcast(known), F.col("id").cast("string") == F.col("_id")).groupBy(pattern.alias("p"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # twice as many at most
    place = {int(c): i for i, c in enumerate(codes)}
    labelled_counts = np.zeros((len(codes), 2))
    for row in seen:
        labelled_counts[place[int(row.p)], int(row.toxic > 0)] += row.n
    model = fit_label_model(bits(codes), counts, 0.1 if prior is None else prior, known=labelled_counts)

    rows = bounded_sample(open_rows, F.col("id"), int(counts.sum()), FIT_ROWS).toPandas()
    hit = rows[list(VOTERS)].to_numpy(dtype=float)
    words = rows["n_words"].to_numpy(dtype=float)
    return lexicons, fit_classifier(hit, words, model.posterior(np.minimum(hit, 1))), hits


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the voters' hits for every row.

    Only labels of rows whose crc32(id) mod 3 is not 1 are used.  Null and
    empty texts get the score of a text without hits; rows without an id are
    scored and not held out; ids may have any type.  Without any labelled toxic
    text the induced lexicons are empty and the seed words carry the model.
    Only the id and the text are read, so other columns may have any name.
    """
    _, weights, hits = fit(docs, labels, id_column, text_column)
    score = 1 / (1 + F.exp(-_linear(weights)))
    held = F.coalesce(remainder(F.col("id"), 3) == 1, F.lit(False))
    scored = hits.withColumn("score", score)
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *VOTERS)


def _clean_batches(batches: Iterator[pa.RecordBatch], text_column: str, lexicons: dict[str, np.ndarray], weights: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for block, n_words, hits in _hits(blocks(batches, text_column), lexicons):
        score = 1 / (1 + np.exp(-np.clip(_design(hits.astype(float), n_words) @ weights, -700, 700)))
        yield block.rows.filter(pa.array(score < threshold))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows predicted toxic.

    Every row is judged by its own text where it is read, so nothing is
    shuffled or joined, ids may be null or repeated and columns have any name.
    """
    lexicons, weights, _ = fit(docs, labels, id_column, text_column)
    shared = docs.sparkSession.sparkContext.broadcast((lexicons, weights))
    return docs.mapInArrow(lambda batches: _clean_batches(batches, text_column, *shared.value, threshold), docs.schema)
