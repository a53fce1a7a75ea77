"""Language-model scores from a hierarchical Pitman-Yor model of words.

Each training word that precedes another has a restaurant of its own, and so
has the beginning of a text.  All share one parent, the unigram restaurant,
whose parent is uniform over the vocabulary and one unseen word; a context that
was never seen is its parent.

Layout: pairs (context, word) are dealt to buckets by their context and kept as
packed arrays, one row for each bucket, whose number grows with the text.  The
restaurant of a frequent context is dealt out in parts, by word, so that no
bucket holds a hot context whole; its totals are broadcast.  Words with at
least one in about ``1 << SHARE`` bytes of text are broadcast with their counts
and parent probabilities; all others meet theirs by key: before each sweep
their parent's tables are drawn where the word is kept, and what its
probability follows from is sent to the buckets that hold the word with
several customers.

Seating is sampled by Gibbs, one dish of one restaurant at a time: given the
parent's probability of a word, all its customers in a restaurant are seated
anew.  Only the number of tables matters for predictions; up to ``EXACT``
customers it is drawn from its exact conditional (generalised Stirling
numbers), beyond that further customers enter in blocks by the restaurant's
own rule, with the mean and variance of the binomial.  All restaurants are
sampled side by side with the parent of the sweep before.  After each sweep the
strengths and the contexts' discount are drawn from their conditionals on a
grid, the discount by the pairs of at most ``EXACT`` customers; the parent's
discount is estimated from the words with one and two tables.  Draws depend on
context, word and sweep alone, so a task that runs again gives the same, and
which words are broadcast makes no difference.  The tables of dishes with
several customers are written after each sweep, for the next one; scoring reads
those of the samples.

The predictive probability of a token is the average over ``SAMPLES`` sweeps
after ``BURN_IN``.  Scoring: frequent pairs are broadcast and settle many tokens
where they are read.  The others are dealt to their context's bucket; words that
are not broadcast go on to their word's bucket; sums come back by document.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aiscope.llm.graph import ensure_checkpoint_dir, tidy_shuffles
from aiscope.llm.words import LOWER, Block, blocks, mix, span_hashes, split_words

#: A word or pair is broadcast if it has one in so many (2**SHARE) bytes of text, and at least two; so at most some millions are.
SHARE = 23
#: Customers of a dish up to which the number of tables is drawn exactly.
EXACT = 48
BURN_IN, SAMPLES = 2, 2
#: A context with more customers than this, or than a broadcast word must have, is dealt out in parts.
PART = 1 << 16
#: Bytes of text (2**x) for each bucket, and the least number of buckets.
BUCKET_SHARE, LEAST_BUCKETS = 25, 1024
TOP = np.uint64(1 << 63)
END, BEGIN = np.uint64(0x5E4D0F7E12D3C9B1) | TOP, np.uint64(0x1F83D9ABFB41BD6B) | TOP
#: Broadcast words have their place in the table as id, below this; other ids are hashes.
CODES = 1 << 24
CHUNK = 1 << 22  # bytes of packed rows that are worked on at once
GATHER = 1_500_000  # entries that a task gathers before it adds them up
STRENGTHS = np.geomspace(0.02, 500, 24)
DISCOUNTS = np.linspace(0.04, 0.96, 24)
_ODD = np.uint64(0xD1B54A32D192ED03)
#: Documents are summed in groups of so many (2**x) neighbours.
GROUP = 12


# --- tokens and arrays ------------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """The tokens of a block: words and one end for each text."""

    word: np.ndarray  # hashes
    before: np.ndarray  # hash of the token before, BEGIN for a text's first
    row: np.ndarray


def tokens(block: Block) -> Tokens:
    words = split_words(block)
    n, rows = len(words.start), block.rows.num_rows
    word = np.full(n + rows, END, dtype=np.uint64)
    if n:
        word[np.arange(n) + words.row] = span_hashes(LOWER[block.data], words.start, words.end) | TOP
    sizes = np.bincount(words.row, minlength=rows) + 1
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return Tokens(word, before, np.repeat(np.arange(rows), sizes))


def edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for key in keys[1:]:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def lookup(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def pick(values: np.ndarray, place: np.ndarray, default: float | np.ndarray = 0.0) -> np.ndarray:
    """Values at places, the default at -1."""
    out = np.array(np.broadcast_to(default, len(place)), dtype=float)
    found = place >= 0
    out[found] = values[place[found]]
    return out


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word + before * _ODD)


def add_up(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = edges(keys)
    return keys[first], *[np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]


def packed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """One row for each run of equal keys: the keys, and each column's values of a run as bytes."""
    first = edges(key)
    bounds = np.append(first, len(key))
    return key[first], [_binary(c, bounds) for c in columns]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def packed_runs(key: np.ndarray, before: np.ndarray, word: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The same for entries in order of key and context, with each context once, its number of entries, and the words in front."""
    head = edges(key, before)
    first = edges(key)
    runs = np.append(np.searchsorted(head, first), len(head))
    bounds = np.append(first, len(key))
    return key[first], [*coded(before[head], runs), _binary(np.diff(np.append(head, len(key))).astype(np.uint32), runs), *coded(word, bounds), *[_binary(c, bounds) for c in columns]]


def coded(ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Ids as bytes in three columns: the low and high part of places in the word table, and hashes of other words."""
    rest = ids >= CODES
    code = np.where(rest, np.uint64(CODES - 1), ids)
    before = np.concatenate(([0], np.cumsum(rest)))
    return [_binary(code.astype(np.uint16), bounds), _binary((code >> np.uint64(16)).astype(np.uint8), bounds), _binary(ids[rest], before[bounds])]


def decoded(rows: list[tuple], i: int) -> np.ndarray:
    ids = joined(rows, i, np.uint16).astype(np.uint64) | joined(rows, i + 1, np.uint8).astype(np.uint64) << np.uint64(16)
    ids[ids == CODES - 1] = joined(rows, i + 2, np.uint64)
    return ids


def place_of(ids: np.ndarray) -> np.ndarray:
    """The place in the word table, -1 for other words."""
    return np.where(ids < CODES, ids, np.uint64(CODES)).astype(np.int64) % CODES - (ids >= CODES)


def grouped(batches: Iterator[pa.RecordBatch], key: str, least: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """Rows in order of a key, as the key and its rows; with ``least``, those of several keys up to so many bytes, as the last key and their rows."""
    now, rows, size = None, [], 0
    for part in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # a batch may hold tens of MB
        columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
        at = part.schema.get_field_index(key)
        for row in zip(*columns):
            if row[at] != now:
                if rows and size >= least:
                    yield now, rows
                    rows, size = [], 0
                now = row[at]
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
    if rows:
        yield now, rows


def joined(rows: list[tuple], i: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[i] for r in rows if r[i] is not None), dtype=kind)


def _batch(names: str, *columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _nothing(n: int) -> pa.Array:
    return pa.nulls(n, pa.binary())


# --- counting ---------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """What tasks share about the training text."""

    n: int
    vocabulary: int
    buckets: int
    words: np.ndarray  # broadcast words, sorted
    counts: np.ndarray
    split: np.ndarray  # contexts that are dealt out in parts, sorted
    parts: np.ndarray
    customers: np.ndarray  # of these contexts

    @property
    def uniform(self) -> float:
        return 1 / (self.vocabulary + 1)

    def ids(self, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and of their contexts."""
        word, of = np.unique(found.word, return_inverse=True)
        place = lookup(word, self.words)
        word = np.where(place >= 0, place.astype(np.uint64), word)[of]
        begins = found.before == BEGIN
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[begins] = BEGIN
        return word, before

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """The hashes of ids."""
        out = ids.copy()
        known = ids < CODES
        out[known] = self.words[ids[known]]
        return out

    def bucket(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bucket of each pair, by the context's part that the word belongs to."""
        key = before
        place = lookup(before, self.split)
        if (place >= 0).any():
            parts = pick(self.parts, place, 1).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = before + mix(word + np.uint64(3)) % parts * _ODD
        return (mix(key + np.uint64(11)) % np.uint64(self.buckets)).astype(np.int64)


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)


WORD_ROWS = "bucket long, ws binary, cs binary"


def _count_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        word, c = add_up(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        held.clear()
        bucket = word_bucket(word, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, columns = packed(bucket[order], word[order], c[order])
        return _batch("bucket ws cs", keys, *columns)

    for block in blocks(batches, "text"):
        held.append(np.unique(tokens(block).word, return_counts=True))
        if sum(len(x[0]) for x in held) > GATHER:
            yield out()
    if held:
        yield out()


def _frequent_word_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts by bucket to a task's tokens and distinct words, and its words with at least ``least``."""
    n, v, words, counts = 0, 0, [], []
    for _, rows in grouped(batches, "bucket", CHUNK):
        word, c = add_up(joined(rows, 1, np.uint64), joined(rows, 2, np.int64))
        n, v = n + int(c.sum()), v + len(c)
        words.append(word[c >= least])
        counts.append(c[c >= least])
    if n:
        yield _batch("n v ws cs", [n], [v], [np.concatenate(words).tobytes()], [np.concatenate(counts).tobytes()])


PAIR_NAMES = "bucket ul uh ur lens wl wh wr cs"
PAIR_ROWS = "bucket long, ul binary, uh binary, ur binary, lens binary, wl binary, wh binary, wr binary, cs binary"


def _pair_batches(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def add(before: np.ndarray, word: np.ndarray, c: np.ndarray) -> None:
        pair = pair_hash(before, word)
        order = np.argsort(pair, kind="stable")
        first = edges(pair[order])
        held.append((before[order[first]], word[order[first]], np.add.reduceat(c[order], first)))

    def gather() -> None:
        parts = [np.concatenate([x[i] for x in held]) for i in range(3)]
        held.clear()
        add(*parts)

    def out() -> pa.RecordBatch:
        gather()
        before, word, c = held.pop()
        bucket = layout.bucket(before, word)
        order = np.lexsort((word, before, bucket))
        keys, columns = packed_runs(bucket[order], before[order], word[order], c[order])
        return _batch(PAIR_NAMES, keys, *columns)

    for block in blocks(batches, "text"):
        word, before = layout.ids(tokens(block))
        add(before, word, np.ones(len(word), dtype=np.int64))
        if sum(len(x[0]) for x in held) > GATHER:
            gather()
            if len(held[0][0]) > GATHER // 2:
                yield out()
    if held:
        yield out()


def _restaurant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of their bucket to one row for each bucket."""
    for bucket, rows in grouped(batches, "bucket"):
        before = np.repeat(decoded(rows, 1), joined(rows, 4, np.uint32))
        word, c = decoded(rows, 5), joined(rows, 8, np.int64)
        order = np.lexsort((word, before))
        before, word = before[order], word[order]
        first = edges(before, word)
        c = np.add.reduceat(c[order], first)
        _, columns = packed_runs(np.zeros(len(first), dtype=np.int64), before[first], word[first], c)
        yield _batch(PAIR_NAMES, [bucket], *columns)


DISH_ROWS = "bucket long, ws binary, cs binary, ts binary"


def _dish_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Restaurants to the count of each word and the number of contexts that serve it, of a task."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        word, c, t = add_up(*[np.concatenate([x[i] for x in held]) for i in range(3)])
        held.clear()
        bucket = word_bucket(word, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, columns = packed(bucket[order], word[order], c[order], t[order])
        return _batch("bucket ws cs ts", keys, *columns)

    for _, rows in grouped(batches, "bucket", CHUNK):
        word, c = decoded(rows, 5), joined(rows, 8, np.int64)
        held.append(add_up(word, c, np.ones(len(word), dtype=np.int64)))
        if sum(len(x[0]) for x in held) > GATHER:
            yield out()
    if held:
        yield out()


def _wanted_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Restaurants to the buckets that hold a word that is not broadcast with several customers, by word."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        word, at = (np.concatenate([x[i] for x in held]) for i in range(2))
        held.clear()
        bucket = word_bucket(word, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, columns = packed(bucket[order], word[order], at[order])
        return _batch("bucket ws xs", keys, *columns)

    for _, rows in grouped(batches, "bucket", CHUNK):
        word, c = decoded(rows, 5), joined(rows, 8, np.int64)
        at = np.repeat(np.array([r[0] for r in rows], dtype=np.uint32), [len(r[8]) // 8 for r in rows])
        some = (c >= 2) & (word >= CODES)
        word, at = word[some], at[some]
        order = np.lexsort((at, word))
        first = edges(word[order], at[order])
        held.append((word[order[first]], at[order[first]]))
        if sum(len(x[0]) for x in held) > GATHER:
            yield out()
    if held:
        yield out()


def _merged_dish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in grouped(batches, "bucket"):
        found = add_up(joined(rows, 1, np.uint64), joined(rows, 2, np.int64), joined(rows, 3, np.int64))
        yield _batch("bucket ws cs ts", [bucket], *packed(np.zeros(len(found[0]), dtype=np.int64), *found)[1])


# --- seating ----------------------------------------------------------------


@lru_cache(maxsize=64)
def log_stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """log S_d(c, t), generalised Stirling numbers of the Pitman-Yor seating."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(1, size + 1):
        for t in range(1, c + 1):
            stay = table[c - 1, t] + math.log(c - 1 - discount * t) if c - 1 >= t and c - 1 - discount * t > 0 else -np.inf
            table[c, t] = np.logaddexp(table[c - 1, t - 1], stay)
    return table


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers."""
    low = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_opened(strength: float, discount: float, tables: np.ndarray) -> np.ndarray:
    """log of strength (strength + discount) … for so many tables."""
    ratio = np.float64(strength / discount)
    return tables * math.log(discount) + log_gamma(ratio + tables) - log_gamma(np.asarray(ratio))


def log_entered(strength: float, customers: np.ndarray) -> np.ndarray:
    """log of strength (strength + 1) … for so many customers."""
    return log_gamma(np.float64(strength) + customers) - log_gamma(np.asarray(np.float64(strength)))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each key and draw."""
    with np.errstate(over="ignore"):
        bits = mix(keys + np.uint64(draw * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, keys: np.ndarray, draw: int) -> np.ndarray:
    """Draw the number of tables of each dish; ``mass`` is the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    stirling = log_stirling(discount)
    shares = uniform(keys, draw)
    several = np.flatnonzero(customers >= 2)
    sizes = np.minimum(customers[several], EXACT)
    order = np.argsort(sizes, kind="stable")
    several, sizes = several[order], sizes[order]
    first = edges(sizes)
    for low, high in zip(first.tolist(), np.append(first[1:], len(sizes)).tolist()):
        size = int(sizes[low])
        steps = np.arange(1, size + 1)
        for at in range(low, high, 100_000):
            part = several[at : min(at + 100_000, high)]
            logs = stirling[size, 1 : size + 1] + steps * np.log(np.maximum(mass[part], 1e-300))[:, None]
            logs -= logs.max(axis=1, keepdims=True)
            total = np.cumsum(np.exp(logs), axis=1)
            tables[part] = 1 + (total < shares[part, None] * total[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        seated, t = np.full(len(many), float(EXACT)), tables[many].astype(float)
        target, weight, step = customers[many].astype(float), mass[many], 1
        while (seated < target).any():
            block = np.minimum(np.ceil(seated * 0.1), target - seated)
            p = weight / (weight + seated - discount * t)
            noise = uniform(keys[many], draw + 7919 * step) - 0.5
            more = block * p + noise * np.sqrt(12 * block * p * (1 - p))  # mean and variance of the binomial
            t += np.clip(more, 0, block)
            seated += block
            step += 1
        tables[many] = np.maximum(np.rint(t), 1)
    return tables


@dataclass(frozen=True)
class Parent:
    """The unigram restaurant: customers are the contexts' tables."""

    strength: float
    discount: float
    customers: float
    tables: float
    uniform: float
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0))  # P of each broadcast word

    @property
    def new(self) -> float:
        return (self.strength + self.discount * self.tables) * self.uniform

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return self.by_own(customers - self.discount * tables)

    def by_own(self, own: np.ndarray) -> np.ndarray:
        """The probability of words by their customers less the discount of their tables."""
        return (own + self.new) / (self.strength + self.customers)

    @property
    def unseen(self) -> float:
        return self.new / (self.strength + self.customers)


@dataclass(frozen=True)
class Step:
    """A sweep over the contexts' restaurants, and what came out of it."""

    strength: float
    discount: float
    parent: Parent  # as the sweep found it
    tables: np.ndarray  # of contexts dealt out in parts, as the sweep found them
    after: Parent | None = None
    tables_after: np.ndarray | None = None


@dataclass
class Restaurants:
    """A bucket: contexts with their runs of words and counts, in order."""

    us: np.ndarray
    lens: np.ndarray
    ws: np.ndarray
    cs: np.ndarray

    def __post_init__(self) -> None:
        self.of = np.repeat(np.arange(len(self.us)), self.lens)

    def totals(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """The customers of each context, and its place among those dealt out in parts."""
        place = lookup(self.us, layout.split)
        own = np.bincount(self.of, self.cs, minlength=len(self.us))
        return pick(layout.customers, place, own), place


def restaurants(rows: list[tuple], at: int = 1) -> Restaurants:
    return Restaurants(decoded(rows, at), joined(rows, at + 3, np.uint32).astype(np.int64), decoded(rows, at + 4), joined(rows, at + 7, np.int64))


def seatings(found: Restaurants, layout: Layout, steps: list[Step], number: int = 0, tables: np.ndarray | None = None, own: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tables of each pair, and of each context, after each step.

    ``number`` is that of the first step and ``tables`` the contexts' before it;
    ``own`` are the words that are not broadcast, sorted, and what
    :meth:`Parent.by_own` takes.
    """
    _, place = found.totals(layout)
    split = place >= 0
    several = np.flatnonzero(found.cs >= 2)
    word = place_of(found.ws[several])
    of = found.of[several]
    keys = pair_hash(layout.hashes(found.us)[of], layout.hashes(found.ws[several]))
    rest = np.flatnonzero(word < 0)
    if len(rest):
        at = lookup(found.ws[several[rest]], own[0])
        if (at < 0).any():
            raise ValueError("a word without its parent's tables")
    tables, out = found.lens.astype(float) if tables is None else tables, []
    for k, step in enumerate(steps, number):
        tables = np.where(split, pick(step.tables, place), tables)
        probability = pick(step.parent.seen, word)
        if len(rest):
            probability[rest] = step.parent.by_own(own[1][at].astype(float)).astype(np.float32)
        mass = (step.strength + step.discount * tables[of]) * probability
        t = np.ones(len(found.cs), dtype=np.int64)
        t[several] = seat(found.cs[several], mass, step.discount, keys, 2 * k)
        tables = np.bincount(found.of, t, minlength=len(found.us))
        after = tables if step.tables_after is None else np.where(split, pick(step.tables_after, place), tables)
        out.append((t, after))
    return out


def seated(found: Restaurants, stored: np.ndarray) -> np.ndarray:
    """Tables of each pair from those that are stored, of pairs with several customers."""
    t = np.ones(len(found.cs), dtype=np.int64)
    t[found.cs >= 2] = stored
    return t


#: What a sweep sends: tables beyond the first of each pair by broadcast word (0) and by other word (1), tables of contexts in parts (2), statistics (3),
#: tables of a bucket's pairs with several customers (4); and what it is given of words that are not broadcast: :meth:`Parent.by_own` (5), all their tables (6).
SWEEP_ROWS = "kind int, bucket long, ws binary, es binary"
MORE, MORE_REST, IN_PARTS, STATISTICS, TABLES, OWN, ROOTS = range(7)
#: What a sweep reads of a bucket: its restaurants (``RESTAURANT``), tables of the sweep before (``SAMPLED``), and words' ``OWN``.
SEAT_ROWS = f"{PAIR_ROWS}, kind int, base long, ws binary, es binary"
RESTAURANT, TOKEN, SUMS, SAMPLED = range(4)


def to_seat(restaurants: DataFrame, tables: list[DataFrame], own: DataFrame | None = None) -> DataFrame:
    """Rows of ``SEAT_ROWS`` in order of bucket."""
    nothing, number = F.lit(None).cast("binary"), lambda n: F.lit(n).cast("long").alias("base")
    names = PAIR_NAMES.split()[1:]
    rows = restaurants.select("bucket", *names, F.lit(RESTAURANT).alias("kind"), number(0), nothing.alias("ws"), nothing.alias("es"))
    for i, swept in enumerate(tables):
        rows = rows.unionByName(swept.where(F.col("kind") == TABLES).select("bucket", *[nothing.alias(c) for c in names], F.lit(SAMPLED).alias("kind"), number(i), nothing.alias("ws"), "es"))
    if own is not None:
        rows = rows.unionByName(own.where(F.col("kind") == OWN).select("bucket", *[nothing.alias(c) for c in names], "kind", number(0), "ws", "es"))
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _own_batches(batches: Iterator[pa.RecordBatch], buckets: int, mass: float, discount: float, draw: int) -> Iterator[pa.RecordBatch]:
    """Words that are not broadcast: tables (kind 0) with those beyond the first of each pair (2), sent to the buckets that want them (1)."""
    held: list[tuple[np.ndarray, ...]] = []
    roots = 0.0

    def out() -> pa.RecordBatch:
        at, word, own = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        order = np.argsort(at, kind="stable")
        keys, columns = packed(at[order].astype(np.int64), word[order], own[order])
        return _batch("kind bucket ws es", pa.array(np.full(len(keys), OWN), pa.int32()), keys, *columns)

    for _, rows in grouped(batches, "bucket", CHUNK):
        of = lambda kind, rows=rows: [r for r in rows if r[1] == kind]
        word, t = joined(of(0), 2, np.uint64), joined(of(0), 3, np.int64)
        word, t = word[word >= CODES], t[word >= CODES]
        order = np.argsort(word)
        word, t = word[order], t[order]
        np.add.at(t, lookup(joined(of(2), 2, np.uint64), word), joined(of(2), 3, np.int64))
        s = root_tables(word, t, mass, discount, draw)
        roots += float(s.sum())
        wanted = joined(of(1), 2, np.uint64)
        if len(wanted):
            held.append((joined(of(1), 3, np.uint32), wanted, (t - discount * s).astype(np.float32)[lookup(wanted, word)]))
        if sum(len(x[0]) for x in held) > GATHER:
            yield out()
    if held:
        yield out()
    yield _batch("kind bucket ws es", pa.array([ROOTS], pa.int32()), [0], [b""], [np.float64(roots).tobytes()])


def _sweep_batches(batches: Iterator[pa.RecordBatch], layout: Layout, step: Step, number: int) -> Iterator[pa.RecordBatch]:
    stirling = np.stack([log_stirling(float(d)) for d in DISCOUNTS])
    statistics = np.zeros(len(STRENGTHS) + len(DISCOUNTS) + 1)
    words, parts, wholes, own, dealt = [], [], [], [], []
    for _, rows in grouped(batches, "bucket", CHUNK):
        mine = [r for r in rows if r[9] == RESTAURANT]
        found = restaurants(mine)
        customers, place = found.totals(layout)
        before = None
        if number:
            before = np.bincount(found.of, seated(found, joined([r for r in rows if r[9] == SAMPLED], 12, np.uint32)), minlength=len(found.us))
        sent = [r for r in rows if r[9] == OWN]
        word, first = np.unique(joined(sent, 11, np.uint64), return_index=True)
        ((t, tables),) = seatings(found, layout, [step], number, before, (word, joined(sent, 12, np.float32)[first]))
        several = np.flatnonzero(found.cs >= 2)
        bounds = np.searchsorted(several, np.cumsum([0, *(len(r[8]) // 8 for r in mine)]))
        m = len(mine)
        yield _batch("kind bucket ws es", pa.array(np.full(m, TABLES), pa.int32()), [r[0] for r in mine], pa.array([b""] * m, pa.binary()), _binary(t[several].astype(np.uint32), bounds))
        more = np.flatnonzero(t > 1)
        words.append(add_up(found.ws[more], t[more] - 1))
        parts.append(add_up(place[place >= 0], tables[place >= 0].astype(np.int64)))
        few = np.flatnonzero((found.cs >= 2) & (found.cs <= EXACT))
        for held, values in ((wholes, customers[place < 0]), (own, tables[place < 0]), (dealt, found.cs[few] * (EXACT + 1) + t[few])):
            held.append(add_up(values, np.ones(len(values), dtype=np.int64)))
        statistics[-1] += (t[more] - 1).sum()
    if not words:
        return
    (c, nc), (o, no), (pair, np_) = (add_up(*[np.concatenate([x[i] for x in held]) for i in range(2)]) for held in (wholes, own, dealt))
    statistics[: len(STRENGTHS)] = [(log_opened(s, step.discount, o) * no).sum() - (log_entered(s, c) * nc).sum() for s in STRENGTHS]
    by_discount = (stirling[:, pair // (EXACT + 1), pair % (EXACT + 1)] * np_).sum(axis=1)
    statistics[len(STRENGTHS) : -1] = by_discount + [(log_opened(step.strength, d, o) * no).sum() for d in DISCOUNTS]
    word, more = add_up(*[np.concatenate([x[i] for x in words]) for i in range(2)])
    place = place_of(word)
    kind = np.where(place >= 0, MORE, MORE_REST)
    value = np.where(place >= 0, place.astype(np.uint64), word)
    bucket = np.where(place >= 0, place >> 12, word_bucket(word, layout.buckets))
    order = np.lexsort((bucket, kind))
    keys, columns = packed((kind * (1 << 40) + bucket)[order], value[order], more[order])
    yield _batch("kind bucket ws es", pa.array(keys >> 40, pa.int32()), keys & ((1 << 40) - 1), *columns)
    at, tables = add_up(*[np.concatenate([x[i] for x in parts]) for i in range(2)])
    keys, columns = packed(at >> 12, at.astype(np.uint64), tables)
    yield _batch("kind bucket ws es", pa.array(np.full(len(keys), IN_PARTS), pa.int32()), keys, *columns)
    yield _batch("kind bucket ws es", pa.array([STATISTICS], pa.int32()), [0], [b""], [statistics.tobytes()])


def _merged_sweep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key = batch.column("kind").to_numpy().astype(np.int64) * (1 << 40) + batch.column("bucket").to_numpy()
            yield batch.append_column("key", pa.array(key))


def _summed_sweep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(_merged_sweep_batches(batches), "key"):
        kind, bucket = rows[0][:2]
        if kind == STATISTICS:
            columns = [pa.array([b""], pa.binary()), pa.array([np.sum([np.frombuffer(r[3]) for r in rows], axis=0).tobytes()], pa.binary())]
        elif kind == TABLES:
            columns = [pa.array([b""], pa.binary()), pa.array([rows[0][3]], pa.binary())]
        else:
            found = add_up(joined(rows, 2, np.uint64), joined(rows, 3, np.int64))
            columns = packed(np.zeros(len(found[0]), dtype=np.int64), *found)[1]
        if len(columns[0]):
            yield _batch("kind bucket ws es", pa.array([kind], pa.int32()), [bucket], *columns)


def _seen_dish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's words: those with one and two tables, all tables, and the broadcast words' own tables."""
    sums, places, tables = np.zeros(3), [], []
    for _, rows in grouped(batches, "bucket", CHUNK):
        place, t = place_of(joined(rows, 1, np.uint64)), joined(rows, 3, np.int64)
        sums += (t == 1).sum(), (t == 2).sum(), t.sum()
        places.append(place[place >= 0])
        tables.append(t[place >= 0])
    if places:
        yield _batch("sums ps ts", [sums.tobytes()], [np.concatenate(places).tobytes()], [np.concatenate(tables).tobytes()])


def root_tables(word: np.ndarray, customers: np.ndarray, mass: float, discount: float, draw: int = 1) -> np.ndarray:
    return seat(customers, np.full(len(word), mass), discount, mix(word + np.uint64(77)), draw)


# --- training ---------------------------------------------------------------


@dataclass
class Model:
    layout: Layout
    steps: list[Step]
    restaurants: DataFrame  # PAIR_ROWS, a row for each bucket
    dishes: DataFrame  # DISH_ROWS, a row for each bucket
    more: list[DataFrame]  # SWEEP_ROWS of kind MORE_REST for each sample
    tables: list[DataFrame]  # SWEEP_ROWS of kind TABLES for each sample
    root_mass: float  # of a new table of a word that is not broadcast

    @property
    def samples(self) -> list[Step]:
        return self.steps[-SAMPLES:]


def _drawn(grid: np.ndarray, log_weights: np.ndarray, rng: np.random.Generator) -> float:
    weights = np.exp(log_weights - log_weights.max())
    return float(grid[np.searchsorted(np.cumsum(weights), rng.random() * weights.sum())])


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fit(texts: DataFrame, seed: int = 7) -> Model:
    """Train on ``texts(text binary)``; all counts cover all rows, and are written to the shared folder."""
    spark = texts.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/words-{uuid.uuid4().hex}"

    def kept(frame: DataFrame, name: str) -> DataFrame:
        with tidy_shuffles(spark):
            frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def dealt(frame: DataFrame, *by: str) -> DataFrame:
        return frame.repartition(*by).sortWithinPartitions(*by)

    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets, least = max(LEAST_BUCKETS, size >> BUCKET_SHARE), max(2, size >> SHARE)
    counted = dealt(texts.mapInArrow(lambda batches: _count_batches(batches, buckets), WORD_ROWS), "bucket")
    found = counted.mapInArrow(lambda batches: _frequent_word_batches(batches, least), "n long, v long, ws binary, cs binary").collect()  # a row a task, and at most some millions of words
    words, counts = joined(found, 2, np.uint64), joined(found, 3, np.int64)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    limit = max(PART, least)
    in_parts = np.flatnonzero((counts > limit) & (words != END))
    split, customers = in_parts.astype(np.uint64), counts[in_parts]
    n_texts = int(counts[words == END].sum())
    if n_texts > limit:
        split, customers = np.append(split, BEGIN), np.append(customers, n_texts)
    order = np.argsort(split)
    split, customers = split[order], customers[order]
    layout = Layout(sum(r[0] for r in found), sum(r[1] for r in found), buckets, words, counts, split, -(-customers // limit), customers)
    shared = spark.sparkContext.broadcast(layout)

    pairs = dealt(texts.mapInArrow(lambda batches: _pair_batches(batches, shared.value), PAIR_ROWS), "bucket")
    tables = kept(pairs.mapInArrow(_restaurant_batches, PAIR_ROWS), "restaurants")
    dishes = dealt(tables.mapInArrow(lambda batches: _dish_batches(batches, buckets), DISH_ROWS), "bucket")
    dishes = kept(dishes.mapInArrow(_merged_dish_batches, DISH_ROWS), "dishes")

    wanted = dealt(tables.mapInArrow(lambda batches: _wanted_batches(batches, buckets), "bucket long, ws binary, xs binary"), "bucket")
    wanted = kept(wanted, "wanted")

    rows = dishes.mapInArrow(_seen_dish_batches, "sums binary, ps binary, ts binary").collect()  # a row a task
    first = np.ones(len(words), dtype=np.int64)
    first[joined(rows, 1, np.int64)] = joined(rows, 2, np.int64)
    sums = np.sum([np.frombuffer(r[0]) for r in rows], axis=0) if rows else np.zeros(3)
    root_discount = round(float(np.clip(sums[0] / max(sums[0] + 2 * sums[1], 1), 0.1, 0.95)), 3)
    root_mass = (1.0 + root_discount * layout.vocabulary) * layout.uniform
    rng = np.random.default_rng(seed)

    def rest(k: int, swept: DataFrame | None) -> tuple[DataFrame, float]:
        """What sweep ``k`` is given of words that are not broadcast, and all their tables in the parent's parent."""
        rows = dishes.select("bucket", F.lit(0).alias("kind"), "ws", F.col("ts").alias("xs"))
        if k < BURN_IN + SAMPLES:
            rows = rows.unionByName(wanted.select("bucket", F.lit(1).alias("kind"), "ws", "xs"))
        if swept is not None:
            rows = rows.unionByName(swept.where(F.col("kind") == MORE_REST).select("bucket", F.lit(2).alias("kind"), "ws", F.col("es").alias("xs")))
        made = dealt(rows, "bucket").mapInArrow(lambda batches: _own_batches(batches, buckets, root_mass, root_discount, 2 * k + 1), SWEEP_ROWS)
        found = kept(made, f"rest-{k}")
        return found, sum(float(np.frombuffer(r.es)[0]) for r in found.where(F.col("kind") == ROOTS).collect())  # a row a task

    def parent(more: np.ndarray, all_more: float, rest_roots: float, strength: float, draw: int) -> Parent:
        t = first + more
        s = root_tables(words, t, root_mass, root_discount, draw)
        bare = Parent(strength, root_discount, float(sums[2] + all_more), float(s.sum() + rest_roots), layout.uniform)
        log_weights = np.array([log_opened(x, root_discount, np.float64(bare.tables)) - log_entered(x, np.float64(bare.customers)) for x in STRENGTHS])
        bare = Parent(_drawn(STRENGTHS, log_weights, rng), root_discount, bare.customers, bare.tables, layout.uniform)
        return Parent(bare.strength, root_discount, bare.customers, bare.tables, layout.uniform, bare.probability(t, s).astype(np.float32))

    own, rest_roots = rest(0, None)
    now, strength, discount = parent(np.zeros(len(words), dtype=np.int64), 0.0, rest_roots, 1.0, 1), 1.0, float(DISCOUNTS[15])
    split_tables = np.zeros(len(split))
    if len(split):
        rows = tables.mapInArrow(lambda batches: _split_batches(batches, shared.value), "ps binary, ts binary").collect()
        split_tables = np.bincount(joined(rows, 0, np.int64), joined(rows, 1, np.int64), minlength=len(split)).astype(float)
    steps: list[Step] = []
    sweeps: list[DataFrame] = []
    for k in range(BURN_IN + SAMPLES):
        steps.append(Step(strength, discount, now, split_tables))
        sent = spark.sparkContext.broadcast((layout, steps[-1], k))
        made = dealt(to_seat(tables, sweeps[-1:], own).mapInArrow(lambda batches, sent=sent: _sweep_batches(batches, *sent.value), SWEEP_ROWS), "kind", "bucket")
        swept = kept(made.mapInArrow(_summed_sweep_batches, SWEEP_ROWS), f"sweep-{k}")
        sweeps.append(swept)
        sent.unpersist()
        rows = swept.where(F.col("kind").isin(MORE, IN_PARTS, STATISTICS)).collect()  # bounded by the broadcast words and contexts
        part = lambda kind, rows=rows: [r for r in rows if r[0] == kind]
        more = np.zeros(len(words), dtype=np.int64)
        more[joined(part(MORE), 2, np.uint64).astype(np.int64)] = joined(part(MORE), 3, np.int64)
        split_tables = np.zeros(len(split))
        split_tables[joined(part(IN_PARTS), 2, np.uint64).astype(np.int64)] = joined(part(IN_PARTS), 3, np.int64)
        statistics = np.sum([np.frombuffer(r[3]) for r in part(STATISTICS)] or [np.zeros(len(STRENGTHS) + len(DISCOUNTS) + 1)], axis=0)
        _drop(spark, f"{folder}/rest-{k}")
        if 0 < k <= BURN_IN:
            _drop(spark, f"{folder}/sweep-{k - 1}")
        own, rest_roots = rest(k + 1, swept)
        now = parent(more, float(statistics[-1]), rest_roots, now.strength, 2 * k + 3)
        steps[-1] = Step(strength, discount, steps[-1].parent, steps[-1].tables, now, split_tables)
        of_split = lambda s, d: float((log_opened(s, d, split_tables)).sum())  # noqa: E731, B023
        by_strength = statistics[: len(STRENGTHS)] + [of_split(s, discount) - float(log_entered(s, customers).sum()) for s in STRENGTHS]
        by_discount = statistics[len(STRENGTHS) : -1] + [of_split(strength, d) for d in DISCOUNTS]
        strength, discount = _drawn(STRENGTHS, by_strength, rng), _drawn(DISCOUNTS, by_discount, rng)
    for name in ("wanted", f"rest-{BURN_IN + SAMPLES}"):
        _drop(spark, f"{folder}/{name}")
    return Model(layout, steps, tables, dishes, *[[x.where(F.col("kind") == kind) for x in sweeps[-SAMPLES:]] for kind in (MORE_REST, TABLES)], root_mass)


def _split_batches(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """The words served in each context that is dealt out in parts, of a task."""
    sums = np.zeros(len(layout.split), dtype=np.int64)
    for _, rows in grouped(batches, "bucket", CHUNK):
        place = lookup(decoded(rows, 1), layout.split)
        np.add.at(sums, place[place >= 0], joined(rows, 4, np.uint32)[place >= 0].astype(np.int64))
    some = np.flatnonzero(sums)
    yield _batch("ps ts", [some.tobytes()], [sums[some].tobytes()])


# --- scoring ----------------------------------------------------------------


def sampled(found: Restaurants, layout: Layout, samples: list[Step], stored: list[np.ndarray]) -> list[tuple[Step, np.ndarray, np.ndarray]]:
    """Each sample with its tables of each pair and of each context."""
    _, place = found.totals(layout)
    out = []
    for step, part in zip(samples, stored):
        t = seated(found, part)
        out.append((step, t, pick(step.tables_after, place, np.bincount(found.of, t, minlength=len(found.us)))))
    return out


def _frequent_pair_batches(batches: Iterator[pa.RecordBatch], layout: Layout, samples: list[Step], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of broadcast words with at least ``least`` customers and their average predictive probabilities, of a task."""
    pairs, values = [], []
    for _, rows in grouped(batches, "bucket", CHUNK):
        found = restaurants([r for r in rows if r[9] == RESTAURANT])
        often = np.flatnonzero((found.cs >= least) & (found.ws < CODES))
        if not len(often):
            continue
        customers, _ = found.totals(layout)
        of = found.of[often]
        word = place_of(found.ws[often])
        p = np.zeros(len(often))
        stored = [joined([r for r in rows if r[9] == SAMPLED and r[10] == i], 12, np.uint32) for i in range(SAMPLES)]
        for step, t, tables in sampled(found, layout, samples, stored):
            whole = step.strength + customers[of]
            p += ((found.cs[often] - step.discount * t[often]) + (step.strength + step.discount * tables[of]) * step.after.seen[word]) / whole / SAMPLES
        pairs.append(pair_hash(found.us[of], found.ws[often]))
        values.append(np.log10(p))
    if pairs:
        yield _batch("ps vs", [np.concatenate(pairs).tobytes()], [np.concatenate(values).astype(np.float32).tobytes()])


SETTLED_KIND = np.dtype([("doc", np.int64), ("id", np.int64), ("n", np.int64), ("known", np.int64), ("base", np.float64), ("score", np.float64)])
#: By bucket: restaurants (0), tokens (1) as runs of contexts with words, numbers and documents from ``base`` on in two parts, documents' settled sums (2) and tables (3) of sample ``base`` in ``cs``.
MEET_NAMES = "bucket kind base ul uh ur lens wl wh wr cs docs more"
MEET_ROWS = "bucket long, kind int, base long, ul binary, uh binary, ur binary, lens binary, wl binary, wh binary, wr binary, cs binary, docs binary, more binary"
#: By twice a document group, or twice a word bucket and one: words (0) with counts and tables, more tables (1) of sample ``base``, tokens (2) with shares, documents' scores (3) and settled sums (4).
PART_ROWS = "k long, kind int, base long, ws binary, cs binary, docs binary, x binary"
WORD, MORE_TABLES, REST_TOKEN, SCORE, WHOLE = range(5)


def _base(counts: np.ndarray, layout: Layout) -> np.ndarray:
    return np.log10((counts + 0.1) / (layout.n + 0.1 * (layout.vocabulary + 1)))


def _token_batches(batches: Iterator[pa.RecordBatch], layout: Layout, often: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    pairs, log_p = often
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        before, word, doc, n = (np.concatenate([x[i] for x in held]) for i in range(4))
        held.clear()
        bucket = layout.bucket(before, word)
        order = np.lexsort((before, bucket))
        base = int(doc.min())
        offset = (doc - base)[order].astype(np.uint32)
        keys, columns = packed_runs(bucket[order], before[order], word[order], n[order], offset.astype(np.uint16), (offset >> np.uint32(16)).astype(np.uint16))
        m = len(keys)
        return _batch(MEET_NAMES, keys, pa.array(np.full(m, TOKEN), pa.int32()), np.full(m, base), *columns)

    for block in blocks(batches, "text"):
        found = tokens(block)
        rows = block.rows.num_rows
        doc = block.column("doc").to_numpy()
        word, before = layout.ids(found)
        place = place_of(word)
        sums = np.zeros(rows, dtype=SETTLED_KIND)
        sums["doc"], sums["id"] = doc, block.column("id").fill_null(0).to_numpy()
        sums["n"] = np.bincount(found.row, minlength=rows)
        sums["known"] = np.bincount(found.row, place >= 0, minlength=rows)
        sums["base"] = np.bincount(found.row, np.where(place >= 0, _base(pick(layout.counts, place), layout), 0), minlength=rows)
        pair, which, back = np.unique(pair_hash(before, word), return_index=True, return_inverse=True)
        at = lookup(pair, pairs)
        sums["score"] = np.bincount(found.row, pick(log_p, at)[back], minlength=rows)
        rest = np.flatnonzero((at < 0)[back])
        if len(rest):
            code, n = np.unique(back[rest] * np.int64(rows) + found.row[rest], return_counts=True)
            one = which[code // rows]
            held.append((before[one], word[one], doc[code % rows], n))
        spread = mix(doc[:1].view(np.uint64)) % np.uint64(layout.buckets)
        yield _batch(MEET_NAMES, spread.astype(np.int64), pa.array([SUMS], pa.int32()), [0], *[_nothing(1)] * 7, [sums.tobytes()], _nothing(1), _nothing(1))
        if sum(len(x[0]) for x in held) > GATHER:
            yield out()
    if held:
        yield out()


class _Scores:
    """Scores of documents, added up and sent by groups of documents."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        self.held.append((doc, score))

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in self.held) <= least:
            return
        doc, score = add_up(*[np.concatenate([x[i] for x in self.held]) for i in range(2)])
        self.held = []
        keys, (low, values) = packed(doc >> GROUP, (doc & ((1 << GROUP) - 1)).astype(np.uint16), score.astype(np.float32))
        m = len(keys)
        yield _batch("k kind base ws cs docs x", keys * 2, pa.array(np.full(m, SCORE), pa.int32()), np.zeros(m, dtype=np.int64), _nothing(m), _nothing(m), low, values)


def _meet_batches(batches: Iterator[pa.RecordBatch], layout: Layout, samples: list[Step]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: tokens of broadcast words get their score, others their pair's share and the parent's weights."""
    scores = _Scores()
    for _, rows in grouped(batches, "bucket", CHUNK):
        whole = joined([r for r in rows if r[1] == SUMS], 10, SETTLED_KIND)
        if len(whole):
            whole = whole[np.argsort(whole["doc"], kind="stable")]
            keys, (values,) = packed(whole["doc"] >> GROUP, whole)
            m = len(keys)
            yield _batch("k kind base ws cs docs x", keys * 2, pa.array(np.full(m, WHOLE), pa.int32()), np.zeros(m, dtype=np.int64), _nothing(m), _nothing(m), _nothing(m), values)
        mine = [r for r in rows if r[1] == TOKEN]
        if not mine:
            continue
        found = restaurants([r for r in rows if r[1] == RESTAURANT], 3)
        us, lens = decoded(mine, 3), joined(mine, 6, np.uint32).astype(np.int64)
        run = np.repeat(np.arange(len(us)), lens)
        word, n = decoded(mine, 7), joined(mine, 10, np.int64)
        doc = joined(mine, 11, np.uint16).astype(np.int64) + (joined(mine, 12, np.uint16).astype(np.int64) << 16)
        doc += np.repeat([r[2] for r in mine], [len(r[11]) // 2 for r in mine])
        pairs = pair_hash(found.us[found.of], found.ws)
        order = np.argsort(pairs)
        place = lookup(pair_hash(us[run], word), pairs[order])
        place[place >= 0] = order[place[place >= 0]]
        by_hash = np.argsort(found.us)  # of several buckets; only contexts dealt out in parts come twice, and their totals are broadcast
        context, in_parts = lookup(us, found.us[by_hash]), lookup(us, layout.split)
        context[context >= 0] = by_hash[context[context >= 0]]
        customers, _ = found.totals(layout)
        whole = pick(layout.customers, in_parts, pick(customers, context))
        c = pick(found.cs, place)
        share, weights = np.zeros(len(word)), []
        stored = [joined([r for r in rows if r[1] == SAMPLED and r[2] == i], 10, np.uint32) for i in range(SAMPLES)]
        for step, t, tables in sampled(found, layout, samples, stored):
            own = pick(step.tables_after, in_parts, pick(tables, context))
            share += np.where(place >= 0, c - step.discount * pick(t, place), 0) / (step.strength + whole)[run] / SAMPLES
            weights.append(((step.strength + step.discount * own) / (step.strength + whole) / SAMPLES)[run])
        at = place_of(word)
        frequent = at >= 0
        p = share[frequent] + sum(w[frequent] * s.after.seen[at[frequent]] for w, s in zip(weights, samples))
        scores.add(doc[frequent], n[frequent] * np.log10(p))
        rest = np.flatnonzero(~frequent)
        if len(rest):
            bucket = word_bucket(word[rest], layout.buckets)
            rest = rest[np.argsort(bucket, kind="stable")]
            shares = np.column_stack([share, *weights])[rest].astype(np.float32)
            keys, (ws, cs, docs, x) = packed(word_bucket(word[rest], layout.buckets), word[rest], n[rest], doc[rest], np.ascontiguousarray(shares).view(np.dtype((np.void, 4 * (SAMPLES + 1)))).reshape(-1))
            m = len(keys)
            yield _batch("k kind base ws cs docs x", keys * 2 + 1, pa.array(np.full(m, REST_TOKEN), pa.int32()), np.zeros(m, dtype=np.int64), ws, cs, docs, x)
        yield from scores.flush(GATHER)
    yield from scores.flush(0)


def _rest_word_batches(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Words that are not broadcast, with counts and tables."""
    for bucket, rows in grouped(batches, "bucket"):
        word = joined(rows, 1, np.uint64)
        rest = word >= CODES
        if rest.any():
            columns = packed(np.zeros(int(rest.sum()), dtype=np.int64), word[rest], joined(rows, 2, np.int64)[rest], joined(rows, 3, np.int64)[rest])[1]
            yield _batch("k kind base ws cs docs x", [bucket * 2 + 1], pa.array([WORD], pa.int32()), [0], columns[0], columns[1], _nothing(1), columns[2])


def _sum_batches(batches: Iterator[pa.RecordBatch], layout: Layout, samples: list[Step], root_mass: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of k to sums per document."""
    for _, rows in grouped(batches, "k", CHUNK):
        of = lambda kind, rows=rows: [r for r in rows if r[1] == kind]
        sums = joined(of(WHOLE), 6, SETTLED_KIND).copy()
        sums = sums[np.argsort(sums["doc"])]
        if len(sums):
            doc = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[5], dtype=np.uint16).astype(np.int64) + ((r[0] // 2) << GROUP) for r in of(SCORE)]])
            np.add.at(sums["score"], np.searchsorted(sums["doc"], doc), joined(of(SCORE), 6, np.float32).astype(float))
            keys, (values,) = packed(sums["doc"] >> GROUP, sums)
            yield _batch("docs sums", keys, values)
        mine = of(REST_TOKEN)
        word = joined(mine, 3, np.uint64)
        if not len(word):
            continue
        n, doc = joined(mine, 4, np.int64), joined(mine, 5, np.int64)
        shares = joined(mine, 6, np.float32).reshape(-1, SAMPLES + 1).astype(float)
        known, counts, t = joined(of(WORD), 3, np.uint64), joined(of(WORD), 4, np.int64), joined(of(WORD), 6, np.int64)
        order = np.argsort(known)
        known, counts, t = known[order], counts[order], t[order]
        place = lookup(word, known)
        p = shares[:, 0].copy()
        for i, step in enumerate(samples):
            more = t.copy()
            extra = [r for r in of(MORE_TABLES) if r[2] == i]
            np.add.at(more, lookup(joined(extra, 3, np.uint64), known), joined(extra, 4, np.int64))
            s = root_tables(known, more, root_mass, step.after.discount, 2 * (BURN_IN + i) + 3)
            p += shares[:, i + 1] * pick(step.after.probability(more, s), place, step.after.unseen)
        c = pick(counts, place)
        doc, seen, base, score = add_up(doc, n * (place >= 0), n * _base(c, layout), n * np.log10(p))
        sums = np.zeros(len(doc), dtype=SETTLED_KIND)
        sums["doc"], sums["known"], sums["base"], sums["score"] = doc, seen, base, score
        keys, (values,) = packed(sums["doc"] >> GROUP, sums)
        yield _batch("docs sums", keys, values)


def _document_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums in order of their document group to one row per document."""
    for _, rows in grouped(batches, "docs"):
        sums = joined(rows, 1, SETTLED_KIND)
        doc, *rest = add_up(sums["doc"], *[sums[x] for x in SETTLED_KIND.names[1:]])
        yield _batch("doc id n_tokens n_known base score", doc, *rest)


def held_out(id_column: Column, divisor: int = 10) -> Column:
    """crc32 of the id as text leaves no remainder; rows without an id are training rows."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(divisor)) == 0, F.lit(False))


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Trains on the rows that are not held out and scores all.  Scores are log10
    probabilities of the whole text with its end; a null text is only its end.
    Repeated rows are scored each; without training rows every token is unseen.
    Ids are whole numbers; a row without one is a training row.  Only the id and
    the text are read, so other columns may have any name.  Words are told apart
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    model = fit(source.where(~held_out(F.col("id"))).select("text"))
    layout, root_mass = model.layout, model.root_mass
    state = spark.sparkContext.broadcast((layout, model.samples))
    size = layout.n
    least = max(2, size >> 20)
    with tidy_shuffles(spark):
        rows = to_seat(model.restaurants, model.tables).mapInArrow(lambda batches: _frequent_pair_batches(batches, *state.value, least), "ps binary, vs binary").collect()  # at most one pair for each ``least`` tokens
    pairs, log_p = joined(rows, 0, np.uint64), joined(rows, 1, np.float32)
    order = np.argsort(pairs)
    often = spark.sparkContext.broadcast((pairs[order], log_p[order]))

    numbered = source.withColumn("doc", F.monotonically_increasing_id() * 2 + F.col("id").isNull().cast("int"))
    read = numbered.mapInArrow(lambda batches: _token_batches(batches, state.value[0], often.value), MEET_ROWS)
    nothing = F.lit(None).cast("binary")
    served = model.restaurants.select("bucket", F.lit(RESTAURANT).alias("kind"), F.lit(0).cast("long").alias("base"), *PAIR_NAMES.split()[1:], nothing.alias("docs"), nothing.alias("more"))
    for i, tables in enumerate(model.tables):
        served = served.unionByName(tables.select("bucket", F.lit(SAMPLED).alias("kind"), F.lit(i).cast("long").alias("base"), *[nothing.alias(c) for c in PAIR_NAMES.split()[1:-1]], F.col("es").alias("cs"), nothing.alias("docs"), nothing.alias("more")))
    met = read.unionByName(served).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _meet_batches(batches, *state.value), PART_ROWS)
    met = met.unionByName(model.dishes.mapInArrow(lambda batches: _rest_word_batches(batches, state.value[0]), PART_ROWS))
    for i, more in enumerate(model.more):
        met = met.unionByName(more.select((F.col("bucket") * 2 + 1).alias("k"), F.lit(MORE_TABLES).alias("kind"), F.lit(i).cast("long").alias("base"), "ws", F.col("es").alias("cs"), nothing.alias("docs"), nothing.alias("x")))
    parts = met.repartition("k").sortWithinPartitions("k").mapInArrow(lambda batches: _sum_batches(batches, *state.value, root_mass), "docs long, sums binary")
    sums = parts.repartition("docs").sortWithinPartitions("docs").mapInArrow(_document_batches, "doc long, id long, n_tokens long, n_known long, base double, score double")
    doc_id = F.when(F.col("doc") % 2 == 0, F.col("id"))  # the number is odd where there is no id
    return sums.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "n_tokens", "n_known", F.lit(layout.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """``held_out, perplexity, base_perplexity`` from scored documents."""
    mean = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))
