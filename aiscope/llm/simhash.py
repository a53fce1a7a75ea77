"""SimHash near-duplicate classes with Golay-code fuzzy hashing.

A fingerprint has one bit for each bit position that is set in over half of
the XXH64 hashes of a text's word shingles.  Fingerprints that differ in at
most four bits are linked; classes are the connected components.

Finding links: a 64-bit fingerprint is cut into segments A (23 bits), B (23
bits) and C (18 bits).  The perfect binary Golay code has a codeword within
distance 3 of any 23-bit word; the codewords within distance 4 are 1 or 6, and
two words at distance 2 or less always share one of those (both lie within 4
of the codeword nearest to a word between them).  At most four errors over
(A, B, C) leave one of these cases, each an equality key:

* A or B without an error: the segment itself;
* C without an error and A or B with at most two: C and a codeword of it;
* A and B with at most two each: a codeword of both.

Rows with the same key are compared in sorted runs.  Runs of over ``block``
rows are dealt again as pairs of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aiscope.llm.graph import connected_components, cut, ensure_checkpoint_dir, fresh, join_by_key
from aiscope.llm.words import LOWER, blocks, split_words

GOLAY_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEED = 42


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each 12-bit upper half, and for each syndrome its error patterns of weight 4 or less."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(x << 11) for x in range(4096)], dtype=np.int64)
    single = [remainder(1 << bit) for bit in range(23)]
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)

    def add(bits: tuple[int, ...]) -> None:
        syndrome = 0
        for bit in bits:
            syndrome ^= single[bit]
        patterns[syndrome, filled[syndrome]] = sum(1 << bit for bit in bits)
        filled[syndrome] += 1

    from itertools import combinations

    for weight in range(5):
        for bits in combinations(range(23), weight):
            add(bits)
    return upper, patterns


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of all codewords within distance 4: six columns, -1 where there are fewer."""
    upper, patterns = golay_tables()
    words = words.astype(np.int64)
    errors = patterns[upper[words >> 11] ^ (words & 0x7FF)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all link keys of unsigned 64-bit fingerprints."""
    a = (fingerprints & np.uint64(0x7FFFFF)).astype(np.int64)
    b = ((fingerprints >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fingerprints >> np.uint64(46)).astype(np.int64)
    near_a, near_b = golay_indices(a), golay_indices(b)
    n = len(fingerprints)
    kinds = [a[:, None], b[:, None]]
    kinds += [np.where(near >= 0, (c[:, None] << 12) | near, -1) for near in (near_a, near_b)]
    pair = np.where((near_a[:, :, None] >= 0) & (near_b[:, None, :] >= 0), (near_a[:, :, None] << 12) | near_b[:, None, :], -1)
    kinds.append(pair.reshape(n, 36))
    rows, keys = [], []
    for kind, values in enumerate(kinds):
        row, column = np.nonzero(values >= 0)
        rows.append(row)
        keys.append(values[row, column] | (kind << 40))
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for block in blocks(batches, "text"):
        data = LOWER[block.data]
        words = split_words(block)
        n = block.rows.num_rows
        count = np.bincount(words.row, minlength=n)
        prints = np.zeros(n, dtype=np.uint64)
        if len(words.row):
            # all words of the block, joined by single spaces
            length = words.end - words.start
            joined = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
            begin = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
            joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[~np.isin(data, (9, 10, 11, 12, 13, 32))]
            text = joined.tobytes()
            first = np.concatenate(([0], np.cumsum(count)[:-1]))
            shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
            row = np.repeat(np.arange(n), shingles)
            at = np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[row]
            to = at + np.minimum(count[row], shingle) - 1
            starts, ends = begin[at].tolist(), (begin[to] + length[to]).tolist()
            hashes = np.array([digest(text[s:e], SEED) for s, e in zip(starts, ends)], dtype=np.uint64)
            ones = np.zeros((n, 64), dtype=np.int64)
            filled = np.flatnonzero(shingles)
            for low in range(0, len(filled), 512):
                part = filled[low : low + 512]
                lo = int((np.cumsum(shingles) - shingles)[part[0]])
                hi = lo + int(shingles[part].sum())
                bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[part] = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(shingles[part])[:-1])), axis=0, dtype=np.int64)
            set_bits = 2 * ones > shingles[:, None]
            prints = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
        names = [x for x in block.rows.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*map(block.column, names), pa.array(prints.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; fp is the signed form of the 64-bit fingerprint, 0 for a text without words or a null."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    return source.mapInArrow(lambda batches: _fingerprint_batches(batches, shingle), f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for low in range(0, len(prints), 4096):
            part = prints[low : low + 4096]
            row, key = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


class _Forest:
    """Links of one task, thinned to a spanning forest of what it has seen."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((x, y))

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.links) >= least and self.links:
            a, b = zip(*self.links)
            nothing = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), nothing], names=["a", "b", "key"])
            self.links = []
            if len(self.parent) > 200_000:
                self.parent = {}


def _compare(key: np.ndarray, fp: np.ndarray, distance: int, forest: _Forest) -> None:
    """Link near fingerprints of the same key; rows come in key order."""
    for lag in range(1, len(key)):
        same = np.flatnonzero(key[lag:] == key[:-lag])
        if not len(same):
            return
        near = same[np.bitwise_count((fp[same + lag] ^ fp[same]).view(np.uint64)) <= distance]
        if len(near):
            forest.add(fp[near], fp[near + lag])


def _link_batches(batches: Iterator[pa.RecordBatch], distance: int, block: int) -> Iterator[pa.RecordBatch]:
    """Batches in key order to links (a, b, null); rows of a run over ``block`` are handed on as (fp, null, key)."""
    forest = _Forest()
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = None  # the key of a run that is handed on

    def hand_on(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(prints), pa.nulls(len(prints), pa.int64()), pa.array(keys)], names=["a", "b", "key"])

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy()))
        fp = np.concatenate((fp, batch.column("fp").to_numpy()))
        if large is not None:
            rest = int(np.searchsorted(key, large, side="right"))
            if rest:
                yield hand_on(key[:rest], fp[:rest])
                key, fp = key[rest:], fp[rest:]
            if len(key):
                large = None
        if not len(key):
            continue
        edge = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        big = sizes > block
        if big[-1]:
            large = key[-1]
        keep_from = len(key) if big[-1] else starts[-1]  # the last run may go on in the next batch
        of_big = np.repeat(big, sizes)
        if of_big.any():
            yield hand_on(key[of_big], fp[of_big])
        done = ~of_big
        done[keep_from:] = False
        _compare(key[done], fp[done], distance, forest)
        key, fp = key[keep_from:], fp[keep_from:]
        yield from forest.flush(5000)
    _compare(key, fp, distance, forest)
    yield from forest.flush(0)


def _linked(keyed: DataFrame, distance: int, block: int) -> DataFrame:
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _link_batches(batches, distance, block), "a long, b long, key long")


def near_links(prints: DataFrame, distance: int = 4, block: int = 20_000) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``prints.fp`` within ``distance`` (at most 4) bits of each other.

    Within a task links are thinned to a spanning forest, so a class of m near
    copies gives links in proportion to m, not all pairs.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the Golay keys guarantee links of at most 4 differing bits")
    keyed = prints.select("fp").distinct().mapInArrow(_key_batches, "key long, fp long")
    found = cut(_linked(keyed, distance, block))
    links = found.where("b is not null").select("a", "b")
    rest = found.where("key is not null").select("key", F.col("a").alias("fp"))
    if rest.isEmpty():
        return links
    parts = F.ceil(F.col("n") / F.lit(max(1, block // 2))).cast("int")
    sized = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    grid = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = grid.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp").distinct()
    return links.unionAll(_linked(again, distance, 1 << 62).select("a", "b"))


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Ways over which the members of one class are dealt when they meet the class's smallest id.
SALTS = 32


def simhash_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id in the class.  A null or wordless text
    has fingerprint zero and is linked like any other; repeated rows stay
    repeated; a null id keeps its row and never names a class unless the class
    has no other id.  Ids may have any type that can be ordered.  An empty table
    gives an empty result.  Only the id and the text are read, so other columns
    may have any name.
    """
    prints = cut(fingerprints(docs, id_column, text_column, shingle))
    owned = _roots(prints, distance)
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS))
    linked = owned.where("linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_class = linked.withColumn("salt", salt.cast("int")).join(smallest, ["root", "salt"]).select("fp", "component_id", "n")
    labels = cut(owned.where("not linked").select("fp", F.col("least").alias("component_id"), "n").unionAll(of_class))
    return join_by_key(prints, labels, "fp", "n").select(F.col("id").alias("doc_id"), _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _roots(prints: DataFrame, distance: int, least: Column | None = None) -> DataFrame:
    """``(fp, least, n, root, linked)`` for each distinct fingerprint: its smallest id (or other value), its rows, the name of its class, and whether that has others."""
    distinct = prints.groupBy("fp").agg(F.min(F.col("id") if least is None else least).alias("least"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(near_links(prints, distance))
    return cut(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class does: that with the smallest id.

    Of rows that share the id one stays; a null id comes after all others.  Rows
    are told apart by a number of their own, so one that shares its id with a
    removed row of another class stays.  The numbered rows are written to the
    shared folder, as a frame that is computed twice may come in another order.
    Ids may have any type that can be ordered, and columns any name.
    """
    spark = docs.sparkSession
    [number] = fresh(docs, "row")
    folder = f"{ensure_checkpoint_dir(spark)}/numbered-{uuid.uuid4().hex}"
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(folder)
    numbered = spark.read.parquet(folder)
    source = numbered.select(F.col(id_column).alias("id"), F.col(number).alias("row"), F.col(text_column).cast("binary").alias("text"))
    prints = cut(source.mapInArrow(lambda batches: _fingerprint_batches(batches, 4), f"id {source.schema['id'].dataType.simpleString()}, row long, fp long"))
    # the first row of each fingerprint, then of each class: rows themselves are not joined
    owned = _roots(prints, 4, F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    first = owned.groupBy("root").agg(F.min("least").alias("first"))
    stay = first.select(F.col("first.row").alias(number))
    return numbered.join(stay, number, "left_semi").select(docs.columns)
