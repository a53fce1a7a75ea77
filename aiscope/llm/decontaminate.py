"""Benchmark decontamination by canonical templates.

Text becomes a sequence of template tokens: numbers, names (capitalised words,
also those that begin a sentence) and units after a number turn into typed
placeholders, other words stay, in lower case.  Windows of template tokens are
hashed and joined with those of the benchmark.  Windows of one item that lie
along shifts of a narrow band are taken together, so that words may be put in or
left out between them.  A document is contaminated by an item when they cover
at least ``share`` of the item's tokens and either that much is covered by
windows that are equal word for word, or the slots are consistent: most repeats
of a filler in the item stand for one filler in the document, and most repeats
of a name in the document for one in the item.  So re-parameterised copies of a
question are found and chance meetings of placeholders are not.

Items without any window of enough plain words (short ones, rows of numbers)
are looked for by all their raw words in a row; if they have one or two words,
as whole documents only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from aiscope.llm.graph import cut, fresh, keys
from aiscope.llm.words import LOWER, Block, blocks, mix, span_hashes, split_words, window_hashes

WINDOW = 5
SHARE = 0.6
#: Shifts of one band; bands overlap by half, so windows at most half a band apart meet in one.
BAND = 16
#: Raw items of at most so many words are matched with whole documents.
TINY = 2
#: The most benchmark windows (16 bytes each) that are broadcast as a filter; beyond, the join shuffles every window.
BROADCAST_WINDOWS = 2_000_000

# Fixed word lists of the canonical form.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years c f k degrees percent usd eur gbp dollar dollars cent cents euro euros mph kmh kph w kw kwh v a hz khz mhz ghz kb mb gb tb".split()

LITERAL, NUMBER, NAME, UNIT = range(4)

STOPS = np.ones(256, dtype=bool)  # everything but ASCII letters, digits and bytes of other scripts
STOPS[48:58] = STOPS[65:91] = STOPS[97:123] = STOPS[128:] = False
SENTENCE = np.zeros(256, dtype=np.int64)
SENTENCE[[ord(c) for c in ".!?:;\n|"]] = 1


def _hashes_of(words: list[str]) -> np.ndarray:
    text = " ".join(words).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    return np.sort(span_hashes(data, start, start + lengths))


_NUMBERS, _UNITS = _hashes_of(NUMBER_WORDS), _hashes_of(UNIT_WORDS)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


@dataclass
class Template:
    value: np.ndarray  # hash of each template token
    kind: np.ndarray
    filler: np.ndarray  # hash of what stands in a slot
    row: np.ndarray
    raw: np.ndarray  # hash of each word
    raw_row: np.ndarray


def template(block: Block) -> Template:
    """The template tokens of all texts of a block; neighbouring numbers or names are one slot."""
    words = split_words(block, STOPS)
    n = len(words.start)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return Template(empty.astype(np.uint64), empty, empty.astype(np.uint64), empty, empty.astype(np.uint64), empty)
    data = block.data
    hashes = span_hashes(LOWER[data], words.start, words.end)
    first = data[words.start]
    number = (first >= 48) & (first <= 57)
    number |= _member(hashes, _NUMBERS)
    same_row = np.zeros(n, dtype=bool)
    same_row[1:] = words.row[1:] == words.row[:-1]
    stop = np.concatenate(([0], np.cumsum(SENTENCE[data])))
    inside = np.zeros(n, dtype=bool)  # in one sentence with the word before
    inside[1:] = same_row[1:] & (stop[words.start[1:]] == stop[words.end[:-1]])
    kind = np.zeros(n, dtype=np.int64)
    kind[(first >= 65) & (first <= 90)] = NAME
    kind[number] = NUMBER
    after_number = np.zeros(n, dtype=bool)
    after_number[1:] = number[:-1] & same_row[1:]
    kind[(kind == LITERAL) & after_number & _member(hashes, _UNITS)] = UNIT
    begins = np.ones(n, dtype=bool)
    begins[1:] = ~(inside[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME)))
    at = np.flatnonzero(begins)
    with np.errstate(over="ignore"):
        filler = mix(np.add.reduceat(hashes * (np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) + 1).astype(np.uint64), at))
    kind = kind[at]
    return Template(np.where(kind == LITERAL, hashes[at], kind.astype(np.uint64)), kind, filler, words.row[at], hashes, words.row)


def template_windows(found: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of windows within one text that have at least half literal tokens."""
    n = len(found.value) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    literal = np.concatenate(([0], np.cumsum(found.kind == LITERAL)))
    at = np.flatnonzero((found.row[:n] == found.row[size - 1 :]) & (2 * (literal[size:] - literal[:-size]) >= size))
    return at, window_hashes(found.value, size)[at]


def raw_windows(found: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of so many words in a row; of few, only whole texts."""
    n = len(found.raw) - size + 1
    if n <= 0 or size < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    fits = found.raw_row[:n] == found.raw_row[size - 1 :]
    if size <= TINY:
        whole = np.bincount(found.raw_row)
        fits &= whole[found.raw_row[:n]] == size
    at = np.flatnonzero(fits)
    return at, mix(window_hashes(found.raw, size)[at] + np.uint64(size))


#: ``raw`` is the number of words of a raw window, 0 for windows of template tokens.
SCHEMA = "k1 long, k2 long, id {id}, pos int, total int, raw int, hash long, kinds array<int>, fillers array<long>"


def _rows(block: Block, found: Template, at: np.ndarray, hashes: np.ndarray, total: np.ndarray, size: int, raw: int) -> pa.RecordBatch:
    """Windows as rows; those of template tokens with the kind and filler of every token."""
    of = (found.raw_row if raw else found.row)[at]
    first = np.searchsorted(found.raw_row if raw else found.row, np.arange(block.rows.num_rows))
    held = 0 if raw else size
    index = (at[:, None] + np.arange(held)).reshape(-1)
    offsets = pa.array(np.arange(len(at) + 1) * held, pa.int32())
    kinds = pa.ListArray.from_arrays(offsets, pa.array(found.kind[index], pa.int32()))
    fillers = pa.ListArray.from_arrays(offsets, pa.array(np.where(found.kind[index] == LITERAL, 0, found.filler[index].view(np.int64))))
    keys = [block.column(x).take(pa.array(of)) for x in ("k1", "k2", "id")]
    columns = [*keys, pa.array(at - first[of], pa.int32()), pa.array(total[of], pa.int32()), pa.array(np.full(len(at), raw), pa.int32()), pa.array(hashes.view(np.int64)), kinds, fillers]
    return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "id", "pos", "total", "raw", "hash", "kinds", "fillers"])


def _item_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Windows of benchmark items, and one raw window for each item whose windows cannot cover enough of it."""
    for block in blocks(batches, "text"):
        found = template(block)
        n = block.rows.num_rows
        tokens = np.bincount(found.row, minlength=n)
        at, hashes = template_windows(found, size)
        mark = np.zeros(len(found.row) + size + 1, dtype=np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
        covered = np.bincount(found.row, np.cumsum(mark)[: len(found.row)] > 0, minlength=n)
        usable = (covered >= SHARE * tokens) & (tokens > 0)
        keep = usable[found.row[at]] if len(at) else np.zeros(0, dtype=bool)
        yield _rows(block, found, at[keep], hashes[keep], tokens, size, 0)
        words = np.bincount(found.raw_row, minlength=n)
        first = np.searchsorted(found.raw_row, np.arange(n))
        for length in np.unique(words[~usable & (words > 0)]).tolist():
            rows = np.flatnonzero(~usable & (words == length))
            place, hashes = raw_windows(found, length)
            pick = np.searchsorted(place, first[rows])
            yield _rows(block, found, first[rows], hashes[pick], words, size, length)


def _document_batches(batches: Iterator[pa.RecordBatch], size: int, raw_sizes: list[int], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    marks = None
    if wanted is not None:
        marks = np.zeros(1 << 24, dtype=bool)
        marks[(wanted >> np.uint64(40)).astype(np.int64)] = True
    for block in blocks(batches, "text"):
        found = template(block)
        nothing = np.zeros(block.rows.num_rows, dtype=np.int64)
        for raw in (0, *raw_sizes):
            at, hashes = raw_windows(found, raw) if raw else template_windows(found, size)
            if wanted is not None and len(at):
                maybe = np.flatnonzero(marks[(hashes >> np.uint64(40)).astype(np.int64)])
                hit = maybe[_member(hashes[maybe], wanted)] if len(wanted) else maybe[:0]
                at, hashes = at[hit], hashes[hit]
            if len(at):
                yield _rows(block, found, at, hashes, nothing, size, raw)


def _prepared(frame: DataFrame, id_column: str, text_column: str) -> DataFrame:
    k1, k2 = keys(id_column, text_column)
    return frame.select(k1.alias("k1"), k2.alias("k2"), F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))


def _covered(positions: Column, size: Column) -> Column:
    """Tokens under windows that begin at these distinct places."""
    at = F.array_sort(positions)
    return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + size).alias("end"), (a["n"] + p + size - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])


@F.pandas_udf(BooleanType())
def consistent(slots: pd.Series) -> pd.Series:
    """Do slots (place in the item, kind, filler in the document, filler in the item) mostly agree?"""

    def agree(found: list[dict]) -> bool:
        torn = evidence = 0
        for one, other, kinds in (("m", "d", (NUMBER, NAME, UNIT)), ("d", "m", (NAME,))):
            groups: dict[tuple[int, int], Counter] = {}
            for s in found:
                if s["kind"] in kinds:
                    groups.setdefault((s["kind"], s[one]), Counter())[s[other]] += 1
            for counts in groups.values():
                n = counts.total()
                if n >= 2:
                    evidence += n
                    torn += n - max(counts.values())
        return torn == 0 or 2 * torn < evidence

    return slots.map(lambda found: agree([] if found is None else list(found)))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_column: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``k1, k2, item_id, matched, total``: items found in documents, by the documents' keys; ``matched`` of ``total`` tokens are covered.

    The benchmark's distinct window hashes are broadcast to filter windows
    where they are made, if there are at most ``BROADCAST_WINDOWS``; otherwise
    all windows are shuffled to the hash join.  Only hits go on: those of one
    document and item along one band of shifts are bounded by the item's size.
    """
    item_schema = SCHEMA.format(id=items.schema[item_id].dataType.simpleString())
    doc_schema = SCHEMA.format(id=docs.schema[doc_id].dataType.simpleString())
    made = _prepared(items, item_id, text_column).where("id is not null").mapInArrow(lambda batches: _item_batches(batches, window), item_schema)
    marks = cut(made.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "total", "raw", "hash", "kinds", F.col("fillers").alias("item_fillers")))
    raw_sizes = sorted(r.raw for r in marks.where("raw > 0").select("raw").distinct().collect())  # distinct numbers of words of raw items
    known = marks.select("hash").distinct().limit(BROADCAST_WINDOWS + 1).toArrow()
    wanted = None
    if known.num_rows <= BROADCAST_WINDOWS:
        wanted = np.sort(known.column("hash").to_numpy().astype(np.int64).view(np.uint64))
        shared = docs.sparkSession.sparkContext.broadcast(wanted)
    found = _prepared(docs, doc_id, text_column).mapInArrow(lambda batches: _document_batches(batches, window, raw_sizes, None if wanted is None else shared.value), doc_schema)
    joined = found.select("k1", "k2", F.col("pos").alias("doc_pos"), "hash", "raw", F.col("fillers").alias("doc_fillers")).join(marks, ["hash", "raw"])
    size = F.when(F.col("raw") > 0, F.col("raw")).otherwise(window)
    slot = lambda s, i: F.struct((F.col("item_pos") + i).alias("at"), s["kinds"].alias("kind"), s["doc_fillers"].alias("d"), s["item_fillers"].alias("m"))
    slots = F.filter(F.transform(F.arrays_zip("kinds", "doc_fillers", "item_fillers"), slot), lambda s: s["kind"] > LITERAL)
    shift = F.col("doc_pos") - F.col("item_pos")
    bands = F.array(F.floor(shift / BAND) * 2, F.floor((shift + BAND // 2) / BAND) * 2 + 1)
    hits = joined.select("k1", "k2", "item_id", "item_pos", "total", size.alias("size"), slots.alias("slots"), (F.col("doc_fillers") == F.col("item_fillers")).alias("equal"), F.explode(bands).alias("band"))
    grouped = hits.groupBy("k1", "k2", "item_id", "band").agg(
        F.max("total").alias("total"), F.max("size").alias("size"), F.collect_set("item_pos").alias("places"), F.collect_set(F.when(F.col("equal"), F.col("item_pos"))).alias("equals"), F.collect_set("slots").alias("slots")
    )
    enough = F.ceil(F.col("total") * F.lit(share))
    near = grouped.withColumn("matched", _covered(F.col("places"), F.col("size"))).where(F.col("matched") >= enough)
    near = near.where((_covered(F.col("equals"), F.col("size")) >= enough) | consistent(F.array_distinct(F.flatten("slots"))))
    return near.groupBy("k1", "k2", "item_id").agg(F.max("matched").alias("matched"), F.max("total").alias("total"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, contaminated, item_ids, matched_tokens``.

    Null and empty texts are clean, and match no item; an item that is null,
    empty or without an id is not looked for; an empty benchmark leaves all
    clean.  Rows are judged by their text, so rows with the same id or none
    never share a verdict unless their texts are equal; ids may have any type.
    Only the id and the text are read, so other columns may have any name.
    """
    found = matches(docs, items, doc_id, item_id, text_column).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("matched").alias("matched_tokens"))
    k1, k2 = keys(doc_id, text_column)
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2")).join(found, ["k1", "k2"], "left")
    none = F.array().cast(f"array<{items.schema[item_id].dataType.simpleString()}>")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("matched_tokens", F.lit(0)).cast("long").alias("matched_tokens"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; their columns may have any name."""
    names = fresh(docs, "k1", "k2")
    found = matches(docs, items, doc_id, item_id, text_column).select(*[F.col(k).alias(n) for k, n in zip(("k1", "k2"), names)]).distinct()
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(keys(doc_id, text_column), names)])
    return keyed.join(found, names, "left_anti").select(*docs.columns)
