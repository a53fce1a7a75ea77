"""Removal of passages that repeat, within and across documents, by paragraph MinHash.

A text is cut into paragraphs by its content: at line ends and at some sentence
ends, and in stretches without either at some words.  Where such places lie
closer than ``MIN_WORDS``, the one with the smallest hash of the words beside it
is taken, line ends before sentence ends, so that short lines (lists, verse,
code) make up paragraphs together.  Cuts depend on few words around them: a
passage that lies inside longer text is cut as elsewhere, and every word of a
text of ``MIN_WORDS`` or more is in a paragraph.  A word said that often in a row
is a paragraph of its own.  Paragraphs get MinHash bands
over their word shingles; paragraphs that share a band are compared by the exact
Jaccard similarity of their shingles; classes are connected components; the
first paragraph of a class stays, the others are removals.

Equal paragraphs need no comparison: they share one content hash, so only
different contents that collide are read again, through a bitmap of their
hashes of fixed size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aiscope.llm.graph import connected_components, cut, ensure_checkpoint_dir, fresh
from aiscope.llm.words import LOWER, Block, blocks, mix, powers, span_hashes, split_words, window_hashes

MIN_WORDS = 7
#: Words without a cut on both sides from which a word may be one.
STRETCH = 10
SHINGLE = 5
#: Removals: repeated paragraphs that follow one another need so many words together.
MIN_PASSAGE_WORDS = 20
MAX_SPACE = 16  # code points of white space between paragraphs that follow one another
THRESHOLD = 0.8
BITMAP_BITS = 26  # 8 MB, whatever the input


def tune_bands(threshold: float = THRESHOLD, recall: float = 0.98, rows: int = 3) -> tuple[int, int]:
    """The fewest bands of ``rows`` hashes that find a pair at the threshold with the wanted probability."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


def smallest(rank: np.ndarray, reach: int) -> np.ndarray:
    """Places smaller than all within ``reach`` before them and no larger than those after; of ties the first."""
    out = np.ones(len(rank), dtype=bool)
    for k in range(1, min(reach, len(rank) - 1) + 1):
        out[k:] &= (rank[k:] < rank[:-k]) | (rank[k:] == 0)
        out[:-k] &= rank[:-k] <= rank[k:]
    return out


class Paragraphs:
    """The paragraphs of all texts of a block, as ranges of words."""

    def __init__(self, block: Block):
        data = LOWER[block.data]
        self.words = words = split_words(block)
        n = len(words.start)
        self.hashes = span_hashes(data, words.start, words.end) if n else np.zeros(0, np.uint64)
        if not n:
            self.first = self.last = np.zeros(0, dtype=np.int64)
            return
        lines = np.concatenate(([0], np.cumsum(block.data == 10)))
        begins = np.ones(n, dtype=bool)  # a text begins at this word
        begins[1:] = words.row[1:] != words.row[:-1]
        line, sentence = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        line[1:] = lines[words.start[1:]] != lines[words.end[:-1]]
        final = block.data[words.end - 1]
        spot = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            spot[1:] = mix(self.hashes[:-1] * np.uint64(3) + self.hashes[1:]) >> np.uint64(3)
        sentence[1:] = ((final == 46) | (final == 63) | (final == 33))[:-1] & (spot[1:] & np.uint64(1) == 0)
        # a word said over and over is a paragraph of its own
        same = np.concatenate(([0], np.flatnonzero(begins | np.append(True, self.hashes[1:] != self.hashes[:-1]))[1:], [n]))
        long = np.diff(same) >= MIN_WORDS
        spoken = np.zeros(n + 1, dtype=bool)
        spoken[same[:-1][long]] = spoken[same[1:][long]] = True
        texts = np.cumsum(np.append(begins, np.ones(MIN_WORDS, dtype=bool)))
        at = np.flatnonzero(spoken[:n])
        at = at[(texts[at + MIN_WORDS - 1] == texts[at]) & (texts[at] == texts[np.maximum(at - MIN_WORDS, 0)]) & (at >= MIN_WORDS)]
        at = at[np.diff(at, prepend=-MIN_WORDS) >= MIN_WORDS]  # few words between two such runs go with the second
        none = np.uint64((1 << 64) - 1)
        rank = np.where(begins, np.uint64(0), np.where(line, spot + np.uint64(1), np.where(sentence, spot | np.uint64(1 << 62), none)))
        rank[at] = 0
        end = np.zeros(1, dtype=np.uint64)  # like the beginning of a text
        cuts = smallest(np.append(rank, end), MIN_WORDS - 1)[:-1] & (rank != none)
        near = np.cumsum(np.append(cuts, np.zeros(STRETCH + 1, dtype=bool)))
        alone = near[np.arange(n) + STRETCH] == np.where(np.arange(n) > STRETCH, near[np.maximum(np.arange(n) - STRETCH - 1, 0)], 0)
        alone &= np.arange(n) <= n - STRETCH
        rank = np.where(alone, spot | np.uint64(1 << 62), none)
        breaks = cuts | (smallest(np.append(rank, end), MIN_WORDS - 1)[:-1] & alone)
        first = np.flatnonzero(breaks)
        last = np.append(first[1:], n)
        fits = last - first >= MIN_WORDS  # only texts of fewer words
        self.first, self.last = first[fits], last[fits]

    def content(self) -> np.ndarray:
        """A 64-bit hash of each paragraph's words."""
        up, down = powers(len(self.hashes) + 1, 0xA0761D6478BD642F)
        total = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.hashes * up[: len(self.hashes)], out=total[1:])
            return mix((total[self.last] - total[self.first]) * down[self.first] + (self.last - self.first).astype(np.uint64))

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """Paragraphs x bands: keys of MinHash bands over word shingles."""
        if not len(self.first):
            return np.zeros((0, bands), dtype=np.uint64)
        shingles = window_hashes(self.hashes, SHINGLE)
        # first and one past the last shingle of each paragraph; every other range is dropped
        edges = np.stack((self.first, self.last - SHINGLE + 1), axis=1).reshape(-1)
        shingles = np.append(shingles, np.zeros(SHINGLE, np.uint64))
        keys = np.zeros((len(self.first), bands), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(bands * rows):
                odd = int(mix(np.array([k + 1], dtype=np.uint64))[0]) | 1
                least = np.minimum.reduceat(shingles * np.uint64(odd), edges)[::2]
                keys[:, k // rows] = mix(keys[:, k // rows] * np.uint64(31) + least + np.uint64(k // rows))
        return keys

    def shingle_set(self, i: int) -> np.ndarray:
        return np.unique(window_hashes(self.hashes[self.first[i] : self.last[i]], SHINGLE))


def _points(block: Block) -> np.ndarray | None:
    """Code points before each byte of the block, or None if all are single bytes."""
    if len(block.data) and int(block.data.max()) >= 128:
        return np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    return None


UNITS = "id {id}, row long, start int, end int, n_words int, content long, bands array<long>"
#: Places for contents that a task remembers, so that it sends the bands of an often repeated one once.
REMEMBERED = 1 << 20


def _paragraph_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph, with bands where its content is new to the task, and one without words for each text."""
    seen = np.zeros(REMEMBERED, dtype=np.uint64)
    for block in blocks(batches, "text"):
        found = Paragraphs(block)
        n = block.rows.num_rows
        some = len(found.first) > 0
        row = found.words.row[found.first] if some else found.first
        content = found.content() if some else np.zeros(0, np.uint64)
        begin, end = (found.words.start[found.first], found.words.end[found.last - 1]) if some else (found.first, found.first)
        points = _points(block)
        base = block.offsets[row]
        if points is not None:
            begin, end, base = points[begin], points[end], points[base]
        _, once = np.unique(content, return_index=True)
        new = np.zeros(len(content), dtype=bool)
        place = (content[once] % np.uint64(REMEMBERED)).astype(np.int64)
        new[once] = seen[place] != content[once]
        seen[place] = content[once]
        keys = found.bands(bands, rows)[new]
        edges = np.concatenate(([0], np.cumsum(new) * bands, np.full(n, int(new.sum()) * bands)))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
        every = pa.array(np.concatenate((row, np.arange(n))))
        zero = np.zeros(n, dtype=np.int64)
        columns = [block.column("id").take(every), block.column("row").take(every)]
        columns += [pa.array(np.concatenate(x), pa.int32()) for x in ((begin - base, zero - 1), (end - base, zero - 1), (found.last - found.first, zero))]
        columns += [pa.array(np.concatenate((content.view(np.int64), zero))), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "start", "end", "n_words", "content", "bands"])


def _collision_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, content) in order of both: the distinct pairs of keys that have two contents or more."""
    key, content = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(key: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
        edge = np.ones(len(key), dtype=bool)
        edge[1:] = key[1:] != key[:-1]
        alone = edge & np.append(edge[1:], True)
        return pa.RecordBatch.from_arrays([pa.array(key[~alone]), pa.array(content[~alone])], names=["key", "content"])

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy()))
        content = np.concatenate((content, batch.column("content").to_numpy()))
        if not len(key):
            continue
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        key, content = key[new], content[new]
        last = int(np.searchsorted(key, key[-1], side="left"))
        if last:
            yield pairs(key[:last], content[:last])
            key, content = key[last:], content[last:]
    if len(key):
        yield pairs(key, content)


def _shingle_batches(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Content hash and shingles, once a block, of paragraphs whose content is marked in the bitmap."""
    for block in blocks(batches, "text"):
        found = Paragraphs(block)
        if not len(found.first):
            continue
        content = found.content()
        spot = content & np.uint64((1 << BITMAP_BITS) - 1)
        marked = np.flatnonzero((bitmap[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1))
        _, once = np.unique(content[marked], return_index=True)
        marked = marked[once]
        if len(marked):
            sets = [found.shingle_set(i).view(np.int64) for i in marked.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(content[marked].view(np.int64)), lists], names=["content", "shingles"])


class _Classes:
    """Union-find over contents; the links that joined two classes are what a task hands on."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        p, q = self.find(a), self.find(b)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
            self.links.append((a, b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _verify_run(contents: list[int], sets: list[np.ndarray], threshold: float, classes: _Classes) -> None:
    """Link all similar contents of one key.  Each is held against every one before it that is not yet in its class."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    low = 0
    for at, i in enumerate(order.tolist()):
        while sizes[order[low]] < threshold * sizes[i]:
            low += 1
        for j in order[low:at][::-1].tolist():
            if classes.find(contents[i]) != classes.find(contents[j]) and jaccard(sets[i], sets[j]) >= threshold:
                classes.join(contents[i], contents[j])


def _verify_batches(batches: Iterator[pa.RecordBatch], threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, content, shingles) in key order to links (a, b); contents of a key beyond ``block`` go out as (content, null, key)."""
    classes = _Classes()
    key, contents, sets, over = None, [], [], False

    def links() -> pa.RecordBatch:
        a, b = zip(*classes.links) if classes.links else ((), ())
        classes.links = []
        if len(classes.parent) > 200_000:
            classes.parent = {}
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def hand_on(values: list[int], of: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.nulls(len(values), pa.int64()), pa.array([of] * len(values), pa.int64())], names=["a", "b", "key"])

    for batch in batches:
        lists = batch.column("shingles")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, (k, c) in enumerate(zip(batch.column("key").to_pylist(), batch.column("content").to_pylist())):
            if k != key:
                if not over:
                    _verify_run(contents, sets, threshold, classes)
                key, contents, sets, over = k, [], [], False
            if over:
                yield hand_on([c], k)
                continue
            contents.append(c)
            sets.append(values[offsets[i] : offsets[i + 1]])
            if len(contents) > block:
                yield hand_on(contents, k)
                contents, sets, over = [], [], True
        if len(classes.links) > 5000:
            yield links()
    if not over:
        _verify_run(contents, sets, threshold, classes)
    yield links()


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float, block: int) -> DataFrame:
    dealt = pairs.join(shingles, "content").repartition("key").sortWithinPartitions("key", "content")
    return dealt.select("key", "content", "shingles").mapInArrow(lambda batches: _verify_batches(batches, threshold, block), "a long, b long, key long")


def similar_contents(docs: DataFrame, units: DataFrame, threshold: float, block: int = 4_000) -> DataFrame:
    """Links ``(a, b)`` that connect all different contents of similarity ``threshold`` or more that share a band.

    ``docs`` are (id, text) rows and ``units`` their paragraphs.
    """
    keyed = units.select("content", F.explode("bands").alias("key")).repartition("key").sortWithinPartitions("key", "content")
    pairs = cut(keyed.select("key", "content").mapInArrow(_collision_batches, "key long, content long"))
    spot = F.col("content").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bits = pairs.select(F.shiftright(spot, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast((content & {(1 << BITMAP_BITS) - 1}) & 63 as int))").alias("bit"))
    bits = bits.groupBy("i").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most 2**(BITMAP_BITS-6) rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    bitmap[bits.column("i").to_numpy()] = bits.column("bit").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))
    shingles = docs.mapInArrow(lambda batches: _shingle_batches(batches, shared.value), "content long, shingles array<long>")
    shingles = cut(shingles.groupBy("content").agg(F.first("shingles").alias("shingles")))
    found = cut(_verified(pairs, shingles, threshold, block))
    links = found.where("b is not null").select("a", "b")
    rest = found.where("key is not null").select("key", F.col("a").alias("content"))
    if rest.isEmpty():
        return links
    # keys with too many contents for a task: every two of their blocks meet under a key of their own
    sized = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").withColumn("parts", F.ceil(F.col("n") * 2 / F.lit(block)).cast("int"))
    grid = sized.withColumn("own", F.pmod(F.xxhash64("content"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = grid.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "content").distinct()
    return links.unionAll(_verified(again, shingles, threshold, 1 << 62).select("a", "b"))


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).cast("binary").alias("text"))


def repeated_passages(numbered: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every paragraph of ``numbered(id, row, text binary)`` that belongs to a class of two or more, and a row without class for each text.

    Columns: ``id, row, start, end, n_words, class_id, first_doc_id, removed``;
    offsets are code points, the end exclusive.  The first paragraph of a
    class, by document id, row and place, is kept, and so are short phrases:
    what goes are runs of repeats that follow one another with ``MIN_PASSAGE_WORDS`` words or
    more.  Null and empty texts have no paragraphs.  Rows with a null id come
    last in that order; rows with the same id are documents of their own.
    """
    spark = numbered.sparkSession
    bands, rows = tune_bands(threshold)
    folder = f"{ensure_checkpoint_dir(spark)}/paragraphs-{uuid.uuid4().hex}"
    schema = UNITS.format(id=numbered.schema["id"].dataType.simpleString())
    numbered.mapInArrow(lambda batches: _paragraph_batches(batches, bands, rows), schema).write.parquet(folder)
    units = spark.read.parquet(folder)
    real = units.where("n_words > 0")
    roots = connected_components(similar_contents(numbered, real, threshold))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "start")
    counted = real.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    owned = counted.join(roots, F.col("content") == F.col("node"), "left").where("n > 1 or root is not null")
    owned = cut(owned.select("content", "n", "place", F.coalesce("root", "content").alias("class_id")))
    first = owned.groupBy("class_id").agg(F.sum("n").alias("size"), F.min("place").alias("first")).where("size > 1")
    labels = cut(owned.join(first, "class_id").select("content", "class_id", "first"))
    slim = real.select("id", "row", "start", "end", "n_words", "content")
    members = slim.join(labels, "content")
    is_first = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    found = members.select("id", "row", "start", "end", "n_words", "class_id", F.col("first.id").alias("first_doc_id"), (~is_first).alias("again"))
    whole = units.where("n_words = 0").select("id", "row", "start", "end", "n_words", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast(found.schema["first_doc_id"].dataType).alias("first_doc_id"), F.lit(False).alias("again"))
    in_order = Window.partitionBy("row", "again").orderBy("start")
    apart = F.coalesce(F.col("start") > F.lag("end").over(in_order) + MAX_SPACE, F.lit(True))
    runs = found.unionByName(whole).withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(in_order))
    length = F.sum("n_words").over(Window.partitionBy("row", "again", "run"))
    return runs.withColumn("removed", F.col("again") & (length >= MIN_PASSAGE_WORDS)).drop("apart", "run", "again")


def dedup_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: what is removed from it and where that was seen first.

    ``n_repeated`` paragraphs belong to a class, ``n_removed`` of them with
    ``removed_words`` words go, as ``removed_spans``; ``first_doc_ids`` are the
    documents that keep them.  Null and empty texts have none of these.  Ids may
    have any type that can be ordered; rows with the same id or none are told
    apart.  Only the id and the text are read, so other columns may have any
    name.  Paragraphs, words and shingles are told apart by 64-bit hashes.
    """
    found = repeated_passages(_numbered(docs, id_column, text_column))
    gone = F.col("removed")
    report = found.groupBy("row", F.col("id").alias("doc_id")).agg(
        F.count("class_id").alias("n_repeated"), F.sum(gone.cast("long")).alias("n_removed"), F.coalesce(F.sum(F.when(gone, F.col("n_words"))), F.lit(0)).cast("long").alias("removed_words"),
        F.array_sort(F.collect_list(F.when(gone, F.struct("start", "end")))).alias("removed"), F.array_sort(F.collect_set(F.when(gone, F.col("first_doc_id")))).alias("first_doc_ids"),
    )
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return report.select("doc_id", "n_repeated", "n_removed", "removed_words", spans.alias("removed_spans"), "first_doc_ids")


def _strip_batches(batches: Iterator[pa.RecordBatch], text_column: str, spans_column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_column)
        out = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(spans_column).to_pylist()):
            if text and spans:
                parts, done = [], 0
                for span in spans:
                    parts.append(text[done : span["start"]])
                    done = span["end"]
                text = "".join(parts) + text[done:]
            out.append(text)
        rest = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
        yield rest.select([n for n in rest.schema.names if n != spans_column])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the removals cut out of the text; a text may become empty but no row goes.

    Rows are told apart by a number of their own, and the numbered rows are
    written to the shared folder, as a frame that is computed twice may come in
    another order.  Columns may have any name.
    """
    spark = docs.sparkSession
    number, of, spans = fresh(docs, "row", "of", "spans")
    folder = f"{ensure_checkpoint_dir(spark)}/numbered-{uuid.uuid4().hex}"
    docs.withColumn(number, F.monotonically_increasing_id()).write.parquet(folder)
    numbered = spark.read.parquet(folder)
    found = repeated_passages(numbered.select(F.col(id_column).alias("id"), F.col(number).alias("row"), F.col(text_column).cast("binary").alias("text")))
    gone = found.where("removed").groupBy(F.col("row").alias(of)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    joined = numbered.join(gone, F.col(number) == F.col(of), "left").select(*docs.columns, spans)
    return joined.mapInArrow(lambda batches: _strip_batches(batches, text_column, spans), docs.schema)
