"""Byte-level BPE encoding and decoding of whole text columns.

Pre-tokenisation uses no regex.  Code points become symbols of a small
alphabet (letter, number, space, other, ... with one symbol of lookahead); a
symbol is a transition function on the states of an automaton, and function
composition is associative, so the state before every symbol comes from a
blocked prefix scan over arrays.  Token starts follow from state and symbol.
The slices go to a cache of merged pieces; each piece keeps its byte length
per id, so that decoding finds every id's bytes by offset.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aiscope.llm.words import blocks

# Symbols.  APOS2 and APOS3: an apostrophe that begins a contraction of two or three code points.
LETTER, NUMBER, OTHER, SPACE_GAP, SPACE_LAST, WHITE_GAP, WHITE_LAST, APOS2, APOS3, RESET = range(10)
# States after a symbol.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AT_SPACE, LEFT2, LEFT1, CLOSED = range(9)
N_STATES = 9


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        table[point] = {"L": 1, "N": 2}.get(kind, 0)
    # the fixed set of code points with the property White_Space
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = 3
    return table


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """next_state[symbol, state] and begins[symbol, state]: does a token begin at this symbol?"""
    step = np.zeros((10, N_STATES), dtype=np.uint8)
    begins = np.zeros((10, N_STATES), dtype=bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for state in range(N_STATES):
        for symbol in range(10):
            if symbol == RESET:
                step[symbol, state] = BEGIN
            elif state in (LEFT2, LEFT1):  # inside a contraction
                step[symbol, state] = LEFT1 if state == LEFT2 else CLOSED
            elif symbol in (SPACE_GAP, WHITE_GAP):  # more white space follows, or the text ends
                step[symbol, state] = IN_WHITE
                begins[symbol, state] = state not in (IN_WHITE, AT_SPACE)
            elif symbol in (SPACE_LAST, WHITE_LAST):  # the last before another symbol is a token's first or a token
                step[symbol, state] = AT_SPACE if symbol == SPACE_LAST else CLOSED
                begins[symbol, state] = True
            elif symbol in (APOS2, APOS3) and state not in (IN_OTHER, AT_SPACE):
                step[symbol, state] = LEFT1 if symbol == APOS2 else LEFT2
                begins[symbol, state] = True
            else:
                to = run.get(symbol, IN_OTHER)
                step[symbol, state] = to
                begins[symbol, state] = state not in (to, AT_SPACE)
    return step, begins


def states_before(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol, from BEGIN: a prefix scan of composed transition functions.

    Blocks of ``width`` symbols compose their functions side by side; the
    blocks' functions are scanned in the same way; then each block replays from
    its own first state.
    """
    step, _ = transitions()
    n = len(symbols)
    if n <= width:
        out, state = np.empty(n, dtype=np.uint8), BEGIN
        for i, symbol in enumerate(symbols.tolist()):
            out[i] = state
            state = step[symbol, state]
        return out
    rows = -(-n // width)
    padded = np.full(rows * width, RESET, dtype=np.uint8)
    padded[:n] = symbols
    table = np.ascontiguousarray(padded.reshape(rows, width).T)
    maps = step[table[0]]  # rows x states: the function of the block so far
    flat = step.reshape(-1)
    for column in table[1:]:
        maps = flat[(column.astype(np.int64) * N_STATES)[:, None] + maps]
    first = _scan_maps(maps)
    out = np.empty((width, rows), dtype=np.uint8)
    state = first
    for i, column in enumerate(table):
        out[i] = state
        state = flat[column.astype(np.int64) * N_STATES + state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def _scan_maps(maps: np.ndarray) -> np.ndarray:
    """The state before each block: exclusive scan of functions by doubling, applied to BEGIN."""
    total, shift = maps.copy(), 1
    while shift < len(total):
        later = np.take_along_axis(total[shift:], total[:-shift].astype(np.int64), axis=1)
        total = np.concatenate((total[:shift], later))
        shift *= 2
    return np.concatenate(([BEGIN], total[:-1, BEGIN])).astype(np.uint8)


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin; ``firsts`` are the positions at which a text begins."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = point_classes()[points]
    starts_text = np.zeros(n + 1, dtype=bool)
    starts_text[firsts] = True
    starts_text[n] = True
    ends_text = starts_text[1:]  # the symbol is the last of its text
    white = kind == 3
    goes_on = np.zeros(n, dtype=bool)
    goes_on[:-1] = ~white[1:]
    last = white & goes_on & ~ends_text
    symbols = np.array([OTHER, LETTER, NUMBER, WHITE_GAP], dtype=np.uint8)[kind]
    space = points == 32
    symbols[white & space & ~last] = SPACE_GAP
    symbols[last & ~space] = WHITE_LAST
    symbols[last & space] = SPACE_LAST
    at = np.flatnonzero(points == 39)
    if len(at):
        nxt = np.where(at + 1 < n, points[np.minimum(at + 1, n - 1)], 0)
        nxt[ends_text[at]] = 0
        after = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        after[ends_text[at] | ends_text[np.minimum(at + 1, n - 1)]] = 0
        symbols[at[np.isin(nxt, [ord(c) for c in "stmd"])]] = APOS2
        three = (np.isin(nxt, [ord("r"), ord("v")]) & (after == ord("e"))) | ((nxt == ord("l")) & (after == ord("l")))
        symbols[at[three]] = APOS3
    # a reset symbol before each text makes the automaton forget the one before
    inner = np.unique(firsts[firsts < n])
    place = np.arange(n) + np.searchsorted(inner, np.arange(n), side="right")
    spread = np.full(n + len(inner), RESET, dtype=np.uint8)
    spread[place] = symbols
    before = states_before(spread)[place]
    _, begins = transitions()
    return np.flatnonzero(begins[symbols, before])


class Vocabulary:
    """Ranks of a byte-level BPE and a bounded cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 400_000):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.cache_size = cache_size

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token})

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the adjacent pair of the lowest rank is merged until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = ranks.get, 1 << 60
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for pieces where scanning all pairs each time is slow."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins at i; 0 once it is merged into another
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if end[i])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece)
            if len(piece) <= 64:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Written(dict):
    """piece -> its decimal ids joined by a space; filled on demand and bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: bytes) -> bytes:
        ids = b" ".join(b"%d" % i for i in self.vocabulary.merge(piece))
        if len(piece) <= 64:
            if len(self) >= self.vocabulary.cache_size:
                self.clear()
            self[piece] = ids
        return ids


class _Counted(dict):
    """piece -> number of its ids; filled on demand and bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: bytes) -> int:
        n = len(self.vocabulary.merge(piece))
        if len(piece) <= 64:
            if len(self) >= 2 * self.vocabulary.cache_size:
                self.clear()
            self[piece] = n
        return n


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All pre-tokens of a block of texts, the number of them in each text, and their byte starts."""
    text = data.tobytes()
    n = len(offsets) - 1
    if not len(data):
        return [], np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    leads = (data & 0xC0) != 0x80
    byte_at = np.flatnonzero(leads)  # byte where each code point begins
    firsts = np.searchsorted(byte_at, offsets[:-1])
    starts = byte_at[token_starts(points, firsts)]
    at = [*starts.tolist(), len(data)]
    found = list(map(text.__getitem__, map(slice, at[:-1], at[1:])))
    return found, np.diff(np.searchsorted(starts, offsets)), starts


@lru_cache(maxsize=2)
def load_vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary.parse(content)


def read_ranks(path: str) -> bytes:
    """The rank file at ``path``: a local path on the driver, or any address that Arrow's file systems open."""
    if "://" in path:
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as source:
            return source.read()
    with open(path, "rb") as source:
        return source.read()


def _encoded(block, vocabulary: Vocabulary, written: _Written) -> Iterator[tuple[bytes, bytes]]:
    """(ids written in decimal, decoded bytes) of each text."""
    found, sizes, _ = pieces(block.data, block.offsets)
    ids = list(map(written.__getitem__, found))
    first = 0
    tokens = vocabulary.tokens
    for size in sizes.tolist():
        line = b" ".join(ids[first : first + size])
        first += size
        yield line, b"".join([tokens[i] for i in map(int, line.split())])


def _digest_batches(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    vocabulary = load_vocabulary(ranks)
    written = _Written(vocabulary)
    for block in blocks(batches, "_text"):
        counts, ids, texts = [], [], []
        for line, text in _encoded(block, vocabulary, written):
            counts.append(line.count(b" ") + 1 if line else 0)
            ids.append(hashlib.sha256(line).hexdigest())
            texts.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _source(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("_text"))
    return source, source.schema["doc_id"].dataType.simpleString()


def encode_digests(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row: encode, then decode the ids.

    A null text counts as empty: no tokens, digests of nothing.
    """
    source, kind = _source(docs, id_column, text_column)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(lambda batches: _digest_batches(batches, ranks.value), schema)


def _id_batches(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    vocabulary = load_vocabulary(ranks)
    for block in blocks(batches, "_text"):
        found, sizes, _ = pieces(block.data, block.offsets)
        per_piece = [vocabulary.encode_piece(p) for p in found]
        ids = np.array([i for piece in per_piece for i in piece], dtype=np.int32)
        lengths = np.array([len(vocabulary.tokens[i]) for i in ids.tolist()], dtype=np.int32)
        each = np.array([len(p) for p in per_piece], dtype=np.int64)
        edges = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(sizes)))]
        begin = np.concatenate(([0], np.cumsum(lengths)))
        starts = begin[:-1] - np.repeat(begin[edges[:-1]], np.diff(edges))
        lists = lambda v: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, pa.int32()))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists(ids), lists(starts)], names=["doc_id", "ids", "starts"])


def encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, starts``: token ids and the byte offset at which each begins; empty arrays for null texts."""
    source, kind = _source(docs, id_column, text_column)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return source.mapInArrow(lambda batches: _id_batches(batches, ranks.value), f"doc_id {kind}, ids array<int>, starts array<int>")


def _decode_batches(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    vocabulary = load_vocabulary(ranks)
    for batch in batches:
        texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids give null bytes."""
    source = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return source.mapInArrow(lambda batches: _decode_batches(batches, ranks.value), f"doc_id {kind}, bytes binary")


def _count_batches(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    counted = _Counted(load_vocabulary(ranks))
    for block in blocks(batches, "_text"):
        found, sizes, _ = pieces(block.data, block.offsets)
        each = np.fromiter(map(counted.__getitem__, found), dtype=np.int64, count=len(found))
        total = np.concatenate(([0], np.cumsum(each)))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(total[edges[1:]] - total[edges[:-1]])], names=["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for every row; a null text has none."""
    source, kind = _source(docs, id_column, text_column)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return source.mapInArrow(lambda batches: _count_batches(batches, ranks.value), f"doc_id {kind}, n_tokens long")
