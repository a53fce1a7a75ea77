"""BPE encoding and decoding of whole text columns, by the file format of the tokenizers library.

Pre-tokens that a task has not met yet are merged together: the symbols of all
of them lie in one flat array.  Each round finds the rank of every changed
adjacent pair by binary search over the sorted pair keys, takes the lowest rank
of each word by a segmented minimum, and merges all places of that pair at
once.  Words without a mergeable pair leave the array.  A vocabulary in which a
merge could make way for an earlier one is merged one place at a time.

Ids, written ids and decoded bytes are rows of flat tables, gathered by index.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aiscope.llm.bytebpe import pieces, read_ranks
from aiscope.llm.words import blocks

#: Rank of a pair that no merge joins.
NONE = np.iinfo(np.int32).max
#: Pre-tokens of more symbols are merged with a heap; their rounds would take time by length times merges.
LONG = 512
#: Bounds of a task's table of known pre-tokens, which is emptied beyond them.
KNOWN, KNOWN_BYTES = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Rows:
    """Byte strings or id lists of various lengths, one after another in a flat array."""

    def __init__(self, items: list, kind: type):
        self.size = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(items), dtype=np.uint8) if kind is bytes else np.array([x for item in items for x in item], dtype=np.int32)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` one after another, and where each ends."""
        size = self.size[at]
        ends = np.cumsum(size)
        place = np.repeat(self.start[at] - (ends - size), size)
        place += np.arange(len(place))
        return self.flat[place], ends


@dataclass
class Model:
    """What tasks need of a tokenizer file."""

    keys: np.ndarray  # left id << 32 | right id of each merge, sorted
    ranks: np.ndarray  # its place in the list of merges
    made: np.ndarray  # the id that it makes
    of_byte: np.ndarray  # the id of each single byte
    tokens: list[bytes]  # by id; b"" where an id is free
    added: dict[bytes, int]  # texts that are one token wherever they stand
    at_once: bool  # merging all places of a pair at once gives what merging one by one would

    @classmethod
    def parse(cls, content: bytes) -> Model:
        file = json.loads(content)
        model, pre, decoder = file["model"], file.get("pre_tokenizer") or {}, file.get("decoder") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model.get("type", "BPE") != "BPE" or not plain or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError("only plain byte-level BPE files are supported: no normalizer, prefixes, suffixes or dropout")
        plain_added = [t for t in file.get("added_tokens", []) if not (t.get("single_word") or t.get("lstrip") or t.get("rstrip"))]
        if len(plain_added) < len(file.get("added_tokens", [])):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        letters, vocab = byte_alphabet(), model["vocab"]
        if not all(c in vocab for c in letters):
            raise ValueError("the vocabulary must have a token for each byte")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank_of: dict[str, int] = {}
        at_once = True
        for rank, (left, right) in enumerate(merges):
            at_once &= all(len(x) == 1 or rank_of.get(x, NONE) < rank for x in (left, right)) and left + right not in rank_of
            rank_of[left + right] = rank
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64).reshape(-1)
        order = np.argsort(keys)
        tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in plain_added)]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        added = {t["content"].encode(): t["id"] for t in plain_added if t["content"]}
        for text, i in added.items():
            tokens[i] = text
        of_byte = np.zeros(256, dtype=np.int32)
        for letter, byte in letters.items():
            of_byte[byte] = vocab[letter]
        return cls(keys[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in merges], dtype=np.int32)[order], of_byte, tokens, added, at_once)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id made) of each pair, by binary search."""
        if not len(self.keys):
            return np.full(len(left), NONE, dtype=np.int32), np.zeros(len(left), dtype=np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]


def merge_words(words: list[bytes], model: Model) -> list[np.ndarray]:
    """The ids of each word; words must not be empty."""
    out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
    symbols = model.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    names = np.arange(len(words))  # of the words still in the array
    rank, made = np.full(len(symbols), NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(symbols), dtype=bool)
    inner[last] = False  # the last symbol of a word begins no pair
    at = np.flatnonzero(inner)
    rank[at], made[at] = model.find(symbols[at], symbols[at + 1])
    while len(names):
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(rank, starts)
        done = least == NONE
        if done.any():
            for k in np.flatnonzero(done).tolist():
                out[names[k]] = symbols[starts[k] : starts[k] + sizes[k]].copy()
            stays = np.repeat(~done, sizes)
            symbols, rank, made = symbols[stays], rank[stays], made[stays]
            names, sizes, least = names[~done], sizes[~done], least[~done]
            if not len(names):
                break
            starts = np.cumsum(sizes) - sizes
        chosen = np.flatnonzero(rank == np.repeat(least, sizes))
        word = np.searchsorted(starts, chosen, side="right") - 1
        if model.at_once:  # of places that overlap, as in aaa, every other one counts from the left
            begins = np.concatenate(([True], np.diff(chosen) != 1))
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            taken = (np.arange(len(chosen)) - run) % 2 == 0
        else:
            taken = np.concatenate(([True], np.diff(word) != 0))
        chosen, word = chosen[taken], word[taken]
        symbols[chosen] = made[chosen]
        gone = np.zeros(len(symbols), dtype=bool)
        gone[chosen + 1] = True
        rank[chosen] = NONE
        shift = np.cumsum(gone)
        symbols, rank, made = symbols[~gone], rank[~gone], made[~gone]
        chosen = chosen - shift[chosen]
        sizes = sizes - np.bincount(word, minlength=len(sizes))
        starts = np.cumsum(sizes) - sizes
        # pairs that begin at a merged symbol or just before one
        at = np.unique(np.concatenate((chosen, chosen - 1)))
        ends = np.zeros(len(symbols) + 1, dtype=bool)
        ends[starts + sizes - 1] = True
        at = at[(at >= 0)]
        at = at[~ends[at]]
        rank[at], made[at] = model.find(symbols[at], symbols[at + 1])
        rank[starts + sizes - 1] = NONE
    return out


def merge_long(word: bytes, pairs: dict[tuple[int, int], tuple[int, int]], model: Model) -> np.ndarray:
    """The same for one long word: a heap of pairs over a linked list of symbols."""
    symbols = model.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    offers = [(*pairs[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
    heap = [(rank, i, made, a, b) for rank, made, i, a, b in offers]
    heapq.heapify(heap)
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j], after[i] = made, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (found := pairs.get(p := (symbols[k], symbols[after[k]]))):
                heapq.heappush(heap, (found[0], k, found[1], *p))
    return np.array([s for s in symbols if s >= 0], dtype=np.int32)


class Encoder:
    """A task's tables: known pre-tokens with their ids, and the bytes and digits of each id."""

    def __init__(self, model: Model):
        self.model = model
        self.bytes_of = Rows(model.tokens, bytes)
        self.digits_of = Rows([b"%d," % i for i in range(len(model.tokens))], bytes)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.forget()

    def forget(self) -> None:
        self.code: dict = {}  # pre-token -> its row in start and size
        self.rows = 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def learn(self, words: list[bytes]) -> None:
        short = [w for w in words if len(w) <= LONG]
        found = dict(zip(short, merge_words(short, self.model)))
        for word in words:
            if len(word) > LONG:
                if not self.pairs:
                    lefts, rights = (self.model.keys >> 32).tolist(), (self.model.keys & 0xFFFFFFFF).tolist()
                    self.pairs = dict(zip(zip(lefts, rights), zip(self.model.ranks.tolist(), self.model.made.tolist())))
                found[word] = merge_long(word, self.pairs, self.model)
        self.keep(list(found), list(found.values()))

    def keep(self, words: list[bytes], ids: list[np.ndarray]) -> None:
        first, n = self.rows, len(words)
        while first + n > len(self.start):
            self.start, self.size = np.concatenate((self.start, 0 * self.start)), np.concatenate((self.size, 0 * self.size))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=n)
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, 0 * self.flat))
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.start[first : first + n], self.size[first : first + n] = self.used + np.cumsum(size) - size, size
        self.used += total
        self.rows += n
        self.code.update(zip(words, range(first, first + n)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, and where each text's ids end."""
        cuts, added = self.added_places(data, offsets)
        found, counts, _ = pieces(data, cuts)
        if added:
            part = np.searchsorted(cuts[1:-1], [a for a, _ in added], side="right")  # the stretch that each added token is
            at = np.cumsum(counts) - counts
            for k, (_, text) in zip(part.tolist(), added):
                found[at[k]] = (text,)  # its pieces become one entry that is no bytes
                for i in range(at[k] + 1, at[k] + counts[k]):
                    found[i] = ()
        if self.rows > KNOWN or self.used > 16 * KNOWN:
            self.forget()
        new = dict.fromkeys(w for w in found if w not in self.code)
        plain = [w for w in new if isinstance(w, bytes)]
        if plain:
            self.learn(plain)
        special = [w for w in new if not isinstance(w, bytes)]
        if special:
            self.keep(special, [np.array([self.model.added[w[0]]] if w else [], dtype=np.int32) for w in special])
        codes = np.fromiter(map(self.code.__getitem__, found), dtype=np.int64, count=len(found))
        size = self.size[codes]
        ends = np.cumsum(size)
        place = np.repeat(self.start[codes] - (ends - size), size)
        place += np.arange(len(place))
        ids = self.flat[place]
        edge = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(cuts, offsets[1:])]  # pieces before each text's end
        ends = np.concatenate(([0], ends))[edge]
        for word in [w for w in new if len(w) > KNOWN_BYTES]:
            del self.code[word]
        return ids, ends

    def added_places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        """Offsets that also cut before and after each added token, and where these stand."""
        if not self.model.added:
            return offsets, []
        text, found = data.tobytes(), []
        if not any(t in text for t in self.model.added):
            return offsets, []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            at = low
            while at < high:
                hits = [(p, -len(t), t) for t in self.model.added if (p := text.find(t, at, high)) >= 0]
                if not hits:
                    break
                p, _, t = min(hits)
                found.append((p, t))
                at = p + len(t)
        cuts = [c for p, t in found for c in (p, p + len(t))]
        return np.unique(np.concatenate((offsets, np.array(cuts, dtype=np.int64)))) if cuts else offsets, found


def _source(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("_text"))
    return source, source.schema["doc_id"].dataType.simpleString()


def _shared(docs: DataFrame, path: str):
    """The parsed file as a broadcast variable: its size is that of a vocabulary, whatever the documents."""
    return docs.sparkSession.sparkContext.broadcast(Model.parse(read_ranks(path)))


def _digest_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model)
    nothing = hashlib.sha256(b"").hexdigest()
    for block in blocks(batches, "_text"):
        ids, ends = encoder.encode(block.data, block.offsets)
        written, digits = encoder.digits_of.gather(ids)
        text, letters = encoder.bytes_of.gather(ids)
        at = np.concatenate(([0], ends))
        digits, letters = np.concatenate(([0], digits))[at], np.concatenate(([0], letters))[at]
        written, text = memoryview(written), memoryview(text)
        one, two = [], []
        for a, b, c, d in zip(digits[:-1].tolist(), digits[1:].tolist(), letters[:-1].tolist(), letters[1:].tolist()):
            one.append(hashlib.sha256(written[a : b - 1]).hexdigest() if b > a else nothing)
            two.append(hashlib.sha256(shown(text[c:d])).hexdigest())
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(at)), pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def shown(data: memoryview) -> bytes | memoryview:
    """Bytes as UTF-8 text: what is no UTF-8 becomes U+FFFD."""
    try:
        str(data, "utf-8")
        return data
    except UnicodeDecodeError:
        return str(data, "utf-8", "replace").encode()


def encode_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row: encode, then decode the ids.

    Ids are joined by commas; the decoded text includes special tokens.  A null
    or empty text has no tokens and digests of nothing; null, repeated or string
    ids are kept as they are; other columns may have any name.
    """
    source, kind = _source(docs, id_column, text_column)
    model = _shared(docs, path)
    return source.mapInArrow(lambda batches: _digest_batches(batches, model.value), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model)
    for block in blocks(batches, "_text"):
        ids, ends = encoder.encode(block.data, block.offsets)
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each text; none for a null or empty one."""
    source, kind = _source(docs, id_column, text_column)
    model = _shared(docs, path)
    return source.mapInArrow(lambda batches: _id_batches(batches, model.value), f"doc_id {kind}, ids array<int>")


def _text_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    bytes_of = Rows(model.tokens, bytes)
    for batch in batches:
        texts = []
        for ids in batch.column("ids"):
            known = np.array([i for i in ids.as_py() or () if i is not None and 0 <= i < len(model.tokens)], dtype=np.int64)
            texts.append(bytes_of.gather(known)[0].tobytes().decode("utf-8", "replace") if ids.is_valid else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text, unknown ones are left out."""
    source = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    model = _shared(encoded, path)
    return source.mapInArrow(lambda batches: _text_batches(batches, model.value), f"doc_id {kind}, text string")
