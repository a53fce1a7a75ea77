"""Secret spans in text, with multipart credentials linked by an interval join.

Strong candidates stand alone.  Weak candidates (a short assigned value, a
mixed token of the length of a cloud key) are reported only when the two other
complementary parts of a credential, or the one that such a token needs, lie
within ``scope`` code points of them: parts are intervals, and the join finds
for each weak part the nearest complementary interval before and after it.
A credential lies within one document, so the join needs no shuffle: each row
holds all intervals that it can meet, sorted, and is searched by bisection.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base spans; the second group of "assign" needs 12 characters.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # a maximal run; shorter ones are dropped anyway
#: Order of kinds for spans that start together.
KINDS = ("assign", "access", "hex", "endpoint", "key", "user", "weak")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

# Parts of multipart credentials.
ADDRESS = re.compile(rb"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp)://[^\s\"'<>\\]{4,}")
#: A whole run of the bytes of host names, taken once: what it ends in is looked for afterwards, so that no text is scanned again from each of its places.
HOST_RUN = re.compile(rb"(?<![a-z0-9.-])[a-z0-9.-]++")
HOST_END = re.compile(rb"(?<=[a-z0-9-])\.(?:amazonaws\.com|windows\.net|googleapis\.com)(?![A-Za-z0-9_])")
CLOUD = (b".amazonaws.com", b".windows.net", b".googleapis.com")
USER = re.compile(rb"\b(?:user(?:name)?|login|account|client_?id|access_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.+-]{3,})", re.IGNORECASE)
KEY_LIKE = re.compile(rb"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")

#: A document without any of these bytes has neither a base span nor a weak part; hex runs are looked for apart.
HINT = re.compile(rb"passw|secret|token|api_?key|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/]{32}", re.IGNORECASE)


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, leftmost and non-overlapping per kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def near(starts: np.ndarray, ends: np.ndarray, start: int, end: int, scope: int) -> bool:
    """Does an interval of those sorted by start, not overlapping each other, lie within ``scope`` of ``start..end``?"""
    after = int(np.searchsorted(starts, start, side="left"))
    if after < len(starts) and starts[after] - end <= scope:
        return True
    return after > 0 and start - ends[after - 1] <= scope


def endpoint_spans(text: bytes) -> list[tuple[int, int]]:
    """Addresses, and host names of cloud services outside them; in time that follows the length of the text."""
    found = [(m.start(), m.end()) for m in ADDRESS.finditer(text)]
    if not any(end in text for end in CLOUD):
        return found
    taken = [s for s, _ in found]
    for run in HOST_RUN.finditer(text):
        low, last = run.start(), None
        for last in HOST_END.finditer(text, low, min(run.end() + 1, len(text))):  # noqa: B007  the last one counts
            pass
        if last is None:
            continue
        if low and (text[low - 1 : low].isalnum() or text[low - 1] == 95):  # the first part belongs to a longer word
            low = min((p for p in (text.find(b".", low, last.start()), text.find(b"-", low, last.start())) if p >= 0), default=last.start())
        low = max(low, text.rfind(b"..", low, last.start()) + 1)
        low = last.start() - len(text[low : last.start()].lstrip(b".-"))
        k = bisect_left(taken, last.end())  # of the addresses
        if low < last.start() and not (k and found[k - 1][1] > low):
            found.append((low, last.end()))
    return sorted(found)


def in_points(text: bytes, *groups: list[tuple]) -> list[list[tuple]]:
    """Spans (start, end, ...) of bytes as spans of code points."""
    if text.isascii() or not any(groups):
        return list(groups)
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [[(int(point[s]), int(point[e]), *rest) for s, e, *rest in spans] for spans in groups]


def linked_spans(text: bytes, base: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """Weak candidates with their complementary parts within ``scope`` code points, and those parts; in code points."""
    short = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < ASSIGN_LENGTH]
    spans = sorted((s, e) for s, e, _ in base)
    starts, furthest = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    free = lambda m: not (k := bisect_left(starts, m.end())) or furthest[k - 1] <= m.start()  # noqa: E731  no base span overlaps it
    tokens = [(m.start(), m.end()) for m in KEY_LIKE.finditer(text) if free(m)]
    if not short and not tokens:
        return []
    endpoints = endpoint_spans(text)
    access = [(s, e) for s, e, kind in base if kind == "access"]
    users = [(m.start(), m.end()) for m in USER.finditer(text)]
    short, tokens, endpoints, access, users = in_points(text, short, tokens, endpoints, access, users)

    def sides(parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        table = np.array(sorted(parts), dtype=np.int64).reshape(-1, 2)
        return table[:, 0], table[:, 1]

    by = {"endpoint": sides(endpoints), "access": sides(access), "user": sides(users)}
    found: set[tuple[int, int, str]] = set()

    def partners(start: int, end: int, kind: str) -> list[tuple[int, int, str]]:
        starts, ends = by[kind]
        low, high = np.searchsorted(ends, start - scope), np.searchsorted(starts, end + scope, side="right")
        return [(int(starts[i]), int(ends[i]), kind) for i in range(low, high)]

    for start, end in tokens:  # the secret half of an access key pair
        if near(*by["access"], start, end, scope):
            found.add((start, end, "key"))
            found.update(x for x in partners(start, end, "endpoint"))
    for start, end in short:  # a weak value needs a user and an endpoint
        if near(*by["user"], start, end, scope) and near(*by["endpoint"], start, end, scope):
            found.add((start, end, "weak"))
            found.update(partners(start, end, "user"))
            found.update(partners(start, end, "endpoint"))
    return list(found)


def scan(text: bytes, scope: int = 400) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, in code points, by start and then kind."""
    if not HINT.search(text):
        return [], []
    base = base_spans(text)
    linked = linked_spans(text, base, scope)
    [base] = in_points(text, base)
    spans = base + linked
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=order), sorted(spans, key=order)


SCHEMA = "kinds array<string>, starts array<long>, ends array<long>, n_base int"


def _scan_batches(batches: Iterator[pa.RecordBatch], scope: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, starts, ends, sizes, hits = [], [], [], [], {k: [] for k in ("assign", "access", "hex")}
        digests, written = [], []
        nothing = hashlib.sha256(b"").hexdigest()
        for value in batch.column("_text"):
            text = value.as_py()
            base, spans = scan(text, scope) if text else ([], [])
            kinds.append([k for _, _, k in spans])
            starts.append([s for s, _, _ in spans])
            ends.append([e for _, e, _ in spans])
            sizes.append(len(base))
            for kind, n in hits.items():
                n.append(sum(k == kind for _, _, k in base) if base else 0)
            join = lambda x: ",".join(f"{k}:{s}:{e}" for s, e, k in x)
            digests.append(hashlib.sha256(join(base).encode()).hexdigest() if base else nothing)
            written.append(join(spans))
        columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_text"]
        names = [n for n in batch.schema.names if n != "_text"]
        arrays = [pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
        arrays += [pa.array(hits[k], pa.int64()) for k in hits] + [pa.array(digests), pa.array(written)]
        yield pa.RecordBatch.from_arrays(columns + arrays, names=names + ["kinds", "starts", "ends", *[f"n_{k}" for k in hits], "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = 400) -> DataFrame:
    """One row per document: the id as ``doc_id``, span arrays (kinds, starts, ends) and their digest columns.

    Offsets are code points, the end exclusive.  A null or empty text has no
    spans; a null id and repeated rows are kept as they are, ids of any type.
    Only the id and the text are read, so other columns may have any name.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, kinds array<string>, starts array<long>, ends array<long>, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return source.mapInArrow(lambda batches: _scan_batches(batches, scope), schema)


def _redact_batches(batches: Iterator[pa.RecordBatch], text_column: str, scope: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_column)
        out = []
        for value in batch.column(at):
            text = value.as_py()
            _, spans = scan(text.encode("utf-8", "surrogatepass"), scope) if text else ([], [])
            if spans:
                parts, done = [], 0
                for start, end, kind in spans:
                    if end <= done:
                        continue
                    parts += [text[done : max(start, done)], f"[{kind.upper()}]" if start >= done else ""]
                    done = end
                text = "".join(parts) + text[done:]
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def redact_secrets(docs: DataFrame, text_column: str = "text", scope: int = 400) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one; nulls stay null; other columns may have any name."""
    return docs.mapInArrow(lambda batches: _redact_batches(batches, text_column, scope), docs.schema)
