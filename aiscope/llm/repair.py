"""Repair of conversation structure by weighted CYK parsing over spans of rows.

A conversation is legal when its roles' initials read ``(s?(ua)+)?``.  The
repair grammar is in Chomsky normal form: for states p, q of what has been
said, ``N[p,q]`` derives the edits of a span of rows that lead from p to q.

* ``N[p,q] -> N[p,r] N[r,q]``, over two neighbouring spans
* ``N[p,q] -> edit of one row``: keep, rerole or delete
* ``N[p,q] -> nothing``: inserted turns, closed into the cells of single rows

A cell holds the least (cost, audit) of its span, cells are combined bottom-up
by span length, and equal spans of different conversations share them.  Among
edits of one span and one cost none is a prefix of another (it would lack a row
or pay for an insertion), so the least audit of a whole is made of least audits
of its parts, and a conversation longer than ``SPAN`` rows may be joined from
spans end to end.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
#: What may be said next, by state: the initial and the state after it.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows whose spans are all parsed together; longer conversations are joined from such spans.
SPAN = 16
#: Cells remembered by a task.
MEMORY = 100_000
#: A prefix that costs so much more than another is in no cheapest repair: whatever follows it, the other can follow with two insertions and a deletion more.
HOPELESS = 2 * INSERT + DELETE + TRUNCATED + 1
#: White space that ends no text.
SPACES = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """``N[p,q] -> N[p,r] N[r,q]``: the least (cost, audit) for each p and q, also against those in ``into``."""
    out = {} if into is None else into
    for (p, r), (cost, audit) in left.items():
        for q in range(r, 4) if r < USER else (USER, ASSISTANT):
            if (more := right.get((r, q))) is not None:
                total = cost + more[0]
                best = out.get((p, q))
                if best is None or total < best[0] or (total == best[0] and audit + more[1] < best[1]):
                    out[p, q] = (total, audit + more[1])
    return out


def insertion_closure() -> Cell:
    """The cheapest insertions that lead from p to q."""
    cells: Cell = {(p, p): (0, "") for p in NEXT}
    step = {(p, q): (INSERT, "I") for p, after in NEXT.items() for initial, q in after.items() if initial in ROLE}
    for _ in NEXT:
        cells = joined(cells, step, dict(cells))
    return cells


def terminal(symbol: str) -> Cell:
    """The edits of one row: ``x`` must go, else its initial (``o``: another), in upper case if the row is truncated."""
    cells: Cell = {(p, p): (DELETE, "D") for p in NEXT}
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for p, after in NEXT.items():
            for initial, q in after.items():
                if initial == symbol.lower():
                    cells[p, q] = (KEEP + extra, "K")
                elif initial in ROLE:
                    cells[p, q] = (REROLE + extra, "R")
    return cells


class Parser:
    """Cells by the symbols of their span."""

    def __init__(self):
        self.closure = insertion_closure()
        self.cells: dict[str, Cell] = {}

    def parse(self, symbols: str) -> Cell:
        """The cell of a span of one row or more, from those of all shorter spans within."""
        if len(self.cells) > MEMORY:
            self.cells.clear()
        cells = self.cells
        for length in range(1, len(symbols) + 1):
            for i in range(len(symbols) - length + 1):
                span = symbols[i : i + length]
                if span in cells:
                    continue
                if length == 1:
                    cells[span] = joined(joined(self.closure, terminal(span)), self.closure)
                    continue
                found: Cell = {}
                for k in range(1, length):
                    joined(cells[span[:k]], cells[span[k:]], found)
                cells[span] = found
        return cells[symbols]


class Path:
    """The best edits from START to a state: those that all paths share have been taken off ``audit``."""

    def __init__(self, cost: int, audit: str, shape: str, digest):
        self.cost, self.audit, self.shape, self.digest = cost, audit, shape, digest


def apply_edits(audit: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """(initial, role, text) of every row that the edits leave, from a state."""
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else next(x for x in NEXT[state] if x in ROLE)
        state = NEXT[state][initial]
        yield initial, role if edit == "K" else ROLE[initial], text


class Conversation:
    """The running repair of one conversation, whose rows come in order.

    Memory is that of the rows of one span, and of the edits: a digest for each
    state goes along, so that texts need not be kept until the end.
    """

    def __init__(self, key, parser: Parser):
        self.key, self.parser = key, parser
        self.turns = [None, None, 0]  # least, greatest, distinct
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.rows: list[tuple[str, str]] = []
        self.symbols = ""
        self.done: list[tuple[str, str]] = []  # edits and shape that all paths share
        self.said = False  # is there a row that all paths share?
        self.paths = {START: Path(0, "", "", hashlib.sha256())}

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            low, high, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != high)]
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        kind = initial if initial in ("s", "u", "a") else "o"
        self.symbols += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        self.rows.append((role, text))
        if len(self.rows) == SPAN:
            self.extend(range(4))

    def extend(self, wanted) -> None:
        """Lead all paths over the waiting rows, to the states wanted."""
        cell = self.parser.parse(self.symbols) if self.rows else self.parser.closure
        best: dict[int, tuple[int, str, int, str]] = {}
        for p, path in self.paths.items():
            for q in wanted:
                if (p, q) in cell:
                    cost, audit = cell[p, q]
                    offer = (path.cost + cost, path.audit + audit, p, audit)
                    if q not in best or offer[:2] < best[q][:2]:
                        best[q] = offer
        least = min(offer[0] for offer in best.values())
        paths = {}
        for q, (cost, whole, p, audit) in best.items():
            if cost > least + HOPELESS:
                continue
            digest, shape = self.paths[p].digest.copy(), self.paths[p].shape
            first = not (shape or self.said)
            for initial, role, text in apply_edits(audit, self.rows, p):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                shape, first = shape + initial, False
            paths[q] = Path(cost, whole, shape, digest)
        shared = [os.path.commonprefix([getattr(p, name) for p in paths.values()]) for name in ("audit", "shape")]
        self.done.append((shared[0], shared[1]))
        self.said |= bool(shared[1])
        for path in paths.values():
            path.audit, path.shape = path.audit[len(shared[0]) :], path.shape[len(shared[1]) :]
        self.paths, self.rows, self.symbols = paths, [], ""

    def end(self) -> tuple:
        self.extend(FINAL)
        best = min(self.paths.values(), key=lambda p: (p.cost, p.audit))
        low, high, n = self.turns
        audit, shape = ("".join(x) for x in zip(*self.done, (best.audit, best.shape)))
        return (self.key, 0 if low is None else high - low + 1 - n, *self.faults.values(), self.illegal, best.cost, audit, best.digest.hexdigest(), shape)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repair_batches(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    parser, now, found, weight = Parser(), None, [], 0

    def written() -> pa.RecordBatch:
        columns = list(zip(*found))
        arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]] + [pa.array(c, pa.string()) for c in columns[7:]]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *COUNTS, "audit", "repaired_sha256", "shape"])

    for batch in batches:
        for key, turn, role, text, fault, present in zip(*(batch.column(n).to_pylist() for n in ("_conv", "_turn", "_role", "_text", "_fault", "_present"))):
            if now is None or key != now.key:
                if now is not None:
                    found.append(now.end())
                    weight += len(found[-1][-3])
                now = Conversation(key, parser)
            if present:
                now.add(turn, role, text, fault)
            if len(found) >= 4096 or weight > 1 << 22:
                yield written()
                found, weight = [], 0
    if now is not None:
        found.append(now.end())
        yield written()


def with_faults(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``_conv, _turn, _role, _text, _present, _fault, _again`` of each row, dealt by conversation and in order within it.

    The order is by turn (nulls first), then role, text and copy.  A duplicate
    is told by its place among the rows of its conversation with its role and text.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    out = rows.select(F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"), (F.lit(True) if present is None else present).alias("_present"))
    out = out.repartition("_conv")
    same = Window.partitionBy("_conv", "_role", "_text", "_present").orderBy(F.col("_turn").asc_nulls_first())
    out = out.withColumn("_again", F.row_number().over(same))
    tail = F.rtrim(F.col("_text"), F.lit(SPACES))
    fault = F.when(tail == "", "blank").when(F.col("_again") > 1, "duplicate").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated")
    return out.withColumn("_fault", fault)


def _order() -> list[Column]:
    return [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("_again")]


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation of ``conv_id, turn, role, text``: its faults and its cheapest repair.

    ``gaps, blank, duplicate, truncated, illegal, cost`` (long), ``audit`` (the
    edits' initials), ``repaired_sha256`` (of ``role:text`` lines) and ``shape``
    (the repaired roles' initials).  Rows for which ``present`` is not true only
    make their conversation known; one without other rows has zeros, an empty
    audit and the digest of nothing.  Null roles and texts count as one space,
    null turns come first, a null conv_id is a conversation like any other,
    repeated rows are duplicates of the first; other columns may have any name.

    A digest reads a conversation in order, so each conversation is one sorted
    stream within a task: the task holds some rows of it, never all.
    """
    ready = with_faults(conversations, None if present is None else F.coalesce(present, F.lit(False)))
    ready = ready.sortWithinPartitions("_conv", *_order())
    kind = conversations.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{n} long' for n in COUNTS)}, audit string, repaired_sha256 string, shape string"
    ready = ready.select("_conv", "_turn", "_role", "_text", "_fault", "_present")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        yield from _repair_batches(_chain(first, batches), first.schema.field("_conv").type)

    return ready.mapInArrow(run, schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows that the cheapest repairs leave: ``conv_id, place, turn, edit, role, text``; an inserted row has no turn."""
    edits = repair(conversations).select(F.col("conv_id").alias("_conv"), "shape", F.posexplode(F.split("audit", "")).alias("_at", "edit")).where("edit <> ''")
    so_far = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumns({"_row": F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(so_far), "place": F.sum(F.when(F.col("edit") == "D", 0).otherwise(1)).over(so_far)}).where("edit <> 'D'")
    rows = with_faults(conversations)
    rows = rows.select(F.col("_conv").alias("_of"), "_turn", "_role", "_text", F.row_number().over(Window.partitionBy("_conv").orderBy(*_order())).alias("_n"))
    both = edits.join(rows, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_n") == F.col("_row")) & (F.col("edit") != "I"), "left")
    said = F.when(F.col("edit") == "K", F.col("_role")).when(F.substr("shape", F.col("place").cast("int"), F.lit(1)) == "u", "user").otherwise("assistant")
    return both.select(F.col("_conv").alias("conv_id"), F.col("place").cast("long").alias("place"), F.col("_turn").alias("turn"), "edit", said.alias("role"), F.coalesce("_text", F.lit("")).alias("text"))


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with planted faults, and whether each is still there.

    By crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1),
    rid of its sentence ends (2), repeated (3) or given the role user (4).
    Nulls count as one space.
    """
    conv, turn, role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn", "role", "text"))
    kind = F.col("_kind")
    out = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat_ws(":", conv, turn).cast("binary")) % 20).alias("_kind"))
    out = out.withColumns({"text": F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(kind == 4, "user").otherwise(F.col("role"))})
    out = out.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return out.drop("_copy"), kind != 0
