"""Quality rules as a short-circuit cascade of native column expressions.

Every rule is a reject predicate.  The cascade is one CASE expression with a
branch for each rule, and a rule's own features are computed inside its branch:
a row that one rule rejects is spared the features of all later ones.  On a
sample the time that each rule takes and the share of rows that it rejects are
estimated, and rules are tried by rejections per cost.  The order changes the
work and the rule that is named, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column  # of the text ``_t`` and the columns of the base


def _kept_chars(keep: str) -> Column:
    """Code points of the text in the class ``keep``."""
    return F.length(F.regexp_replace("_t", f"[^{keep}]+", "")).cast("long")


def _lines() -> Column:
    return F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def rules() -> list[Rule]:
    """The method's own rules, tried on rows that pass the base; thresholds are meant to leave prose alone."""
    words, chars = F.col("n_words"), F.col("word_chars")
    letters = _kept_chars(r"\p{L}")
    return [
        Rule("symbols", F.col("n_symbols") * 20 > chars),
        Rule("word_length", (chars < words * 2) | (chars > words * 25)),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 0) & let(F.size(_lines()), lambda n: (n >= 3) & (F.col("n_dup_lines") * 10 > n * 3))),
        Rule("few_letters", letters * 2 < chars),
        Rule("shouting", let(F.struct(letters.alias("all"), _kept_chars(r"\p{Lu}").alias("upper")), lambda x: (x["all"] >= 40) & (x["upper"] * 2 > x["all"]))),
        Rule("exclamations", _kept_chars("!") * 5 > words),
        Rule("cut_lines", let(_lines(), lambda a: (F.size(a) >= 3) & (F.size(F.filter(a, lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"))) * 2 > F.size(a)))),
        Rule("bullets", let(_lines(), lambda a: (F.size(a) >= 5) & (F.size(F.filter(a, lambda x: x.rlike(r"^[\x20\x09]*[-*\u2022]"))) * 10 > F.size(a) * 9))),
    ]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever the optimizer puts it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in 5-word windows found twice or more, by 64-bit hashes of windows of 64-bit word hashes."""
    return F.when(F.size(words) >= 6, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_windows(h), _covered))).otherwise(0)


def _windows(h: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))


def _covered(windows: Column) -> Column:
    """Texts without an equal pair, by far the most, are settled by one distinct count; others sort their windows."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, lambda p: let(_equal_starts(p), _length_of))).otherwise(0)


def _equal_starts(p: Column) -> Column:
    """Sorted places of the windows that have an equal one, from pairs in order of hash."""
    equal = F.filter(p, lambda a, i: ((i > 0) & (a["x"] == F.get(p, i - 1)["x"])) | F.coalesce(a["x"] == F.get(p, i + 1)["x"], F.lit(False)))
    return F.sort_array(F.transform(equal, lambda a: a["i"]))


def _length_of(starts: Column) -> Column:
    """Places covered by stretches of five that begin at sorted starts."""
    more = F.transform(starts, lambda s, i: F.when(i > 0, F.least(F.lit(5), s - F.get(starts, i - 1))).otherwise(5))
    return F.aggregate(more, F.lit(0), lambda a, b: a + b)


def base(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The text ``_t``, the base counts and ``base_failed`` of every row; a null text counts as empty."""
    frame = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    words = let(F.array_remove(F.split("_t", SPACES), ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r")))
    again = let(_lines(), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    counts = [F.length(F.regexp_replace("_t", SPACES, "")).cast("long").alias("word_chars"), _kept_chars("#*$%&|<>").alias("n_symbols"), again.cast("long").alias("n_dup_lines")]
    frame = frame.select("doc_id", "_t", words.alias("_w"), *counts)
    frame = frame.select("doc_id", "_t", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return frame.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def estimate(docs: DataFrame, text_column: str = "text", sample_rows: int = 1000, tried: list[Rule] | None = None, repeats: int = 6) -> list[Estimate]:
    """Seconds and rejected share of each rule on about ``sample_rows`` rows, best gain first.

    Rows are drawn by a hash of their place, so no task gets the sample whole.
    A rule is timed over ``repeats`` evaluations of each row, less the time of
    reading the rows alone, and the better of two runs counts.  Only the order
    of the cascade depends on the sample.
    """
    tried = rules() if tried is None else tried
    share = min(1.0, sample_rows / max(1, docs.count()))
    place = F.xxhash64(F.monotonically_increasing_id())
    sample = base(docs.select(F.lit(0).alias("id"), F.col(text_column).alias("text")).where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))), "id").where(~F.col("base_failed")).cache()
    try:
        hits = lambda r: F.coalesce(r.rejects, F.lit(False)).cast("int")
        found = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(hits(r)).alias(f"r{i}") for i, r in enumerate(tried)]).first()
        again = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_again"))

        def seconds(value: Column) -> float:
            runs = []
            for _ in range(2):
                began = time.perf_counter()
                again.agg(F.sum(value)).first()
                runs.append(time.perf_counter() - began)
            return min(runs)

        alone = seconds(F.length("_t"))
        costs = [max(seconds(hits(r)) - alone, 1e-4) for r in tried]
    finally:
        sample.unpersist()
    made = [Estimate(r.name, costs[i], (found[f"r{i}"] or 0) / max(1, found["n"])) for i, r in enumerate(tried)]
    return sorted(made, key=lambda x: (-x.gain, x.cost))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: list[str] | None = None, tried: list[Rule] | None = None) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``rejected_by`` for every row.

    ``order`` names the rules in the order to try them; by default it is
    estimated on a sample.  Without words (null and empty texts) a row fails
    the base.  Repeated rows and null ids, of any type, are kept as they are.
    Only the id and the text are read, so other columns may have any name.
    Repeated windows and lines: windows are compared by 64-bit hashes, lines whole.
    """
    by_name = {r.name: r for r in (rules() if tried is None else tried)}
    order = order or [x.name for x in estimate(docs, text_column, tried=list(by_name.values()))]
    verdict = F.when(F.col("base_failed"), "base")
    for name in order:
        verdict = verdict.when(by_name[name].rejects, name)
    judged = base(docs, id_column, text_column).withColumn("rejected_by", verdict)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
