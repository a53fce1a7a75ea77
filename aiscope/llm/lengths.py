"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; suffix sums over the
histogram then answer, for every context limit, how many tokens there are, how
many documents are cut and what is left after cutting, and exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aiscope.llm.bytebpe import count_tokens
from aiscope.llm.graph import cut

#: Lengths are summed within buckets of this many, so that no window runs over all lengths in one task.
BUCKET = 4096


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs`` from ``n_tokens`` per document; nulls count as empty."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For every length that occurs, taken as a context limit, what lies at and above it.

    ``docs_longer`` and ``tokens_longer`` are over documents longer than the
    limit, ``docs_within`` over the others, ``tokens_kept`` is the total when
    each document is cut at the limit, ``tokens_cut`` the rest.  Limits between
    two lengths follow from the row below: see :func:`truncated_total`.
    """
    rows = hist.withColumn("b", F.floor(F.col("n_tokens") / bucket)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    whole = rows.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # at most longest text / bucket rows
    total = Window.partitionBy()
    whole = whole.select("b", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(total).alias("n"), F.sum("bt").over(total).alias("t"))
    longer = Window.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("d", F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).withColumn("s", F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
    rows = rows.join(whole, "b").withColumn("docs_longer", F.col("d") + F.col("ad")).withColumn("tokens_longer", F.col("s") + F.col("at"))
    kept = F.col("t") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return rows.select(
        "n_tokens", "n_docs", (F.col("n") - F.col("docs_longer")).alias("docs_within"), "docs_longer", "tokens_longer", kept.alias("tokens_kept"), (F.col("t") - kept).alias("tokens_cut"),
        F.col("t").alias("tokens_total"), ((F.col("n") - F.col("docs_longer")) / F.col("n")).alias("share_within"),
    )


def truncated_total(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_cut, tokens_kept`` for any limits, also those between two lengths.

    The row of the largest length within a limit has the suffix sums beyond it.
    """
    below = lambda x: F.max_by(F.struct("docs_longer", "tokens_longer"), F.when(F.col("n_tokens") <= x, F.col("n_tokens")))
    whole = F.struct(F.max(F.col("docs_within") + F.col("docs_longer")).alias("docs_longer"), F.max("tokens_total").alias("tokens_longer"))
    found = sums.agg(F.max("tokens_total").alias("t"), *[F.coalesce(below(limit), whole).alias(f"l{i}") for i, limit in enumerate(limits)])
    cut_at = lambda i, limit: F.struct(F.lit(int(limit)).cast("long").alias("context_limit"), F.col(f"l{i}.docs_longer").alias("docs_cut"), (F.col("t") - F.col(f"l{i}.tokens_longer") + F.col(f"l{i}.docs_longer") * int(limit)).alias("tokens_kept"))
    return found.where("t is not null").select(F.explode(F.array(*[cut_at(i, limit) for i, limit in enumerate(limits)])).alias("x")).select("x.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The exact length below or at which each share of documents lies: ``share, n_tokens``."""
    parts = [F.min(F.when(F.col("share_within") >= share, F.col("n_tokens"))).alias(f"q{i}") for i, share in enumerate(shares)]
    names = F.array(*[F.struct(F.lit(share).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, share in enumerate(shares)])
    return sums.agg(*parts).select(F.explode(names).alias("x")).select("x.*")


def token_lengths(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The length table of all documents, one row per encoded length; an empty table gives no rows.  Only the id and the text are read, so other columns may have any name."""
    return suffix_sums(cut(histogram(count_tokens(docs, ranks_path, id_column, text_column))))
