"""Component tables: scoring, summaries, filters, ranking, differences and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aiscope.functions import columns as C
from aiscope.functions import dims

KEY = ["name", "type", "provider"]


def score(components: DataFrame, mode: str = "accumulate") -> DataFrame:
    """Add ``score, severity, factors, owasp`` from ``flags`` and ``model_name``; narrow, no shuffle."""
    model = F.col("model_name") if "model_name" in components.columns else None
    scored = components.withColumn("score", C.risk_score(F.col("flags"), model, mode))
    return scored.withColumn("severity", C.severity(F.col("score"))).withColumn("factors", C.risk_factors(F.col("flags"))).withColumn("owasp", C.flag_owasp(F.col("flags")))


def with_flags(components: DataFrame, flags: DataFrame, key: str = "component_id") -> DataFrame:
    """Join exploded flags back as a sorted array; components without a flag get an empty one."""
    lists = flags.groupBy(key).agg(F.array_sort(F.collect_list("flag")).alias("flags"))
    return components.join(lists, key, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def summary(components: DataFrame) -> DataFrame:
    """Counts by type, provider and severity, and totals, per scan in one pass.

    Rows are ``scan_id, dimension, value, n``.  Empty providers are not counted.
    """
    sets = [["scan_id", "type"], ["scan_id", "provider"], ["scan_id", "severity"], ["scan_id"]]
    grouped = components.groupingSets([[F.col(c) for c in s] for s in sets], "scan_id", "type", "provider", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "provider").when(F.col("g") == 6, "severity").otherwise("total")
    value = F.when(F.col("g") == 3, F.col("type")).when(F.col("g") == 5, F.col("provider")).when(F.col("g") == 6, F.col("severity")).otherwise("")
    return grouped.select("scan_id", kind.alias("dimension"), value.alias("value"), "n").where("not (dimension = 'provider' and value = '')")


def scan_totals(components: DataFrame) -> DataFrame:
    """Per scan: components, highest score, highest severity and distinct files with findings."""
    real = ~F.col("file_path").isin("", dims.DEPENDENCY_FILES)
    return components.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("n_components"), F.max("score").alias("max_score"),
        F.max_by("severity", C.severity_rank(F.col("severity"))).alias("max_severity"),
        F.countDistinct(F.when(real, F.col("file_path"))).alias("files_with_findings"),
    )


def at_least(components: DataFrame, level: str) -> DataFrame:
    """Components of a severity or higher; an unknown level filters nothing."""
    rank = dims.SEVERITY_RANK.get(level.lower())
    return components if rank is None else components.where(C.severity_rank(F.col("severity")) >= rank)


def workflow_name(components: DataFrame) -> Column:
    """The workflow that a component belongs to: ``workflow`` where there is one, else its file, else ``unknown``."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("workflow", "file_path") if c in components.columns]
    return F.coalesce(*names, F.lit("unknown"))


def search(components: DataFrame, text: str = "", severity: str = "", kind: str = "", workflow: str = "") -> DataFrame:
    """Name or provider contains ``text`` in any case, and severity, type and workflow are equal where given."""
    found = components.where(workflow_name(components) == workflow) if workflow else components
    if text:
        low = text.lower()
        found = found.where(F.lower("name").contains(low) | F.lower("provider").contains(low))
    if severity:
        found = found.where(F.col("severity") == severity)
    return found.where(F.col("type") == kind) if kind else found


def is_failure(severity: Column, flags: Column) -> Column:
    # Flags that fail whatever the severity.
    failing = ["hardcoded_api_key", "hardcoded_credentials", "shadow_ai", "webhook_no_auth", "code_http_tools", "mcp_unknown_server", "internet_facing"]
    return severity.isin("critical", "high") | F.arrays_overlap(flags, F.array(*map(F.lit, failing)))


def top_k(components: DataFrame, k: int, order: str = "component_id") -> DataFrame:
    """The ``k`` riskiest components of each scan, ranked from 1."""
    window = Window.partitionBy("scan_id").orderBy(F.desc("score"), order)
    return components.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def flag_counts(components: DataFrame) -> DataFrame:
    """How often each flag occurs, with its remedy's category and severity."""
    table = components.sparkSession.createDataFrame([(f, *x) for f, x in dims.FLAG_OWASP.items()], "flag string, owasp string, owasp_name string, remedy_severity string")
    counted = components.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(table), "flag")


def owasp_counts(components: DataFrame) -> DataFrame:
    """Components per category code, from ``owasp`` arrays of ``code: name``."""
    codes = F.array_distinct(F.transform("owasp", lambda x: F.trim(F.split(x, ":")[0])))
    return components.select(F.explode(codes).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def workflow_rollup(components: DataFrame, order: str | None = None) -> DataFrame:
    """Per workflow: components, highest score and the severity of that component; with ``order``, of the first of equal score, and the trigger of the first component."""
    grouped = components.groupBy("workflow") if "workflow" in components.columns else components.groupBy(workflow_name(components).alias("workflow"))
    if order is None:
        return grouped.agg(F.count(F.lit(1)).alias("n_components"), F.max("score").alias("max_score"), F.max_by("severity", "score").alias("severity"))
    trigger = F.nullif(F.col("trigger"), F.lit("")) if "trigger" in components.columns else F.lit(None).cast("string")
    worst = F.min_by("severity", F.struct((-F.col("score")).alias("by"), order))
    return grouped.agg(F.count(F.lit(1)).alias("n_components"), F.max("score").alias("max_score"), worst.alias("severity"), F.coalesce(F.min_by(trigger, order), F.lit("-")).alias("trigger"))


def severity_groups(components: DataFrame, least: str = "low", order: str = "component_id") -> DataFrame:
    """Per scan the severities from critical down to ``least`` that occur: ``scan_id, place, severity, n, components``, these by score, highest first."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), F.col(order).alias("id"))))
    grouped = at_least(components, least).groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("n"), listed.alias("_l"))
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc(C.severity_rank(F.col("severity")))))
    return grouped.select("scan_id", place.alias("place"), "severity", "n", F.transform("_l", lambda x: x["id"]).alias("components"))


def report_places(components: DataFrame, by: str = "score", descending: bool = True, order: str = "component_id") -> DataFrame:
    """Add ``place``: where a report of the scan lists each component, by a column (numbers as numbers, text in any case), ties by ``order``."""
    kind = components.schema[by].dataType.simpleString()
    key = F.lower(by) if kind == "string" else F.col(by)
    within = Window.partitionBy("scan_id").orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), order)
    return components.withColumn("place", F.row_number().over(within))


def history(scans: DataFrame) -> DataFrame:
    """Totals over stored scans: how many, their components, highest risk, distinct targets."""
    return scans.agg(F.count(F.lit(1)).alias("n_scans"), F.sum("n_components").alias("n_components"), F.max("max_score").alias("max_score"), F.countDistinct("target_path").alias("n_targets"))


def last_of_key(components: DataFrame, order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    every = [c for c in components.columns if c not in KEY]
    best = components.groupBy(*KEY).agg(F.max_by(F.struct(*every), order).alias("x"))
    return best.select(*KEY, *[f"x.{c}" for c in every])


def diff(before: DataFrame, after: DataFrame, order: str = "component_id") -> DataFrame:
    """Added, removed and modified components by (name, type, provider), the last duplicate counting.

    Modified: another score or severity.  ``score_delta`` is new less old.
    """
    slim = lambda rows: rows.select(*dict.fromkeys([*KEY, order, "score", "severity"]))  # noqa: E731  what is not compared is neither sorted nor shuffled
    old = last_of_key(slim(before), order).select(*KEY, F.col("score").alias("old_score"), F.col("severity").alias("old_severity"))
    new = last_of_key(slim(after), order).select(*KEY, F.col("score").alias("new_score"), F.col("severity").alias("new_severity"))
    joined = old.join(new, KEY, "full")
    differs = (F.col("old_score") != F.col("new_score")) | (F.col("old_severity") != F.col("new_severity"))
    change = F.when(F.col("old_score").isNull(), "added").when(F.col("new_score").isNull(), "removed").when(differs, "modified").otherwise("unchanged")
    return joined.withColumn("change", change).withColumn("score_delta", F.col("new_score") - F.col("old_score"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def compare_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names only after (added), only before (removed), or in both (common)."""
    a, b = before.select("name"), after.select("name")
    tag = lambda frame, kind: frame.select("name", F.lit(kind).alias("kind"))
    return tag(b.subtract(a), "added").unionAll(tag(a.subtract(b), "removed")).unionAll(tag(a.intersect(b), "common"))


def threshold_policy(components: DataFrame, max_critical: int | None = None, max_high: int | None = None, max_score: int | None = None, block_providers: list[str] | None = None, block_flags: list[str] | None = None) -> DataFrame:
    """Violations ``scan_id, rule, subject, n`` of a policy of limits; limits that are None do not apply.

    ``subject`` is the component (or severity), ``n`` what was found.
    """
    parts = []
    limits = {k: v for k, v in (("critical", max_critical), ("high", max_high)) if v is not None}
    if limits:
        counts = components.where(F.col("severity").isin(*limits)).groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("n"))
        over = F.col("n") > C.lookup(F.col("severity"), limits)
        parts.append(counts.where(over).select("scan_id", F.concat(F.lit("max_"), "severity").alias("rule"), F.col("severity").alias("subject"), "n"))
    one = lambda rows, rule, n: rows.select("scan_id", F.lit(rule).alias("rule"), F.col("name").alias("subject"), n.cast("long").alias("n"))
    if max_score is not None:
        parts.append(one(components.where(F.col("score") > max_score), "max_score", F.col("score")))
    if block_providers:
        parts.append(one(components.where(F.lower("provider").isin([p.lower() for p in block_providers])), "blocked_provider", F.lit(1)))
    if block_flags:
        hit = F.size(F.array_intersect("flags", F.array(*map(F.lit, block_flags))))
        parts.append(one(components.where(hit > 0), "blocked_flag", hit))
    if not parts:
        return components.select("scan_id", F.lit("").alias("rule"), "name", F.lit(0).cast("long").alias("n")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def policy_passed(components: DataFrame, violations: DataFrame) -> DataFrame:
    """``scan_id, n_violations, passed`` for every scan."""
    counts = violations.groupBy("scan_id").agg(F.count(F.lit(1)).alias("v"))
    scans = components.select("scan_id").distinct().join(counts, "scan_id", "left")
    return scans.select("scan_id", F.coalesce("v", F.lit(0)).alias("n_violations"), F.col("v").isNull().alias("passed"))


def lookup_models(names: DataFrame, column: str = "model_name") -> DataFrame:
    """Add ``registry_provider, deprecated`` by the longest registered name that the model starts with."""
    table = F.broadcast(dims.models(names.sparkSession).select("prefix", F.col("provider").alias("p"), F.col("deprecated").alias("d")))
    distinct = names.select(column).distinct()
    best = distinct.join(table, F.col(column).startswith(F.col("prefix"))).groupBy(column).agg(F.max_by(F.struct("prefix", "p", "d"), F.length("prefix")).alias("m"))
    best = best.select(F.col(column).alias("_model"), F.col("m.prefix").alias("registry_name"), F.col("m.p").alias("registry_provider"), F.col("m.d").alias("deprecated"))
    return names.join(best, F.col(column) == F.col("_model"), "left").drop("_model")


def apply_enrichment(components: DataFrame, results: DataFrame) -> DataFrame:
    """Fill empty models and providers from ``results(component_id, model, provider)``; the registry's provider wins."""
    found = lookup_models(results.withColumnRenamed("model", "model_name")).select("component_id", F.col("model_name").alias("_m"), F.coalesce("registry_provider", "provider").alias("_p"), F.coalesce("deprecated", F.lit(False)).alias("_d"))
    joined = components.join(found, "component_id", "left")
    fill = (F.col("model_name") == "") & F.col("_m").isNotNull() & (F.col("_m") != "")
    more = F.array_compact(F.array(F.when(F.col("_d"), "deprecated_model"), F.when(~C.is_pinned(F.col("_m")), "unpinned_model")))
    flags = F.when(fill, F.array_union("flags", more)).otherwise(F.col("flags"))
    return joined.select(*[c for c in components.columns if c not in ("model_name", "provider", "flags")], F.when(fill, F.col("_m")).otherwise(F.col("model_name")).alias("model_name"), F.when(fill & (F.col("provider") == ""), F.col("_p")).otherwise(F.col("provider")).alias("provider"), flags.alias("flags"))


# --- reports -------------------------------------------------------------------


def callable_models(components: DataFrame) -> DataFrame:
    """Providers and models that a client exists for, with the name to call them by."""
    rows = components.where(F.col("type").isin("llm_provider", "model") & F.lower("provider").isin(dims.CALLABLE_PROVIDERS))
    return rows.withColumn("call_name", F.coalesce(F.nullif("model_name", F.lit("")), "name"))


def to_enrich(components: DataFrame) -> DataFrame:
    """Providers and models whose model is not known."""
    return components.where(F.col("type").isin("llm_provider", "model") & (F.coalesce("model_name", F.lit("")) == ""))


def report_order(components: DataFrame, order: str = "component_id") -> DataFrame:
    """Components as a report lists them: scan by scan, the gravest severity first, then by score."""
    return components.orderBy("scan_id", F.desc(C.severity_rank(F.col("severity"))), F.desc("score"), order)


def shown_flags(components: DataFrame, n: int = 3) -> DataFrame:
    """Add the first flags, as text."""
    return components.withColumn("shown", F.array_join(F.slice("flags", 1, n), ", "))


def newest_scans(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.desc("scan_timestamp"), "scan_id")


def type_counts(components: DataFrame) -> DataFrame:
    """Types with their counts, by name."""
    return components.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type")


def sorted_by(components: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted by any column: ranks and scores as numbers, others as text in lower case."""
    key = F.col(column).cast("double") if column in ("rank", "score", "risk_score") else F.lower(F.col(column).cast("string"))
    return components.orderBy(key.desc() if descending else key.asc())


def policy_summaries(policies: DataFrame, n: int = 8, size: int = 200) -> DataFrame:
    """The first enabled policies ``policy_id, name, description``, descriptions shortened."""
    return policies.where("enabled").orderBy("policy_id").limit(n).select("policy_id", "name", C.shortened(F.col("description"), size).alias("description"))


def breaches(components: DataFrame, level: str, order: str = "component_id") -> DataFrame:
    """The first component of each scan at a severity or above; an unknown level breaches nothing."""
    if level.lower() not in dims.SEVERITY_RANK:
        return components.limit(0)
    every = [c for c in components.columns if c != "scan_id"]
    first = at_least(components, level).groupBy("scan_id").agg(F.min_by(F.struct(*every), order).alias("x"))
    return first.select("scan_id", "x.*")


def recommendations(components: DataFrame) -> DataFrame:
    """``scan_id, position, flag, advice`` for the flags of each scan that reports advise on, in their order."""
    found = components.select("scan_id", F.explode("flags").alias("flag")).distinct()
    place = C.lookup(F.col("flag"), {f: i for i, f in enumerate(dims.RECOMMENDED)})
    advice = C.lookup(F.col("flag"), {f: r for f, (r, _) in dims.REMEDIES.items()})
    return found.withColumn("position", place).where("position is not null").select("scan_id", "position", "flag", F.coalesce(advice, F.lit("Restrict who can reach it")).alias("advice"))


def remedies(components: DataFrame, key: str = "component_id") -> DataFrame:
    """``key, flag, remedy, guardrail, category, severity`` for each flag of each component."""
    rows = components.select(key, F.explode("flags").alias("flag"))
    part = lambda table, i: C.lookup(F.col("flag"), {f: x[i] for f, x in table.items()})
    return rows.select(key, "flag", part(dims.REMEDIES, 0).alias("remedy"), part(dims.REMEDIES, 1).alias("guardrail"), part(dims.FLAG_OWASP, 0).alias("category"), part(dims.FLAG_OWASP, 2).alias("severity"))
