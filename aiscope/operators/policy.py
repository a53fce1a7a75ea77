"""Rule policies over components and requests, compliance rules and outcomes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from aiscope.functions import columns as C
from aiscope.functions import dims


def string_match(op: Column, have: Column, want: Column) -> Column:
    """Operators on text in any case; an empty or missing value never matches."""
    h, w = F.lower(have), F.lower(want)
    found = F.when(op == "==", h == w).when(op == "!=", h != w).when(op == "contains", h.contains(w)).when(op == "startswith", h.startswith(w)).when(op == "endswith", h.endswith(w))
    return F.coalesce(found, F.lit(False)) & F.coalesce(have != "", F.lit(False))


def ordered_match(op: Column, have: Column, want: Column) -> Column:
    found = F.when(op == "==", have == want).when(op == "!=", have != want).when(op == ">", have > want).when(op == ">=", have >= want).when(op == "<", have < want).when(op == "<=", have <= want)
    return F.coalesce(found, F.lit(False))


def component_fields(components: DataFrame) -> dict[str, Column]:
    """Fields of a component that rules can name."""
    names = {"severity": "severity", "provider": "provider", "component_type": "type", "risk_score": "score", "name": "name", "file": "file_path"}
    return {field: F.col(column).cast("string") for field, column in names.items() if column in components.columns}


#: A rule set larger than this is refused: it travels as one literal.
MAX_RULES = 10_000
#: Up to so many rules are compiled one by one.
COMPILED_RULES = 64
RULE_FIELDS = "rule_id", "effect", "action", "field", "op", "value"


def rule_rows(rules: DataFrame) -> list[Row]:
    """A small rule table in the order of ``rule_id``, nulls last; its size is checked."""
    have = [c if c in rules.columns else F.lit(None).cast("string").alias(c) for c in RULE_FIELDS]
    rows = rules.select(*have).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return sorted(rows, key=lambda r: (r.rule_id is None, 0 if r.rule_id is None else r.rule_id))


def rule_array(rules: DataFrame, rows: list[Row] | None = None) -> Column:
    """A small rule table as an array literal of structs, in the order of :func:`rule_rows`."""
    kind = rules.schema["rule_id"].dataType.simpleString()
    text = json.dumps([r.asDict() for r in (rule_rows(rules) if rows is None else rows)], default=str)
    return F.from_json(F.lit(text), f"array<struct<rule_id:{kind},effect:string,action:string,field:string,op:string,value:string>>")


def gate(components: DataFrame, rules: DataFrame, entities: DataFrame | None = None, key: str = "component_id") -> DataFrame:
    """Components that a forbid rule matches: ``key, rule_id, field, op, value``.

    Every component is held against all rules where it is read.  Severities
    compare by rank, numbers as numbers, else text in any case.
    ``entities(name, attributes)`` adds fields that are missing; several of one
    name count as one, of which each attribute has its least value.
    """
    own = component_fields(components)
    fields = components.select(key, F.col("name").alias("_name"), *[c.alias(f"_f_{field}") for field, c in own.items()])
    if entities is not None:
        each = entities.select(F.col("name").alias("_e"), F.explode("attributes").alias("_k", "_v")).groupBy("_e", "_k").agg(F.min("_v").alias("_v"))
        more = each.groupBy("_e").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_attributes"))
        fields = fields.join(more, F.col("_name") == F.col("_e"), "left")

    def hit(rule: dict[str, Column] | Column, have: Column) -> Column:
        op, want = rule["op"], rule["value"]
        number, number_wanted = have.try_cast("double"), want.try_cast("double")
        is_rank = (rule["field"] == "severity") & (C.severity_rank(want) > 0)
        found = F.when(is_rank, ordered_match(op, C.severity_rank(have), C.severity_rank(want))).when(number.isNotNull() & number_wanted.isNotNull(), ordered_match(op, number, number_wanted)).otherwise(string_match(op, have, want))
        return (rule["effect"] == "forbid") & have.isNotNull() & found

    rows = rule_rows(rules)
    if len(rows) <= COMPILED_RULES:
        kinds = {c: rules.schema[c].dataType if c == "rule_id" else "string" for c in RULE_FIELDS}
        met = []
        for row in rows:
            rule = {c: F.lit(row[c]).cast(kinds[c]) for c in RULE_FIELDS}
            have = F.col(f"_f_{row.field}") if row.field in own else F.lit(None).cast("string") if entities is None else F.try_element_at("_attributes", rule["field"])
            met.append(F.when(hit(rule, have), F.struct(*[rule[c].alias(c) for c in RULE_FIELDS])))
        found = F.array(*met) if met else F.lit(None).cast(f"array<struct<rule_id:{rules.schema['rule_id'].dataType.simpleString()},effect:string,action:string,field:string,op:string,value:string>>")
    else:
        known = F.create_map(*[x for field in own for x in (F.lit(field), F.col(f"_f_{field}"))])
        fields = fields.withColumn("_f", known if entities is None else F.map_concat(known, F.coalesce(F.map_filter("_attributes", lambda k, _: ~k.isin(*own)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
        found = F.filter(rule_array(rules, rows), lambda rule: hit(rule, F.try_element_at("_f", rule["field"])))
    # an outer explode, so that the rules are not held against every component once more in a filter on the array's size
    return fields.select(key, F.explode_outer(found).alias("r")).where("r is not null").select(key, "r.rule_id", "r.field", "r.op", "r.value")


def request_fields(requests: DataFrame) -> Column:
    base = [F.lit("url"), F.col("url"), F.lit("method"), F.upper("method"), F.lit("hostname"), C.url_host(F.col("url")), F.lit("path"), C.url_path(F.col("url")), F.lit("scheme"), C.url_scheme(F.col("url"))]
    fields = F.create_map(*base)
    if "headers" in requests.columns:
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        fields = F.map_concat(fields, F.coalesce(C.header_fields(F.col("headers")), empty))
    return fields


def action_matches(method: Column, pattern: Column) -> Column:
    """``*``, ``http``, ``http.get`` or a prefix with a star against a method."""
    name = F.concat(F.lit("http."), F.lower(method))
    low = F.lower(pattern)
    return (low == "*") | (low == "http") | (low == name) | (low.endswith("*") & name.startswith(F.regexp_replace(low, r"\*$", "")))


def _matching(rules: DataFrame, numeric_ops: bool, action: str | None) -> Column:
    """All rules that match the fields ``_f``, as structs that sort by effect (forbid first) and then ``rule_id``."""

    def hit(rule: Column) -> Column:
        have, op, want = F.try_element_at("_f", rule["field"]), rule["op"], rule["value"]
        found = string_match(op, have, want)
        if numeric_ops:
            number, wanted = have.try_cast("double"), want.try_cast("double")
            plain = ordered_match(op, F.lower(have), F.lower(want)) & op.isin(">", ">=", "<", "<=")
            found = F.when(number.isNotNull() & wanted.isNotNull(), ordered_match(op, number, wanted)).otherwise(found | plain)
        if action == "method":
            found = found & action_matches(F.col("method"), rule["action"])
        elif action is not None:
            found = found & (F.coalesce(rule["action"], F.lit("*")).isin("*", "") | (F.lower(rule["action"]) == F.lower(F.col(action))))
        return F.coalesce(found, F.lit(False))

    return F.transform(F.filter(rule_array(rules), hit), lambda r: F.struct(F.when(r["effect"] == "forbid", 0).otherwise(1).alias("rank"), *[r[c].alias(c) for c in ("rule_id", "effect", "field", "op", "value")]))


def _says(rule: Column) -> Column:
    return F.concat(F.lit("request."), rule["field"], F.lit(" "), rule["op"], F.lit(' "'), rule["value"], F.lit('"'))


def decide(requests: DataFrame, rules: DataFrame, numeric_ops: bool = False, action_match: bool = False) -> DataFrame:
    """Each request with ``decision``, ``reason`` and the ``rule_id`` that decided.

    Forbid beats permit beats the default, allow; the first matching rule by
    ``rule_id`` counts.  ``rules(rule_id, effect, action, field, op, value)`` is
    small.  Requests are decided row by row, so rows without a key or with the
    same one have verdicts of their own, and nothing is shuffled.
    """
    fields = requests.withColumn("_f", request_fields(requests))
    met = fields.withColumn("_m", F.array_min(_matching(rules, numeric_ops, "method" if action_match else None)))
    forbidden = F.coalesce(F.col("_m.effect") == "forbid", F.lit(False))
    reason = F.when(F.col("_m").isNull(), "No matching policy rules (default allow)").when(forbidden, F.concat(F.lit("Forbidden by policy: "), _says(F.col("_m")))).otherwise(F.concat(F.lit("Explicitly permitted by policy: "), _says(F.col("_m"))))
    return met.select(*requests.columns, F.when(forbidden, "deny").otherwise("allow").alias("decision"), reason.alias("reason"), F.col("_m.rule_id").alias("rule_id"))


def explain(requests: DataFrame, rules: DataFrame, numeric_ops: bool = False, action: str | None = "method") -> DataFrame:
    """Each request with ``decision``, all ``reasons`` for it, and ``triggered``: the distinct ids of the rules behind them.

    If any forbid rule matches, all that do are named and permits are not; else
    all permits that match; else the default.  A rule's action is held against
    the method, or against the column that ``action`` names (a tool's name, in
    any case; ``*``, "" or null for all tools), or against nothing.
    """
    fields = requests.withColumn("_f", request_fields(requests)).withColumn("_all", F.array_sort(_matching(rules, numeric_ops, action)))
    fields = fields.withColumn("_m", F.filter("_all", lambda r: r["rank"] == F.element_at("_all", 1)["rank"]))
    forbidden = F.exists("_m", lambda r: r["effect"] == "forbid")
    says = F.transform("_m", lambda r: F.concat(F.when(r["effect"] == "forbid", "Forbidden by policy: ").otherwise("Explicitly permitted by policy: "), _says(r)))
    reasons = F.when(F.size("_m") == 0, F.array(F.lit("No matching policy rules (default allow)"))).otherwise(says)
    triggered = F.array_distinct(F.transform("_m", lambda r: r["rule_id"]))
    return fields.select(*requests.columns, F.when(forbidden, "deny").otherwise("allow").alias("decision"), reasons.alias("reasons"), triggered.alias("triggered"))


def violation_report(violations: DataFrame, rules: DataFrame, key: str = "component_id") -> DataFrame:
    """Each rule that :func:`gate` found broken, once: ``rule_id, condition, n_violations, n_components``, and its text where ``rules`` has ``raw``."""
    per = violations.groupBy("rule_id", F.concat(F.lit("resource."), "field", F.lit(" "), "op", F.lit(" "), "value").alias("condition")).agg(F.count(F.lit(1)).alias("n_violations"), F.countDistinct(key).alias("n_components"))
    if "raw" not in rules.columns:
        return per
    texts = rules.groupBy("rule_id").agg(F.min("raw").alias("raw"))
    return per.join(F.broadcast(texts.limit(MAX_RULES)), "rule_id", "left")


def outcome(decision: Column, mode: Column | str, failed: Column | None = None) -> Column:
    """``allowed``, ``blocked``, ``warned`` or ``error``."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    base = F.when(decision == "allow", "allowed").when(mode == "block", "blocked").otherwise("warned")
    return base if failed is None else F.when(failed & (base != "blocked"), "error").otherwise(base)


def excluded(requests: DataFrame, patterns: list[str]) -> DataFrame:
    """Requests whose URL matches none of the patterns."""
    return requests.where(~F.col("url").rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else requests


def evaluate_records(records: DataFrame, column: str = "text", mode: str = "block") -> DataFrame:
    """Check text for personal data, injection and danger: ``checks``, ``violations``, ``allowed``."""
    from aiscope.functions import text

    t = F.col(column)
    pii = F.array_distinct(F.transform(text.detect_pii(t), lambda m: m["type"]))
    names = lambda hits: F.transform(hits, lambda h: h["name"])
    rows = records.withColumn("_p", pii).withColumn("_i", names(text.injections(t))).withColumn("_d", names(text.dangers(t)))
    check = lambda name, c: F.struct(F.lit(name).alias("name"), (F.size(c) == 0).alias("passed"), F.col(c).alias("findings"))
    checks = F.array(check("pii", "_p"), check("prompt_injection", "_i"), check("content_filter", "_d"))
    severity = {"pii": "high", "prompt_injection": "critical", "content_filter": "high"}
    violations = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: F.struct(c["name"].alias("check"), C.lookup(c["name"], severity).alias("severity")))
    return rows.withColumn("checks", checks).withColumn("violations", violations).withColumn("allowed", (F.size("violations") == 0) | F.lit(mode != "block")).drop("_p", "_i", "_d")


def evaluate_payloads(records: DataFrame, payload: str = "payload", mode: str = "block") -> DataFrame:
    """The same for JSON payloads: the strings in them are checked together, and a payload without fields passes unevaluated."""
    empty = F.coalesce(F.json_array_length(payload) == 0, F.size(F.json_object_keys(payload)) <= 0, F.lit(True))
    checked = evaluate_records(records.withColumn("_t", F.when(~empty, C.string_leaves(F.col(payload))).otherwise("")), "_t", mode)
    return checked.withColumn("evaluated", ~empty).drop("_t")


def rule_context(checked: DataFrame) -> DataFrame:
    """Add what rules may ask of a checked record: ``pii_detected, pii_types, injection_detected, content_blocked, n_violations``."""
    found = lambda name: F.filter("checks", lambda c: c["name"] == name)[0]["findings"]
    return checked.select("*", (F.size(found("pii")) > 0).alias("pii_detected"), F.array_sort(found("pii")).alias("pii_types"), (F.size(found("prompt_injection")) > 0).alias("injection_detected"), (F.size(found("content_filter")) > 0).alias("content_blocked"), F.size("violations").alias("n_violations"))


def owasp_categories(components: DataFrame) -> DataFrame:
    """Add ``categories``: the codes A01 to A10 whose rules hold, sorted.

    Reads ``flags, usage_type, type, model_name`` and, where they are, ``metadata`` as text and ``source``.
    """
    meta = F.lower("metadata") if "metadata" in components.columns else F.lit("")
    source = F.col("source") if "source" in components.columns else F.lit("")
    has = lambda *flags: F.arrays_overlap("flags", F.array(*map(F.lit, flags)))
    usage, kind = F.col("usage_type"), F.col("type")
    # Fixed rules of the categories.
    rules = {
        "A01": meta.contains("prompt") | meta.contains("user_input") | usage.contains("chat") | usage.contains("completion") | has("no_input_validation") | kind.isin("llm_provider", "model"),
        "A02": has("no_output_validation", "direct_output_use", "no_sanitization"),
        "A03": meta.contains("fine-tune") | meta.contains("training") | has("custom_model") | F.col("model_name").contains("ft:"),
        "A04": has("no_rate_limit", "no_token_limit") | meta.contains("unlimited"),
        "A05": has("shadow_ai", "unvetted_package", "unknown_source") | (source == "unknown"),
        "A06": has("hardcoded_api_key", "hardcoded_credentials", "pii_detected", "sensitive_data"),
        "A07": kind.isin("mcp_server", "mcp_client", "tool") | has("mcp_unknown_server", "tool_no_validation") | (usage == "tool_use"),
        "A08": has("code_http_tools", "code_execution", "http_tools", "multi_agent_no_trust", "unrestricted_actions"),
        "A09": has("no_human_in_loop", "autonomous", "auto_approve") | ((usage == "agent") & ~meta.contains("validation")),
        "A10": has("exposed_endpoint", "model_file_exposed", "public_model_api") | (has("no_auth") & (kind == "endpoint")),
    }
    return components.withColumn("categories", F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()])))


def eu_act_findings(components: DataFrame, key: str = "component_id") -> DataFrame:
    """``key, category, requirement, status``: high-risk areas, transparency gaps and prohibited practices."""
    meta = F.lower("metadata") if "metadata" in components.columns else F.lit("")
    words = [F.col("name"), meta, F.array_join("flags", " ")]
    components = components.withColumn("_all", F.lower(F.concat_ws(" ", *words, "usage_type")))
    # null values are left out by concat_ws, so no area gives an empty text
    components = components.withColumn("_areas", F.concat_ws(", ", *[F.when(F.col("_all").rlike("|".join(terms)), area) for area, terms in dims.HIGH_RISK.items()]))
    usage = F.col("usage_type")
    told = meta.rlike("disclosure|transparency|user_notification|ai_notice")
    marked = meta.rlike("watermark|synthetic_label|ai_generated")
    row = lambda category, requirement, status: F.struct(F.lit(category).alias("category"), requirement.alias("requirement"), F.lit(status).alias("status"))
    rows = F.array(
        F.when(F.col("_areas") != "", row("high_risk", F.concat(F.lit("Annex III - "), "_areas"), "Flag")),
        F.when(usage.isin("completion", "agent", "image_gen", "speech") & ~told, row("transparency", F.lit("Missing AI system disclosure to users (Article 53)"), "Fail")),
        F.when(usage.isin("image_gen", "speech") & ~marked, row("transparency", F.lit("Missing synthetic content labeling (Article 52)"), "Fail")),
        F.when(F.lower(F.concat_ws(" ", *words)).rlike("|".join(dims.PROHIBITED)), row("prohibited", F.lit("Article 5 - Prohibited AI Practices"), "Critical")),
    )
    # an outer explode, as in :func:`gate`
    return components.select(key, F.explode_outer(rows).alias("f")).where("f is not null").select(key, "f.*")


def licence_findings(components: DataFrame, key: str = "component_id", longest: bool = False) -> DataFrame:
    """``key, licence, licence_type`` of models and providers: from metadata first, then from the model's name.

    The first licence of the list that occurs counts, or with ``longest`` the longest.
    """
    meta = F.lower("metadata") if "metadata" in components.columns else F.lit("")
    known = sorted(dims.LICENCES, key=lambda x: -len(x[0])) if longest else dims.LICENCES
    by_text = F.when(F.lit(False), "")
    for name, _ in known:
        by_text = by_text.when(meta.contains(name.lower()), name)
    by_model = F.when(F.lit(False), "")
    for part, name in dims.MODEL_LICENCES:
        by_model = by_model.when(F.lower("model_name").contains(part), name)
    licence = F.coalesce(by_text, by_model, F.lit("Unknown"))
    kind = F.coalesce(C.lookup(licence, dict(dims.LICENCES)), F.lit("unknown"))
    rows = components.where(F.col("type").isin("model", "llm_provider"))
    return rows.select(key, licence.alias("licence"), kind.alias("licence_type"))
