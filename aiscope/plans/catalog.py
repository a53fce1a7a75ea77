"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aiscope.functions import dims, text
from aiscope.operators import components as K
from aiscope.operators import detect, export, graph, policy
from aiscope.plans.views import table, with_views
from aiscope.sources import files
from aiscope.sources.shared import shared_folder
from aiscope.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


# --- text governance ------------------------------------------------------------

_REDACTED = "text"
for _label, _rx in dims.REDACTIONS:
    _REDACTED = f"regexp_replace({_REDACTED}, {quoted(_rx)}, '[REDACTED_{_label}]', 'g')"


@query(f"""
SELECT source, lang, kind, count(*) AS n_docs FROM (
  SELECT source, lang, unnest(list_distinct(regexp_extract_all({_REDACTED}, '\\[REDACTED_([A-Z0-9_]+)\\]', 1))) AS kind FROM documents)
GROUP BY source, lang, kind""")
def redact_documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = docs.select("source", "lang", F.explode(text.redacted_types(F.col("text"))).alias("kind"))
    return kinds.groupBy("source", "lang", "kind").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"SELECT doc_id, length(r) AS n_chars_left, md5(r) AS digest FROM (SELECT doc_id, {_REDACTED} AS r FROM documents)")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("r"))
    return docs.select("doc_id", F.length("r").cast("long").alias("n_chars_left"), F.md5("r").alias("digest"))


_PII = " UNION ALL ".join(f"SELECT lang, doc_id, {quoted(kind)} AS kind, len(regexp_extract_all(text, {quoted(rx)})) AS n FROM documents" for kind, rx in dims.DETECTIONS if kind != "credit_card")


@query(f"SELECT lang, kind, CAST(sum(n) AS BIGINT) AS n_matches, count(*) AS n_docs FROM ({_PII}) WHERE n > 0 GROUP BY lang, kind")
def pii_types_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(text.detect_pii(F.col("text"), kinds=["ssn", "email", "phone_us", "ip_address"])).alias("m"))
    per_doc = docs.groupBy("lang", "doc_id", F.col("m.type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("lang", "kind").agg(F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""
SELECT doc_id, count(*) AS n_cards FROM (
  SELECT doc_id, regexp_replace(v, '[\\s-]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(dict(dims.DETECTIONS)["credit_card"])})) AS v FROM documents))
WHERE length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN CAST(substr(d, length(d) - CAST(i AS INT), 1) AS INT)
  ELSE 2 * CAST(substr(d, length(d) - CAST(i AS INT), 1) AS INT) - CASE WHEN CAST(substr(d, length(d) - CAST(i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END END for i in range(0, length(d))]) % 10 = 0
GROUP BY doc_id""")
def pii_cards_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.detect_pii(F.col("text"), kinds=["credit_card"])).alias("m"))
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cards"))


def _names(table_: list[tuple[str, str, str]], column: str) -> str:
    return " || ".join(f"CASE WHEN regexp_matches({column}, {quoted(rx)}) THEN {quoted(name + ',')} ELSE '' END" for name, rx, _ in table_)


@query(with_views("chat") + f" SELECT conv_id, turn, found FROM (SELECT conv_id, turn, rtrim({_names(dims.INJECTIONS + dims.DANGERS, 'text')}, ',') AS found FROM chat) WHERE found <> ''")
def injection_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "chat")
    names = F.array_join(F.transform(text.content_filter(F.col("text")), lambda x: x["name"]), ",")
    return chat.select("conv_id", "turn", names.alias("found")).where("found <> ''")


@query(with_views("chat") + f""" SELECT role, allowed, count(*) AS n FROM (
  SELECT role, NOT ({" OR ".join(f"regexp_matches(text, {quoted(rx)})" for _, rx, _ in dims.INJECTIONS + dims.DANGERS)}
    OR {" OR ".join(f"regexp_matches(text, {quoted(rx)})" for kind, rx in dims.DETECTIONS if kind != "credit_card")}) AS allowed FROM chat) GROUP BY role, allowed""")
def record_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = policy.evaluate_records(table(spark, sf_dir, "chat"))
    return checked.groupBy("role", "allowed").agg(F.count(F.lit(1)).alias("n"))


# --- components -------------------------------------------------------------------

_FACTOR = "CASE flag " + " ".join(f"WHEN {quoted(f)} THEN {quoted(f'{dims.FLAG_TEXTS[f]} (+{w})')}" for f, w in dims.RISK_WEIGHTS.items()) + " END"
_SCORED = with_views("components", "component_flags") + f""", f AS (
  SELECT component_id, sum(weight) AS w, string_agg(flag, ',' ORDER BY flag) AS flags, string_agg({_FACTOR}, '; ' ORDER BY flag) AS factors FROM component_flags GROUP BY component_id),
 scored AS (SELECT *, CASE WHEN score >= 76 THEN 'critical' WHEN score >= 51 THEN 'high' WHEN score >= 26 THEN 'medium' ELSE 'low' END AS severity FROM (
  SELECT c.*, coalesce(f.flags, '') AS flags, coalesce(f.factors, '') AS factors,
    CAST(least(100, coalesce(f.w, 0) + CASE WHEN c.model_name IN {listed(dims.DEPRECATED_MODELS)} THEN 10 ELSE 0 END) AS INT) AS score
  FROM components c LEFT JOIN f ON c.component_id = f.component_id)) """


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.score(K.with_flags(table(spark, sf_dir, "components"), table(spark, sf_dir, "component_flags")))


@query(_SCORED + "SELECT component_id, score, severity FROM scored")
def risk_score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("component_id", "score", "severity")


@query(_SCORED + "SELECT component_id, factors FROM scored")
def risk_factors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("component_id", F.array_join("factors", "; ").alias("factors"))


@query(_SCORED + """SELECT scan_id, 'type' AS dimension, type AS value, count(*) AS n FROM scored GROUP BY scan_id, type
UNION ALL SELECT scan_id, 'provider', provider, count(*) FROM scored WHERE provider <> '' GROUP BY scan_id, provider
UNION ALL SELECT scan_id, 'severity', severity, count(*) FROM scored GROUP BY scan_id, severity
UNION ALL SELECT scan_id, 'total', '', count(*) FROM scored GROUP BY scan_id""")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summary(scored(spark, sf_dir))


@query(_SCORED + """SELECT scan_id, count(*) AS n_components, max(score) AS max_score, arg_max(severity, score) AS max_severity,
  count(DISTINCT file_path) AS files_with_findings FROM scored GROUP BY scan_id""")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.scan_totals(scored(spark, sf_dir))


@query(_SCORED + "SELECT scan_id, rank, component_id, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, component_id) AS rank FROM scored) WHERE rank <= 5")
def top_risk_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(scored(spark, sf_dir), 5).select("scan_id", "rank", "component_id", "score")


@query(_SCORED + "SELECT component_id, name, provider, severity FROM scored WHERE severity IN ('medium', 'high', 'critical') AND (contains(lower(name), 'an') OR contains(lower(provider), 'an')) AND type = 'model'")
def severity_filter_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.search(K.at_least(scored(spark, sf_dir), "medium"), "AN", kind="model")
    return found.select("component_id", "name", "provider", "severity")


@query(_SCORED + """, x AS (SELECT unnest(string_split(flags, ',')) AS flag FROM scored WHERE flags <> '')
SELECT flag, count(*) AS n FROM x GROUP BY flag""")
def flag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flag_counts(scored(spark, sf_dir)).select("flag", "n")


_OWASP_CODE = "CASE flag " + " ".join(f"WHEN {quoted(f)} THEN {quoted(c)}" for f, (c, _, _) in dims.FLAG_OWASP.items()) + " END"


@query(with_views("component_flags") + f" SELECT category, count(*) AS n FROM (SELECT DISTINCT component_id, {_OWASP_CODE} AS category FROM component_flags) GROUP BY category")
def owasp_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.owasp_counts(scored(spark, sf_dir))


@query(_SCORED + f"""SELECT scan_id, count(*) AS n_cases, count(*) FILTER (WHERE severity IN ('critical', 'high') OR contains(flags, 'hardcoded_api_key')
  OR contains(flags, 'shadow_ai') OR contains(flags, 'internet_facing')) AS n_failed FROM scored GROUP BY scan_id""")
def junit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.junit_cases(scored(spark, sf_dir)).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("failed").alias("n_failed"))


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A baseline and a current scan with renamed, dropped and newly flagged components."""
    rows = K.with_flags(table(spark, sf_dir, "components"), table(spark, sf_dir, "component_flags"))
    renamed = F.when(F.col("h") % 17 == 0, F.concat("name", F.lit("-v2"))).otherwise(F.col("name"))
    flags = F.when(F.col("h") % 23 == 0, F.array_append("flags", F.lit("no_rate_limit"))).otherwise(F.col("flags"))
    now = rows.where("h % 19 <> 0").withColumn("name", renamed).withColumn("flags", flags)
    return K.score(rows), K.score(now)


_SEVERITY = "CASE WHEN {0} >= 76 THEN 'critical' WHEN {0} >= 51 THEN 'high' WHEN {0} >= 26 THEN 'medium' ELSE 'low' END"
_TWO = with_views("components", "component_flags") + f""", f AS (SELECT component_id, sum(weight) AS w FROM component_flags GROUP BY component_id),
 base AS (SELECT c.*, coalesce(f.w, 0) + CASE WHEN model_name IN {listed(dims.DEPRECATED_MODELS)} THEN 10 ELSE 0 END AS raw FROM components c LEFT JOIN f ON c.component_id = f.component_id),
 one AS (SELECT component_id, name, type, provider, CAST(least(100, raw) AS INT) AS score FROM base),
 two AS (SELECT component_id, CASE WHEN h % 17 = 0 THEN name || '-v2' ELSE name END AS name, type, provider,
   CAST(least(100, raw + CASE WHEN h % 23 = 0 THEN 10 ELSE 0 END) AS INT) AS score FROM base WHERE h % 19 <> 0),
 a AS (SELECT name, type, provider, arg_max(score, component_id) AS s FROM one GROUP BY name, type, provider),
 b AS (SELECT name, type, provider, arg_max(score, component_id) AS s FROM two GROUP BY name, type, provider),
 d AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.type, b.type) AS type, coalesce(a.provider, b.provider) AS provider, a.s AS old_score, b.s AS new_score, b.s - a.s AS score_delta,
   CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'modified' ELSE 'unchanged' END AS change
   FROM a FULL JOIN b ON a.name = b.name AND a.type = b.type AND a.provider = b.provider) """


@query(_TWO + "SELECT name, type, provider, old_score, new_score, score_delta, change FROM d")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.diff(*two_scans(spark, sf_dir)).select("name", "type", "provider", "old_score", "new_score", "score_delta", "change")


@query(_TWO + "SELECT change, count(*) AS n FROM d GROUP BY change")
def scan_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.diff_counts(K.diff(*two_scans(spark, sf_dir)))


@query(_TWO + """SELECT name, 'added' AS kind FROM (SELECT name FROM two EXCEPT SELECT name FROM one)
UNION ALL SELECT name, 'removed' FROM (SELECT name FROM one EXCEPT SELECT name FROM two)
UNION ALL SELECT name, 'common' FROM (SELECT name FROM one INTERSECT SELECT name FROM two)""")
def scan_names_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compare_names(*two_scans(spark, sf_dir))


LIMITS = {"max_critical": 3, "max_high": 20, "max_score": 85, "block_providers": ["france", "CHINA"], "block_flags": ["hardcoded_api_key", "shadow_ai"]}


@query(_SCORED + """, v AS (
 SELECT scan_id, 'max_' || severity AS rule, severity AS subject, count(*) AS n FROM scored WHERE severity IN ('critical', 'high') GROUP BY scan_id, severity HAVING count(*) > CASE severity WHEN 'critical' THEN 3 ELSE 20 END
 UNION ALL SELECT scan_id, 'max_score', name, CAST(score AS BIGINT) FROM scored WHERE score > 85
 UNION ALL SELECT scan_id, 'blocked_provider', name, 1 FROM scored WHERE lower(provider) IN ('france', 'china')
 UNION ALL SELECT scan_id, 'blocked_flag', name, CAST(contains(flags, 'hardcoded_api_key') AS INT) + CAST(contains(flags, 'shadow_ai') AS INT) FROM scored WHERE contains(flags, 'hardcoded_api_key') OR contains(flags, 'shadow_ai'))
SELECT scan_id, rule, subject, CAST(n AS BIGINT) AS n FROM v""")
def policy_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.threshold_policy(scored(spark, sf_dir), **LIMITS)
    return found.select("scan_id", "rule", F.col("subject"), "n")


GATE_RULES = [(1, "forbid", "severity", ">=", "high"), (2, "forbid", "risk_score", ">", "60"), (3, "forbid", "provider", "==", "france"), (4, "forbid", "component_type", "contains", "mcp"), (5, "permit", "name", "==", "x")]


@query(_SCORED + """SELECT component_id, 1 AS rule_id FROM scored WHERE severity IN ('high', 'critical')
UNION ALL SELECT component_id, 2 FROM scored WHERE score > 60 UNION ALL SELECT component_id, 3 FROM scored WHERE lower(provider) = 'france'
UNION ALL SELECT component_id, 4 FROM scored WHERE contains(type, 'mcp')""")
def rule_gate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(GATE_RULES, "rule_id int, effect string, field string, op string, value string")
    return policy.gate(scored(spark, sf_dir), rules).select("component_id", "rule_id")


@query(_SCORED + """SELECT component_id, code AS categories FROM (SELECT component_id, rtrim(
  CASE WHEN contains(usage_type, 'completion') OR type IN ('llm_provider', 'model') THEN 'A01,' ELSE '' END || CASE WHEN contains(flags, 'shadow_ai') THEN 'A05,' ELSE '' END ||
  CASE WHEN contains(flags, 'hardcoded_api_key') THEN 'A06,' ELSE '' END || CASE WHEN type IN ('mcp_server', 'mcp_client', 'tool') OR usage_type = 'tool_use' THEN 'A07,' ELSE '' END ||
  CASE WHEN usage_type = 'agent' THEN 'A09,' ELSE '' END || CASE WHEN contains(flags, 'no_auth') AND type = 'endpoint' THEN 'A10,' ELSE '' END, ',') AS code FROM scored)""")
def owasp_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.owasp_categories(scored(spark, sf_dir)).select("component_id", F.array_join("categories", ",").alias("categories"))


@query(with_views("components") + """ SELECT component_id, licence, CASE licence WHEN 'Unknown' THEN 'unknown' WHEN 'LLAMAV2' THEN 'restrictive' ELSE 'permissive' END AS licence_type FROM (
  SELECT component_id, CASE WHEN contains(model_name, 'llama-3') THEN 'LLAMAV2' WHEN contains(model_name, 'mistral') THEN 'Apache-2.0' ELSE 'Unknown' END AS licence FROM components WHERE type IN ('model', 'llm_provider'))""")
def license_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.licence_findings(table(spark, sf_dir, "components"))


_HIGH_RISK_SQL = " UNION ALL ".join(f"SELECT component_id, {i} AS i, {quoted(area)} AS area FROM t WHERE regexp_matches(x, {quoted('|'.join(words))})" for i, (area, words) in enumerate(dims.HIGH_RISK.items()))


@query(_SCORED + f""", t AS (SELECT component_id, usage_type, lower(name || ' ' || replace(flags, ',', ' ') || ' ' || usage_type) AS x FROM scored)
SELECT component_id, 'high_risk' AS category, 'Annex III - ' || string_agg(area, ', ' ORDER BY i) AS requirement, 'Flag' AS status FROM ({_HIGH_RISK_SQL}) GROUP BY component_id
UNION ALL SELECT component_id, 'transparency', 'Missing AI system disclosure to users (Article 53)', 'Fail' FROM t WHERE usage_type IN ('completion', 'agent', 'image_gen')
UNION ALL SELECT component_id, 'transparency', 'Missing synthetic content labeling (Article 52)', 'Fail' FROM t WHERE usage_type = 'image_gen'""")
def eu_act_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.eu_act_findings(scored(spark, sf_dir))


@query(_SCORED + """, r AS (SELECT scan_id, 'aiscope/' || replace(replace(lower(name), ' ', '-'), '_', '-') AS rule_id, component_id, severity FROM scored),
 g AS (SELECT scan_id, rule_id, min(component_id) AS first, arg_min(severity, component_id) AS severity FROM r GROUP BY scan_id, rule_id)
SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY first) - 1 AS rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'warning' ELSE 'note' END AS level FROM g""")
def sarif_rules_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.sarif_rules(scored(spark, sf_dir)).select("scan_id", "rule_id", F.col("rule_index").cast("long").alias("rule_index"), "level")


@query(_SCORED + """SELECT component_id, name || CASE WHEN provider <> '' THEN ' | provider=' || provider ELSE '' END || CASE WHEN model_name <> '' THEN ' | model=' || model_name ELSE '' END
  || CASE WHEN flags <> '' THEN ' | flags=' || flags ELSE '' END AS message, file_path AS uri FROM scored""")
def sarif_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.sarif_results(scored(spark, sf_dir)).select("component_id", "message", "uri")


@query(_SCORED + """SELECT component_id, CASE type WHEN 'llm_provider' THEN 'machine-learning-model' WHEN 'model' THEN 'machine-learning-model' WHEN 'agent_framework' THEN 'framework' WHEN 'workflow' THEN 'framework'
  WHEN 'container' THEN 'container' WHEN 'tool' THEN 'library' WHEN 'mcp_client' THEN 'library' ELSE 'service' END AS bom_type,
  'pkg:' || CASE WHEN type = 'container' THEN 'docker' WHEN contains(name, '/') THEN 'npm' ELSE 'pypi' END || '/' || replace(lower(name), '_', '-') AS purl,
  'risk_score=' || score || ';usage_type=' || usage_type || ';source_location=' || file_path || CASE WHEN line_number > 0 THEN ':' || line_number ELSE '' END || CASE WHEN provider <> '' THEN ';provider=' || provider ELSE '' END
  || CASE WHEN factors <> '' THEN ';risk_factors=' || replace(factors, '; ', ', ') ELSE '' END || CASE WHEN flags <> '' THEN ';flags=' || replace(flags, ',', ', ') ELSE '' END
  || CASE WHEN model_name <> '' THEN ';model_name=' || model_name ELSE '' END AS properties FROM scored""")
def cyclonedx_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.bom_components(scored(spark, sf_dir))
    flat = F.array_join(F.transform("properties", lambda p: F.concat(F.substring_index(p["name"], ":", -1), F.lit("="), p["value"])), ";")
    return rows.select("component_id", "bom_type", "purl", flat.alias("properties"))


@query(_SCORED + "SELECT name, type, provider, '' AS version, model_name, file_path, CAST(line_number AS VARCHAR) AS line_number, usage_type, score AS risk_score, severity, replace(flags, ',', ', ') AS flags FROM scored")
def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.flat_table(scored(spark, sf_dir))


_REGISTRY = ", ".join(f"({quoted(n)}, {quoted(p)}, {str(n in dims.DEPRECATED_NAMES).lower()})" for p, names in dims.MODEL_NAMES.items() for n in names)


@query(with_views("components") + f""", r AS (SELECT * FROM (VALUES {_REGISTRY}) AS r(prefix, provider, deprecated)),
 m AS (SELECT model_name, arg_max(prefix, length(prefix)) AS registry_name, arg_max(r.provider, length(prefix)) AS registry_provider, arg_max(deprecated, length(prefix)) AS deprecated
  FROM (SELECT DISTINCT model_name FROM components) c JOIN r ON starts_with(c.model_name, r.prefix) GROUP BY model_name)
SELECT c.model_name, registry_name, registry_provider, deprecated, count(*) AS n FROM components c LEFT JOIN m ON c.model_name = m.model_name GROUP BY ALL""")
def model_registry_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.lookup_models(table(spark, sf_dir, "components").select("model_name"))
    return found.groupBy("model_name", "registry_name", "registry_provider", "deprecated").agg(F.count(F.lit(1)).alias("n"))


# --- requests and events --------------------------------------------------------------

REQUEST_RULES = [
    (1, "forbid", "*", "url", "contains", "deepseek"), (2, "forbid", "*", "method", "==", "delete"), (3, "permit", "*", "hostname", "endswith", "openai.com"),
    (4, "permit", "*", "path", "startswith", "/v1/p"), (5, "forbid", "*", "scheme", "!=", "https"),
]
RULES_SCHEMA = "rule_id int, effect string, action string, field string, op string, value string"
_DECIDED = with_views("requests") + """, d AS (SELECT *, CASE WHEN contains(lower(url), 'deepseek') THEN 1 WHEN method = 'DELETE' THEN 2
  WHEN regexp_matches(url, '^https://[^/:]*openai\\.com[/:]') THEN 3 WHEN regexp_matches(url, '^https://[^/]+/v1/p') THEN 4 END AS rule_id FROM requests) """


@query(_DECIDED + "SELECT request_id, CASE WHEN rule_id <= 2 THEN 'deny' ELSE 'allow' END AS decision, CASE WHEN rule_id <= 2 THEN 'blocked' ELSE 'allowed' END AS outcome, rule_id FROM d")
def request_policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(REQUEST_RULES, RULES_SCHEMA)
    decided = policy.decide(table(spark, sf_dir, "requests"), rules)
    return decided.select("request_id", "decision", policy.outcome(F.col("decision"), "block").alias("outcome"), "rule_id")


@query(_DECIDED + "SELECT date_trunc('minute', ts) AS minute, CASE WHEN rule_id <= 2 THEN 'warned' ELSE 'allowed' END AS outcome, count(*) AS n, max(duration_ms) AS max_ms FROM d GROUP BY ALL")
def decision_counts_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(REQUEST_RULES, RULES_SCHEMA)
    decided = policy.decide(table(spark, sf_dir, "requests"), rules)
    by = [F.date_trunc("minute", "ts").alias("minute"), policy.outcome(F.col("decision"), "warn").alias("outcome")]
    return decided.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("duration_ms").alias("max_ms"))


@query("""SELECT day, part, batch, count(*) AS n_events, substr(sha256(string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR))), 1, 32) AS idempotency_key FROM (
  SELECT CAST(ts AS DATE) AS day, event_id % 16 AS part, event_id, CAST(ceil(row_number() OVER (PARTITION BY CAST(ts AS DATE), event_id % 16 ORDER BY event_id) / 100.0) AS BIGINT) AS batch FROM events) GROUP BY day, part, batch""")
def event_batches_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's events are dealt to sixteen senders, which number their own."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("part", F.col("event_id") % 16)
    return export.batches(events, by=["day", "part"])


@query("SELECT user_id AS agent_id, max(ts) AS last_seen, arg_max(event_type, ts) AS last_event, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS alive FROM events GROUP BY user_id")
def fleet_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    per = events.groupBy(F.col("user_id").alias("agent_id")).agg(F.max("ts").alias("last_seen"), F.max_by("event_type", "ts").alias("last_event"))
    now = events.agg(F.max("ts").alias("now"))  # one row
    return per.crossJoin(F.broadcast(now)).select("agent_id", "last_seen", "last_event", (F.col("last_seen") >= F.col("now") - F.expr("interval 1 day")).alias("alive"))


# --- detection ------------------------------------------------------------------------


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.lines(table(spark, sf_dir, "source_files"))


_LINES = with_views("source_files", "manifests") + """, l AS (SELECT path, project, string_split(content, chr(10)) AS a FROM source_files),
 lines AS (SELECT path, project, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM l) """
_SDKS = " UNION ALL ".join(
    f"SELECT path, project, line_no, {quoted(sdk)} AS sdk, regexp_matches(line, {quoted('|'.join(s[4]))}) AS used, " + (f"regexp_extract(line, {quoted(s[5])}, 1)" if s[5] else "''")
    + f" AS model FROM lines WHERE regexp_matches(line, {quoted('|'.join(s[3] + s[4]))})" for sdk, s in dims.SDK_SIGNATURES.items()
)
_USAGE = _LINES + f""", hits AS ({_SDKS}), ranked AS (SELECT path, project, line_no, sdk, used, CASE WHEN used THEN model ELSE '' END AS model_name, row_number() OVER (PARTITION BY path, sdk ORDER BY line_no) AS seen FROM hits) """


@query(_USAGE + f"""SELECT path, CAST(line_no AS INT) AS line_no, sdk, model_name, CAST(seen AS INT) AS seen FROM ranked
WHERE seen = 1 OR (used AND model_name <> '' AND (model_name IN {listed(dims.DEPRECATED_MODELS)} OR NOT regexp_matches(model_name, '\\d{{4,8}}')))""")
def sdk_usage_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sdk_usage(source_lines(spark, sf_dir)).select("path", "line_no", "sdk", "model_name", "seen")


_DEPS = ", ".join(f"({quoted(sdk)}, {quoted(d.lower().replace('_', '-'))})" for sdk, s in dims.SDK_SIGNATURES.items() for d in s[6])


@query(_USAGE + f""", dep AS (SELECT * FROM (VALUES {_DEPS}) AS d(sdk, dep)), known AS (SELECT DISTINCT m.project, dep.sdk FROM manifests m JOIN dep ON replace(lower(m.dep), '_', '-') = dep.dep)
SELECT r.project, r.path, r.sdk FROM ranked r LEFT JOIN known k ON r.project = k.project AND r.sdk = k.sdk WHERE r.seen = 1 AND k.sdk IS NULL""")
def shadow_sdk(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = detect.sdk_usage(source_lines(spark, sf_dir)).where("seen = 1").withColumn("project", F.split("path", "/")[0])
    return detect.shadow_sdks(usage, table(spark, sf_dir, "manifests")).select("project", "path", "sdk")


_ENDPOINT = "CASE " + " ".join(f"WHEN regexp_matches(lower(line), {quoted(rx)}) THEN {quoted(p)}" for rx, p, _ in dims.ENDPOINTS) + " END"


@query(_LINES + f"""SELECT path, provider, CAST(min(line_no) AS INT) AS line_no FROM (SELECT path, line_no, {_ENDPOINT} AS provider FROM lines WHERE NOT starts_with(ltrim(line), '#')) WHERE provider IS NOT NULL GROUP BY path, provider""")
def endpoint_first_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.endpoint_findings(source_lines(spark, sf_dir)).select("path", "provider", "line_no")


_KEYS = " UNION ALL ".join(f"SELECT path, line_no, {quoted(p)} AS provider, unnest(regexp_extract_all(line, {quoted(rx)}, {g})) AS k FROM lines" for rx, p, g in dims.KEY_PATTERNS)


@query(_LINES + f"""SELECT path, CAST(line_no AS INT) AS line_no, provider, CASE WHEN length(k) <= 12 THEN substr(k, 1, 4) || '...' || right(k, 2) ELSE substr(k, 1, 8) || '...' || right(k, 4) END AS masked FROM ({_KEYS})""")
def secret_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.key_findings(source_lines(spark, sf_dir))


@query(_LINES + f"SELECT model_name, count(DISTINCT path) AS n_files FROM (SELECT path, unnest(regexp_extract_all(line, {quoted(detect.MODEL_MENTION)}, 1)) AS model_name FROM lines) GROUP BY model_name")
def model_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "source_files").select("path", F.col("content").alias("text"))
    return detect.model_mentions(texts, "path").groupBy("model_name").agg(F.countDistinct("path").alias("n_files"))


# --- workflows ------------------------------------------------------------------------

_GRAPH = with_views("workflow_nodes", "workflow_edges", recursive=True)


@query(_GRAPH + """, n AS (SELECT DISTINCT workflow_id, src AS node, dst AS other FROM workflow_edges UNION SELECT DISTINCT workflow_id, dst, src FROM workflow_edges)
SELECT a.workflow_id, a.node FROM workflow_nodes a JOIN n ON a.workflow_id = n.workflow_id AND a.node = n.node JOIN workflow_nodes o ON o.workflow_id = n.workflow_id AND o.node = n.other
WHERE a.type = 'x.agent' GROUP BY a.workflow_id, a.node HAVING bool_or(o.type = 'x.toolCode') AND bool_or(o.type = 'x.toolHttpRequest')""")
def workflow_agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.agents_with_code_and_http(table(spark, sf_dir, "workflow_nodes"), table(spark, sf_dir, "workflow_edges"))


@query(_GRAPH + """, c AS (SELECT DISTINCT e.workflow_id FROM workflow_edges e JOIN workflow_nodes a ON a.workflow_id = e.workflow_id AND a.node = e.src AND a.type = 'x.agent'
  JOIN workflow_nodes h ON h.workflow_id = e.workflow_id AND h.node = e.dst AND h.type = 'base.executeWorkflow' JOIN workflow_edges f ON f.workflow_id = e.workflow_id AND f.src = h.node
  JOIN workflow_nodes b ON b.workflow_id = e.workflow_id AND b.node = f.dst AND b.type = 'x.agent')
SELECT n.workflow_id, count(*) AS n_nodes, count(*) FILTER (WHERE type = 'x.agent') AS n_agents, bool_or(type = 'base.webhook') AS internet_facing, max(c.workflow_id) IS NOT NULL AS chained,
  CASE WHEN bool_or(type = 'base.webhook') THEN 'webhook' END AS trigger, false AS handles_errors
FROM workflow_nodes n LEFT JOIN c ON n.workflow_id = c.workflow_id GROUP BY n.workflow_id""")
def workflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = graph.workflow_flags(table(spark, sf_dir, "workflow_nodes"), table(spark, sf_dir, "workflow_edges"))
    return flags.select("workflow_id", "n_nodes", "n_agents", "internet_facing", "chained", "trigger", "handles_errors")


@query(_GRAPH + """, s AS (SELECT e.workflow_id, e.src, arg_min(e.dst, e.edge_pos) AS next FROM workflow_edges e
  JOIN workflow_nodes a ON a.workflow_id = e.workflow_id AND a.node = e.src AND a.type = 'x.agent' JOIN workflow_nodes b ON b.workflow_id = e.workflow_id AND b.node = e.dst AND b.type = 'x.agent' GROUP BY e.workflow_id, e.src),
 w AS (SELECT workflow_id, src AS first, [src, next] AS chain FROM s WHERE src <> next
  UNION ALL SELECT w.workflow_id, w.first, list_append(w.chain, s.next) FROM w JOIN s ON s.workflow_id = w.workflow_id AND s.src = w.chain[-1] WHERE NOT list_contains(w.chain, s.next))
SELECT workflow_id, first, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM w GROUP BY workflow_id, first""")
def workflow_agent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = graph.agent_chains(table(spark, sf_dir, "workflow_nodes"), table(spark, sf_dir, "workflow_edges"))
    return chains.select("workflow_id", "first", F.array_join("chain", ">").alias("chain"))


# --- incremental scans -------------------------------------------------------------------


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS sha256 FROM documents WHERE doc_id % 10 = 0 OR doc_id % 10 = 1")
def hash_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are new or changed since an earlier scan, which had other texts or none for some."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    seen = docs.where("path % 10 <> 1").select("path", F.sha2("content", 256).alias("sha256"))
    now = docs.withColumn("content", F.when(F.col("path") % 10 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return files.changed_files(now, seen).select(F.col("path").alias("doc_id"), "sha256")




# --- streams ---------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query(_DECIDED + "SELECT date_trunc('minute', ts) AS minute, CASE WHEN rule_id <= 2 THEN 'warned' ELSE 'allowed' END AS outcome, count(*) AS n, max(duration_ms) AS max_ms FROM d GROUP BY ALL")
def stream_decisions_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query of decisions per minute as a stream over what is there."""
    kind = F.col("event_type")
    method = F.when(kind.isin("view", "click"), "GET").when(kind == "purchase", "POST").when(kind == "signup", "PUT").otherwise("DELETE")
    hosts = F.array(*map(F.lit, ["api.openai.com", "api.deepseek.com", "api.anthropic.com", "files.example.com", "localhost:11434"]))
    url = F.concat(F.lit("https://"), F.get(hosts, (F.col("event_id") % 5).cast("int")), F.lit("/v1/"), kind)
    requests = event_stream(spark, sf_dir).select(F.col("event_id").alias("request_id"), "ts", method.alias("method"), url.alias("url"), F.col("value").alias("duration_ms"))
    rules = spark.createDataFrame(REQUEST_RULES, RULES_SCHEMA)
    decided = policy.decide(requests, rules).withColumn("outcome", policy.outcome(F.col("decision"), "warn"))
    folder = shared_folder(spark, "decisions")
    streams.into_table(streams.decisions_per_window(decided), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table").withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice and counts once."""
    twice = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = streams.deduplicated(twice, "event_id", "ts").select("event_id", "event_type")
    folder = shared_folder(spark, "dedup")
    streams.into_table(once, f"{folder}/table", f"{folder}/checkpoint", mode="append").awaitTermination()
    return spark.read.parquet(f"{folder}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
