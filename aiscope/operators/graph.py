"""Workflow graphs: nodes and edges as tables, risky wiring as joins."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aiscope.functions import columns as C
from aiscope.functions import dims
from aiscope.sources import files

AGENT, CODE, HTTP, HUB, WEBHOOK = "agent$", "toolCode$", "toolHttpRequest$", "executeWorkflow$", "webhook$"


def neighbours(edges: DataFrame, both_ways: bool = True) -> DataFrame:
    """``workflow_id, node, other`` along edges, and against them where wanted."""
    out = edges.select("workflow_id", F.col("src").alias("node"), F.col("dst").alias("other"))
    back = edges.select("workflow_id", F.col("dst").alias("node"), F.col("src").alias("other"))
    return (out.unionAll(back) if both_ways else out).distinct()


def agents_with_code_and_http(nodes: DataFrame, edges: DataFrame, both_ways: bool = True) -> DataFrame:
    """Agents that have a code tool and an HTTP tool among their neighbours.

    Edges are read once, in both directions, and only agents and tools are
    joined; equal pairs need not be made distinct, as they do not change what an
    agent has.
    """
    pair = lambda node, other: F.struct(F.col(node).alias("node"), F.col(other).alias("other"))
    pairs = edges.select("workflow_id", F.inline(F.array(pair("src", "dst"), *([pair("dst", "src")] if both_ways else []))))
    code, http = F.col("type").rlike(CODE), F.col("type").rlike(HTTP)
    tools = nodes.where(code | http).select("workflow_id", F.col("node").alias("other"), code.alias("code"), http.alias("http"))
    agents = nodes.where(F.col("type").rlike(AGENT)).select("workflow_id", "node")
    has = pairs.join(tools, ["workflow_id", "other"]).groupBy("workflow_id", "node").agg(F.bool_or("code").alias("code"), F.bool_or("http").alias("http")).where("code and http")
    return has.join(agents, ["workflow_id", "node"], "left_semi").select("workflow_id", "node")


def chained_workflows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Workflows in which an agent leads to a workflow call that leads to an agent."""
    kind = lambda rx: nodes.where(F.col("type").rlike(rx)).select("workflow_id", "node")
    first = edges.join(kind(AGENT).withColumnRenamed("node", "src"), ["workflow_id", "src"], "left_semi").select("workflow_id", F.col("dst").alias("hub"))
    second = edges.join(kind(AGENT).withColumnRenamed("node", "dst"), ["workflow_id", "dst"], "left_semi").select("workflow_id", F.col("src").alias("hub"))
    hubs = kind(HUB).withColumnRenamed("node", "hub")
    return first.join(hubs, ["workflow_id", "hub"], "left_semi").join(second, ["workflow_id", "hub"], "left_semi").select("workflow_id").distinct()


def workflow_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per workflow: internet-facing, error handling, trigger, chain, counts and the distinct node types."""
    is_kind = lambda rx: F.col("type").rlike(rx)
    trigger = F.when(is_kind("(?i)webhook"), "webhook").when(is_kind("(?i)schedule|cron"), "schedule").when(is_kind("(?i)manualTrigger"), "manual")
    per = nodes.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(is_kind(AGENT)).alias("n_agents"), F.bool_or(is_kind(WEBHOOK)).alias("internet_facing"),
        F.bool_or(is_kind("(?i)error")).alias("handles_errors"), F.min_by(trigger, F.when(trigger.isNotNull(), F.col("pos"))).alias("trigger"),
        F.array_sort(F.collect_set("type")).alias("node_types"),
    )
    chained = chained_workflows(nodes, edges).withColumn("chained", F.lit(True))
    return per.join(chained, "workflow_id", "left").withColumn("chained", F.coalesce("chained", F.lit(False)))


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first agent that each agent leads to, by the edges' order."""
    agents = nodes.where(F.col("type").rlike(AGENT)).select("workflow_id", "node")
    to = edges.join(agents.withColumnRenamed("node", "dst"), ["workflow_id", "dst"], "left_semi").join(agents.withColumnRenamed("node", "src"), ["workflow_id", "src"], "left_semi")
    return to.groupBy("workflow_id", "src").agg(F.min_by("dst", F.struct("edge_pos", "dst")).alias("next"))


def agent_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """From each agent, follow first successors until none or a repeat: ``workflow_id, first, chain`` of two or more.

    A workflow's successors are one small map, followed at most as many times
    as it has entries, so there is no join per step.
    """
    entries = F.collect_list(F.struct("src", "next"))
    maps = successors(nodes, edges).groupBy("workflow_id").agg(F.map_from_entries(entries).alias("m"))
    starts = maps.select("workflow_id", "m", F.explode(F.map_keys("m")).alias("first"))

    def step(chain: Column, _: Column) -> Column:
        following = F.try_element_at(F.col("m"), F.element_at(chain, -1))
        return F.when(following.isNull() | F.array_contains(chain, following), chain).otherwise(F.array_append(chain, following))

    chain = F.aggregate(F.sequence(F.lit(1), F.size("m")), F.array("first"), step)
    return starts.select("workflow_id", "first", chain.alias("chain")).where(F.size("chain") >= 2)


def multi_agent_without_trust(flags: DataFrame) -> DataFrame:
    """Workflows with more than one agent and no chain flag of their own."""
    return flags.where("n_agents > 1 and not chained").select("workflow_id", "n_agents")


# Keys of parameters that hold credentials.
CREDENTIAL_KEYS = ["apiKey", "api_key", "accessToken", "access_token", "token", "secret", "password", "authorization", "bearer", "credential", "privateKey"]
# Code that a workflow should not run.
DANGEROUS_CODE = r"\beval\(|\bexec\(|child_process|execSync|spawn\(|os\.system|subprocess\.|__import__\(|Function\(|require\(['\"]fs['\"]\)|require\(['\"]http|process\.env|fetch\(|axios|XMLHttpRequest|globalThis|vm\.run|importlib|pickle\.loads|shutil\.rmtree"


def node_findings(nodes: DataFrame) -> DataFrame:
    """Nodes with dangerous code or inline credentials, from ``parameters`` as JSON text."""
    key = "|".join(CREDENTIAL_KEYS)
    value = F.regexp_extract("parameters", rf'(?i)"(?:{key})"\s*:\s*"([^"{{$=]{{6,}})"', 1)
    inline = (value != "") & ~value.rlike(r"(?i)your|placeholder|changeme|example|xxx")
    flags = F.array_compact(F.array(F.when(F.col("type").rlike("(?i)code") & F.col("parameters").rlike(DANGEROUS_CODE), "code_http_tools"), F.when(F.coalesce(inline, F.lit(False)), "hardcoded_credentials")))
    return nodes.withColumn("flags", flags).where(F.size("flags") > 0)


def node_kind(kind: Column) -> Column:
    """Struct ``type, usage_type, provider`` of an AI node's type, else null."""
    row = lambda *x: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(("type", "usage_type", "provider"), x)])
    found = F.when(~kind.isin([dims.NODE_PACKAGE + n for n in dims.NODE_NAMES]), F.lit(None))
    for part, *what in dims.NODE_KINDS:
        found = found.when(kind.contains(part), row(*what))
    low = F.lower(kind)
    found = found.when(low.contains("embedding"), row("model", "embedding", C.first_part(kind, dims.EMBEDDING_PARTS, "unknown")))
    found = found.when(kind.contains("vectorStore"), row("tool", "embedding", C.first_part(kind, dims.STORE_PARTS, "unknown")))
    # the package's own name contains "chain", so all other nodes of it are orchestration
    return found.when(low.contains("chain"), row("agent_framework", "orchestration", "n8n"))


def _string(parameters: Column, *path: str) -> Column:
    return F.try_variant_get(parameters, "$." + ".".join(path), "string")


def ai_nodes_of(v: Column) -> Column:
    """Structs ``node, type, provider`` of the AI nodes of a workflow export's variant, as :func:`node_components` names them."""
    get = lambda n, key: F.try_variant_get(n, f"$.{key}", "string")
    nodes = F.transform(F.when(files.is_workflow(v), F.try_variant_get(v, "$.nodes", "array<variant>")), lambda n: F.struct(F.coalesce(F.nullif(get(n, "name"), F.lit("")), get(n, "type")).alias("node"), node_kind(get(n, "type")).alias("k")))
    return F.transform(F.filter(nodes, lambda n: n["k"].isNotNull()), lambda n: F.struct(n["node"].alias("node"), n["k"]["type"].alias("type"), n["k"]["provider"].alias("provider")))


def node_components(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """AI nodes of workflow exports as components, from ``node, type, parameters`` (JSON text) and the columns to keep.

    Columns: the kept ones, ``node, type, usage_type, provider, model_name, flags``.
    Flags: inline credentials, a client of a server that is not local, a model without a version.
    """
    rows = nodes.withColumn("_k", node_kind(F.col("type"))).where("_k is not null").withColumn("_p", F.try_parse_json("parameters"))
    model_keys = ["model", "modelId", "modelName", "modelVersion"]
    model = F.coalesce(*[_string(F.col("_p"), k) for k in model_keys], *[_string(F.col("_p"), "resource", k) for k in model_keys], F.lit(""))
    rows = rows.select(*keep, F.coalesce(F.nullif("node", F.lit("")), "type").alias("node"), "_p", "parameters", "_k.*", model.alias("model_name"))
    value = lambda key: F.coalesce(_string(F.col("_p"), key), F.lit(""))
    own = functools.reduce(operator.or_, [(F.length(value(k)) > 5) & ~F.lower(value(k)).isin("your_api_key", "your-api-key", "placeholder", "example") for k in NODE_CREDENTIALS])
    key = F.col("parameters").rlike("|".join(f"(?:{p})" for p, _, _ in dims.KEY_PATTERNS))
    urls = F.array(*[value(k) for k in ("sseEndpoint", "sseUrl", "serverUrl", "url", "endpoint")])
    remote = F.exists(urls, lambda u: (u != "") & ~F.lower(u).rlike(r"localhost|127\.0\.0\.1|::1"))
    unpinned = F.col("model_name").isin(dims.UNPINNED_MODELS) | ((F.col("model_name") == "") & (F.col("type") == "llm_provider"))
    flags = F.array_compact(F.array(F.when(own | key, "hardcoded_credentials"), F.when((F.col("type") == "mcp_client") & remote, "mcp_unknown_server"), F.when(unpinned, "unpinned_model")))
    return rows.withColumn("flags", flags).drop("_p", "parameters")


# Names of parameters that hold a node's credentials.
NODE_CREDENTIALS = ["apiKey", "api_key", "token", "accessToken", "access_token", "secret", "secretKey", "secret_key", "password", "authToken", "auth_token"]


def http_keys(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """HTTP-request nodes with a key in their parameters: the kept columns, ``node, provider`` of the first pattern found."""
    provider = F.when(F.lit(False), F.lit(""))
    for pattern, name, _ in dims.KEY_PATTERNS:
        provider = provider.when(F.col("parameters").rlike(pattern), name)
    return nodes.where(F.col("type").endswith(".httpRequest")).withColumn("provider", provider).where("provider is not null").select(*keep, "node", "provider")


def workflow_risks(nodes: DataFrame, settings: DataFrame | None = None, key: str = "workflow_id") -> DataFrame:
    """Per workflow ``internet_facing, webhook_no_auth, handles_errors`` from ``type, parameters`` (JSON text) and, where it is, ``on_error``.

    Errors are handled by a workflow named in ``settings(key, error_workflow)``,
    by a node for errors, or by a node that goes on after one.
    """
    low = F.lower("type")
    hook = low.contains("webhook")
    auth = F.get_json_object("parameters", "$.authentication")
    goes_on = (F.coalesce("on_error", F.lit("")) != "") & (F.col("on_error") != "stopWorkflow") if "on_error" in nodes.columns else F.lit(False)
    per = nodes.groupBy(key).agg(F.bool_or(hook).alias("internet_facing"), F.bool_or(hook & (F.coalesce(auth, F.lit("none")) == "none")).alias("webhook_no_auth"), F.bool_or(low.contains("error") | F.coalesce(goes_on, F.lit(False))).alias("handles_errors"))
    if settings is None:
        return per
    named = settings.where(F.coalesce("error_workflow", F.lit("")) != "").select(key, F.lit(True).alias("_named")).distinct()
    return per.join(named, key, "left").select(key, "internet_facing", "webhook_no_auth", (F.col("handles_errors") | F.coalesce("_named", F.lit(False))).alias("handles_errors"))
