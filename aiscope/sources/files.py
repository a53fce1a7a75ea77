"""Source trees and text as tables: listing, pruning, decoding, lines, and structured documents."""

from __future__ import annotations

import ast
import bisect
import functools
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aiscope.functions import columns as C
from aiscope.functions import dims

MAX_FILE_SIZE = 10 * 1024 * 1024
MAX_RULES = 10_000


def corpus(spark: SparkSession, root: str, max_size: int = MAX_FILE_SIZE, include_tests: bool = False, with_content: bool = True) -> DataFrame:
    """Files below ``root`` as ``path, modificationTime, length[, content]``.

    Excluded folders, test folders (unless wanted), compiled Python and files
    over ``max_size`` are left out; the size limit reaches the file source, so
    large files are not opened.  Binary files (a zero byte among the first
    8192) go when the content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.col("length") <= max_size)
    files = files.where(kept_path(relative(F.col("path"), root), include_tests))
    if not with_content:
        return files.select("path", "modificationTime", "length")
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    return files.where(~F.contains(head, F.decode(F.lit(b"\0"), "ISO-8859-1")))


def relative(path: Column, root: str) -> Column:
    bare = root.split("://")[-1].rstrip("/")
    return F.regexp_replace(path, r"^.*?" + "".join("\\" + c if not c.isalnum() else c for c in bare) + "/?", "")


def kept_path(path: Column, include_tests: bool = False) -> Column:
    dropped = dims.EXCLUDED_DIRS + ([] if include_tests else dims.TEST_DIRS)
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dropped))) & ~path.endswith(".pyc")


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Leave out ignored files.  ``rules(priority, pattern, negated)``: of all that match, the last decides."""
    rows = rules.select("priority", "pattern", "negated").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} ignore rules")
    kept = F.when(F.lit(False), F.lit(True))
    for row in sorted(rows, key=lambda r: -r.priority):
        kept = kept.when(F.col("path").rlike(row.pattern), F.lit(bool(row.negated)))
    return files.where(kept.otherwise(F.lit(True)))


def with_family(files: DataFrame) -> DataFrame:
    """One row per file and family that it belongs to, by extension in any case or exact name."""
    spark = files.sparkSession
    rows = [(family, x) for family, names in dims.FILE_FAMILIES.items() for x in names]
    table = F.broadcast(spark.createDataFrame(rows, "family string, mark string"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    named = files.withColumn("_name", name).withColumn("_ext", ext)
    return named.join(table, (F.col("mark") == F.col("_ext")) | (F.col("mark") == F.col("_name"))).drop("_name", "_ext", "mark").distinct()


def text_of(content: Column, fallback: bool = False) -> Column:
    """UTF-8 with wrong bytes dropped, or as Latin-1 when any is wrong."""
    if fallback:
        return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def lines(texts: DataFrame, text: str = "content") -> DataFrame:
    """``path, line_no, line`` from 1; other columns stay."""
    rest = [c for c in texts.columns if c != text]
    split = F.split(F.col(text).cast("string"), "\r\n|\n|\r")
    return texts.select(*rest, F.posexplode(split).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose content hash is not in ``seen(path, sha256)``, with their hash."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(seen.select("path", "sha256"), ["path", "sha256"], "left_anti")


def updated_hashes(seen: DataFrame, files: DataFrame) -> DataFrame:
    """The state after a scan: new hashes replace old ones of the same path."""
    new = files.select("path", F.sha2("content", 256).alias("sha256"))
    return seen.join(new, "path", "left_anti").unionByName(new)


def workflows(documents: DataFrame, text: str = "content") -> DataFrame:
    """Workflow exports: rows whose JSON has a list of nodes and an object of connections, with ``v VARIANT``."""
    parsed = documents.withColumn("v", F.try_parse_json(F.col(text)))
    return parsed.where(is_workflow(F.col("v")))


def is_workflow(v: Column) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, "$.connections", "variant"))
    return F.try_variant_get(v, "$.nodes", "array<variant>").isNotNull() & kind.startswith("OBJECT")


def workflow_nodes(documents: DataFrame) -> DataFrame:
    """``path, workflow, pos, node, type, parameters, credentials`` of valid exports."""
    nodes = documents.select("path", F.coalesce(F.try_variant_get("v", "$.name", "string"), F.col("path")).alias("workflow"), F.posexplode(F.try_variant_get("v", "$.nodes", "array<variant>")).alias("pos", "n"))
    get = lambda key, kind: F.try_variant_get("n", f"$.{key}", kind)
    return nodes.select("path", "workflow", "pos", get("name", "string").alias("node"), get("type", "string").alias("type"), F.to_json(get("parameters", "variant")).alias("parameters"), F.to_json(get("credentials", "variant")).alias("credentials"))


def workflow_edges(documents: DataFrame) -> DataFrame:
    """``path, src, dst, edge_pos``: distinct targets of each node, in the order of the export."""
    return documents.sparkSession.sql(
        """select path, src, dst, min(edge_pos) as edge_pos from (
             select w.path, s.key as src, try_variant_get(t.value, '$.node', 'string') as dst,
                    struct(k.pos as kind, o.pos as output, t.pos as target) as edge_pos
             from {documents} w,
                  lateral variant_explode(try_variant_get(w.v, '$.connections', 'variant')) s,
                  lateral variant_explode(s.value) k,
                  lateral variant_explode(k.value) o,
                  lateral variant_explode(o.value) t)
           where dst is not null group by path, src, dst""",
        documents=documents,
    )


def notebook_cells(documents: DataFrame, text: str = "content") -> DataFrame:
    """``path, cell, source`` of code cells; a source may be text or a list of lines."""
    parsed = documents.withColumn("v", F.try_parse_json(F.col(text)))
    return parsed.select("path", F.explode_outer(code_cells(F.col("v"))).alias("c")).where("c is not null").select("path", "c.*")


def code_cells(v: Column) -> Column:
    """Structs ``cell, source`` of the code cells of a notebook's variant."""
    cells = F.transform(F.try_variant_get(v, "$.cells", "array<variant>"), lambda c, i: F.struct(i.alias("cell"), c.alias("c")))
    code = F.filter(cells, lambda x: F.try_variant_get(x["c"], "$.cell_type", "string") == "code")
    source = lambda c: F.coalesce(F.array_join(F.try_variant_get(c, "$.source", "array<string>"), ""), F.try_variant_get(c, "$.source", "string"))
    return F.transform(code, lambda x: F.struct(x["cell"].alias("cell"), source(x["c"]).alias("source")))


@functools.cache
def _yaml_loader() -> type:
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Safe, and reads tags such as !Ref as plain values."""

    def plain(loader, _suffix: str, node: yaml.Node):  # noqa: ANN001, ANN202
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, deep=True)

    Loader.add_multi_constructor("!", plain)
    return Loader


def yaml_as_json(text: str | None) -> str | None:
    """A YAML text as JSON; None if it is no YAML or holds what JSON does not."""
    import yaml

    try:
        return None if text is None else json.dumps(yaml.load(text, Loader=_yaml_loader()), default=str, allow_nan=False)  # noqa: S506
    except (yaml.YAMLError, TypeError, ValueError, AttributeError, RecursionError):
        return None


def toml_as_json(text: str | None) -> str | None:
    """The same for TOML."""
    import tomllib

    try:
        return None if text is None else json.dumps(tomllib.loads(text), default=str, allow_nan=False)
    except (tomllib.TOMLDecodeError, TypeError, ValueError, RecursionError):
        return None


yaml_json = C.parsed_in_runs(yaml_as_json, pa.string(), T.StringType())
yaml_json_shared = C.parsed_in_runs(yaml_as_json, pa.string(), T.StringType(), shared=True)
toml_json = C.parsed_in_runs(toml_as_json, pa.string(), T.StringType())
toml_json_shared = C.parsed_in_runs(toml_as_json, pa.string(), T.StringType(), shared=True)


def yaml_documents(documents: DataFrame) -> DataFrame:
    """``path, v VARIANT`` from ``path, content``; files that are no YAML give no row."""
    read = documents.select("path", yaml_json(F.col("content").cast("string")).alias("json"))
    return read.select("path", F.try_parse_json("json").alias("v")).where("v is not null")


FACT = T.StructType().add("kind", "string").add("name", "string").add("args", T.ArrayType(T.StringType())).add("line", "integer")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else ""


def facts_of(text: str | None) -> list[tuple[str, str, list[str], int]]:
    """(kind, name, args, line) of the syntax tree of a Python text; none if it has errors."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows: list[tuple[str, str, list[str], int]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            rows += [("import", a.name, [a.asname or a.name], node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            rows += [("import_from", node.module, [a.name, a.asname or a.name], node.lineno) for a in node.names]
        elif isinstance(node, ast.Call):
            rows.append(("call", _dotted(node.func), [], node.lineno))
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            rows.append(("string", node.value, [], node.lineno))
        if isinstance(node, ast.ClassDef):
            rows.append(("class", node.name, [_dotted(b) for b in node.bases], node.lineno))
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in node.decorator_list:
                of = d.args if isinstance(d, ast.Call) else []
                refs = [a.value if isinstance(a, ast.Constant) else _dotted(a) for a in of]
                rows.append(("decorator", _dotted(d), [node.name, *map(str, refs)], d.lineno))
    # lone surrogates, which an escape in a literal may give, are no text
    clean = lambda x: x.encode("utf-8", "replace").decode()
    return [(kind, clean(name), [clean(a) for a in args], line) for kind, name, args, line in rows]


_FACT = pa.struct([("kind", pa.string()), ("name", pa.string()), ("args", pa.list_(pa.string())), ("line", pa.int32())])
_facts = lambda text: [dict(zip(("kind", "name", "args", "line"), fact)) for fact in facts_of(text)]
python_facts_of = C.parsed_in_runs(_facts, pa.list_(_FACT), T.ArrayType(FACT))
python_facts_shared = C.parsed_in_runs(_facts, pa.list_(_FACT), T.ArrayType(FACT), shared=True)


def python_facts(documents: DataFrame) -> DataFrame:
    """Facts of Python syntax trees, ``path, kind, name, args, line``: imports, calls, strings, classes and decorators; bad files give none."""
    found = documents.select("path", F.explode(python_facts_of(F.col("content").cast("string"))).alias("f"))
    return found.select("path", "f.*")


# What begins, ends or hides a brace in Terraform files.
_HCL_CODE = re.compile(r"""(?P<head>\bresource\s+"(?P<type>[^"\n]+)"\s+"(?P<name>[^"\n]+)")|(?P<string>")|(?P<open>\{)|(?P<close>\})|(?P<comment>\#[^\n]*|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|<<[-~]?\s*"?(?P<heredoc>\w+)"?[^\n]*\n""", re.VERBOSE)
_HCL_STRING = re.compile(r"""(?P<skip>\\.|\$\$\{|%%\{)|(?P<inner>[$%]\{)|(?P<end>"|\n)""")


def hcl_resources(text: str | None) -> list[tuple[int, str, str, str]]:
    """(line, type, name, block) of the resources of a Terraform file.

    One pass over the text with a stack of what is open: braces in strings,
    comments and heredocs count for nothing, expressions in strings may hold
    strings of their own, and a block may begin on a later line.
    """
    text = text or ""
    ends = [m.start() for m in re.finditer("\n", text)]
    found: list[list] = []  # [start, type, name, end of the block]
    stack: list[tuple[str, int | None]] = []  # what is open, and the resource whose block a brace begins
    at, waiting = 0, None
    while at < len(text):
        if stack and stack[-1][0] == "string":
            m = _HCL_STRING.search(text, at)
            if m is None:
                break
            at = m.end()
            if m["inner"]:
                stack.append(("inner", None))
            elif m["end"]:
                stack.pop()
            continue
        m = _HCL_CODE.search(text, at)
        if m is None:
            break
        at = m.end()
        if m["head"]:
            found.append([m.start(), m["type"], m["name"], None])
            waiting = len(found) - 1
        elif m["string"]:
            stack.append(("string", None))
        elif m["open"]:
            stack.append(("brace", waiting))
            waiting = None
        elif m["close"] and stack:
            _, of = stack.pop()
            if of is not None:
                found[of][3] = at
        elif m["heredoc"]:
            end = re.compile(rf"^[ \t]*{re.escape(m['heredoc'])}[ \t]*\r?$", re.MULTILINE).search(text, at)
            at = end.end() if end else len(text)
    closed = {k for k, f in enumerate(found) if f[3] is not None}
    begun = {of for _, of in stack if of is not None}
    # resources do not hold each other, so a block that is not closed ends where the next one begins
    last = [*(f[0] for f in found[1:]), len(text)]
    block = lambda k, f: text[f[0] : min(f[3] if k in closed else last[k], last[k])] if k in closed or k in begun else ""
    return [(bisect.bisect_left(ends, f[0]) + 1, f[1], f[2], block(k, f)) for k, f in enumerate(found)]


RESOURCE = T.StructType().add("line_no", "integer").add("resource_type", "string").add("resource_name", "string").add("block", "string")
_RESOURCE = pa.struct([("line_no", pa.int32()), ("resource_type", pa.string()), ("resource_name", pa.string()), ("block", pa.string())])
_resources = lambda text: [dict(zip(RESOURCE.names, r)) for r in hcl_resources(text)]
terraform_blocks = C.parsed_in_runs(_resources, pa.list_(_RESOURCE), T.ArrayType(RESOURCE))
terraform_blocks_shared = C.parsed_in_runs(_resources, pa.list_(_RESOURCE), T.ArrayType(RESOURCE), shared=True)


SCAN_SCHEMA = """scan_id string, target_path string, scan_timestamp string, components array<struct<
    id string, name string, type string, version string, provider string, model_name string,
    location struct<file_path string, line_number int, context_snippet string>, usage_type string,
    risk struct<score int, severity string, factors array<string>, owasp_categories array<string>>,
    metadata map<string, string>, flags array<string>, source string>>"""


def saved_scans(spark: SparkSession, path: str) -> DataFrame:
    """Saved scans, one component a row; documents without components (such as a bill of materials) are left out."""
    scans = spark.read.schema(_ddl(SCAN_SCHEMA)).json(path, multiLine=True)
    return scans.where("components is not null and scan_timestamp is not null").select("scan_id", "target_path", "scan_timestamp", F.posexplode("components").alias("pos", "c")).select("scan_id", "target_path", "scan_timestamp", "pos", "c.*")


def _ddl(text: str) -> str:
    return " ".join(text.split()).replace("struct< ", "struct<")


def findings(documents: DataFrame, text: str = "content") -> DataFrame:
    """Components from three shapes: a list, an object with components, or SARIF runs with results.

    Columns: ``path, name, component_type, provider, severity, risk_score, file, line``.
    """
    v = documents.select("path", F.try_parse_json(F.col(text)).alias("v"))
    get = lambda c, key, kind: F.try_variant_get(c, f"$.{key}", kind)
    listed = v.select("path", F.explode(F.coalesce(F.try_variant_get("v", "$.components", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("c"))
    props = F.map_from_entries(F.transform(F.coalesce(get("c", "properties", "array<struct<name string, value string>>"), F.array().cast("array<struct<name:string,value:string>>")), lambda p: F.struct(F.regexp_replace(F.translate(F.substring_index(p["name"], ":", -1), "-", "_"), "^$", "_"), p["value"])))
    props = F.map_filter(props, lambda k, _: k.isNotNull())
    one = listed.select(
        "path", get("c", "name", "string").alias("name"), F.coalesce(get("c", "component_type", "string"), get("c", "type", "string")).alias("component_type"),
        F.coalesce(get("c", "provider", "string"), props["provider"]).alias("provider"),
        F.coalesce(get("c", "risk.severity", "string"), get("c", "severity", "string")).alias("severity"),
        F.coalesce(get("c", "risk.score", "int"), get("c", "risk_score", "int"), props["risk_score"].try_cast("int")).alias("risk_score"),
        F.coalesce(get("c", "location.file_path", "string"), get("c", "file_path", "string"), F.substring_index(props["source_location"], ":", 1)).alias("file"),
        get("c", "location.line_number", "int").alias("line"),
    )
    results = v.select("path", F.explode(F.try_variant_get("v", "$.runs", "array<variant>")).alias("r")).select("path", F.explode(F.try_variant_get("r", "$.results", "array<variant>")).alias("c"))
    place = "locations[0].physicalLocation"
    two = results.select(
        "path", get("c", "ruleId", "string").alias("name"), get("c", "properties.component_type", "string").alias("component_type"), get("c", "properties.provider", "string").alias("provider"),
        F.when(get("c", "level", "string") == "error", "critical").when(get("c", "level", "string") == "warning", "high").otherwise("medium").alias("severity"),
        get("c", "properties.risk_score", "int").alias("risk_score"), get("c", f"{place}.artifactLocation.uri", "string").alias("file"), get("c", f"{place}.region.startLine", "int").alias("line"),
    )
    return one.unionByName(two)


def running_section(rows: DataFrame, marker: Column, by: list[str], order: str, name: str = "section") -> DataFrame:
    """Carry the last marker down the lines of each file."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(window))


LISTING_KINDS = [
    # Listing kind, name key, id key, component type, provider, place prefix.
    ("bedrock_models", "modelName", "modelId", "model", "AWS Bedrock", "aws://bedrock/models/"), ("bedrock_agents", "agentName", "agentId", "agent_framework", "AWS Bedrock", "aws://bedrock/agents/"),
    ("bedrock_knowledge_bases", "name", "knowledgeBaseId", "tool", "AWS Bedrock", "aws://bedrock/knowledge-bases/"), ("sagemaker_endpoints", "EndpointName", "EndpointArn", "endpoint", "AWS SageMaker", "aws://sagemaker/endpoints/"),
    ("sagemaker_models", "ModelName", "ModelArn", "model", "AWS SageMaker", "aws://sagemaker/models/"), ("vertex_endpoints", "displayName", "name", "endpoint", "Google Vertex AI", "gcp://vertex/endpoints/"),
    ("vertex_models", "displayName", "name", "model", "Google Vertex AI", "gcp://vertex/models/"), ("azure_openai", "name", "id", "llm_provider", "Azure OpenAI", "azure://openai/"),
    ("azure_ml_endpoints", "name", "id", "endpoint", "Azure ML", "azure://ml/endpoints/"),
    ("bedrock_custom_models", "modelName", "modelArn", "model", "AWS Bedrock", "aws://bedrock/custom-models/"), ("comprehend_endpoints", "EndpointName", "EndpointArn", "endpoint", "AWS Comprehend", "aws://comprehend/endpoints/"),
    ("kendra_indices", "Name", "Id", "tool", "AWS Kendra", "aws://kendra/indices/"), ("vertex_custom_jobs", "displayName", "name", "workflow", "Google Vertex AI", "gcp://vertex/custom-jobs/"),
    ("azure_openai_deployments", "name", "id", "model", "Azure OpenAI", "azure://openai/deployments/"), ("azure_cognitive_services", "name", "id", "llm_provider", "Azure AI", "azure://cognitive/"),
]


def cloud_components(listings: DataFrame) -> DataFrame:
    """Exported cloud listings ``listing_kind, item VARIANT`` as components; unknown kinds are left out."""
    table = listings.sparkSession.createDataFrame(LISTING_KINDS, "listing_kind string, name_key string, id_key string, type string, provider string, prefix string")
    met = listings.join(F.broadcast(table), "listing_kind")
    name, ident = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key in sorted({k for row in LISTING_KINDS for k in row[1:3]}):
        value = F.try_variant_get("item", f"$.{key}", "string")
        name = F.when(F.col("name_key") == key, value).otherwise(name)
        ident = F.when(F.col("id_key") == key, value).otherwise(ident)
    usage = F.when(F.lower(name).contains("embed"), "embedding").when(F.col("type") == "agent_framework", "agent").otherwise("completion")
    return met.select(F.coalesce(name, ident).alias("name"), "type", "provider", usage.alias("usage_type"), F.concat("prefix", F.coalesce(ident, name)).alias("file_path"))


REQUEST_LOG = "timestamp timestamp, method string, url string, status_code int, duration_ms double, policy_decision string, enforcement_action string, error string"


def request_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST_LOG).json(path)


def policy_rules(policies: DataFrame) -> DataFrame:
    """Rules of enabled policy texts ``policies(policy_id, enabled, dsl)``, a row for each condition.

    Understands ``forbid|permit (principal, action == Action::"x", resource)
    when { request.field op "value"; … };`` with comments.  Longer operators
    are tried before shorter ones.
    """
    rule = r'(?is)(?:forbid|permit)\s*\([^)]*\)\s*when\s*\{[^}]+\}\s*;'
    condition = r'(?i)(?:request|resource|context)\.(\w+)\s*(==|!=|>=|<=|>|<|contains|startswith|endswith)\s*("[^"]*"|[\d.]+)'
    text = F.regexp_replace("dsl", r"//[^\n]*", "")
    rules = policies.where("enabled").select("policy_id", F.posexplode(F.regexp_extract_all(text, F.lit(rule), F.lit(0))).alias("rule_pos", "raw"))
    conditions = rules.withColumn("effect", F.lower(F.regexp_extract("raw", r"(?i)(forbid|permit)", 1))).withColumn("action", F.regexp_extract("raw", r'Action::"([^"]*)"', 1))
    body = F.regexp_extract("raw", r"(?s)\{([^}]+)\}", 1)
    conditions = conditions.select("policy_id", "rule_pos", "raw", "effect", "action", F.posexplode(F.regexp_extract_all(body, F.lit(condition), F.lit(0))).alias("cond_pos", "c"))
    part = lambda i: F.regexp_extract("c", condition, i)
    value = F.regexp_replace(part(3), '^"|"$', "")
    return conditions.select("policy_id", "rule_pos", "cond_pos", "effect", "action", F.lower(part(1)).alias("field"), F.lower(part(2)).alias("op"), value.alias("value"), value.try_cast("double").alias("value_num"), F.trim("raw").alias("raw"))
