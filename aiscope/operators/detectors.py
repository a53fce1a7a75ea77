"""The library's own detectors, registered by name for :func:`aiscope.operators.plugins.run_detectors`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aiscope.functions import columns as C
from aiscope.functions import dims
from aiscope.operators import detect, graph
from aiscope.operators.plugins import detector
from aiscope.sources import files


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _ends(*extensions: str):  # noqa: ANN202
    return lambda path: F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*extensions)


_CODE = [x for x in dims.FILE_FAMILIES["code"] if x.startswith(".")]
_is_yaml, _is_json = _ends(".yml", ".yaml"), _ends(".json")
_BASES = sorted({p.split(".")[0] for names in dims.PACKAGES.values() for p in names})


def _is_compose(path: Column) -> Column:
    return _name(path).rlike(r"^(docker-)?compose[^/]*\.ya?ml$")


def _is_ci(path: Column) -> Column:
    return _is_yaml(path) & (path.contains(".github/workflows/") | _name(path).rlike(r"^(ci|\.gitlab-ci)\.ya?ml$"))


def _is_manifest(path: Column) -> Column:
    return _name(path).rlike(r"^requirements.*\.txt$|\.csproj$") | _name(path).isin(*dims.FILE_FAMILIES["deps"])


def _is_settings(path: Column) -> Column:
    return _name(path).rlike(r"\.(json|ya?ml|toml|ini|cfg)$") & ~_name(path).isin(*dims.SKIPPED_CONFIG)


def _imports_ai(fact: Column) -> Column:
    return fact["kind"].isin("import", "import_from") & F.split(fact["name"], r"\.")[0].isin(*_BASES)


def _is_call(fact: Column) -> Column:
    return (fact["kind"] == "call") & fact["name"].rlike("|".join(p for p, _, _ in dims.API_CALLS))


def _names_model(fact: Column) -> Column:
    return (fact["kind"] == "string") & fact["name"].rlike(f"^(?:{'|'.join(p for p, _ in dims.MODEL_LITERALS)})$")


def _makes_flow(fact: Column) -> Column:
    return fact["kind"].isin("class", "decorator") | ((fact["kind"] == "import_from") & (F.get(fact["args"], F.lit(0)) == "Flow"))


@detector("python_imports", _ends(".py"), form="python", maybe=_imports_ai)
def python_imports(facts: DataFrame) -> DataFrame:
    return detect.fact_imports(facts).withColumnRenamed("package", "name").withColumn("type", C.type_of_usage(F.col("usage_type")))


@detector("python_calls", _ends(".py"), form="python", maybe=_is_call)
def python_calls(facts: DataFrame) -> DataFrame:
    return detect.api_calls(facts).select("path", F.col("call").alias("name"), F.lit("llm_provider").alias("type"), "provider", "line")


@detector("python_models", _ends(".py"), form="python", maybe=_names_model)
def python_models(facts: DataFrame) -> DataFrame:
    return detect.model_literals(facts).select("path", F.col("model_name").alias("name"), F.lit("model").alias("type"), "provider", "line")


@detector("python_flows", _ends(".py"), form="python", maybe=_makes_flow)
def python_flows(facts: DataFrame) -> DataFrame:
    """Flow classes and decorated parts of agents."""
    classes = detect.flow_classes(facts).select("path", "name", F.lit("agent_framework").alias("type"), F.lit("CrewAI").alias("provider"), "line")
    parts = detect.fact_decorators(facts).select("path", F.concat_ws(": ", "meaning", "target").alias("name"), F.lit("agent_framework").alias("type"), F.lit("CrewAI").alias("provider"), "line")
    return classes.unionAll(parts)


@detector("sdk_usage", _ends(*_CODE), form="lines", rows=detect.sdk_hits, columns=("sdk", "provider", "type", "usage_type", "used", "model_name"))
def sdk_usage(found: DataFrame) -> DataFrame:
    return detect.first_uses(found.withColumn("used", F.col("used").cast("boolean"))).select("path", "name", "type", "provider", F.col("line_no").alias("line"))


@detector("endpoints", lambda path: detect.is_env_file(path) | _ends(*_CODE, ".yml", ".yaml", ".json", ".toml", ".ini", ".cfg")(path), form="lines", rows=lambda line: detect.endpoint_hits(F.col("path"), line), columns=("kind_rank", "kind", "provider", "usage_type"))
def endpoints(found: DataFrame) -> DataFrame:
    return detect.first_endpoints(found).select("path", F.concat_ws(" ", "provider", "kind").alias("name"), F.lit("endpoint").alias("type"), "provider", F.col("line_no").alias("line"))


@detector("config_keys", _is_settings, form="lines", rows=detect.key_hits, columns=("provider",))
def config_keys(found: DataFrame) -> DataFrame:
    return found.select("path", F.concat("provider", F.lit(" API Key")).alias("name"), F.lit("llm_provider").alias("type"), "provider", F.col("line_no").alias("line"))


@detector("dependencies", _is_manifest, form="manifest", maybe=detect.may_be_known)
def dependencies(declared: DataFrame) -> DataFrame:
    return detect.dependency_components(declared.where("dep <> ''").distinct())


@detector("notebook_imports", _ends(".ipynb"), form="json", rows=lambda v: detect.cell_modules(files.code_cells(v)), columns=("cell", "line_no", "module"))
def notebook_imports(found: DataFrame) -> DataFrame:
    named = detect.first_modules(found.withColumn("cell", F.col("cell").cast("int")).withColumn("line_no", F.col("line_no").cast("int")))
    return named.select("path", F.col("package").alias("name"), C.type_of_usage(F.col("usage_type")).alias("type"), "provider", F.col("line_no").alias("line"))


@detector("notebook_models", _ends(".ipynb"), form="json", rows=lambda v: detect.cell_models(files.code_cells(v)), columns=("provider", "type", "model_name"))
def notebook_models(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("model_name").alias("name"), "type", "provider")


@detector("dockerfiles", lambda path: _name(path).rlike(r"(?i)^dockerfile|\.dockerfile$"), form="lines", rows=detect.image_hits, columns=("image", "provider"))
def dockerfiles(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("image").alias("name"), F.lit("container").alias("type"), "provider", F.col("line_no").alias("line"))


def _ai_services(v: Column) -> Column:
    return F.filter(detect.services_of(v), lambda s: detect.image_priority(s["image"]).isNotNull() | s["gpu"] | s["ai_env"] | s["model_mount"])


@detector("compose_services", _is_compose, form="yaml", rows=_ai_services, columns=("service", "image"))
def compose_services(found: DataFrame) -> DataFrame:
    """Services with an AI image, a GPU, a mounted model or variables of AI software."""
    return found.select("path", F.col("service").alias("name"), F.lit("container").alias("type"), C.image_provider(F.col("image")).alias("provider"))


@detector("ci_steps", _is_ci, form="yaml", rows=detect.steps_of, columns=("action", "token"))
def ci_steps(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("action").alias("name"), F.lit("tool").alias("type"), F.col("token").alias("provider"))


@detector("ci_env", _is_ci, form="yaml", rows=lambda v: F.filter(detect.variables_of(v), lambda e: detect.is_key_variable(e["name"])), columns=("name",))
def ci_env(found: DataFrame) -> DataFrame:
    return found.select("path", "name", F.lit("llm_provider").alias("type"), C.ci_env_provider(F.col("name")).alias("provider"))


@detector("terraform", _ends(".tf"), form="terraform", maybe=lambda resource: resource["resource_type"].isin(*detect.TERRAFORM_TYPES))
def terraform(resources: DataFrame) -> DataFrame:
    return detect.known_resources(resources).select("path", F.concat_ws(".", "resource_type", "resource_name").alias("name"), "type", "provider", F.col("line_no").alias("line"))


@detector("cloudformation", lambda path: _ends(".yml", ".yaml", ".json", ".template")(path) & ~_is_compose(path) & ~_is_ci(path), form="yaml", maybe=detect.may_have_stack, rows=detect.stack_resources, columns=("resource_type", "resource_name", "type", "provider"))
def cloudformation(found: DataFrame) -> DataFrame:
    return found.select("path", F.concat_ws(".", "resource_type", "resource_name").alias("name"), "type", "provider")


@detector("mcp_servers", _is_json, form="json", rows=detect.servers_of, columns=("server", "provider"))
def mcp_servers(found: DataFrame) -> DataFrame:
    return found.select("path", F.concat("server", F.lit(" (MCP Server)")).alias("name"), F.lit("mcp_server").alias("type"), "provider")


@detector("workflow_nodes", _is_json, form="json", rows=graph.ai_nodes_of, columns=("node", "type", "provider"))
def workflow_nodes(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("node").alias("name"), "type", "provider")


@detector("model_files", _ends(*detect.MODEL_FILES), form="file")
def model_files(listing: DataFrame) -> DataFrame:
    return detect.model_files(listing).select("path", _name(F.col("path")).alias("name"), F.lit("model").alias("type"), F.col("format").alias("provider"))
