"""Detection over lines of text: SDK use, keys, endpoints, dependencies, images and infrastructure.

Pattern tables of this package are small and fixed, so they become literal
expressions of one projection: patterns compile once and nothing is joined.
User-supplied tables join as broadcasts.
"""

from __future__ import annotations

import functools
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aiscope.functions import columns as C
from aiscope.functions import dims, text
from aiscope.sources import files

SNIPPET = 200


def _hits(line: Column) -> Column:
    """Structs for the SDKs that a line imports or uses, in the SDKs' order."""
    out = []
    for i, (sdk, (provider, kind, usage, imports, uses, model, _)) in enumerate(dims.SDK_SIGNATURES.items()):
        imported, used = (contains_any(line, telling_literals(x)) & line.rlike("|".join(x)) if x else F.lit(False) for x in (imports, uses))
        name = F.when(used, F.regexp_extract(line, model, 1)).otherwise("") if model else F.lit("")
        row = F.struct(F.lit(i).alias("priority"), F.lit(sdk).alias("sdk"), F.lit(provider).alias("provider"), F.lit(kind).alias("type"), F.lit(usage).alias("usage_type"), used.alias("used"), name.alias("model_name"))
        out.append(F.when(imported | used, row))
    return F.array_compact(F.array(*out))


def any_sdk_pattern() -> str:
    return "|".join(p for s in dims.SDK_SIGNATURES.values() for p in s[3] + s[4])


def literals(pattern: str) -> list[str]:
    """Plain text that a pattern cannot match without, as it stands between its operators."""
    text = re.sub(r"\\[sbwd][*+?]?|\[[^\]]*\][*+?]?|\((?:\?:)?[^()]*\)[*?]|[()^$]|.[*?]", "\0", re.sub(r"\\([(.@/-])", lambda m: {"(": "\1", ".": "\2"}.get(m[1], m[1]), pattern))
    return [x.replace("\1", "(").replace("\2", ".") for x in re.split("\0|\\+", text) if x]


def required_literals(patterns: list[str]) -> list[str]:
    """A few substrings one of which is in every text that any of the patterns matches."""
    common = ["(", "import", "from", "require"]
    out = []
    for pattern in patterns:
        have = literals(pattern)
        short = [c for c in common if any(c in x for x in have)]
        out.append(short[0] if short else max(have, key=len))
    return sorted({x for x in out if not any(y in x and y != x for y in out)})


def telling_literals(patterns: list[str]) -> list[str]:
    """For each pattern the longest substring that every match has, other than words that much text has; one of them is in every text that a pattern matches."""
    common = ("import", "from", "require", "require(", "use")
    out = [max(literals(p), key=lambda x: (x not in common, len(x))) for p in patterns]
    return sorted({x for x in out if not any(y in x and y != x for y in out)})


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(operator.or_, [text.contains(x) for x in parts])


def may_have_sdk(line: Column) -> Column:
    """Plain substrings rule out most lines before any pattern is tried; those of patterns that share a word wait for that word."""
    groups: dict[str, list[str]] = {}
    for pattern in [p for s in dims.SDK_SIGNATURES.values() for p in s[3] + s[4]]:
        have = literals(pattern)
        groups.setdefault(next((c for c in ("require", "import", "(", "@", "from") if any(c in x for x in have)), ""), []).append(pattern)
    return reduce(operator.or_, [line.contains(c) & contains_any(line, telling_literals(ps)) for c, ps in groups.items()])


def sdk_hits(line: Column) -> Column:
    """Structs ``priority, sdk, provider, type, usage_type, used, model_name`` of the SDKs of a line; null or empty if there are none."""
    return F.when(may_have_sdk(line), _hits(line))


def sdk_lines(lines: DataFrame) -> DataFrame:
    """``path, line_no, line, sdk, provider, type, usage_type, used, model_name`` for every SDK on a line."""
    hit = lines.where(may_have_sdk(F.col("line")))
    return hit.select("path", "line_no", "line", F.explode(_hits(F.col("line"))).alias("h")).select("path", "line_no", "line", "h.*")


def sdk_usage(lines: DataFrame) -> DataFrame:
    """The first line of each SDK in each file, and later lines that name a deprecated or unpinned model.

    ``seen`` is 1 for the first; ``flags`` are those of the model.
    """
    snippet = F.substring(text.redact(F.trim("line")), 1, SNIPPET)
    return first_uses(sdk_lines(lines)).select("path", "line_no", "name", "sdk", "type", "provider", "usage_type", "model_name", "seen", "flags", snippet.alias("snippet"))


def first_uses(found: DataFrame) -> DataFrame:
    """What :func:`sdk_usage` keeps of ``path, line_no, sdk, provider, type, usage_type, used, model_name``; other columns stay."""
    by_line = Window.partitionBy("path", "sdk").orderBy("line_no")
    model = F.col("model_name")
    flags = F.array_compact(F.array(F.when(model.isin(dims.DEPRECATED_MODELS), "deprecated_model"), F.when((model != "") & ~C.is_pinned(model), "unpinned_model")))
    ranked = found.withColumn("seen", F.row_number().over(by_line)).withColumn("flags", flags)
    kept = ranked.where((F.col("seen") == 1) | (F.col("used") & (F.size("flags") > 0)))
    later = F.col("seen") > 1
    return kept.withColumn("name", F.when(later, F.concat("sdk", F.lit(" Model"))).otherwise(F.col("sdk"))).withColumn("type", F.when(later, "model").otherwise(F.col("type")))


def shadow_sdks(usage: DataFrame, manifests: DataFrame) -> DataFrame:
    """First uses ``project, path, sdk`` whose packages the project does not declare, under either spelling."""
    deps = usage.sparkSession.createDataFrame([(sdk, d) for sdk, s in dims.SDK_SIGNATURES.items() for d in s[6]], "sdk string, dep string")
    declared = manifests.select("project", C.package_key(F.col("dep")).alias("dep")).distinct()
    known = declared.join(F.broadcast(deps.withColumn("dep", C.package_key(F.col("dep"))).distinct()), "dep").select("project", "sdk").distinct()
    return usage.join(known, ["project", "sdk"], "left_anti")


#: What precedes a key and its first 20 characters; every key has them.
KEY_BEGIN = r"(?:[-_\s'\":=]|AIza)[a-zA-Z0-9_-]{20}"


def key_hits(line: Column) -> Column:
    """Structs ``provider, masked`` of the keys in a line; one simple pattern rules out most lines before the others are tried."""
    pattern = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p, _, _ in dims.KEY_PATTERNS)
    return F.when(line.rlike(KEY_BEGIN) & line.rlike(pattern), F.transform(text.api_keys(line), lambda k: F.struct(k["provider"].alias("provider"), k["masked"].alias("masked"))))


def key_findings(lines: DataFrame, *keep: str) -> DataFrame:
    """``path, line_no, provider, masked`` of keys; the key itself leaves only masked."""
    found = lines.select("path", "line_no", *keep, F.explode_outer(key_hits(F.col("line"))).alias("k")).where("k is not null")
    return found.select("path", "line_no", *keep, F.col("k.provider").alias("provider"), F.col("k.masked").alias("masked"))


def endpoint_of(line: Column) -> Column:
    """Struct ``provider, usage_type`` of the first endpoint pattern in a line, else null."""
    low, found = F.lower(line), F.when(F.lit(False), F.struct(F.lit("").alias("provider"), F.lit("").alias("usage_type")))
    for pattern, provider, usage in dims.ENDPOINTS:
        found = found.when(low.rlike(pattern), F.struct(F.lit(provider).alias("provider"), F.lit(usage).alias("usage_type")))
    return found


# Environment variables by exact name, and parts of names that end in _API_KEY.
ENV_NAMES = {
    "OPENAI_API_KEY": "OpenAI", "ANTHROPIC_API_KEY": "Anthropic", "HF_TOKEN": "HuggingFace", "HUGGINGFACE_TOKEN": "HuggingFace", "COHERE_API_KEY": "Cohere", "MISTRAL_API_KEY": "Mistral",
    "GOOGLE_AI_KEY": "Google", "GOOGLE_API_KEY": "Google", "AZURE_OPENAI_KEY": "Azure OpenAI", "AZURE_OPENAI_API_KEY": "Azure OpenAI", "TOGETHER_API_KEY": "Together", "REPLICATE_API_TOKEN": "Replicate",
    "OLLAMA_HOST": "Ollama", "GROQ_API_KEY": "Groq", "AWS_BEDROCK": "AWS Bedrock", "VERTEX_AI": "Google Vertex AI", "XAI_API_KEY": "xAI",
}
ENV_PARTS = [("OPENAI", "OpenAI"), ("ANTHROPIC", "Anthropic"), ("GOOGLE", "Google"), ("GEMINI", "Google"), ("COHERE", "Cohere"), ("MISTRAL", "Mistral"), ("HUGGING", "HuggingFace"), ("REPLICATE", "Replicate"), ("TOGETHER", "Together"), ("GROQ", "Groq"), ("DEEPSEEK", "DeepSeek")]


def env_provider(name: Column) -> Column:
    found = F.when(name.isin(*ENV_NAMES), C.lookup(name, ENV_NAMES))
    for part, provider in ENV_PARTS:
        found = found.when(name.endswith("_API_KEY") & F.upper(name).contains(part), provider)
    return found


def is_env_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(r"^\.env(\..+)?$|\.env$")


# How the hosts of endpoints end; looked for from the dot on, and back from there.
HOST_ENDS = r"(?i)\.(?:com|ai|xyz|co)(?<=(?:openai|azure|anthropic|googleapis|replicate|amazonaws|aliyuncs)\.com|(?:cohere|mistral|x)\.ai|together\.xyz|huggingface\.co)|:11434"


def endpoint_hits(path: Column, line: Column) -> Column:
    """Structs ``kind_rank, kind, provider, usage_type``: the endpoint in a line, and the variable of an env file; comment lines have none.

    One simple pattern rules out most lines before the others are tried.
    """
    row = lambda rank, kind, provider, usage: F.struct(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), provider.alias("provider"), usage.alias("usage_type"))
    name = F.regexp_extract(line, r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    marked, env = line.rlike(HOST_ENDS), path.contains(".env") & is_env_file(path)
    may = marked & F.exists(F.array(F.lower(line)), lambda low: contains_any(low, telling_literals([p for p, _, _ in dims.ENDPOINTS])))
    hosts = F.transform(F.array(F.when(may, endpoint_of(line))), lambda e: F.when(e.isNotNull(), row(1, "endpoint", e["provider"], e["usage_type"])))
    names = F.transform(F.array(F.when(env, env_provider(name))), lambda p: F.when(p.isNotNull(), row(0, "env_var", p, F.lit("completion"))))
    return F.when((env | marked) & ~F.ltrim(line).startswith("#") & (F.trim(line) != ""), F.array_compact(F.concat(hosts, names)))


def endpoint_findings(lines: DataFrame) -> DataFrame:
    """The first finding of each provider in each file: an endpoint in any line, or a variable of an env file.

    On the same line the variable comes first.  Comment lines are left out.
    """
    # an outer explode, so that the patterns are not tried once more in a filter on the array's size
    found = lines.select("path", "line_no", F.explode_outer(endpoint_hits(F.col("path"), F.col("line"))).alias("e")).where("e is not null")
    return first_endpoints(found.select("path", "line_no", "e.*"))


def first_endpoints(found: DataFrame) -> DataFrame:
    """What :func:`endpoint_findings` keeps of ``path, line_no, kind_rank, kind, provider, usage_type``."""
    first = Window.partitionBy("path", "provider").orderBy("line_no", "kind_rank")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "kind_rank")


def hardcoded_value(value: Column) -> Column:
    """A value that is neither a reference nor a placeholder and that holds a key."""
    # Words of placeholders.
    placeholders = r"(?i)your|xxx|placeholder|changeme|example|todo|<"
    key = "|".join(p if not p.startswith("(?i)") else f"(?:{p})" for p, _, _ in dims.KEY_PATTERNS)
    return (F.trim(value) != "") & ~value.rlike(r"^\$\{") & ~value.rlike(placeholders) & value.rlike(key)


# Model names inside text.
MODEL_MENTION = r"(gpt-4\.5(?:-\w+)*|gpt-4o?(?:-\w+)*|gpt-3\.5(?:-\w+)*|text-(?:davinci|curie|babbage|ada)-\d+|code-(?:davinci|cushman)-\d+|text-embedding-\w+-\d+|dall-e-\d+|whisper-\d+|claude-3-\w+(?:-\w+)*|claude-2(?:\.\d+)?|claude-instant-\d+(?:\.\d+)?|claude-(?:sonnet|opus|haiku)-4(?:-\w+)*|gemini-[\w.]+(?:-\w+)*|mistral-\w+(?:-\w+)*|mixtral-\w+(?:-\w+)*|llama-\d+(?:-\w+)*|codellama-\w+(?:-\w+)*|phi-\d+(?:-\w+)*|deepseek-\w+(?:-\w+)*|grok-\d+(?:\.\d+)?(?:-\w+)*)"


def model_mentions(texts: DataFrame, *keep: str) -> DataFrame:
    """Distinct model names in each text, with their registry row."""
    from aiscope.operators.components import lookup_models

    found = texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MODEL_MENTION), F.lit(1)))).alias("model_name"))
    return lookup_models(found)


# --- dependency manifests ----------------------------------------------------


# Sections of manifests that declare dependencies.
JSON_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
CARGO_SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]
#: A requirement's name, where a version, extras, a marker, an address or nothing follows.
REQUIREMENT = r"(?m)^[ \t]*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)(?=[ \t]*(?:$|[\[<>=!~;@#\\\\]))"
GRADLE = r"(?m)^[ \t]*(?:\w*[iI]mplementation|\w*[aA]pi|compile|\w*[cC]ompileOnly|\w*[rR]untimeOnly)\b[ \t(]*(?:(?:platform|enforcedPlatform)[ \t]*\([ \t]*)?"


def manifest_dependencies(documents: DataFrame) -> DataFrame:
    """Distinct ``path, dep`` declared in manifests ``path, content``, told apart by file name.

    JSON and TOML files are read by their structure, POM files by their
    dependency elements, the others by their statements.  A file that is broken
    declares nothing; versions, scripts and addresses are no dependencies.
    """
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    rows = documents.select("path", text.alias("_t"))
    rows = rows.withColumn("_v", manifest_value(F.col("path"), F.col("_t"), files.toml_json(F.when(is_toml(F.col("path")), F.col("_t")))))
    return rows.select("path", F.explode(declared(F.col("path"), F.col("_t"), F.col("_v"))).alias("dep")).where("dep <> ''").distinct()


def is_toml(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin("Pipfile", "pyproject.toml", "Cargo.toml", "poetry.lock")


def manifest_value(path: Column, text: Column, toml: Column) -> Column:
    """The variant of a manifest that is JSON, or TOML given as JSON."""
    return F.when(F.element_at(F.split(path, "/"), -1) == "package.json", F.try_parse_json(text)).when(is_toml(path), F.try_parse_json(toml))


def declared(path: Column, text: Column, v: Column) -> Column:
    """The distinct names that a manifest declares, as an array: from its text, whose lines end in ``\\n``, and its variant."""
    file = F.element_at(F.split(path, "/"), -1)
    none = F.array().cast("array<string>")
    entry = lambda *path: "$" + "".join(f'["{p}"]' for p in path)
    keys = lambda *path: F.coalesce(F.map_keys(F.try_variant_get(v, entry(*path), "map<string,variant>")), none)
    strings = lambda *path: F.coalesce(F.try_variant_get(v, entry(*path), "array<string>"), none)
    listed = lambda *path: F.coalesce(F.flatten(F.transform(F.map_values(F.try_variant_get(v, entry(*path), "map<string,variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), none))), none)
    below = lambda path, *sections: F.coalesce(F.flatten(F.transform(F.map_values(F.try_variant_get(v, entry(*path), "map<string,variant>")), lambda x: F.flatten(F.array(*[F.coalesce(F.map_keys(F.try_variant_get(x, entry(s), "map<string,variant>")), none) for s in sections])))), none)
    named = lambda values: F.transform(values, lambda x: F.regexp_extract(x, r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1))
    all_of = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    poetry = F.filter(F.concat(keys("tool", "poetry", "dependencies"), keys("tool", "poetry", "dev-dependencies"), below(("tool", "poetry", "group"), "dependencies")), lambda x: x != "python")
    locked = F.coalesce(F.transform(F.try_variant_get(v, "$.package", "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string")), none)
    pom = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<exclusions>.*?</exclusions>", "")
    blocks = F.regexp_extract_all(pom, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    element = lambda block, tag: F.trim(F.regexp_extract(block, rf"<{tag}>\s*([^<]+?)\s*</{tag}>", 1))
    found = (
        F.when(file.rlike(r"^requirements.*\.txt$"), all_of(REQUIREMENT))
        .when(file == "Pipfile", F.concat(keys("packages"), keys("dev-packages")))
        .when(file == "pyproject.toml", F.concat(named(F.concat(strings("project", "dependencies"), listed("project", "optional-dependencies"), listed("dependency-groups"))), poetry))
        .when(file == "poetry.lock", locked)
        .when(file == "Cargo.toml", F.concat(*[keys(s) for s in CARGO_SECTIONS], keys("workspace", "dependencies"), below(("target",), *CARGO_SECTIONS)))
        .when(file == "package.json", F.concat(*[keys(s) for s in JSON_SECTIONS]))
        .when(file == "go.mod", F.filter(F.transform(F.filter(all_of(r"(?m)^[ \t]*(?:require[ \t]+)?[a-z0-9.-]+\.[a-z]+(?:/\S+)?[ \t]+v\d[^\n]*", 0), lambda x: ~x.contains("=>")), lambda x: F.regexp_extract(x, r"([a-z0-9.-]+\.[a-z]+(?:/\S+)?)[ \t]+v\d", 1)), lambda x: x != ""))
        .when(file == "Gemfile", all_of(r"(?m)^[ \t]*gem[ \t(]+[\"']([^\"']+)[\"']"))
        .when(file == "pom.xml", F.transform(F.filter(blocks, lambda b: element(b, "artifactId") != ""), lambda b: F.concat_ws(":", element(b, "groupId"), element(b, "artifactId"))))
        .when(file.isin("build.gradle", "build.gradle.kts"), F.concat(all_of(GRADLE + r"[\"']([^:\"']+:[^:\"']+)"), F.transform(all_of(GRADLE + r"group\s*[:=]\s*[\"'][^\"']+[\"']\s*,\s*name\s*[:=]\s*[\"'][^\"']+[\"']", 0), lambda x: F.concat_ws(":", F.regexp_extract(x, r"group\s*[:=]\s*[\"']([^\"']+)", 1), F.regexp_extract(x, r"name\s*[:=]\s*[\"']([^\"']+)", 1)))))
        .when(file.endswith(".csproj"), F.regexp_extract_all(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), F.lit(r"<PackageReference\s[^>]*?Include=\"([^\"]+)\""), F.lit(1)))
    )
    return F.array_distinct(found)


def may_be_known(dep: Column) -> Column:
    """Whether a declared name may be an AI package; see :func:`known_packages`."""
    keys = sorted({n.lower().replace("_", "-") for names in dims.PACKAGES.values() for n in names})
    return C.package_key(dep).isin(*keys) | C.package_key(F.element_at(F.split(dep, ":"), -1)).isin(*keys)


def known_packages(declared: DataFrame) -> DataFrame:
    """Declared names that are AI packages, with provider and usage; names compare under all spellings."""
    table = dims.packages(declared.sparkSession).withColumn("k", C.package_key(F.col("package"))).groupBy("k").agg(F.min(F.struct("package", "provider", "usage_type")).alias("p"))
    key = C.package_key(F.col("dep"))
    last_part = C.package_key(F.element_at(F.split("dep", ":"), -1))
    met = declared.join(F.broadcast(table), (F.col("k") == key) | (F.col("k") == last_part))
    return met.select(*declared.columns, F.col("p.provider").alias("provider"), F.col("p.usage_type").alias("usage_type")).distinct()


# --- containers and infrastructure --------------------------------------------


def image_priority(ref: Column) -> Column:
    """Place of the first known image that a reference contains, else null."""
    found = F.when(F.lit(False), F.lit(0))
    for i, image in enumerate(dims.IMAGES):
        found = found.when(F.lower(ref).contains(image), i)
    return found


def image_hits(line: Column) -> Column:
    """Structs ``image, tag, provider`` of a FROM line with an AI image."""
    bare = F.trim(F.split(line, "#")[0])
    ref = F.when(line.rlike(r"(?i)^ *FROM\s"), F.regexp_replace(F.regexp_extract(bare, r"(?i)^FROM\s+(.*)$", 1), r"--platform=\S+\s+", ""))
    known = F.filter(F.array(ref), lambda r: (r != "") & image_priority(r).isNotNull())
    return F.transform(known, lambda r: F.struct(C.image_name(r).alias("image"), C.image_tag(r).alias("tag"), C.image_provider(r).alias("provider")))


def dockerfile_images(lines: DataFrame) -> DataFrame:
    """``path, line_no, image, tag, provider`` of FROM lines with an AI image."""
    found = lines.select("path", "line_no", F.explode_outer(image_hits(F.col("line"))).alias("i")).where("i is not null")
    return found.select("path", "line_no", "i.*")


def members(v: Column, path: str = "$") -> Column:
    """The ``key, value`` of an object's members, or of a list's with null keys, as an array; empty if it is neither."""
    elements = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(F.map_entries(F.try_variant_get(v, path, "map<string,variant>")), elements, F.array().cast("array<struct<key:string,value:variant>>"))


# Parts of variables that compose services pass to AI software.
COMPOSE_ENV = ["OPENAI", "ANTHROPIC", "HUGGING", "HF_TOKEN", "COHERE", "MISTRAL", "OLLAMA", "BEDROCK", "AZURE_OPENAI", "GOOGLE_AI", "VERTEX", "REPLICATE", "TOGETHER", "MODEL_NAME", "MODEL_ID", "LLM_", "AI_API", "EMBEDDING"]


def services_of(v: Column) -> Column:
    """Structs ``service, image, build, gpu, ai_env, model_mount`` of the services of a compose file's variant."""
    get = lambda s, path: F.try_variant_get(s["value"], path, "string")

    def service(s: Column) -> Column:
        as_text = F.lower(F.to_json(s["value"]))
        image, build = F.coalesce(get(s, "$.image"), F.lit("")), F.coalesce(get(s, "$.build.context"), get(s, "$.build"))
        gpu = as_text.rlike(r'"driver":"nvidia"|"capabilities":\[[^\]]*"gpu"|"runtime":"nvidia"')
        ai_env = F.coalesce(F.to_json(F.try_variant_get(s["value"], "$.environment", "variant")).rlike("(?i)" + "|".join(COMPOSE_ENV)), F.lit(False))
        model_mount = as_text.rlike(r'"volumes":\[[^\]]*(model|weights|checkpoint|\.cache/huggingface)')
        return F.struct(s["key"].alias("service"), image.alias("image"), build.alias("build"), gpu.alias("gpu"), ai_env.alias("ai_env"), model_mount.alias("model_mount"))

    return F.transform(members(v, "$.services"), service)


def compose_services(documents: DataFrame) -> DataFrame:
    """``path, service, image, gpu, ai_env, model_mount`` of compose files, from ``path, v VARIANT``."""
    return documents.select("path", F.explode_outer(services_of(F.col("v"))).alias("s")).where("s is not null").select("path", "s.*")


# Steps of CI workflows, in order.
ACTIONS = ["github/copilot", "copilot", "openai", "anthropic", "ai-review", "ai-test", "ai-pr-reviewer", "code-review-gpt", "gpt-review", "claude-review", "llm-review", "semantic-release", "ai-commit", "ai-changelog", "huggingface", "langchain", "autogpt"]


def steps_of(v: Column) -> Column:
    """Structs ``job, step, action, version, token`` of the steps of a CI workflow's variant that use an AI action."""

    def token(uses: Column) -> Column:
        found, low = F.when(F.lit(False), F.lit("")), F.lower(uses)
        for name in ACTIONS:
            found = found.when(low.contains(name), name)
        return found

    def steps(job: Column) -> Column:
        all_steps = F.transform(members(job["value"], "$.steps"), lambda t, i: F.struct(job["key"].alias("job"), i.alias("step"), F.try_variant_get(t["value"], "$.uses", "string").alias("uses")))
        used = F.filter(all_steps, lambda x: token(x["uses"]).isNotNull())
        return F.transform(used, lambda x: F.struct(x["job"].alias("job"), x["step"].alias("step"), C.action_name(x["uses"]).alias("action"), C.action_version(x["uses"]).alias("version"), token(x["uses"]).alias("token")))

    return F.flatten(F.transform(members(v, "$.jobs"), steps))


def ci_steps(documents: DataFrame) -> DataFrame:
    """``path, job, step, action, version, token`` of CI steps that use an AI action."""
    return documents.select("path", F.explode_outer(steps_of(F.col("v"))).alias("s")).where("s is not null").select("path", "s.*")


def terraform_resources(documents: DataFrame) -> DataFrame:
    """``path, line_no, resource_type, resource_name, context, block, provider, type`` of the AI resources in Terraform files ``path, content``.

    The context is the resource's line and the next five, up to 200 characters;
    the block runs to the brace that closes it.
    """
    text = F.col("content").cast("string")
    found = documents.where(text.contains("resource")).select("path", text.alias("_t"), F.explode(files.terraform_blocks(text)).alias("r"))
    lined = F.slice(F.split("_t", "\r\n|\n"), F.col("r.line_no"), F.lit(6))
    return known_resources(found.select("path", "r.*", F.substring(F.trim(F.array_join(lined, "\n")), 1, SNIPPET).alias("context")))


#: Types of AI resources, and their provider and type of component.
TERRAFORM_TYPES = {name: kind for kind, names in dims.TERRAFORM.items() for name in names}


def known_resources(rows: DataFrame) -> DataFrame:
    """Rows whose ``resource_type`` is an AI resource of Terraform, with ``provider, type``."""
    given = rows.withColumn("provider", C.lookup(F.col("resource_type"), {k: v[0] for k, v in TERRAFORM_TYPES.items()})).where("provider is not null")
    return given.withColumn("type", C.lookup(F.col("resource_type"), {k: v[1] for k, v in TERRAFORM_TYPES.items()}))


def terraform_attributes(resources: DataFrame) -> DataFrame:
    """Add the attributes of the block: ``model_id`` by any of its names, ``instance_type, region, gpu, endpoint_name, kind, display_name, description``."""
    attr = lambda name: F.nullif(F.regexp_extract("block", rf'{name}\s*=\s*"([^"]+)"', 1), F.lit(""))
    instance = F.coalesce(attr("instance_type"), attr("machine_type"), attr("vm_size"))
    gpu = F.coalesce(instance.rlike(r"(?i)(^|\.)(ml\.)?(p[2-5]|g[4-6])[a-z]*\.|a2-|nvidia|standard_n[cdv]"), F.lit(False))
    return resources.withColumn("model_id", F.coalesce(attr("model_id"), attr("foundation_model"), attr("model_name"))).withColumn("instance_type", instance).withColumn("region", F.coalesce(attr("region"), attr("location"))).withColumn("gpu", gpu).select("*", *[attr(rf"\b{n}").alias(n) for n in ("endpoint_name", "kind", "display_name", "description")])


def stack_resources(v: Column) -> Column:
    """Structs ``resource_name, resource_type, model_name, provider, type`` of the AI resources of a template's variant."""
    # Keys that may name the model, in order.
    keys = ["FoundationModel", "ModelId", "ModelName", "ModelPackageName", "ModelDataUrl", "BaseModelIdentifier", "EndpointName"]
    table = {f"AWS::{name}": kind for kind, names in dims.CLOUDFORMATION.items() for name in names}
    kind = lambda r: F.try_variant_get(r["value"], "$.Type", "string")

    def row(r: Column) -> Column:
        model = F.coalesce(*[F.nullif(F.try_variant_get(r["value"], f"$.Properties.{k}", "string"), F.lit("")) for k in keys], F.lit(""))
        return F.struct(r["key"].alias("resource_name"), kind(r).alias("resource_type"), model.alias("model_name"), C.lookup(kind(r), {k: v[0] for k, v in table.items()}).alias("provider"), C.lookup(kind(r), {k: v[1] for k, v in table.items()}).alias("type"))

    return F.transform(F.filter(members(v, "$.Resources"), lambda r: kind(r).isin(*table)), row)


def may_have_stack(text: Column) -> Column:
    """Whether a YAML or JSON text can hold a resource of AWS: its type as it stands, or escapes that may spell it."""
    return contains_any(text, ["AWS::", *("\\" + x for x in ("x", "u", "U", "\r", "\n", "\u0085", "\u2028", "\u2029"))])


def cloudformation_resources(documents: DataFrame) -> DataFrame:
    """``path, resource_name, resource_type, model_name, provider, type`` of AI resources in templates ``path, v VARIANT``."""
    return documents.select("path", F.explode_outer(stack_resources(F.col("v"))).alias("r")).where("r is not null").select("path", "r.*")


# Model files by extension.
MODEL_FILES = {".onnx": "ONNX", ".pt": "PyTorch", ".pth": "PyTorch", ".safetensors": "SafeTensors", ".gguf": "GGUF", ".ggml": "GGML", ".h5": "Keras", ".tflite": "TensorFlow Lite", ".bin": "Binary"}


def model_files(files: DataFrame) -> DataFrame:
    """Model artefacts from ``path, length``: format, size, and a flag beyond 1 GiB; ``.bin`` counts from 1 MiB."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = files.withColumn("format", C.lookup(ext, MODEL_FILES)).where(F.col("format").isNotNull() & ((ext != ".bin") | (F.col("length") >= 1 << 20)))
    return found.select("path", "format", F.round(F.col("length") / (1 << 20), 2).alias("size_mb"), F.when(F.col("length") > 1 << 30, F.array(F.lit("large_model_file"))).otherwise(F.array().cast("array<string>")).alias("flags"))


# Parts of commands that are trusted, and providers by part of "name command", in order.
TRUSTED_COMMANDS = ["npx", "node", "python", "python3", "uvx", "mcp-server-", "@modelcontextprotocol/", "@anthropic/"]
MCP_PROVIDERS = [
    ("anthropic", "Anthropic"), ("claude", "Anthropic"), ("openai", "OpenAI"), ("google", "Google"), ("gemini", "Google"), ("filesystem", "MCP Filesystem"), ("fs", "MCP Filesystem"), ("github", "GitHub"), ("git", "MCP Git"),
    ("sqlite", "MCP Database"), ("postgres", "MCP Database"), ("database", "MCP Database"), ("fetch", "MCP Fetch"), ("http", "MCP Fetch"), ("brave", "Brave Search"), ("puppeteer", "MCP Browser"), ("browser", "MCP Browser"),
    ("slack", "Slack"), ("memory", "MCP Memory"), ("time", "MCP Time"),
]


def servers_of(v: Column) -> Column:
    """Structs ``server, command, transport, provider, args, env_names, url, flags`` of the servers in a tool configuration's variant; see :func:`mcp_servers`."""
    none = F.array().cast("array<string>")
    get = lambda s, key, kind: F.try_variant_get(s["value"], f"$.{key}", kind)
    shapes = [F.map_entries(F.try_variant_get(v, path, "map<string,variant>")) for path in ("$.mcpServers", "$.mcp.servers", "$.servers")]
    shape = F.coalesce(*[F.when(F.size(x) > 0, x) for x in shapes])

    def row(s: Column) -> Column:
        command = get(s, "command", "string")
        args = F.coalesce(get(s, "args", "array<string>"), F.when(F.coalesce(get(s, "args", "string"), F.lit("")) != "", F.array(get(s, "args", "string"))), none)
        url = F.coalesce(get(s, "url", "string"), F.get(F.filter(args, lambda a: a.rlike("https?://")), F.lit(0)))
        transport = F.coalesce(get(s, "transport", "string"), F.when(get(s, "url", "variant").isNotNull(), "sse"), F.lit("stdio"))
        env = F.coalesce(F.map_keys(get(s, "env", "map<string,variant>")), none)
        both, name = F.lower(F.concat_ws(" ", s["key"], command)), F.lower(s["key"])
        provider = F.when(F.lit(False), F.lit(""))
        for part, owner in MCP_PROVIDERS:
            provider = provider.when((name if part == "fs" else both).contains(part), owner)
        trusted = contains_any(F.lower(command), TRUSTED_COMMANDS)
        remote = url.isNotNull() & ~C.is_local(url)
        flags = F.array_compact(F.array(F.when(~trusted | remote, "mcp_unknown_server"), F.when(name.contains("http") | name.contains("fetch"), "internet_facing")))
        fields = {"server": s["key"], "command": command, "transport": transport, "args": args, "env_names": env, "url": url, "provider": provider.otherwise("MCP"), "flags": flags}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    return F.transform(F.filter(shape, lambda s: get(s, "command", "string") != ""), row)


def mcp_servers(documents: DataFrame) -> DataFrame:
    """Servers of tool configurations ``path, v VARIANT`` in their three shapes: ``path, server, command, transport, provider, args, env_names, url, flags``.

    The second and third shape count where those before are missing or empty.  A
    server needs a command; one that is not trusted, or an address that is not
    local, is an unknown server.
    """
    return documents.select("path", F.explode_outer(servers_of(F.col("v"))).alias("s")).where("s is not null").select("path", "s.*")


def notebook_imports(cells: DataFrame) -> DataFrame:
    """First import of each AI package in each notebook, by full name before base name."""
    lined = cells.select("path", "cell", F.posexplode(F.split("source", "\n")).alias("line_no", "line")).where(~F.ltrim("line").startswith("#"))
    return first_modules(lined.select("path", "cell", "line_no", imported_module(F.col("line")).alias("module")).where("module <> ''"))


def imported_module(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*(?:from|import)\s+([A-Za-z0-9_.]+)", 1)


def cell_modules(cells: Column) -> Column:
    """Structs ``cell, line_no, module`` of the lines of cells, structs ``cell, source``, that import an AI package."""
    names = F.array(*[F.lit(x) for known in dims.PACKAGES.values() for x in known])
    known = lambda x: F.array_contains(names, x["module"]) | F.array_contains(names, F.split(x["module"], r"\.")[0])
    modules = lambda c: F.transform(F.split(c["source"], "\n"), lambda line, i: F.struct(c["cell"].alias("cell"), i.alias("line_no"), F.when(~F.ltrim(line).startswith("#"), imported_module(line)).otherwise("").alias("module")))
    return F.flatten(F.transform(cells, lambda c: F.filter(F.coalesce(modules(c), F.array().cast("array<struct<cell:int,line_no:int,module:string>>")), lambda x: (x["module"] != "") & known(x))))


def first_modules(named: DataFrame) -> DataFrame:
    """What :func:`notebook_imports` keeps of ``path, cell, line_no, module``, lines from 0."""
    table = F.broadcast(dims.packages(named.sparkSession))
    met = named.join(table, (F.col("package") == F.col("module")) | (F.col("package") == F.split("module", r"\.")[0]))
    best = Window.partitionBy("path", "package").orderBy("cell", "line_no", F.desc(F.length("package")))
    return met.withColumn("n", F.row_number().over(best)).where("n = 1").select("path", "cell", (F.col("line_no") + 1).alias("line_no"), "package", "provider", "usage_type")


def fact_imports(facts: DataFrame) -> DataFrame:
    """Imports of AI packages from syntax-tree facts: the longest known prefix of a module, once per file."""
    modules = facts.where(F.col("kind").isin("import", "import_from")).withColumn("parts", F.split("name", r"\."))
    prefixes = modules.select("path", "name", "line", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "."))).alias("package"))
    met = prefixes.join(F.broadcast(dims.packages(facts.sparkSession)), "package")
    longest = met.groupBy("path", "name").agg(F.max_by(F.struct("package", "provider", "usage_type"), F.length("package")).alias("p"), F.min("line").alias("line"))
    return longest.groupBy("path", F.col("p.package").alias("package"), F.col("p.provider").alias("provider"), F.col("p.usage_type").alias("usage_type")).agg(F.min("line").alias("line"))


def fact_decorators(facts: DataFrame) -> DataFrame:
    """Flow decorators with what they decorate and the names they listen to or route from."""
    # Decorators and what they mean.
    kinds = {"crew": "crew_definition", "agent": "agent_definition", "task": "task_definition", "flow": "flow_definition", "tool": "tool_definition", "start": "flow_start", "listen": "flow_listener", "router": "flow_router"}
    last = F.element_at(F.split("name", r"\."), -1)
    found = facts.where("kind = 'decorator'").withColumn("meaning", C.lookup(last, kinds)).where("meaning is not null")
    return found.select("path", "line", "meaning", F.col("args")[0].alias("target"), F.slice("args", 2, 100).alias("refs"))


def flow_classes(facts: DataFrame) -> DataFrame:
    """Classes whose base is a name imported as a flow."""
    alias = facts.where("kind = 'import_from' and args[0] = 'Flow'").select(F.col("path").alias("p"), F.col("args")[1].alias("alias"))
    bases = facts.where("kind = 'class'").select("path", "name", "line", F.explode("args").alias("base"))
    return bases.join(alias, (F.col("path") == F.col("p")) & (F.col("base") == F.col("alias"))).select("path", "name", "line").distinct()


#: Lines of a block by which findings meet lines.
CONTEXT_BLOCK = 512


def context_lines(findings: DataFrame, lines: DataFrame, radius: int = 10, head: int = 20) -> DataFrame:
    """Each distinct finding ``path, line_no`` with the lines around it as ``context``, joined in order; a finding without a line has the first ``head``.

    Lines and findings are dealt to blocks of a file, a block with the few lines
    beyond its ends that its findings can ask for; there a window over the place
    gives each finding its lines.  So a line is shuffled once, or twice near the
    end of a block, however many findings have it, and no group is a whole file.
    """
    reach = max(radius, head // 2)  # of a finding's middle, to either side
    lined = F.col("at") > 0
    at = findings.select("path", F.col("line_no").cast("int").alias("at")).where("path is not null").distinct()
    low, high = F.when(lined, F.col("at").cast("long") - radius).otherwise(1), F.when(lined, F.col("at").cast("long") + radius).otherwise(head)
    block = lambda twice: F.floor(twice / (2 * CONTEXT_BLOCK)).cast("long")
    # places are counted twice, as the middle of the first lines may lie between two
    none = F.lit(None).cast("struct<n:long,line:string>")
    asking = at.select("path", (low + high).alias("_at2"), "at", low.alias("_low"), high.alias("_high"), F.lit(True).alias("_asks"), none.alias("_l")).withColumn("_block", block(F.col("_at2")))
    n = F.col("line_no").cast("long")
    there = lines.where("path is not null and line_no is not null").select("path", (2 * n).alias("_at2"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("_low"), F.lit(None).cast("long").alias("_high"), F.lit(False).alias("_asks"), F.struct(n.alias("n"), F.col("line").alias("line")).alias("_l"))
    there = there.withColumn("_block", F.explode(F.sequence(block(F.col("_at2") - 2 * reach), block(F.col("_at2") + 2 * reach))))
    near = Window.partitionBy("path", "_block").orderBy("_at2").rangeBetween(-2 * reach, 2 * reach)
    met = asking.unionByName(there).withColumn("_near", F.collect_list("_l").over(near)).where("_asks")
    met = met.select("path", "at", F.array_sort(F.filter("_near", lambda l: l["n"].between(F.col("_low"), F.col("_high")))).alias("l")).where(F.size("l") > 0)
    return met.select("path", F.col("at").alias("line_no"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


# --- calls, names and loading of models ---------------------------------------


def api_calls(facts: DataFrame) -> DataFrame:
    """``path, provider, call, line``: the first call of each kind in a file, from syntax-tree facts; a call counts as the first kind that it matches."""
    kind = F.when(F.lit(False), F.lit(0))
    for i, (pattern, _, _) in enumerate(dims.API_CALLS):
        kind = kind.when(F.col("name").rlike(pattern), i)
    found = facts.where("kind = 'call'").withColumn("k", kind).where("k is not null").groupBy("path", "k").agg(F.min("line").alias("line"))
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in dims.API_CALLS]), F.col("k") + 1)
    return found.select("path", pick(1).alias("provider"), F.concat(pick(1), F.lit(" API call: "), pick(2)).alias("call"), "line")


def model_literals(facts: DataFrame) -> DataFrame:
    """``path, provider, model_name, line``: string literals that are a model's name as a whole, each once per file."""
    provider = F.when(F.lit(False), F.lit(""))
    for pattern, name in dims.MODEL_LITERALS:
        provider = provider.when(F.col("name").rlike(f"^(?:{pattern})$"), name)
    found = facts.where("kind = 'string'").withColumn("provider", provider).where("provider is not null")
    return found.groupBy("path", "provider", F.col("name").alias("model_name")).agg(F.min("line").alias("line"))


def loaded_models(source: Column) -> Column:
    """Distinct structs ``provider, type, model_name`` of model loading in a code cell's text."""

    def loaded(pattern: str, provider: str, kind: str) -> Column:
        named = "([^" in pattern
        values = F.regexp_extract_all(source, F.lit(pattern), F.lit(int(named)))
        return F.transform(values, lambda v: F.struct(F.lit(provider).alias("provider"), F.lit(kind).alias("type"), (v if named else F.lit("")).alias("model_name")))

    return F.array_distinct(F.concat(*[loaded(*row) for row in dims.MODEL_LOADING]))


def cell_models(cells: Column) -> Column:
    """The same of all cells, structs ``cell, source``; plain substrings rule out most cells before any pattern is tried."""
    marks = telling_literals([p for p, _, _ in dims.MODEL_LOADING])
    none = F.array().cast("array<struct<provider:string,type:string,model_name:string>>")
    return F.flatten(F.transform(cells, lambda c: F.when(contains_any(c["source"], marks), loaded_models(c["source"])).otherwise(none)))


def notebook_models(cells: DataFrame) -> DataFrame:
    """``path, cell, provider, type, model_name`` of model loading in code cells, each once per cell."""
    return cells.select("path", "cell", F.explode_outer(loaded_models(F.col("source"))).alias("m")).where("m is not null").select("path", "cell", "m.*")


def is_key_variable(name: Column) -> Column:
    return contains_any(F.upper(name), dims.CI_ENV_NAMES)


def variables_of(v: Column) -> Column:
    """Structs ``scope, name, value`` of the variables of a CI workflow's variant, of the workflow (global) and of its jobs."""
    values = lambda v, path: F.coalesce(F.map_entries(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    keyed = lambda scope, v: F.transform(values(v, "$.env"), lambda e: F.struct(scope.alias("scope"), e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    return F.concat(keyed(F.lit("global"), v), F.flatten(F.transform(values(v, "$.jobs"), lambda j: keyed(j["key"], j["value"]))))


def ci_env(documents: DataFrame) -> DataFrame:
    """``path, scope, name, provider, hardcoded`` of key variables in CI workflows, of the workflow (global) and of its jobs."""
    found = documents.select("path", F.explode_outer(variables_of(F.col("v"))).alias("e")).where("e is not null").select("path", "e.*")
    value = F.coalesce("value", F.lit(""))
    referenced = F.trim(value).startswith("${{") | value.contains("secrets.")
    return found.where(is_key_variable(F.col("name"))).select("path", "scope", "name", C.ci_env_provider(F.col("name")).alias("provider"), ((value != "") & ~referenced).alias("hardcoded"))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` parts and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(?:\./)+", "$1"), "^/", "")


def compose_builds(services: DataFrame, images: DataFrame) -> DataFrame:
    """Findings of the Dockerfiles that compose services are built from: ``path, service, dockerfile, image, name``.

    ``services`` are :func:`compose_services`, ``images`` :func:`dockerfile_images`; they meet by the computed path.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    file = F.coalesce(F.col("dockerfile"), F.lit("Dockerfile")) if "dockerfile" in services.columns else F.lit("Dockerfile")
    wanted = services.where(F.coalesce(F.col("build"), F.lit("")) != "").select("path", "service", normal_path(F.concat(folder, "build", F.lit("/"), file)).alias("dockerfile"))
    met = wanted.join(images.select(normal_path(F.col("path")).alias("dockerfile"), "image"), "dockerfile")
    return met.select("path", "service", "dockerfile", "image", F.concat("service", F.lit(" ("), "image", F.lit(")")).alias("name"))


def env_values(lines: DataFrame) -> DataFrame:
    """``path, line_no, name, provider, hardcoded, masked`` of key variables in env files."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[\"']?(.*?)[\"']?\s*$"
    rows = lines.where(is_env_file(F.col("path")) & ~F.ltrim("line").startswith("#")).select("path", "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"))
    rows = rows.withColumn("provider", env_provider(F.col("name"))).where("provider is not null")
    return rows.select("path", "line_no", "name", "provider", hardcoded_value(F.col("value")).alias("hardcoded"), F.when(F.col("value") != "", text.mask_key(F.col("value"))).otherwise("").alias("masked"))


def config_keys(lines: DataFrame) -> DataFrame:
    """Keys in configuration files, apart from those of build tools: ``path, line_no, provider, masked``."""
    name = F.element_at(F.split("path", "/"), -1)
    config = name.rlike(r"\.(json|ya?ml|toml|ini|cfg)$") & ~name.isin(*dims.SKIPPED_CONFIG)
    return key_findings(lines.where(config))


def dependency_components(declared: DataFrame) -> DataFrame:
    """Declared AI packages as components: ``path, name, provider, usage_type, type``."""
    return known_packages(declared).select("path", F.col("dep").alias("name"), "provider", "usage_type", C.type_of_usage(F.col("usage_type")).alias("type"))


def all_package_names(spark) -> DataFrame:  # noqa: ANN001
    """The distinct package names of SDK signatures and of the package table."""
    rows = spark.createDataFrame([(d,) for s in dims.SDK_SIGNATURES.values() for d in s[6]], "package string")
    return rows.union(dims.packages(spark).select("package")).distinct()
