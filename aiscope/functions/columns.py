"""Scalar functions over components, requests and names."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DataType, StringType

from aiscope.functions import dims


def lookup(column: Column, table: dict, default: Column | None = None) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.create_map(*pairs)[column]
    return found if default is None else F.coalesce(found, default)


def severity(score: Column) -> Column:
    return F.when(score >= 76, "critical").when(score >= 51, "high").when(score >= 26, "medium").otherwise("low")


def severity_rank(name: Column) -> Column:
    return lookup(F.lower(name), dims.SEVERITY_RANK, F.lit(0))


def risk_score(flags: Column, model_name: Column | None = None, mode: str = "accumulate") -> Column:
    """Sum of the flags' weights, at most 100.

    ``accumulate`` counts repeated flags each time and adds the weight of a
    deprecated model for a model of that list; ``distinct`` counts each once.
    """
    weights = F.create_map(*[F.lit(x) for item in dims.RISK_WEIGHTS.items() for x in item])
    all_flags = flags
    if model_name is not None:
        deprecated = F.coalesce(model_name.isin(dims.DEPRECATED_MODELS), F.lit(False))
        all_flags = F.concat(flags, F.when(deprecated, F.array(F.lit("deprecated_model"))).otherwise(F.array().cast("array<string>")))
    if mode == "distinct":
        all_flags = F.array_distinct(all_flags)
    total = F.aggregate(all_flags, F.lit(0), lambda a, f: a + F.coalesce(weights[f], F.lit(0)))
    return F.least(total, F.lit(100))


def risk_factors(flags: Column) -> Column:
    """Text and weight of each known flag, in the flags' order."""
    texts = {f: f"{dims.FLAG_TEXTS[f]} (+{w})" for f, w in dims.RISK_WEIGHTS.items()}
    table = F.create_map(*[F.lit(x) for item in texts.items() for x in item])
    return F.array_compact(F.transform(flags, lambda f: table[f]))


def flag_owasp(flags: Column) -> Column:
    """Sorted distinct ``code: name`` of the flags."""
    table = F.create_map(*[F.lit(x) for f, (code, name, _) in dims.FLAG_OWASP.items() for x in (f, f"{code}: {name}")])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(flags, lambda f: table[f]))))


def is_pinned(model: Column) -> Column:
    return model.rlike(r"\d{4,8}")


def package_key(name: Column) -> Column:
    """Package names compare in lower case with dashes."""
    return F.lower(F.translate(name, "_", "-"))


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), " _", "--")


def rule_id(name: Column, prefix: str = "aiscope") -> Column:
    return F.concat(F.lit(f"{prefix}/"), slug(name))


def package_url(name: Column, kind: Column, version: Column) -> Column:
    """A package URL: containers by image and tag, scoped or slashed names as npm, else pypi."""
    base = F.translate(F.lower(name), "_", "-")
    clean = F.when(F.coalesce(version, F.lit("")).isin("", "unknown"), "").otherwise(version)
    container, tagged = kind == "container", base.contains(":")
    image = F.when(container & tagged, F.substring_index(base, ":", 1)).otherwise(base)
    tag = F.substring(base, F.instr(base, ":") + 1, F.lit(2147483647))
    shown = F.when(container & tagged, F.coalesce(F.nullif(version, F.lit("")), tag)).otherwise(clean)
    scheme = F.when(container, "docker").when(base.startswith("@") | base.contains("/"), "npm").otherwise("pypi")
    return F.concat(F.lit("pkg:"), scheme, F.lit("/"), image, F.when(shown != "", F.concat(F.lit("@"), shown)).otherwise(""))


def image_name(ref: Column) -> Column:
    """The image of a reference such as ``host:5000/a/b:tag@sha256:… AS alias``."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(ref), r"(?i)\s+as\s+\S+$", ""), "@.*$", "")
    return F.regexp_replace(bare, r":[^:/]+$", "")


def image_tag(ref: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(ref), r"(?i)\s+as\s+\S+$", ""), "@.*$", "")
    tag = F.regexp_extract(bare, r":([^:/]+)$", 1)
    return F.when(tag == "", "latest").otherwise(tag)


def image_provider(image: Column) -> Column:
    """The first of some ordered parts of a name."""
    # Fixed values, in order.
    parts = [("ollama", "Ollama"), ("vllm", "vLLM"), ("huggingface", "HuggingFace"), ("nvidia", "NVIDIA"), ("pytorch", "PyTorch"), ("tensorflow", "TensorFlow"), ("langchain", "LangChain"), ("chroma", "ChromaDB")]
    found = F.when(F.lit(False), "")
    for part, provider in parts:
        found = found.when(F.lower(image).contains(part), provider)
    return found.otherwise("Unknown")


def action_name(ref: Column) -> Column:
    return F.split(ref, "@", 2)[0]


def action_version(ref: Column) -> Column:
    return F.coalesce(F.get(F.split(ref, "@", 2), F.lit(1)), F.lit("latest"))


def is_local(url: Column) -> Column:
    return F.lower(url).rlike(r"localhost|127\.0\.0\.1|0\.0\.0\.0|::1")


def url_host(url: Column) -> Column:
    """Host of any URL in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1))


def header_fields(headers: Column) -> Column:
    """Headers as fields ``header_x_y``."""
    return F.transform_keys(headers, lambda k, _: F.concat(F.lit("header_"), F.translate(F.lower(k), "-", "_")))


def hide_headers(headers: Column) -> Column:
    # Names of headers that hold secrets.
    secret = ["authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-auth-token", "proxy-authorization"]
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(secret), "[REDACTED]").otherwise(v))


def action_url(kind: Column, target: Column) -> Column:
    return F.concat(F.lit("action://"), kind, F.lit("/"), target)


def strip_fence(text: Column) -> Column:
    """JSON text out of a Markdown code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))


def batch_key(ids: Column) -> Column:
    """The idempotency key of a batch: 32 hex digits over its sorted ids."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 32)


def component_id(scan: Column, source: Column, path: Column, line: Column, name: Column, kind: Column, model: Column) -> Column:
    """The same finding of a scan always gets the same id."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (scan, source, path, line, name, kind, model)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_part(text: Column, parts: list[tuple[str, str]], default: str) -> Column:
    """The value of the first part that a text contains."""
    found = F.when(F.lit(False), F.lit(""))
    for part, value in parts:
        found = found.when(text.contains(part), value)
    return found.otherwise(default)


def ci_env_provider(name: Column) -> Column:
    return first_part(F.upper(name), dims.CI_ENV_PARTS, "Unknown")


def type_of_usage(usage: Column) -> Column:
    return F.when(usage.isin("orchestration", "agent"), "agent_framework").when(usage == "tool_use", "tool").otherwise("llm_provider")


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for part in value.values() if isinstance(value, dict) else value:
            yield from _leaves(part)


def _leaves_of(text: str | None) -> str:
    try:
        return " ".join(_leaves(json.loads(text))) if text else ""
    except (ValueError, RecursionError):
        return ""


#: Texts are parsed in runs of at most so many bytes, or one text.
RUN_BYTES = 1 << 20


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[pa.Array]:
    """Slices of a text array, in order, of at most ``size`` bytes or one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > size:
            yield texts.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield texts.slice(begin)


def parsed_in_runs(parse: Callable, kind: pa.DataType, result: DataType | str, shared: bool = False) -> Callable:
    """A column function that parses texts one by one, holding the objects of one run at a time.

    What is parsed goes back after each run.  With ``shared`` it waits in
    Arrow's form for its whole batch instead, and the function can share one
    pass over the rows with others, which functions of iterators can not.
    """
    of = lambda run: pa.array([parse(text) for text in run.to_pylist()], kind)

    def whole(texts: pa.Array) -> pa.Array:
        done = [of(run) for run in runs(texts)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for run in runs(texts):
                yield of(run)

    return F.arrow_udf(whole if shared else parsed, result)


_string_leaves = parsed_in_runs(_leaves_of, pa.string(), StringType())


def string_leaves(document: Column | str) -> Column:
    """All string values of a JSON text, at any depth and in their order, joined by spaces; names of members are left out, and text that is no JSON has none.

    Columns can neither recurse nor match long quoted strings safely, so this runs on Arrow batches.
    """
    return _string_leaves(document)


def message_texts(messages: Column) -> Column:
    """Texts of a JSON list of chat messages, whose content is text or a list of typed parts."""
    listed = F.coalesce(F.try_variant_get(F.try_parse_json(messages), "$", "array<variant>"), F.array().cast("array<variant>"))

    def texts(message: Column) -> Column:
        plain = F.try_variant_get(message, "$.content", "string")
        parts = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
        typed = F.transform(F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        is_list = F.schema_of_variant(F.try_variant_get(message, "$.content", "variant")).startswith("ARRAY")
        return F.when(F.coalesce(is_list, F.lit(False)), typed).otherwise(F.array(F.coalesce(plain, F.lit(""))))

    return F.flatten(F.transform(listed, texts))


def tool_call_names(response: Column) -> Column:
    """Names of the tools that a model's JSON response calls, in either of two shapes."""
    v = F.try_parse_json(response)
    empty = F.array().cast("array<variant>")
    many = lambda value, path: F.coalesce(F.try_variant_get(value, path, "array<variant>"), empty)
    name = lambda value, path: F.coalesce(F.try_variant_get(value, path, "string"), F.lit("unknown"))
    one = F.flatten(F.transform(many(v, "$.choices"), lambda c: F.transform(many(c, "$.message.tool_calls"), lambda t: name(t, "$.function.name"))))
    two = F.transform(F.filter(many(v, "$.content"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"), lambda b: name(b, "$.name"))
    return F.concat(one, two)


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` code points, with dots where some are left out."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """A value of any type in what JSON has: text, numbers and truth values stay, lists, maps and structs are taken apart, all else becomes text.

    ``kind`` is the column's type.  Keys of maps become text, a null key the
    text ``null``; of keys that are then equal the last counts.
    """
    if isinstance(kind, (T.StringType, T.BooleanType, T.NumericType, T.NullType)):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(F.coalesce(e["key"].cast("string"), F.lit("null")).alias("key"), json_safe(e["value"], kind.valueType).alias("value")))
        last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
        return F.map_from_entries(last)
    if isinstance(kind, T.StructType):
        parts = [json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value.cast("string")
