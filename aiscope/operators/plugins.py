"""Detectors and reporters by name, and one pass over a corpus for all detectors.

A detector says which paths it supports and in which form it wants them.  The
corpus is read once: every file is routed by its path and parsed at most once
for each format.  A detector that finds its rows by an expression has them found
in that pass, so a file's text goes no further; others get the rows of their
form that they may want.  What was found is written, dealt by detector; each
detector then finishes its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aiscope.operators import detect
from aiscope.sources import files
from aiscope.sources.shared import shared_folder

#: What every detector returns, besides columns of its own that are dropped.
FINDING = ("path", "name", "type", "provider", "line")
#: Forms of files, and the columns of each beside ``path``.
FORMS = {
    "text": ["content"], "lines": ["line_no", "line"], "json": ["v"], "yaml": ["v"], "python": ["kind", "name", "args", "line"], "terraform": ["line_no", "resource_type", "resource_name"],
    "manifest": ["dep"], "file": ["length"],
}


@dataclass(frozen=True)
class Detector:
    name: str
    supports: Callable[[Column], Column]
    find: Callable[[DataFrame], DataFrame]
    form: str = "text"
    maybe: Callable[[Column], Column] | None = None
    rows: Callable[[Column], Column] | None = None
    columns: tuple[str, ...] = ()


DETECTORS: dict[str, Detector] = {}
REPORTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def detector(name: str, supports: Callable[[Column], Column], form: str = "text", maybe: Callable[[Column], Column] | None = None, rows: Callable[[Column], Column] | None = None, columns: tuple[str, ...] = ()) -> Callable:
    """Register a function from rows of a form to findings.

    ``supports`` is the condition on ``path`` for files that it is given, and
    ``maybe`` one that all it can use fulfils: a line, a fact, a resource, a
    declared package, or, for YAML, the text before it is parsed.

    With ``rows`` the function gets what that expression finds, and nothing else
    of the file is kept: from a line, a text or a variant it gives an array of
    structs with the fields ``columns``.  They arrive as strings beside ``path``
    and, of lines, ``line_no``.
    """
    if form not in FORMS:
        raise ValueError(f"no form {form!r}; there are {', '.join(FORMS)}")
    if rows is not None and form not in ("text", "lines", "json", "yaml"):
        raise ValueError(f"rows are found in text, lines, JSON or YAML, not in form {form!r}")

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        DETECTORS[name] = Detector(name, supports, f, form, maybe, rows, tuple(columns))
        return f

    return add


def reporter(name: str) -> Callable:
    """Register a function from scored components to documents."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        REPORTERS[name] = f
        return f

    return add


CANDIDATE = "path string, length long, line_no int, kind string, text string, args array<string>, detector string"


def candidates(corpus: DataFrame, detectors: list[Detector]) -> DataFrame:
    """The rows of ``path, content`` that detectors find or may want, in the columns of ``CANDIDATE``: one scan, one projection."""
    to = {d.name: F.col(f"_to{i}") for i, d in enumerate(detectors)}
    length = F.col("length").cast("long") if "length" in corpus.columns else F.octet_length("content").cast("long")
    rows = corpus.select("path", length.alias("length"), F.col("content").cast("string").alias("_t"), *[F.coalesce(d.supports(F.col("path")), F.lit(False)).alias(f"_to{i}") for i, d in enumerate(detectors)])
    rows = rows.where(reduce(or_, to.values()))
    of = lambda form: [d for d in detectors if d.form == form]
    whole = lambda form: [d for d in of(form) if d.rows is None]
    any_of = lambda ds: reduce(or_, [to[d.name] for d in ds], F.lit(False))
    path, text = F.col("path"), F.col("_t")
    # one Arrow pass for all parsers, whose texts are null where nobody wants them
    if of("yaml"):
        rows = rows.withColumn("_yaml", files.yaml_json_shared(F.when(reduce(or_, [to[d.name] & d.maybe(text) if d.maybe else to[d.name] for d in of("yaml")]), text)))
    if of("python"):
        rows = rows.withColumn("_facts", files.python_facts_shared(F.when(any_of(of("python")), text)))
    if of("terraform"):
        rows = rows.withColumn("_blocks", files.terraform_blocks_shared(F.when(any_of(of("terraform")) & text.contains("resource"), text)))
    unified = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    if of("manifest"):
        rows = rows.withColumn("_toml", files.toml_json_shared(F.when(any_of(of("manifest")) & detect.is_toml(path), unified)))
    # columns of their own, as several detectors use them
    if len(whole("yaml")) < len(of("yaml")):
        rows = rows.withColumn("_yaml_v", F.try_parse_json("_yaml"))
    if len(whole("json")) < len(of("json")):
        rows = rows.withColumn("_json_v", F.try_parse_json(F.when(any_of([d for d in of("json") if d.rows]), text)))
    if of("lines"):
        # a split at one character is faster than at a pattern
        rows = rows.withColumn("_lines", F.when(~any_of(of("lines")), None).when(text.contains("\r"), F.split(text, "\r\n|\n|\r")).otherwise(F.split(text, "\n")))
    if of("manifest"):
        rows = rows.withColumn("_manifest", F.when(any_of(of("manifest")), unified)).withColumn("_manifest_v", detect.manifest_value(path, F.col("_manifest"), F.col("_toml")))
    none = F.lit(None)
    empty = F.array().cast("array<struct<to:array<string>,line_no:int,kind:string,text:string,args:array<string>>>")

    def item(ds: list[Detector], line_no: Column | None, kind: Column, text: Column | None, args: Column | None = None, value: Column | None = None) -> Column:
        meant = [F.when(to[d.name] & (d.maybe(value) if value is not None and d.maybe else F.lit(True)), F.lit(d.name)) for d in ds]
        return F.struct(F.array_compact(F.array(*meant)).alias("to"), (none if line_no is None else line_no).cast("int").alias("line_no"), kind.alias("kind"), (none if text is None else text).cast("string").alias("text"), (none if args is None else args).cast("array<string>").alias("args"))

    def found(d: Detector, value: Column, line_no: Column | None = None) -> Column:
        made = F.transform(d.rows(value), lambda r: item([d], line_no, F.lit("found"), None, F.array(*[r[c].cast("string") for c in d.columns])))
        return F.coalesce(F.when(d.maybe(value), made) if d.maybe and d.form != "yaml" else made, empty)

    def found_in_lines(d: Detector) -> Column:
        return F.flatten(F.transform("_lines", lambda line, n: found(d, line, n + 1)))

    parts = [F.when(to[d.name], found_in_lines(d)) for d in of("lines") if d.rows]
    for form, value in (("text", text), ("json", F.col("_json_v")), ("yaml", F.col("_yaml_v"))):
        parts += [F.when(to[d.name], found(d, value)) for d in of(form) if d.rows]
    if whole("lines"):
        parts.append(F.transform("_lines", lambda line, n: item(whole("lines"), n + 1, F.lit("line"), line, value=line)))
    for form in ("text", "json"):
        if whole(form):
            parts.append(F.array(item(whole(form), None, F.lit(form), text)))
    if whole("yaml"):
        parts.append(F.when(F.col("_yaml").isNotNull(), F.array(item(whole("yaml"), None, F.lit("yaml"), F.col("_yaml")))))
    if of("python"):
        parts.append(F.transform("_facts", lambda f: item(of("python"), f["line"], f["kind"], f["name"], f["args"], value=f)))
    if of("terraform"):
        parts.append(F.transform("_blocks", lambda r: item(of("terraform"), r["line_no"], F.lit("resource"), r["resource_name"], F.array(r["resource_type"]), value=r)))
    if of("manifest"):
        declared = F.when(F.col("_manifest").isNotNull(), detect.declared(path, F.col("_manifest"), F.col("_manifest_v")))
        parts.append(F.transform(declared, lambda dep: item(of("manifest"), None, F.lit("package"), dep, value=dep)))
    if of("file"):
        parts.append(F.array(item(of("file"), None, F.lit("file"), None)))
    items = F.concat(*[F.coalesce(F.filter(p, lambda x: F.size(x["to"]) > 0), empty) for p in parts])
    kept = rows.select("path", "length", F.explode(items).alias("x"))
    return kept.select("path", "length", "x.line_no", "x.kind", "x.text", "x.args", F.explode("x.to").alias("detector"))


def _shaped(rows: DataFrame, d: Detector) -> DataFrame:
    """Candidates of one detector in its form, or in the columns of what it has found."""
    if d.rows is not None:
        return rows.select("path", *(["line_no"] if d.form == "lines" else []), *[F.col("args")[i].alias(c) for i, c in enumerate(d.columns)])
    text = F.col("text")
    columns = {
        "text": [text.alias("content")], "lines": ["line_no", text.alias("line")], "json": [F.try_parse_json("text").alias("v")], "yaml": [F.try_parse_json("text").alias("v")],
        "python": ["kind", text.alias("name"), "args", F.col("line_no").alias("line")], "terraform": ["line_no", F.col("args")[0].alias("resource_type"), text.alias("resource_name")],
        "manifest": [text.alias("dep")], "file": ["length"],
    }
    return rows.select("path", *columns[d.form])


def run_detectors(corpus: DataFrame, names: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """The findings of all detectors, or those named: ``detector`` and the columns of ``FINDING``, as strings; nothing is merged across detectors.

    ``corpus`` has ``path, content`` and may have ``length``.  The candidates
    are written to ``folder``, by default a new one in the shared folder, which
    must stay as long as the result is read.
    """
    unknown = set(names or ()) - set(DETECTORS)
    if unknown:
        raise ValueError(f"no detectors {sorted(unknown)}; there are {', '.join(sorted(DETECTORS))}")
    chosen = [DETECTORS[n] for n in names or sorted(DETECTORS)]
    spark = corpus.sparkSession
    folder = folder or shared_folder(spark, "candidates")
    candidates(corpus, chosen).write.mode("overwrite").partitionBy("detector").parquet(folder)
    kept = spark.read.schema(CANDIDATE).parquet(folder)
    parts = []
    for d in chosen:
        found = d.find(_shaped(kept.where(F.col("detector") == d.name), d))
        parts.append(found.select(F.lit(d.name).alias("detector"), *[F.col(c).cast("string").alias(c) if c in found.columns else F.lit("").alias(c) for c in FINDING]))
    return reduce(DataFrame.unionAll, parts)


def render(name: str, components: DataFrame) -> DataFrame:
    if name not in REPORTERS:
        raise ValueError(f"no reporter {name!r}; there are {', '.join(sorted(REPORTERS))}")
    return REPORTERS[name](components)
