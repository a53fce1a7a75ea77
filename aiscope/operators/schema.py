"""Validity of JSON documents: a JSON schema compiled to expressions over a VARIANT column.

The result lists every breach with its path and rule, so that documents are
checked where they lie, without Python, a join or a shuffle.  :func:`breaches`
is one expression; :func:`invalid_documents` keeps every value that the schema
names, and every reading of it, in a column of its own, and goes down one list
at a time by exploding it, so that no value is read twice.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREACH = "array<struct<path:string,rule:string>>"
#: Keywords that say nothing about validity, or that :func:`breaches` resolves on its way.
IGNORED = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs", "readOnly", "writeOnly", "deprecated"}
KNOWN = {
    "$ref", "type", "const", "enum", "required", "properties", "additionalProperties", "patternProperties", "minProperties", "maxProperties", "items", "contains", "minItems", "maxItems", "uniqueItems",
    "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "allOf", "anyOf", "oneOf", "not",
}
NUMBER = "decimal(38,12)"


def no_breaches() -> Column:
    return F.array().cast(BREACH)


class UnsupportedSchema(ValueError):
    pass


def _step(key: str) -> str:
    quote = '"' if '"' not in key else "'"
    if quote in key or "\\" in key:
        raise UnsupportedSchema(f"a key with quotes or backslashes: {key!r}")
    return f"$[{quote}{key}{quote}]"


class Value:
    """A variant and what can be read from it, each reading kept by ``bind(column, depth)``; without one they are plain expressions."""

    def __init__(self, column: Column, bind: Callable[[Column, int], Column] | None = None, depth: int = 0):
        self.column, self.bind, self.depth = column, bind, depth

    def _read(self, column: Column) -> Column:
        return column if self.bind is None else self.bind(column, self.depth + 1)

    @cached_property
    def map(self) -> Column:
        return self._read(F.try_variant_get(self.column, "$", "map<string,variant>"))

    @cached_property
    def list(self) -> Column:
        return self._read(F.try_variant_get(self.column, "$", "array<variant>"))

    @cached_property
    def number(self) -> Column:
        return self._read(F.try_variant_get(self.column, "$", NUMBER))

    @cached_property
    def double(self) -> Column:
        return self._read(F.try_variant_get(self.column, "$", "double"))

    @cached_property
    def text(self) -> Column:
        return self._read(F.try_variant_get(self.column, "$", "string"))

    @cached_property
    def kind(self) -> Column:
        return self._read(F.schema_of_variant(self.column))

    def member(self, key: str) -> Value:
        if self.bind is None:
            return Value(F.try_variant_get(self.column, _step(key), "variant"))
        return Value(self.bind(F.try_element_at(self.map, F.lit(key)), self.depth + 2), self.bind, self.depth + 2)

    def item(self, i: int) -> Value:
        found = F.get(self.list, F.lit(i))
        return Value(found) if self.bind is None else Value(self.bind(found, self.depth + 2), self.bind, self.depth + 2)


def is_type(value: Value, name: str) -> Column:
    """Is a variant of a JSON type?  A number without a fraction is an integer."""
    if name == "object":  # told by a cast, as the schema of a large value is dear
        return value.map.isNotNull()
    if name == "array":
        return value.list.isNotNull()
    kind = value.kind
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    tests = {
        "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": F.is_variant_null(value.column), "number": number,
        "integer": number & F.coalesce(value.number % 1 == 0, value.double % 1 == 0, F.lit(False)),
    }
    if name not in tests:
        raise UnsupportedSchema(f"type {name!r}")
    return tests[name]


def equals(value: Value, wanted) -> Column:  # noqa: ANN001
    """Is a variant the JSON value ``wanted``?  Numbers compare by value, objects and lists by their whole content."""
    if wanted is None:
        return F.is_variant_null(value.column)
    if isinstance(wanted, bool):
        return is_type(value, "boolean") & (F.try_variant_get(value.column, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return is_type(value, "number") & (value.double == float(wanted))
    if isinstance(wanted, str):
        return is_type(value, "string") & (value.text == wanted)
    return F.to_json(value.column) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


class Path:
    """Where a value is: a column, and what always follows it."""

    def __init__(self, start: Column, rest: str = ""):
        self.start, self.rest = start, rest

    def __add__(self, step: str) -> Path:
        return Path(self.start, self.rest + step)

    @property
    def column(self) -> Column:
        return F.concat(self.start, F.lit(self.rest)) if self.rest else self.start

    def key(self, name: Column) -> Path:
        return Path(F.concat(self.column, F.lit("."), name))

    def item(self, i: Column) -> Path:
        return Path(F.concat(self.column, F.lit("["), i.cast("string"), F.lit("]")))


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolved(self, schema: dict | bool, through: tuple[str, ...] = ()) -> tuple[dict, tuple[str, ...]]:
        """A schema without its reference, and the references met so far on the way down."""
        if isinstance(schema, bool):
            return ({} if schema else {"not": {}}), through
        unknown = set(schema) - KNOWN - IGNORED
        if unknown:
            raise UnsupportedSchema(f"keywords {sorted(unknown)}")
        if "$ref" not in schema:
            return schema, through
        ref = schema["$ref"]
        if not ref.startswith("#"):
            raise UnsupportedSchema(f"a reference to another document: {ref}")
        if ref in through:
            raise UnsupportedSchema(f"a schema that holds itself: {ref}")
        found = self.root
        for part in ref.removeprefix("#").strip("/").split("/"):
            found = found[part.replace("~1", "/").replace("~0", "~")] if part else found
        return self.resolved(found, (*through, ref))

    def check(self, schema: dict | bool, value: Value, path: Path, through: tuple[str, ...] = ()) -> Column:
        """Breaches of a present value: an array, never null."""
        parts: list[Column] = []  # arrays of breaches, or null
        for here, single, nested in self.rules(schema, value, path, through):
            if single or nested:
                own = [F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(at.column.alias("path"), F.lit(name).alias("rule"))) for name, bad, at in single])).cast(BREACH)] if single else []
                found = F.concat(*own, *[F.coalesce(x, no_breaches()) for x in nested])
                parts.append(found if here is None else F.when(here, found))
        return F.concat(no_breaches(), *[F.coalesce(x, no_breaches()) for x in parts])

    def rules(self, schema: dict | bool, value: Value, path: Path, through: tuple[str, ...]) -> list[tuple[Column | None, list[tuple[str, Column, Path]], list[Column]]]:
        """For each kind of value: its condition, rules with what breaks them and where, and arrays of breaches further down."""
        schema, through = self.resolved(schema, through)
        found = []

        def rules_where(here: Callable[[], Column] | None, add) -> None:  # noqa: ANN001
            """Take the rules that ``add`` states, all under one condition."""
            single: list[tuple[str, Column, Path]] = []
            nested: list[Column] = []
            add(lambda name, bad, at=path: single.append((name, bad, at)), nested)
            if single or nested:
                found.append((here and here(), single, nested))

        passes = lambda part: F.size(_Compiler(self.root).check(part, Value(value.column), path, through)) == 0

        def of_any(rule, nested: list[Column]) -> None:  # noqa: ANN001
            if "type" in schema:
                names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
                rule("type", ~reduce(or_, [is_type(value, n) for n in names]))
            if "const" in schema:
                rule("const", ~equals(value, schema["const"]))
            if "enum" in schema:
                rule("enum", ~reduce(or_, [equals(value, x) for x in schema["enum"]], F.lit(False)))
            for part in schema.get("allOf", []):
                self.descend(part, value, path, through, nested)
            if "anyOf" in schema:
                rule("anyOf", ~reduce(or_, map(passes, schema["anyOf"])))
            if "oneOf" in schema:
                rule("oneOf", sum((F.when(passes(p), 1).otherwise(0) for p in schema["oneOf"]), F.lit(0)) != 1)
            if "not" in schema:
                rule("not", passes(schema["not"]))

        rules_where(None, of_any)
        rules_where(lambda: is_type(value, "string"), lambda rule, _: self.of_text(schema, value, rule))
        rules_where(lambda: is_type(value, "number"), lambda rule, _: self.of_number(schema, value, rule))
        rules_where(lambda: is_type(value, "object"), lambda rule, nested: self.of_object(schema, value, path, through, rule, nested))
        rules_where(lambda: is_type(value, "array"), lambda rule, nested: self.of_list(schema, value, path, through, rule, nested))
        return found

    def descend(self, schema: dict | bool, value: Value, path: Path, through: tuple[str, ...], nested: list[Column]) -> None:
        """Hold a value that may be missing against a schema further down."""
        nested.append(F.when(value.column.isNotNull(), self.check(schema, value, path, through)))

    def each(self, schema: dict | bool, value: Value, path: Path, through: tuple[str, ...], nested: list[Column]) -> None:
        """Hold all items of a list against a schema."""
        nested.append(F.flatten(F.transform(value.list, lambda x, i: self.check(schema, Value(x), path.item(i), through))))

    def of_text(self, schema: dict, value: Value, rule) -> None:  # noqa: ANN001
        text = value.text
        if "minLength" in schema:
            rule("minLength", (F.length(text) < schema["minLength"]))
        if "maxLength" in schema:
            rule("maxLength", (F.length(text) > schema["maxLength"]))
        if "pattern" in schema:
            rule("pattern", ~text.rlike(schema["pattern"]))

    def of_number(self, schema: dict, value: Value, rule) -> None:  # noqa: ANN001
        number = F.coalesce(value.number.cast("double"), value.double)
        tests = {"minimum": lambda n: number < n, "maximum": lambda n: number > n, "exclusiveMinimum": lambda n: number <= n, "exclusiveMaximum": lambda n: number >= n}
        for name, bad in tests.items():
            if name in schema:
                rule(name, bad(float(schema[name])))
        if "multipleOf" in schema:
            rule("multipleOf", (value.number % F.lit(str(schema["multipleOf"])).cast(NUMBER) != 0))

    def of_object(self, schema: dict, value: Value, path: Path, through, rule, nested: list[Column]) -> None:  # noqa: ANN001
        child = lambda key: path + f".{key}"
        named = schema.get("properties", {})
        members = {key: value.member(key) for key in dict.fromkeys([*schema.get("required", []), *named])}
        for key in schema.get("required", []):
            rule("required", members[key].column.isNull(), child(key))
        size = lambda: F.size(F.map_keys(value.map))
        if "minProperties" in schema:
            rule("minProperties", (size() < schema["minProperties"]))
        if "maxProperties" in schema:
            rule("maxProperties", (size() > schema["maxProperties"]))
        for key, part in named.items():
            self.descend(part, members[key], child(key), through, nested)
        patterns, rest = schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        each = lambda keep, part: F.flatten(F.transform(F.filter(F.map_entries(value.map), lambda e: keep(e["key"])), lambda e: _Compiler(self.root).check(part, Value(e["value"]), path.key(e["key"]), through)))
        for pattern, part in patterns.items():
            nested.append(each(lambda key, rx=pattern: key.rlike(rx), part))
        other = lambda key: reduce(or_, [key.rlike(rx) for rx in patterns], key.isin(*named) if named else F.lit(False)) == F.lit(False)
        if rest is False:
            extra = F.filter(F.map_keys(value.map), other)
            nested.append(F.transform(extra, lambda key: F.struct(path.key(key).column.alias("path"), F.lit("additionalProperties").alias("rule"))))
        elif rest is not True:
            nested.append(each(other, rest))

    def of_list(self, schema: dict, value: Value, path: Path, through, rule, nested: list[Column]) -> None:  # noqa: ANN001
        items = value.list if schema.keys() & {"minItems", "maxItems", "uniqueItems", "contains", "items"} else None
        if "minItems" in schema:
            rule("minItems", (F.size(items) < schema["minItems"]))
        if "maxItems" in schema:
            rule("maxItems", (F.size(items) > schema["maxItems"]))
        if schema.get("uniqueItems"):
            written = F.transform(items, lambda x: F.to_json(x))
            rule("uniqueItems", (F.size(F.array_distinct(written)) < F.size(items)))
        if "contains" in schema:
            rule("contains", ~F.exists(items, lambda x: F.size(_Compiler(self.root).check(schema["contains"], Value(x), path, through)) == 0))
        if isinstance(schema.get("items"), list):  # a schema for each place
            for i, part in enumerate(schema["items"]):
                self.descend(part, value.item(i), path + f"[{i}]", through, nested)
        elif "items" in schema:
            self.each(schema["items"], value, path, through, nested)


def breaches(schema: dict, value: Column) -> Column:
    """``array<struct<path, rule>>`` of all breaches of a JSON schema (draft 7) by a VARIANT column.

    A path begins with ``$``; a missing member is named by its own path.  The
    schema becomes one expression; ``format`` is not checked, and keywords or
    references that are not understood raise :class:`UnsupportedSchema` rather
    than pass.  A null value (such as text that is no JSON) breaches ``json``.
    """
    return F.when(value.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))).otherwise(_Compiler(schema).check(schema, Value(value), Path(F.lit("$"))))


class _Level(_Compiler):
    """Schemas compiled to columns: ``kept`` by depth, and ``slots``, one for each rule that can be broken and for each list to go down.

    All paths of a level begin with the same column.  A slot stands for a breach
    (a rule's name, or a column with it), an array of breaches, or the items of
    a list for a schema of :attr:`below`.
    """

    def __init__(self, root: dict):
        super().__init__(root)
        self.kept: dict[int, dict[str, Column]] = defaultdict(dict)
        self.slots: list[tuple[Column, str, str | Column | None]] = []  # condition, end of the path, rule
        self.items: dict[int, tuple[int, Column]] = {}  # by slot
        self.found: dict[int, Column] = {}
        self.below: list[tuple[dict | bool, tuple[str, ...]]] = []

    def bind(self, column: Column, depth: int) -> Column:
        name = f"_k{depth}_{len(self.kept[depth])}"
        self.kept[depth][name] = column
        return F.col(name)

    def slot(self, here: Column, path: Path, rule: str | Column | None = None) -> None:
        self.slots.append((here, path.rest, rule))

    def descend(self, schema: dict | bool, value: Value, path: Path, through: tuple[str, ...], nested: list[Column]) -> None:
        present = value.column.isNotNull()
        for here, single, more in self.rules(schema, value, path, through):
            held = present if here is None else present & here
            for name, bad, at in single:
                self.slot(held & F.coalesce(bad, F.lit(False)), at, name)
            for found in more:
                self.found[len(self.slots)] = found
                self.slot(held, path)

    def each(self, schema: dict | bool, value: Value, path: Path, through: tuple[str, ...], nested: list[Column]) -> None:
        self.items[len(self.slots)] = len(self.below), value.list
        self.slot(value.list.isNotNull(), path)
        self.below.append((schema, through))

    def applied(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """The breaches, and the items for the next level: ``_p`` path, ``_r`` rule or null, ``_n`` number of the schema, ``_v`` item."""
        for depth in sorted(self.kept):
            rows = rows.withColumns(self.kept[depth])
        if self.found:
            rows = rows.withColumns({f"_f{k}": found for k, found in self.found.items()})
        slot = F.col("_s")
        pick = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), slot + 1)

        def of(columns: dict[int, Column], kind: str) -> Column:
            found = F.when(F.lit(False), F.lit(None).cast(kind))
            for k, column in columns.items():
                found = found.when(slot == k, column)
            return found

        # an outer explode, so that the expressions are not copied into a filter on the array's size; the numbers of slots that do not hold fall out after
        numbers = F.array(*[F.when(here, F.lit(k)) for k, (here, _, _) in enumerate(self.slots)])
        rows = rows.withColumn("_s", numbers).withColumn("_s", F.explode_outer("_s")).where("_s is not null")
        rule = F.coalesce(of({k: r for k, (_, _, r) in enumerate(self.slots) if isinstance(r, Column)}, "string"), pick([None if isinstance(r, Column) else r for _, _, r in self.slots], "string"))
        own = [F.concat("_p", pick([end for _, end, _ in self.slots], "string")).alias("_p"), rule.alias("_r")]
        if self.found:
            own.append(of({k: F.col(f"_f{k}") for k in self.found}, BREACH).alias("_f"))
        if self.items:
            own += [pick([self.items[k][0] if k in self.items else None for k in range(len(self.slots))], "int").alias("_n"), of({k: x for k, (_, x) in self.items.items()}, "array<variant>").alias("_l")]
        rows = rows.select(*columns, *own)
        if self.found:
            rows = rows.withColumn("_f", F.explode_outer("_f")).withColumns({"_p": F.coalesce("_f.path", "_p"), "_r": F.coalesce("_f.rule", "_r")})
        if not self.items:
            return rows.select(*columns, "_p", "_r").where("_r is not null")
        rows = rows.select(*columns, "_p", "_r", "_n", F.posexplode_outer("_l").alias("_i", "_v")).where("_r is not null or _v is not null")
        return rows.withColumn("_p", F.when(F.col("_v").isNull(), F.col("_p")).otherwise(Path(F.col("_p")).item(F.col("_i")).column)).drop("_i")


def invalid_documents(documents: DataFrame, schema: dict, text: str = "document") -> DataFrame:
    """A row ``path, rule`` for each breach of each document, beside the documents' other columns.

    The same as :func:`breaches`, with a level for the documents and one for the
    items of each list inside a list.
    """
    columns = [c for c in documents.columns if c != text]
    # a lambda is not compiled into one method with the steps before and after, which together are more than the JVM compiles
    parsed = F.get(F.transform(F.array(text), lambda x: F.try_parse_json(x)), F.lit(0))
    rows = documents.select(*columns, F.lit("$").alias("_p"), F.lit(None).cast("string").alias("_r"), F.lit(0).alias("_n"), parsed.alias("_v"))
    level = None
    while level is None or level.below:
        nodes = [(schema, ())] if level is None else level.below
        path, value, known = Path(F.col("_p")), F.col("_v"), F.col("_r")
        before, level = level, _Level(schema)
        if before is None:
            level.slot(value.isNull(), path, "json")
        else:  # breaches of the levels before
            level.slot(known.isNotNull(), path, known)
        for node, (part, through) in enumerate(nodes):
            own = value if len(nodes) == 1 else level.bind(F.when(F.col("_n") == node, value), 0)
            level.descend(part, Value(own, level.bind), path, through, [])
        rows = level.applied(rows, columns)
    return rows.select(*columns, F.col("_p").alias("path"), F.col("_r").alias("rule"))


# What an exported bill of materials must hold.
_PROPERTY = {"type": "object", "required": ["name", "value"], "properties": {"name": {"type": "string"}, "value": {"type": "string"}}}
_COMPONENT = {
    "type": "object",
    "required": ["bom-ref", "type", "name", "description", "properties", "purl"],
    "properties": {
        "bom-ref": {"type": "string"},
        "type": {"type": "string", "enum": ["application", "framework", "library", "container", "machine-learning-model", "service", "file"]},
        "name": {"type": "string"},
        "version": {"type": "string"},
        "description": {"type": "string"},
        "purl": {"type": "string"},
        "properties": {"type": "array", "items": {"$ref": "#/definitions/property"}},
    },
}
BILL_OF_MATERIALS = {
    "type": "object",
    "required": ["bomFormat", "specVersion", "version", "serialNumber", "metadata", "components"],
    "properties": {
        "bomFormat": {"type": "string", "const": "CycloneDX"},
        "specVersion": {"type": "string", "const": "1.6"},
        "version": {"type": "integer"},
        "serialNumber": {"type": "string", "pattern": "^urn:uuid:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"},
        "metadata": {
            "type": "object",
            "required": ["timestamp", "tools", "properties"],
            "properties": {"timestamp": {"type": "string"}, "tools": {"type": "object"}, "properties": {"type": "array", "items": {"$ref": "#/definitions/property"}}},
        },
        "components": {"type": "array", "items": _COMPONENT},
    },
    "definitions": {"property": _PROPERTY},
}
