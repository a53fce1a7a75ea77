"""Text governance: personal data, keys and attacks in text columns, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aiscope.functions import dims


def _scanned(text: Column, max_scan: int | None) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return whole if max_scan is None else F.substring(whole, 1, max_scan)


def redact(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Replace personal data by ``[REDACTED_TYPE]``, pattern after pattern; ``extra`` maps labels to more patterns."""
    replace = lambda t, x: F.regexp_replace(t, F.lit(x[1]), F.lit(f"[REDACTED_{x[0]}]"))
    first, rest = dims.REDACTIONS[0], dims.REDACTIONS[1:]  # an address has an at sign, all others have digits
    done = F.when(text.contains("@"), replace(text, first)).otherwise(text)
    done = F.when(text.rlike("[0-9]{3}|[0-9]\\."), reduce(replace, rest, done)).otherwise(done)
    return reduce(replace, (extra or {}).items(), done)


def redact_values(values: Column, extra: dict[str, str] | None = None) -> Column:
    """The same for all values of a map of strings."""
    return F.transform_values(values, lambda _, v: redact(v, extra))


def redacted_types(text: Column) -> Column:
    """Sorted distinct labels that redaction puts into a text that had none before."""
    found = F.regexp_extract_all(redact(text), F.lit(r"\[REDACTED_([A-Z0-9_]+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def luhn(digits: Column) -> Column:
    """13 to 19 digits, blanks and dashes aside, with a right check digit."""
    bare = F.regexp_replace(digits, r"[\s-]", "")
    return bare.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", bare)


def _positions(text: Column, values: Column) -> Column:
    """Structs of each value with its 0-based place, as the values follow one another in the text."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<value:string,position:int>>").alias("out"))

    def step(state: Column, value: Column) -> Column:
        place = F.call_function("locate", value, text, state["at"])
        return F.struct((place + F.length(value)).alias("at"), F.array_append(state["out"], F.struct(value.alias("value"), (place - 1).alias("position"))).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def _typed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("type"), x["value"].alias("value"), x["position"].alias("position")))


def detect_pii(text: Column, max_scan: int | None = None, kinds: list[str] | None = None) -> Column:
    """All matches as structs ``type, value, position``, type after type; ``kinds`` names the types to look for, by default all.

    ``max_scan`` caps the code points looked at, by default none.
    """
    scanned = _scanned(text, max_scan)
    wanted = lambda kind: kinds is None or kind in kinds
    none = F.array().cast("array<string>")
    parts = []
    for kind, pattern in dims.DETECTIONS:
        if not wanted(kind):
            continue
        mark = scanned.contains("@") if kind == "email" else scanned.rlike("[0-9]")
        values = F.when(mark, F.regexp_extract_all(scanned, F.lit(pattern), F.lit(0))).otherwise(none)
        found = _positions(scanned, values)
        if kind == "credit_card":
            found = F.filter(found, lambda x: luhn(x["value"]))
        parts.append(_typed(kind, found))
    for pattern, _, _ in dims.KEY_PATTERNS if wanted("api_key") else []:
        values = F.regexp_extract_all(scanned, F.lit(pattern if pattern.startswith("(?i)") else f"(?i){pattern}"), F.lit(0))
        parts.append(_typed("api_key", _positions(scanned, values)))
    return F.concat(*parts)


def contains_pii(text: Column) -> Column:
    return F.size(detect_pii(text)) > 0


def redact_matches(text: Column, matches: Column) -> Column:
    """Replace matches by place, right to left.  Of overlapping matches the leftmost, then the longest, counts."""
    ordered = F.array_sort(matches, lambda a, b: F.when(a["position"] != b["position"], a["position"] - b["position"]).otherwise(F.length(b["value"]) - F.length(a["value"])))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<type:string,value:string,position:int>>").alias("kept"))

    def keep(state: Column, m: Column) -> Column:
        free = m["position"] >= state["end"]
        end = F.when(free, m["position"] + F.length(m["value"])).otherwise(state["end"])
        return F.struct(end.alias("end"), F.when(free, F.array_append(state["kept"], m)).otherwise(state["kept"]).alias("kept"))

    kept = F.reverse(F.aggregate(ordered, empty, keep, lambda s: s["kept"]))
    return F.aggregate(kept, text, lambda t, m: F.concat(F.substring(t, F.lit(1), m["position"]), F.lit("[REDACTED_"), F.upper(m["type"]), F.lit("]"), F.substring(t, m["position"] + F.length(m["value"]) + 1, F.lit(2147483647))))


def _pattern_hits(text: Column, table: list[tuple[str, str, str]], max_scan: int | None = None) -> Column:
    scanned = _scanned(text, max_scan)
    hits = [F.when(scanned.rlike(rx), F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.regexp_extract(scanned, rx, 0).alias("matched"))) for name, rx, severity in table]
    return F.array_compact(F.array(*hits))


def injections(text: Column, max_scan: int | None = None) -> Column:
    """Structs ``name, severity, matched``, one for each prompt-injection pattern found."""
    return _pattern_hits(text, dims.INJECTIONS, max_scan)


def dangers(text: Column, max_scan: int | None = None) -> Column:
    """The same for dangerous content."""
    return _pattern_hits(text, dims.DANGERS, max_scan)


def content_filter(text: Column, max_scan: int | None = None) -> Column:
    return F.concat(injections(text, max_scan), dangers(text, max_scan))


def mask_key(key: Column) -> Column:
    """The first and last characters of a key, never the whole."""
    n = F.length(key)
    return F.when(n <= 12, F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(2)))).otherwise(F.concat(F.substring(key, 1, 8), F.lit("..."), F.right(key, F.lit(4))))


def _masked(priority: int, provider: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(priority).alias("priority"), F.lit(provider).alias("provider"), mask_key(v).alias("masked")))


def api_keys(text: Column) -> Column:
    """Structs ``priority, provider, masked`` of all keys; what one pattern has taken is blanked for the next.

    Patterns go by priority; only the key itself is blanked, by a character
    outside every key, so context words stay for later patterns.
    """
    working, parts = text, []
    for priority, (rx, provider, group) in enumerate(dims.KEY_PATTERNS):
        values = F.regexp_extract_all(working, F.lit(rx), F.lit(group))
        parts.append(_masked(priority, provider, values))
        if group:
            before, after = rx.split("(sk-", 1) if "(sk-" in rx else rx.rsplit("([", 1)
            working = F.regexp_replace(working, f"({before})" + ("(sk-" if "(sk-" in rx else "([") + after, "$1\u0001")
        else:
            working = F.regexp_replace(working, rx, "\u0001")
    return F.concat(*parts)
