"""Ignore files: their lines as rules with a scope, held against all paths below it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules of so many files are broadcast; beyond that they are dealt out by scope, over SALTS parts each.
BROADCAST_SCOPES, SALTS = 10_000, 16
# Named classes of characters in patterns.
NAMED = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}


def _segment(text: str) -> str | None:
    """The regular expression of one part of a path; None if a class is not closed."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        i += 1
        if c == "*":
            if not out or out[-1] != "[^/]*":
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i < len(text):
            out.append(re.escape(text[i]))
            i += 1
        elif c == "[":
            negated = text[i : i + 1] in ("!", "^")
            at = i + negated
            found, first = [], True
            while at < len(text) and (text[at] != "]" or first):
                first = False
                if m := re.match(r"\[:(\w+):\]", text[at:]):
                    found.append(NAMED.get(m[1], ""))
                    at += len(m[0])
                    continue
                if text[at] == "\\" and at + 1 < len(text):
                    at += 1
                found.append(text[at] if text[at] == "-" and found and text[at + 1 : at + 2] not in ("]", "") else "\\" + text[at] if not text[at].isalnum() else text[at])
                at += 1
            if at >= len(text):
                return None
            out.append(f"(?!/)[{'^' if negated else ''}{''.join(found)}]")
            i = at + 1
        else:
            out.append(re.escape(c) if c not in " /" else c)
    return "".join(out)


def wildmatch(line: str) -> tuple[str, bool] | None:
    """(regular expression of paths below the file's folder, negated) of a line of an ignore file; None if it has no rule.

    A pattern with a slash before its end holds from the folder on, others at
    any depth; ``**`` stands for any folders; what is matched takes along all
    that is below it; a slash at the end asks for a folder.
    """
    line = re.sub(r"(?<!\\)(?:\\\\)*\s+$", lambda m: m[0].rstrip(), line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    pattern = line[negated:]
    if pattern[:2] in ("\\#", "\\!"):
        pattern = pattern[1:]
    folder = pattern.endswith("/") and not pattern.endswith("\\/")
    parts = [p for p in pattern.split("/") if p]
    if not parts:
        return None
    anchored = "/" in pattern.rstrip("/") or pattern.startswith("/")
    out = "" if anchored else "(?:.+/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.+/)?"
        else:
            found = _segment(part)
            if found is None:
                return None
            out += found + ("" if last else "/")
    ending = "/.*" if folder else "" if parts[-1] == "**" else "(?:/.*)?"
    return f"^{out}{ending}$", negated


@F.pandas_udf(T.StructType().add("regex", "string").add("negated", "boolean"))
def _compiled(lines: pd.Series) -> pd.DataFrame:
    found = [wildmatch(x) if x is not None else None for x in lines]
    return pd.DataFrame({"regex": [f[0] if f else None for f in found], "negated": [f[1] if f else None for f in found]})


def ignore_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """``scope, line_no, regex, negated`` of the ignore files among ``path, content``; the scope is the file's folder, "" at the top."""
    own = files.where(F.element_at(F.split("path", "/"), -1).isin(*names))
    lined = own.select(F.regexp_replace("path", "/?[^/]*$", "").alias("scope"), F.posexplode(F.split(F.col("content").cast("string"), "\r\n|\n|\r")).alias("line_no", "line"))
    found = lined.select("scope", (F.col("line_no") + 1).alias("line_no"), _compiled("line").alias("r"))
    return found.where("r.regex is not null").select("scope", "line_no", "r.regex", "r.negated")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``path, scope, line_no`` of ignored files with the rule that decides.

    Of the rules of one ignore file the last that matches counts, and of several
    files the deepest that has a match.  Each path meets the files of the
    folders above it by an equi join on the folder; no path meets a rule of
    another folder.
    """
    per_scope = rules.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("line_no", "regex", "negated")), asc=False).alias("rules"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asking = paths.select("path").distinct().select("path", F.explode(above).alias("scope"))
    if per_scope.limit(BROADCAST_SCOPES + 1).count() <= BROADCAST_SCOPES:
        met = asking.join(F.broadcast(per_scope), "scope")
    else:  # the top folder's rules are asked for by every path, so each scope is dealt out over some tasks
        dealt = per_scope.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asking.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(dealt, ["scope", "salt"])
    below = F.when(F.col("scope") == "", F.col("path")).otherwise(F.expr("substring(path, length(scope) + 2)"))
    hit = met.select("path", "scope", F.get(F.filter("rules", lambda r: F.rlike(below, r["regex"])), F.lit(0)).alias("r")).where("r is not null")
    best = hit.groupBy("path").agg(F.max_by(F.struct("scope", "r"), F.length("scope")).alias("b"))
    return best.where("not b.r.negated").select("path", "b.scope", "b.r.line_no")


def without_ignored(files: DataFrame, names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """The files that their own tree's ignore files leave: ``path, content`` and any other columns."""
    return files.join(ignored(files, ignore_rules(files, names)).select("path"), "path", "left_anti")
