"""Semantic versions as orderable structs, and ranges as predicates over them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The format of a version (fixed).
VERSION = r"^\s*v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?\s*$"


def parse(text: Column) -> Column:
    """struct<major, minor, patch, release, pre>, ordered as versions are; null if it isn't one.

    A release (1) follows its prereleases (0); identifiers are numbers, which come first, or texts, and of
    two equal beginnings the shorter comes first. Build metadata does not count.
    """
    part = lambda k: F.regexp_extract(text, VERSION, k)
    pre = part(4)

    def identifier(x: Column) -> Column:
        numeric = x.rlike(r"^\d+$")
        return F.struct(
            F.when(numeric, 0).otherwise(1).alias("alphanumeric"),
            F.when(numeric, x.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("number"),
            F.when(numeric, "").otherwise(x).alias("text"),
        )

    ids = F.when(pre == "", F.array().cast("array<struct<alphanumeric:int,number:bigint,text:string>>")).otherwise(F.transform(F.split(pre, r"\."), identifier))
    out = F.struct(
        part(1).try_cast("bigint").alias("major"), part(2).try_cast("bigint").alias("minor"), part(3).try_cast("bigint").alias("patch"),
        F.when(pre == "", 1).otherwise(0).alias("release"), ids.alias("pre"),
    )
    return F.when(text.rlike(VERSION), out)


def _bounds(term: str) -> list[tuple[str, str]]:
    """Comparators (operator, version text) of one term of a range."""
    sign = re.match(r"\^|~|>=|<=|>|<|=", term)
    if sign and sign[0] not in "^~":
        return [(sign[0], term[sign.end() :].strip())]
    body, _, pre = (term[1:] if sign else term).partition("-")
    numbers = [None if p in ("x", "X", "*", "") else int(p) for p in body.split(".")]
    if len(numbers) > 3:
        raise ValueError(f"too many components: {term!r}")
    major, minor, patch = numbers + [None] * (3 - len(numbers))
    if major is None:
        return [(">=", "0.0.0")]
    low = f"{major}.{minor or 0}.{patch or 0}" + (f"-{pre}" if pre else "")
    if sign and sign[0] == "~":
        high = f"{major + 1}.0.0" if minor is None else f"{major}.{minor + 1}.0"
    elif sign:
        if minor is None or major > 0:
            high = f"{major + 1}.0.0"
        elif patch is None or minor > 0:
            high = f"0.{minor + 1}.0"
        else:
            high = f"0.0.{patch + 1}"
    elif minor is None:
        high = f"{major + 1}.0.0"
    elif patch is None:
        high = f"{major}.{minor + 1}.0"
    else:
        return [("=", low)]
    return [(">=", low), ("<", high)]


def satisfies(version: Column, spec: str) -> Column:
    """Whether a parsed version is in a range: terms in a group all hold, groups are separated by ||.

    A prerelease is in a group only if a bound of it is a prerelease of the same core version.
    """
    groups = []
    for group in spec.split("||"):
        bounds = [b for term in group.split() for b in _bounds(term)]
        if not bounds:
            continue
        checks, cores = [], []
        for op, text in bounds:
            bound = parse(F.lit(text))
            checks.append({">=": version >= bound, ">": version > bound, "<=": version <= bound, "<": version < bound, "=": version == bound}[op])
            if "-" in text.partition("+")[0]:
                cores.append((version["major"] == bound["major"]) & (version["minor"] == bound["minor"]) & (version["patch"] == bound["patch"]))
        same_core = reduce(lambda a, b: a | b, cores, F.lit(False))
        groups.append(reduce(lambda a, b: a & b, checks) & ((version["release"] == 1) | same_core))
    return F.coalesce(reduce(lambda a, b: a | b, groups, F.lit(False)), F.lit(False))


def max_satisfying(text: Column, spec: str) -> Column:
    """Aggregate: the text of the highest version in the range."""
    v = parse(text)
    return F.max_by(text, F.when(satisfies(v, spec), v))
