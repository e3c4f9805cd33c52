"""Advisory feeds as tables (provider, id, package, summary, severity, published, aliases), dependency pins joined to
version ranges, page chains checked for gaps, and target scopes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

OSV = "struct<vulns:array<struct<id:string,summary:string,published:string,aliases:array<string>,affected:array<struct<package:struct<name:string>>>,database_specific:struct<severity:string>>>>"
KEV = "struct<vulnerabilities:array<struct<cveID:string,product:string,vulnerabilityName:string,dateAdded:string>>>"
NVD = "struct<vulnerabilities:array<struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseSeverity:string>>>>>>>>"
GITHUB = "array<struct<ghsa_id:string,cve_id:string,summary:string,severity:string,published_at:string,vulnerabilities:array<struct<package:struct<name:string>>>>>"


def record(provider: str, id_: Column, package: Column, summary: Column, severity: Column, published: Column, aliases: Column) -> list[Column]:
    return [
        F.lit(provider).alias("provider"), id_.alias("id"), F.lower(package).alias("package"), F.coalesce(summary, F.lit("")).alias("summary"),
        F.lower(F.coalesce(severity, F.lit(""))).alias("severity"), published.alias("published"), F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"),
    ]


def osv(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = raw.select(F.explode(F.from_json("text", OSV)["vulns"]).alias("x")).select("x", F.explode_outer(x["affected"]["package"]["name"]).alias("package"))
    return rows.select(*record("osv", x["id"], F.col("package"), x["summary"], x["database_specific"]["severity"], x["published"], x["aliases"]))


def kev(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    return raw.select(F.explode(F.from_json("text", KEV)["vulnerabilities"]).alias("x")).select(*record("kev", x["cveID"], x["product"], x["vulnerabilityName"], F.lit("high"), x["dateAdded"], F.lit(None)))


def nvd(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    english = F.get(F.filter(x["descriptions"], lambda d: d["lang"] == "en"), 0)["value"]
    rows = raw.select(F.explode(F.from_json("text", NVD)["vulnerabilities"]["cve"]).alias("x"))
    return rows.select(*record("nvd", x["id"], F.lit(None).cast("string"), english, F.get(x["metrics"]["cvssMetricV31"], 0)["cvssData"]["baseSeverity"], x["published"], F.lit(None)))


def github(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = raw.select(F.explode(F.from_json("text", GITHUB)).alias("x")).select("x", F.explode_outer(x["vulnerabilities"]["package"]["name"]).alias("package"))
    return rows.select(*record("github", x["ghsa_id"], F.col("package"), x["summary"], x["severity"], x["published_at"], F.when(x["cve_id"].isNotNull(), F.array(x["cve_id"]))))


def version_parts(version: str) -> tuple:
    """A release as numbers; a pre-release sorts before its release."""
    m = re.match(r"v?(\d+(?:\.\d+)*)(.*)$", version.strip())
    if not m:
        raise ValueError(version)
    numbers = [int(x) for x in m[1].split(".")]
    while len(numbers) > 1 and not numbers[-1]:
        numbers.pop()
    rest = m[2].lower().lstrip(".-_")
    early = re.match(r"(dev|alpha|beta|a|b|rc|c)\D*(\d*)", rest)
    stage = {"dev": -4, "alpha": -3, "a": -3, "beta": -2, "b": -2, "rc": -1, "c": -1}.get(early[1], 0) if early else 0
    return tuple(numbers), stage, int(early[2] or 0) if early else 0


def within(version: str | None, spec: str | None) -> bool:
    """Whether a version meets every clause of a specifier; what can't be read as either is compared as a part of it."""
    if not version or not spec:
        return False
    try:
        v = version_parts(version)
        for clause in spec.split(","):
            m = re.match(r"\s*(===|==|!=|<=|>=|<|>|~=)?\s*([^\s]+)\s*$", clause)
            if not m:
                raise ValueError(spec)
            op, bound = m[1] or "==", m[2]
            if bound.endswith(".*"):
                p = version_parts(bound[:-2])[0]
                same = (v[0] + (0,) * len(p))[: len(p)] == p
                ok = same if op == "==" else not same
            else:
                b = version_parts(bound)
                ok = {"==": v == b, "===": v == b, "!=": v != b, "<=": v <= b, ">=": v >= b, "<": v < b, ">": v > b, "~=": v >= b and v[0][: max(1, bound.count("."))] == b[0][: max(1, bound.count("."))]}[op]
            if not ok:
                return False
        return True
    except ValueError:
        return version in spec


@F.pandas_udf(BooleanType())
def version_within(version: pd.Series, spec: pd.Series) -> pd.Series:
    return pd.Series([within(v, s) for v, s in zip(version, spec, strict=True)], dtype=bool)


def vulnerable(pins: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pins (name, version) with the advisories (package, advisory, place, spec) that hold them, and the first spec of an
    advisory that does. Names meet by an equal join, each pin once; only then versions are compared."""
    pins = pins.select("name", "version").distinct()
    met = pins.join(ranges, F.lower(pins["name"]) == ranges["package"]).filter(version_within("version", "spec"))
    return met.groupBy("name", "version", "advisory").agg(F.min_by("spec", "place").alias("spec"))


def chain_faults(pages: DataFrame, run: str) -> DataFrame:
    """(run, page, fault) of pages (run, page, first, n, total, fetched_at) that don't continue the one before."""
    order = Window.partitionBy(run).orderBy("page")
    end, total, at = (F.lag(c).over(order) for c in (F.col("first") + F.col("n"), F.col("total"), F.col("fetched_at")))
    rules = {"gap": F.coalesce(end, F.lit(0)) != F.col("first"), "total_changed": total.isNotNull() & (total != F.col("total")), "time_went_back": at.isNotNull() & (F.col("fetched_at") < at), "beyond_total": F.col("first") + F.col("n") > F.col("total")}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return pages.withColumn("_f", found).select(run, "page", F.explode("_f").alias("fault"))


def in_scope(targets: DataFrame, target: str, patterns: DataFrame) -> DataFrame:
    """Targets under an included pattern and under no excluded one; patterns (pattern, included) are prefixes that end at
    a part of the path. Each target meets the patterns by its own prefixes, so the join is equal."""
    parts = F.split(F.rtrim(F.regexp_replace(target, "/+$", "")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    mine = targets.select(target, F.explode(prefixes).alias("_prefix"))
    p = patterns.select(F.regexp_replace("pattern", "/+$", "").alias("_prefix"), "included")
    state = mine.join(p, "_prefix").groupBy(target).agg(F.bool_or("included").alias("_in"), F.bool_or(~F.col("included")).alias("_out"))
    return targets.join(state.filter("_in and not _out").select(target), target, "left_semi")
