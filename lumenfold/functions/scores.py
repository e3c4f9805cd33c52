"""Scalar scores, cuts, ranks and keys as Column expressions. Fixed values stand in tables at the top."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROBUSTNESS = {"C1": 1.0, "C2": 0.8, "C3": 0.6, "C4": 0.4, "C5": 0.2, "C6": 0.1}
STATUS_RANK = {"actionable": 0, "needs_review": 1, "protected": 2, "false_positive_likely": 3}
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_CUTS = ((0.9, "critical"), (0.8, "high"), (0.6, "medium"), (0.3, "low"))
DELTA_CUTS = ((0.9, "critical"), (0.7, "high"), (0.45, "medium"), (0.2, "low"))
CONFLICT_CUTS = ((0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low"))
CWE_SEVERITY = {
    22: 0.85, 73: 0.80, 78: 0.95, 79: 0.75, 89: 0.95, 94: 0.95, 95: 0.95, 119: 0.90, 125: 0.75, 287: 0.80, 295: 0.70, 306: 0.80, 321: 0.75, 327: 0.65, 338: 0.55,
    352: 0.60, 384: 0.70, 434: 0.80, 502: 0.95, 601: 0.60, 611: 0.85, 787: 0.90, 798: 0.80, 918: 0.80, 1333: 0.45,
}
CWE_DEFAULT = 0.5


def lookup(value: Column, table: Mapping, default) -> Column:
    """A constant table as one expression; no join."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def cut(value: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that the value reaches."""
    out = F.lit(rest)
    for least, name in reversed(cuts):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def first_match(rules: Sequence[tuple[Column, object]], rest=None) -> Column:
    """An ordered rule cascade: the first true condition decides."""
    out = F.lit(rest)
    for condition, result in reversed(rules):
        out = F.when(condition, result if isinstance(result, Column) else F.lit(result)).otherwise(out)
    return out


def additive(rules: Sequence[tuple[Column, float]], low: float, high: float) -> Column:
    """The clamped sum of the weights of all rules that hold."""
    total = F.lit(0)
    for condition, weight in rules:
        total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def fragility(robustness: Column, epistemic: Column, confidence: Column) -> Column:
    return (1 - robustness) * 0.4 + epistemic * 0.3 + (1 - confidence) * 0.3


def structural_risk(dependents: Column, robustness: Column) -> Column:
    return F.least(dependents / 10, F.lit(1.0)) * 0.5 + (1 - robustness) * 0.5


def conflict_severity(fragility_a: Column, fragility_b: Column, robustness_a: Column, robustness_b: Column) -> Column:
    return cut(F.greatest(fragility_a, fragility_b) * 0.5 + (1 - F.least(robustness_a, robustness_b)) * 0.5, CONFLICT_CUTS, "info")


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bayes_update(confidence: Column, supports: Column, ratio: float = 3.0) -> Column:
    shift = F.when(supports, F.log(F.lit(ratio))).otherwise(-F.log(F.lit(ratio)))
    return sigmoid(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), logit(confidence) + shift)))


def decay(confidence: Column, per_session: float = 0.95) -> Column:
    return F.greatest(F.lit(0.01), confidence * per_session)


#: Words for a confidence (fixed values).
CONFIDENCE_WORDS = {"critical": 0.95, "high": 0.85, "medium": 0.65, "low": 0.35, "info": 0.2}


def safe_float(value: Column, default: float = 0.5) -> Column:
    """Words and numbers as a confidence between 0 and 1, anything else the default; numbers that aren't finite are an error."""
    number = value.try_cast("double")
    finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.raise_error(F.lit("confidences must be finite"))).otherwise(number)
    return F.coalesce(lookup(F.lower(F.trim(value)), CONFIDENCE_WORDS, None).cast("double"), F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite))), F.lit(default))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of the 95 % interval; 0 and 0 without trials."""
    n, p = total.cast("double"), successes / total
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)
    return (F.when(total > 0, F.greatest(F.lit(0.0), low)).otherwise(F.lit(0.0)), F.when(total > 0, F.least(F.lit(1.0), high)).otherwise(F.lit(0.0)))


def ratio(part: Column, whole: Column) -> Column:
    """0 where it is undefined."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def key_of(*parts: Column, length: int = 16) -> Column:
    """A short digest of parts that are compared without case and runs of white space."""
    plain = [F.lower(F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *plain), 256), 1, length)


def cwe_name(raw: Column) -> Column:
    return F.concat(F.lit("CWE-"), F.nullif(F.regexp_extract(raw, r"(?i)cwe[-_ ]?0*([0-9]+)", 1), F.lit("")))


def pinned(line: Column) -> Column:
    """(name, version) of a requirement that is pinned with ==; null for any other line."""
    pattern = r"^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)"
    name = F.regexp_extract(line, pattern, 1)
    return F.when(name != "", F.struct(F.lower(name).alias("name"), F.regexp_extract(line, pattern, 2).alias("version")))


def route_params(route: Column) -> Column:
    return F.regexp_extract_all(route, F.lit(r"[<{](?:[a-z]+:)?([A-Za-z_][A-Za-z0-9_]*)[>}]"), F.lit(1))


#: Words that say nothing about a claim (fixed values).
STOP_WORDS = (
    "the", "a", "an", "of", "in", "to", "is", "are", "and", "or", "not", "that", "this", "for", "on", "be", "at", "by", "it", "as", "from", "with", "was", "were", "has", "have", "had", "but", "if", "so",
    "possible", "potentially", "maybe", "could", "might", "may", "detected", "found", "issue", "warning", "info", "note",
)


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9_]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def noisy_or(confidences: Column) -> Column:
    """1 less the product of the complements, of an array."""
    return 1 - F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1 - c))
