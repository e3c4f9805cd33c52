"""Rules of the audit path as Column expressions: categories, case types, priorities, states, guards, reportability, reasoning.

Tables of fixed values stand first; a rule is a set of CWE codes or words, and of an ordered table the first rule that
holds decides. Text is compared in lower case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scores as S

# Fixed values. Categories of signals from other tools: name, CWE codes, words.
CATEGORIES = (
    ("xss", ("CWE-79", "CWE-080", "CWE-081", "CWE-083"), ("xss",)),
    ("sql_injection", ("CWE-89",), ("sql",)),
    ("path_traversal", ("CWE-22", "CWE-73"), ("path traversal", "path_traversal")),
    ("command_injection", ("CWE-78",), ("command", "shell")),
    ("unsafe_deserialization", ("CWE-502",), ("deserial", "pickle")),
    ("ssrf", ("CWE-918",), ("ssrf", "server-side request forgery")),
    ("secrets", ("CWE-798",), ("hardcoded", "secret")),
    ("access_control", ("CWE-639", "CWE-862", "CWE-863"), ("idor", "bola", "authz", "authorization bypass", "access control")),
    ("mass_assignment", (), ("mass assignment", "mass_assignment")),
)
CASE_TYPES = {
    "xss": "xss_possible", "sql_injection": "sql_injection_possible", "path_traversal": "path_traversal_possible", "command_injection": "command_injection_possible",
    "unsafe_deserialization": "unsafe_deserialization_possible", "ssrf": "ssrf_possible", "secrets": "hardcoded_secret_possible", "access_control": "idor_bola_possible",
    "mass_assignment": "mass_assignment_possible",
}
MISSING = {
    "access_control": "owner_or_tenant_scoped_lookup", "mass_assignment": "server_side_field_allowlist", "path_traversal": "path.is_within_base_directory == true",
    "unsafe_deserialization": "deserialization.input_trusted_or_signed == true", "ssrf": "outbound_url.host_allowlisted == true",
    "command_injection": "command.arguments_are_not_user_controlled == true", "sql_injection": "query.uses_parameter_binding == true",
    "xss": "output.user_values_escaped == true", "secrets": "secret.value_is_runtime_supplied == true",
}
TOOL_CONFIDENCE = {"very_high": 0.85, "high": 0.85, "critical": 0.85, "error": 0.85, "medium": 0.65, "warning": 0.65, "low": 0.35, "note": 0.35, "info": 0.35}
HYPOTHESES = (
    ("path_traversal_possible", ("CWE-22", "CWE-73"), ("path traversal",)),
    ("xss_possible", ("CWE-79",), ("xss", "markup", "html")),
    ("authorization_bypass_possible", ("CWE-639", "CWE-862", "CWE-863"), ("idor", "access control", "owner_id", "source_id", "user_id")),
    ("unsafe_deserialization_possible", ("CWE-502",), ("pickle", "deserial", "yaml.load")),
    ("hardcoded_credential_possible", ("CWE-798",), ("hardcoded credential", "credential")),
)
GUARDS = (
    ("authentication_guard", (), ("requires_login", "login_required", "authenticated", "authentication", "is_authenticated")),
    ("role_authorization_guard", (), ("requires_admin", "admin_required", "permission_required", "has_permission", "has_role", "role_required", "role_authorization")),
    ("resource_binding_guard", (), ("scoped_to_", "filter_by", "resource_binding", "object_binding", "bound_to_resource", "source_id")),
    ("tenant_guard", (), ("current_user.tenant", "tenant_id", "tenant_scope", "tenant scoped", "tenant-bound")),
    ("ownership_guard", (), ("current_user.id", "current_source", "current_user", "owner_id", "owner_scope", "ownership", "owner_tenant_scope")),
    ("path_containment_guard", (), ("is_within_store", "enforces_store_boundary", "commonpath", "path_containment", "within_root", "within_base")),
    ("input_validation_guard", (), ("matches_allowed_pattern", "allow_list", "allowlist", "allowed_extension", "input_validation", "validate_input", "server_generated", "user_controlled == false", "value_is_header_name", "value_is_runtime_supplied", "input_trusted")),
    ("sanitizer_guard", (), ("sanitiz", "escaped", "escape(", "basename_only", "is_normalized", "safe_loader")),
)
FAMILIES = (
    ("path_boundary", ("storage.path.enforces_store_boundary", "storage.verify.enforces_store_boundary", "storage.store_contains.enforces_store_boundary", "path.is_within_store")),
    ("path_normalization", ("path.is_normalized",)),
    ("filename_validation", ("filename.matches_allowed_pattern", "filename.basename_only", "filename.user_controlled == false")),
    ("server_generated_value", ("server_generated", "identifier.server_generated")),
    ("ownership_scope", ("query.scoped_to_current_",)),
    ("escaping", ("html_output.user_values_escaped", "markup.has_unescaped_user_input == false")),
    ("authorization", ("route.requires_",)),
    ("runtime_surface", ("runtime.surface.",)),
    ("serialization_safety", ("deserialization.input_trusted",)),
)
SKIPPED_PARTS = ("tests", "test", "fixtures", "fixture", "vendor", "generated", "examples")
DEPLOYMENT_PARTS = ("debian", "install_files", "devops", "molecule", "build")
WEB_PARTS = ("source_app", "journalist_app")
REPORTABILITY = (
    ("external", 10), ("lineages", 15), ("codeflow", 20), ("ordered_flow", 20), ("route", 15), ("access", 25), ("attack_path", 25), ("owner_gap", 25), ("mutation", 15), ("sensitive", 15), ("steps", 10), ("high_impact", 15),
    ("strong_guard", -40), ("admin_guard", -25), ("skipped_path", -20), ("nothing_found", -20), ("static_only", -15), ("low_severity", -10),
)
OUTCOMES = (("false_positive", -35), ("enforced", -25), ("bypassed", 20), ("validated_candidate", 10))
VERDICTS = ((80, "reportable_candidate"), (50, "needs_manual_validation"), (20, "weak_signal"))
FEEDBACK = (("false_positive", "likely_false_positive", 0.85), ("protected", "protected_by_guard", 0.85), ("needs_more_evidence", "request_more_evidence", 0.7), ("out_of_scope", "lower_confidence", 0.75), ("duplicate", "lower_confidence", 0.75))
MITIGATES = ("sanitized", "validated", "escaped", "filtered", "checked", "verified", "authenticated", "authorized")
RISKS = ("unsanitized", "unvalidated", "injectable", "tainted", "user_controlled", "untrusted", "exploitable")
SAFE = ("sanitized", "validated", "escaped", "filtered", "safe", "trusted", "verified", "authenticated", "authorized", "parameterized", "checked")
UNSAFE = ("unsanitized", "unvalidated", "injectable", "tainted", "untrusted", "exploitable", "user_controlled", "user-controlled", "unsafe", "vulnerable", "insecure", "weak")
COMMON = ("the", "a", "an", "is", "are", "be", "not", "of", "in", "to", "and", "or", "that", "this", "for")
STATIC_ENDS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".css", ".map")
FIX_WORDS = ("fix", "security", "overflow", "sanitize", "validate", "escape", "inject", "xss", "csrf", "auth", "permission", "bounds", "check", "null", "crash", "vuln", "exploit", "patch", "safe", "unsafe", "trust", "untrust")
ROUTE_GUARANTEES = (
    ("route.requires_login == true", ("login_required", "authenticated", "requires_auth")), ("route.requires_admin == true", ("admin_required",)),
    ("route.requires_permission == true", ("permission_required", "has_perm", "security")), ("route.has_dependency_guard == true", ("depends",)),
)
TRUST = (("callee_external", 0.3), ("caller_external", 0.2), ("no_try", 0.15), ("no_assert", 0.1), ("cross_module", 0.15), ("public_call", 0.1))
RISK = (("writes", 0.15), ("no_validation", 0.2), ("no_timeout", 0.1), ("no_sandbox", 0.15), ("network", 0.15), ("untrusted", 0.15), ("no_errors", 0.1))


def has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_rule(table, cwe: Column, text: Column, rest: str | None) -> Column:
    """The name of the first rule that a CWE code or a word of the text meets."""
    return S.first_match([((cwe.isin(*codes) if codes else F.lit(False)) | has_any(text, words), name) for name, codes, words in table], rest)


def external_category(cwe: Column, text: Column) -> Column:
    return first_rule(CATEGORIES, F.upper(cwe), F.lower(F.concat_ws(" ", cwe, text)), "unknown")


def external_confidence(confidence: Column, severity: Column) -> Column:
    """A tool's own confidence comes first, then its severity."""
    return S.lookup(F.lower(S.truthy(confidence, severity)), TOOL_CONFIDENCE, 0.5)


def hypothesis(cwe: Column, text: Column) -> Column:
    return first_rule(HYPOTHESES, F.upper(cwe), F.lower(text), None)


def guard_class(expression: Column, explicit: Column | None = None) -> Column:
    """A guard's class, by its stated one where that is known, else by its words."""
    by_words = first_rule(GUARDS, F.lit(None).cast("string"), F.lower(F.trim(expression)), None)
    if explicit is None:
        return by_words
    stated = F.lower(F.trim(explicit))
    return F.when(stated.isin(*[g for g, _, _ in GUARDS]), stated).otherwise(by_words)


def families(expressions: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How many guarantees are of each family; one may be of several."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return expressions.groupBy(*by).agg(*[F.count_if(has_any(low, words)).alias(name) for name, words in FAMILIES])


def review_priority(case_type: Column, severity: Column, contradicted: Column, guarantees: Column, missing: Column, sanitized: Column) -> Column:
    """The cascade by case type. `guarantees` is their joined text, `missing` and `sanitized` whether there are such."""
    held, low = guarantees != "", F.lower(guarantees)
    guarded = case_type.isin("path_traversal_possible", "xss_possible", "idor_bola_possible")
    severity = F.lower(severity)
    return S.first_match(
        [
            (contradicted & guarded, "low"),
            ((case_type == "xss_possible") & has_any(low, FAMILIES[5][1]), "low"),
            ((held | sanitized) & guarded & ~missing, "low"),
            (case_type == "unsafe_deserialization_possible", F.when(held, "low").otherwise("critical")),
            (case_type == "command_injection_possible", F.when(missing | ~held, "critical").otherwise("low")),
            (case_type == "idor_bola_possible", F.when(missing | ~held, "high").otherwise("low")),
            (case_type == "path_traversal_possible", F.when(missing & ~held, "high").otherwise("low")),
            (case_type.isin("ssrf_possible", "sql_injection_possible"), "high"),
            (case_type == "hardcoded_secret_possible", F.when(held, "info").otherwise("high")),
            (severity.isin("critical", "high", "medium", "low", "info"), severity),
        ],
        "medium",
    )


def case_status(case_type: Column, state: Column, contradicted: Column, protected: Column, priority: Column) -> Column:
    """The cascade by the hypothesis' state; `protected` is whether guarantees or sanitizers leave nothing missing."""
    urgent = priority.isin("critical", "high")
    return S.first_match(
        [
            (contradicted | protected, "protected"),
            (state == "weakened", F.when(priority.isin("low", "info"), "protected").otherwise("needs_review")),
            (state == "strengthened", F.when(urgent, "actionable").otherwise("needs_review")),
            (state == "unproven", "needs_review"),
            (urgent & case_type.isin("unsafe_deserialization_possible", "command_injection_possible"), "actionable"),
        ],
        "needs_review",
    )


def reportability(df: DataFrame) -> DataFrame:
    """Adds score, verdict and confidence to rows that hold a boolean for each factor of REPORTABILITY, `outcome` (of a
    verified proof, or null), `contradicted`, `n_tools` and `has_path`. Without a verified bypass 79 is the most."""
    total = F.lit(0)
    for name, weight in REPORTABILITY:
        total = total + F.when(F.col(name), weight).otherwise(0)
    total = total + S.lookup(F.col("outcome"), dict(OUTCOMES), 0)
    capped = F.when((total >= 80) & ~F.coalesce(F.col("outcome") == "bypassed", F.lit(False)), 79).otherwise(total)
    score = F.greatest(F.lit(0), F.least(F.lit(100), capped))
    verdict = F.when(F.col("strong_guard") & ~F.col("contradicted"), "protected_by_guard").otherwise(S.cut(score, VERDICTS, "likely_false_positive"))
    signal = F.col("external") | F.col("access") | F.col("attack_path")
    sure = S.first_match([((F.col("n_tools") > 1) | ((F.col("access") | F.col("attack_path")) & F.col("route")), "high"), (signal & F.col("steps") & (F.col("route") | F.col("has_path")), "medium")], "low")
    return df.withColumns({"score": score, "verdict": verdict, "confidence": sure})


def runtime_surface(path: Column) -> Column:
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    among = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    tests = among(("tests", "test")) | F.exists(parts, lambda p: p.startswith("test_") | p.endswith("_test.py"))
    return S.first_match([(among(("alembic",)) & among(("versions",)), "migration"), (tests, "test"), (among(DEPLOYMENT_PARTS), "deployment_or_packaging"), (among((*WEB_PARTS, "api2")) | F.concat(F.lit("/"), low, F.lit("/")).contains("/api/"), "runtime_web")], "source")


def reasoned(verdicts: Column, inconclusive: Column, missing: Column, confidence: Column) -> Column:
    """(recommendation, confidence) from feedback verdicts first, then from evidence."""
    answer = lambda name, c: F.struct(F.lit(name).alias("recommendation"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    rules = [(F.array_contains(verdicts, v), answer(name, c)) for v, name, c in FEEDBACK]
    rules += [(inconclusive, answer("needs_manual_validation", 0.65)), (missing, answer("request_more_evidence", 0.6))]
    out = answer("keep", F.greatest(F.lit(0.1), F.least(confidence, F.lit(0.7))))
    for condition, result in reversed(rules):
        out = F.when(condition, result).otherwise(out)
    return out


def negates(a: Column, b: Column) -> Column:
    """Whether one predicate says the opposite of another: a `not` before it, its comparison turned round, or safe words
    against risky ones about the same thing."""
    plain = (a == F.concat(F.lit("not "), b)) | (b == F.concat(F.lit("not "), a)) | (a == F.concat(F.lit("not ("), b, F.lit(")"))) | (b == F.concat(F.lit("not ("), a, F.lit(")")))
    turned = F.lit(False)
    for x, y in ((" <= ", " > "), (" >= ", " < "), (" == ", " != "), (" is not ", " is "), (" not in ", " in ")):
        for p, q in ((a, b), (b, a)):
            for u, v in ((x, y), (y, x)):
                turned = turned | (p.contains(u) & (F.replace(p, F.lit(u), F.lit(v)) == q))
    words = lambda p: F.array_distinct(F.regexp_extract_all(p, F.lit(r"([a-z][a-z0-9_]+)"), F.lit(1)))
    among = lambda p, names: F.arrays_overlap(words(p), F.array(*[F.lit(n) for n in names]))
    shared = F.array_except(F.array_intersect(words(a), words(b)), F.array(*[F.lit(n) for n in (*SAFE, *UNSAFE, *COMMON)]))
    opposed = ((among(a, SAFE) & among(b, UNSAFE)) | (among(a, UNSAFE) & among(b, SAFE))) & (F.size(shared) > 0)
    return (a != "") & (b != "") & (plain | turned | opposed)


def relation(a: Column, b: Column, lines_a: Column, lines_b: Column) -> Column:
    """How one predicate bears on another of its scope: contradicts, mitigates, supports, or null."""
    return S.first_match([(negates(F.trim(a), F.trim(b)), "contradicts"), (has_any(a, MITIGATES) & has_any(b, RISKS), "mitigates"), (F.arrays_overlap(lines_a, lines_b), "supports")])


def related_pairs(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(a, b, relation), a < b, of rows (scope, id, says, lines) of one scope. Predicates are compared once for each two that a
    scope has, not for each two rows; a row brings along what its own predicate is to the others of its scope."""
    kinds = rows.filter("says is not null").select(*scope, "says").distinct()
    two = kinds.toDF(*scope, "sa").join(kinds.toDF(*scope, "sb"), [*scope])
    apart = F.array().cast("array<int>")
    known = two.select("sa", "sb").distinct().select("sa", "sb", relation(F.col("sa"), F.col("sb"), apart, apart).alias("bears")).filter("bears is not null")
    of = two.join(known, ["sa", "sb"]).groupBy(*scope, "sa").agg(F.map_from_entries(F.collect_list(F.struct("sb", "bears"))).alias("bears"))  # a scope's own predicates
    x = rows.toDF(*scope, "a", "sa", "la").join(of, [*scope, "sa"], "left").select(*scope, "a", "la", "bears")
    y = rows.toDF(*scope, "b", "sb", "lb")
    found = F.coalesce(F.try_element_at("bears", F.col("sb")), F.when(F.arrays_overlap("la", "lb"), "supports"))
    return x.join(y, [*scope]).filter((F.col("a") < F.col("b")) & found.isNotNull()).select("a", "b", found.alias("relation"))


def is_static(path: Column) -> Column:
    out = F.lit(False)
    for end in STATIC_ENDS:
        out = out | F.lower(path).endswith(end)
    return out


def route_guarantees(names: Column) -> Column:
    low = F.lower(F.array_join(names, " "))
    return F.array_compact(F.array(*[F.when(has_any(low, words), F.lit(g)) for g, words in ROUTE_GUARANTEES]))


def weighted(flags: dict[str, Column], weights) -> Column:
    """The sum of the weights of the flags that hold, 1 at most."""
    total = F.lit(0.0)
    for name, w in weights:
        total = total + F.when(flags[name], F.lit(w)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)
