"""Quality rules, line first: each line is judged alone, failing lines go, and a document that loses too much goes too.

A line fails when it is shouted, a navigation strip, boilerplate, over-punctuated, mostly symbols, or equal to an
earlier line. Plain prose lines pass whether or not they end in punctuation, so clean documents lose nothing.

Nulls: a null text is an empty text (no words, rejected); other null columns pass through. Empty tables give empty
results. Repeated rows are judged one by one. Extra columns are kept by `clean_documents`, whatever they are called, and
ignored by `query`. JVM expressions only; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import filtered_in_place, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document goes when the lines taken out hold more than this share of its word characters.
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate when such phrases (fixed values) make up a twelfth of its characters or more.
BOILERPLATE_PART = 12
BOILERPLATE = r"(?i)\b(?:javascript is (?:disabled|required)|enable javascript|cookie policy|accept (?:all )?cookies|lorem ipsum|click here to|sign up for our newsletter|back to top|skip to content)\b"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def boilerplate(line: Column) -> Column:
    return line.rlike(BOILERPLATE) & ((F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))) * BOILERPLATE_PART >= F.length(line))


def may_fail(text: Column) -> Column:
    """False only where no line of the text can fail a rule of `line_fails`: the characters that each rule needs are
    absent and each line with an upper-case letter has a lower-case one. One scan spares most texts the line rules."""
    return text.rlike(r"[!?]{2}|\.{4}|[#*$%&|<>»›•]") | text.rlike(r"(?m)^[^\p{Ll}\n]*+$")


def line_fails(line: Column) -> Column:
    """Whether the rules but `boilerplate` throw one line out, without looking at other lines. The line holds a word."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))  # counted only where a cheap test asks for it
    bars = F.length(line) - F.length(without(line, "|»›•"))
    marks = F.regexp_count(line, F.lit(r"(?:[!?]{2,}|\.{4,})(?=[\x20\x09-\x0D]|$)"))
    shouted = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= 3)
    navigation = (bars >= 2) & (bars * 3 >= n - bars)
    punctuation = line.rlike(r"[!?]{2}|\.{4}") & (n >= 3) & (marks * 3 > n)
    symbols = (F.length(line) - F.length(without(line, SYMBOLS))) * 10 > F.length(without(line, " \t\n\x0b\f\r"))
    marked = line.rlike(r"[#*$%&|<>»›•]") & (navigation | symbols)
    return shouted | punctuation | marked


def covered(sorted_pairs: Column) -> Column:
    """Words under the windows that share a hash with another, from (hash, position) pairs in order."""
    again = F.filter(
        sorted_pairs,
        lambda x, i: F.coalesce(F.get(sorted_pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_pairs, i + 1)["h"] == x["h"], F.lit(False)),
    )
    start = F.struct(F.lit(-WINDOW).cast("int").alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.cast("int").alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("int").alias("n"))
    return F.aggregate(F.sort_array(F.transform(again, lambda x: x["p"])), start, step, lambda a: a["n"])


def measured(docs: DataFrame) -> DataFrame:
    """Adds the measures, `base_failed`, `clean_text` (the lines that stay), `lost_chars` and `kept`.

    Five-word windows are compared by 64-bit hashes: first by a hash set over the windows alone, and only in texts with
    an equal pair by sorting (hash, position).
    """
    own = {"_text", "_words", "_lines", "_hashes", "_pairs", "_stay", *MEASURES, "base_failed", "clean_text", "lost_chars", "kept"}
    df = docs.select(*[docs[c] for c in docs.columns if c not in own], F.coalesce(docs["text"], F.lit("")).alias("_text"))
    df = df.withColumns({"_words": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    hashes = F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(WINDOW)]))
    df = df.withColumns({"_hashes": F.when(F.size("_words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")), "_stay": F.filter(F.array_distinct("_lines"), lambda x: ~boilerplate(x))})
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_stay", F.when(may_fail(F.col("_text")), F.filter("_stay", lambda x: ~line_fails(x))).otherwise(F.col("_stay")))
    df = df.withColumns({"_pairs": F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs), "clean_text": F.array_join("_stay", "\n")})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.when(F.col("_text").rlike(r"[#*$%&|<>]"), F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).otherwise(0).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered(F.col("_pairs")), F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "lost_chars": F.col("word_chars") - F.length(without(F.col("clean_text"), " \t\n\x0b\f\r"))})
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")) & F.col("clean_text").rlike(r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (MIN_WORDS - 1)))
    return df.drop("_text", "_words", "_lines", "_hashes", "_pairs", "_stay")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the failing lines taken out of `text` and `n_chars` counted anew where present.
    Blank lines go with the failing ones; a text that loses no line stays as it is."""
    # The other columns lie in a struct, so that they never meet the names used here.
    rest = [c for c in docs.columns if c != "text"]
    df = docs.select(F.struct(*[docs[c] for c in rest], F.lit(0).alias("_")).alias("row"), docs["text"].alias("text"))
    df = filtered_in_place(measured(df), "kept")
    text = F.when((F.col("lost_chars") == 0), F.col("text")).otherwise(F.col("clean_text"))
    n = lambda c: F.length(text).cast(docs.schema[c].dataType)
    return df.select(*[(text if c == "text" else n(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measured(docs).select("doc_id", *MEASURES, "base_failed", "kept", "lost_chars")




#: The same rows in DuckDB's SQL: windows are compared as strings, words at a line's end by their last characters.
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
places AS (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS p FROM parts WHERE len(w) >= 5),
again AS (SELECT row_id, p FROM (SELECT row_id, p, array_to_string(w[p:p + 4], ' ') AS x FROM places) QUALIFY count(*) OVER (PARTITION BY row_id, x) > 1),
under AS (SELECT row_id, count(DISTINCT q) AS n FROM (SELECT row_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY row_id),
lines AS (SELECT row_id, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT row_id, unnest(l) AS line FROM parts)),
judged AS (SELECT row_id, w, len(w) AS n, length(regexp_replace(line, '[^|»›•]', '', 'g')) AS bars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(array_to_string(w, '')) AS chars, len(list_filter(w, lambda x: regexp_matches(x, '([!?]{{2,}}|\.{{4,}})$'))) AS marks, line FROM lines),
stay AS (SELECT row_id, sum(chars) AS chars, sum(n) AS n FROM judged WHERE NOT (
    (n >= 3 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}')) OR (n >= 3 AND marks * 3 > n) OR (bars >= 2 AND bars * 3 >= n - bars)
    OR symbols * 10 > chars OR (regexp_matches(line, '{BOILERPLATE}') AND (length(line) - length(regexp_replace(line, '{BOILERPLATE}', '', 'g'))) * {BOILERPLATE_PART} >= length(line))) GROUP BY row_id),
measures AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(under.n, 0)::BIGINT AS n_repeat_words, coalesce(stay.chars, 0) AS left_chars, coalesce(stay.n, 0) AS left_words
  FROM parts LEFT JOIN under USING (row_id) LEFT JOIN stay USING (row_id)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, (word_chars - left_chars)::BIGINT AS lost_chars FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
  NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AND left_words >= {MIN_WORDS} AS kept FROM failed
"""
