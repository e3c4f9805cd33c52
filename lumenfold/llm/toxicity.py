"""Toxicity by noisy-channel deobfuscation: words written with look-alike signs, spacing or repetition are decoded by
Viterbi search over a character lattice under a character language model; the restored words are then scored.

1. Language model: counts of character trigrams in all words of all documents. Those that make up less than MIN_GRAM of
   all trigrams count as unseen, whatever script they are in; that also bounds the model, at 1 / MIN_GRAM entries.
2. Channel: a token that mixes letters with signs or digits, repeats a letter three times, or is spelled out with
   separators becomes a lattice: each sign stands for itself or a letter it imitates, runs of a letter for one or two of
   it, separators for nothing. Each departure from the plain reading costs something; Viterbi finds the likeliest word.
   A spelled-out run is read as one word and, its gaps being word ends as well, as several; tokens and runs of any
   length are read whole. When scoring, only tokens that some sign can lie behind are decoded (`skeleton`).
3. Scorer: naive Bayes over the words that labels show to be signs of toxicity. Labels are learned from at most
   MAX_LABELLED rows (the smallest hashes of their doc_ids) whose crc32 of the doc_id leaves a remainder other than 1;
   a word counts from MIN_DOCS toxic documents on and when it is at least exp(MIN_EVIDENCE) times likelier in them.

doc_id, lang, source and labels are never inputs of a score. Nulls: a null text is an empty one and gets the score of a
text without signs; a null doc_id is not held out. Without labels every score is 0. Empty tables give empty results; each
repeated row gets its row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import exp, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import written

MAX_LABELLED = 30_000
MIN_DOCS = 4  # and MIN_SHARE of the toxic rows
MIN_SHARE = 0.01
STEMS = (4, 5, 6)
MIN_EVIDENCE = 3.0
MAX_EVIDENCE = 6.0
THRESHOLD = 0.7
MIN_GRAM = 1e-6
WORDS = 1_000_000  # distinct words of a task whose trigrams are counted at once
CACHE = 500_000  # tokens that are remembered; it changes speed alone
#: Letters that a sign or digit imitates (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_*~,·"
EDGES = ".,;:!?\"'()[]{}<>|*#%&$-_~…"
LETTERS = re.compile(r"[^\W\d_]")
REPEAT = re.compile(r"([^\W\d_])\1\1")
SPELLED = re.compile(r"(?<!\S)(?:[^\W_][\x20.*_~-]{1,3}){2,}[^\W_](?![^\s.,;:!?])")
SIGNS = re.compile(r"[\d@$!|+(€£*#.\-_~·]")
MIXERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
NO_SIGN = -1.5  # log odds that a text without any sign loses against the share of toxic rows
CHANNEL = -2.0  # log weight of reading a sign as a letter
GAP = -1.0  # of reading a single separator as a word end, or a wider gap as none
MERGE = -0.5  # of reading a run as fewer letters


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Character trigrams with add-one smoothing; words are framed by two blanks and one."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.three = counts
        self.chars = len({c for t in counts for c in t}) + 1
        self.two: Counter[str] = Counter()
        for t, n in counts.items():
            self.two[t[:2]] += n

    def step(self, two: str, c: str) -> float:
        return log((self.three.get(two + c, 0) + 1) / (self.two.get(two, 0) + self.chars))

    def decode(self, token: str, breaks: bool = False) -> str:
        """The likeliest word behind a token, or words with `breaks`; its letters stand for themselves."""
        runs: list[tuple[str, int]] = []
        for c in token:
            if runs and runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + 1)
            else:
                runs.append((c, 1))
        best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}  # what was read is a chain from the end
        for c, n in runs:
            arcs: list[tuple[str, float]] = []
            if LETTERS.fullmatch(c):
                arcs += [(c, 0.0 if n == 1 else MERGE)]
                if n > 1:
                    arcs.append((c * 2, 0.0 if n == 2 else MERGE))
            else:
                arcs += [(x * m, CHANNEL if m == min(n, 2) else CHANNEL + 4 * MERGE) for x in LOOKS.get(c, "") for m in ((1,) if n == 1 else (1, 2))]
                if c in SEPARATORS or c == " ":
                    arcs.append(("", GAP if breaks and n > 1 else 0.0))
                    if breaks:
                        arcs.append((" ", 0.0 if n > 1 else GAP))
                elif not arcs:
                    arcs.append(("", CHANNEL))
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (score, out) in best.items():
                for text, cost in arcs:
                    s, v = state, score + cost
                    if text == " ":
                        v += self.step(s, " ") if s != "  " else 0.0
                        s = "  "
                    else:
                        for x in text:
                            v += self.step(s, x)
                            s = s[1] + x
                    if s not in new or new[s][0] < v:
                        new[s] = (v, (out, text) if text else out)
            best = new
        _, out = max(((v + self.step(s, " "), out) for s, (v, out) in best.items()), key=lambda x: x[0])
        parts = []
        while out is not None:
            out, text = out
            parts.append(text)
        return "".join(reversed(parts))


def suspicious(token: str) -> bool:
    return bool(REPEAT.search(token) or (LETTERS.search(token) and SIGNS.search(token)))


def features(word: str) -> list[str]:
    """A word and its beginnings, by which inflected and compounded forms of a stem are known."""
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) > n)]


#: What can stand for one another, under one of them; signs that can be any vowel, and separators, which may be nothing.
CLASSES = str.maketrans({"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "£": "i", "2": "z", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "6": "b", "g": "b", "8": "b", "9": "b", "7": "t", "+": "t", "(": "c"} | dict.fromkeys(SEPARATORS + " ", ""))
RUN = re.compile(r"(.)\1+", re.DOTALL)


def skeleton(token: str) -> str:
    """What all readings of a token without `*` and `#` share: letters and the signs for them in classes, runs as one."""
    return RUN.sub(r"\1", token.translate(CLASSES))


class Restorer:
    """What `pick` makes of each word of a text and of the words behind its obfuscated tokens; results for tokens are
    remembered, up to CACHE of them. `inside` are words that are also sought anywhere in a spelled-out run. With `signs`,
    only tokens whose skeleton begins like one of theirs are decoded; others can't be read as a word that matters."""

    def __init__(self, model: Model, pick: Callable[[str], Iterable[str]] = features, inside: Iterable[str] = (), signs: Iterable[str] | None = None) -> None:
        self.model, self.pick, self.inside, self.known, self.nothing = model, pick, tuple(inside), {}, set()
        # A word of letters alone can be a sign only if it begins like one.
        self.begins = None if signs is None else frozenset(w.lstrip("^")[: STEMS[0]] for w in signs)
        # Readings of `*` and `#` are any vowel, and other marks may be left out: such tokens are always decoded.
        self.open = re.compile("[" + re.escape("".join(c for c, x in LOOKS.items() if x == "aeiou")) + r"]|[^\w" + re.escape("".join(LOOKS) + SEPARATORS) + r"]|_(?!\Z)")
        heads = None if signs is None else {skeleton(w.lstrip("^")) for w in signs}
        self.heads = None if heads is None else tuple(sorted(heads))

    def may_matter(self, token: str) -> bool:
        return self.heads is None or bool(self.open.search(token)) or skeleton(token).startswith(self.heads)

    def forms(self, token: str) -> set[str]:
        if self.begins is not None and token[: STEMS[0]] not in self.begins and token.isalpha() and not REPEAT.search(token):
            return set()
        inner = token.strip(EDGES)
        found = {inner}
        if suspicious(inner) and self.may_matter(inner):
            found.add(self.model.decode(inner))
        if token[0] in LOOKS or token[-1] in LOOKS:  # signs at the edge may be letters, too
            edge = token.strip(".,;:?\"')[]{}<>%&…")
            if suspicious(edge) and self.may_matter(edge):
                found.add(self.model.decode(edge))
        return found - {""}

    def __call__(self, text: str | None) -> set[str]:
        low, known, found = (text or "").lower(), self.known, set()
        tokens = set(low.split())
        for t in tokens.difference(self.nothing):  # most words are known to be nothing
            got = known.get(t)
            if got is None:
                got = tuple({x for w in self.forms(t) for x in self.pick(w)})
                if len(known) + len(self.nothing) > CACHE:
                    known.clear()
                    self.nothing.clear()
                if got:
                    known[t] = got
                else:
                    self.nothing.add(t)
            found.update(got)
        # A run holds three letters with nothing but separators beside them.
        for m in SPELLED.finditer(low) if spaced(low) else ():
            whole = self.model.decode(m[0])
            for w in {whole, *self.model.decode(m[0], breaks=True).split()}:
                found.update(self.pick(w))
            found.update(w for w in self.inside if w in whole)
        return found


def spaced(text: str) -> bool:
    """Whether three letters or digits in a row may stand apart by one to three other characters: false only where
    SPELLED finds nothing, and far cheaper."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < 5:
        return False
    letters = (codes >= 128) | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    alone = letters.copy()
    alone[1:] &= ~letters[:-1] | (codes[:-1] >= 128)
    alone[:-1] &= ~letters[1:] | (codes[1:] >= 128)
    at = np.flatnonzero(alone)
    near = np.diff(at) <= 4
    return bool((near[1:] & near[:-1]).any())


def trigram_counts(docs: DataFrame) -> dict[str, int]:
    """Counts of trigrams over all documents, those that make up MIN_GRAM of all or more."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def grams() -> pd.DataFrame:
            found: Counter[str] = Counter()
            for w, n in seen.items():
                w = w.strip(EDGES)
                if w.isalpha():
                    framed = f"  {w} "
                    for gram in map("".join, zip(framed, framed[1:], framed[2:], strict=False)):
                        found[gram] += n
            seen.clear()
            return pd.DataFrame({"gram": list(found), "n": list(found.values())}).astype({"gram": "object", "n": "int64"})

        for b in batches:
            for t in b["text"]:
                seen.update((t or "").lower().split())
                if len(seen) > WORDS:
                    yield grams()
        yield grams()

    counts = docs.select("text").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, docs.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["gram"]: r["n"] for r in counts.filter(F.col("n") >= MIN_GRAM * total).collect()}


def signature(text: str | None) -> list[int]:
    """Four min-hashes of a text's three-word shingles; near copies share one almost surely."""
    tokens = (text or "").lower().split()
    shingles = {" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))}
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in shingles], dtype=np.uint64)
    return [int((hashes * np.uint64(m) ^ (hashes >> np.uint64(29))).min() >> np.uint64(1)) for m in MIXERS]


def without_copies(sample: DataFrame) -> DataFrame:
    """The sampled rows (id, toxic, text) without near copies of others: a copied document would make signs of all its
    words. The sample is bounded, so its signatures are compared on the driver."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "toxic": b["toxic"], "signs": [signature(t) for t in b["text"]]})

    seen: set[tuple[int, int]] = set()
    kept = []
    for r in sorted(sample.mapInPandas(sign, "id long, toxic int, signs array<long>").collect()):
        own = set(enumerate(r["signs"]))
        if not own & seen:
            kept.append((r["id"], r["toxic"]))
        seen |= own
    # At most MAX_LABELLED ids of 8 bytes: small enough for every executor.
    kept = sample.sparkSession.createDataFrame(kept, "id long, toxic int")
    return sample.join(F.broadcast(kept), ["id", "toxic"], "left_semi").dropDuplicates(["id", "toxic"])


def evidence(docs: DataFrame, labels: DataFrame, model: Model) -> tuple[float, dict[str, float]]:
    """The log odds of toxicity without any sign, and each sign's weight."""
    spark = docs.sparkSession
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id", "toxic").limit(MAX_LABELLED)
    met = docs.join(F.broadcast(drawn), docs["doc_id"].cast("long") == drawn["id"]).select("id", "toxic", "text")
    sample = written(without_copies(written(met, spark)), spark)  # the texts are read once, from then on the sample
    pos, neg = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    if not pos:
        return -1e9, {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(model)
        for b in batches:
            seen = (Counter(), Counter())
            for t, label in zip(b["text"], b["toxic"], strict=True):
                seen[int(label == 1)].update(restore(t))
            every = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": every, "p": [seen[1][w] for w in every], "n": [seen[0][w] for w in every]}).astype({"word": "object", "p": "int64", "n": "int64"})

    words = sample.select("text", "toxic").mapInPandas(count, "word string, p long, n long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    signs = words.filter((F.col("p") >= MIN_DOCS) & (F.col("p") >= MIN_SHARE * pos)).withColumn("w", weight).filter(F.col("w") >= MIN_EVIDENCE).select("word", "w").collect()
    # Toxic texts have signs more often than not, so a text without one is less likely toxic than the share of them.
    return log(pos / max(neg, 1)) + NO_SIGN, {r["word"]: min(r["w"], MAX_EVIDENCE) for r in signs}


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    counts = trigram_counts(docs)
    prior, signs = evidence(docs, labels, Model(counts))
    carried = docs.sparkSession.sparkContext.broadcast(counts)  # at most 1 / MIN_GRAM counts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def best(word: str) -> list[str]:
            """The strongest sign that a word is, so that a word and its beginnings don't count twice."""
            return sorted((x for x in features(word) if x in signs), key=lambda x: (-signs[x], x))[:1]

        restore = Restorer(Model(carried.value), best, [w for w in signs if w[0] != "^" and len(w) >= STEMS[0]], signs)
        for b in batches:
            odds = [prior + sum(sorted(signs[x] for x in restore(t))) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [1 / (1 + exp(-max(min(o, 60.0), -700.0))) for o in odds]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    thin = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    out = thin.mapInPandas(run, "doc_id string, held_out boolean, score double")  # a null among longs would make doubles of them
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
