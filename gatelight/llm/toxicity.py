"""Toxicity by a weighted lexicon that is learned from labelled rows and matched by Aho-Corasick.

Texts are folded first: compatibility forms, case, accents, look-alike letters of other scripts, and digits
or signs that stand in for letters before or after a letter (numbers and amounts without a letter stay, and so do exclamation
marks and bars at a word's end, which are punctuation). What is left is words between single spaces. The
lexicon holds word beginnings, and whole words of two letters or more, with their log-odds weights: strong ones, which hardly any
clean row has, and weak ones, which up to half as many clean rows as toxic ones have. An exception phrase cancels the hits that it
covers; phrases of two words that make a word of toxic rows harmless are learned from the clean rows that have them. The sums of a
text's strong and weak weights are divided by the square root of its length and turned into a score by a logistic
curve of both, fitted to the same labelled rows.

fit() reads at most about max_labelled labelled rows, chosen by a hash of their id; a documented bound, so
that what the driver receives (the pruned lexicon and about max_labelled numbers) doesn't
grow with the corpus. Nothing is cut by rank: candidates are pruned in Spark, by the beginnings that they share. Scoring reads every row whole.

Defined results. A null or empty text has no words and gets the score of a text without hits. Labels
that are null, and labels of absent documents, are not used; of several labels of one id the largest counts, of several texts
the smallest. With labels of one kind only, or
none that words explain, the lexicon is empty and every score is the share of toxic ones among all labelled rows (in the second case
drawn a little to the clean side), or 0 without labels. Repeated rows each give a
row; extra columns are passed over by score() and passed through by drop_toxic().
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch
from gatelight.llm.text import release

# Letters of other scripts that look like Latin ones, after case folding.
LOOKALIKES = {
    "а": "a", "в": "b", "г": "r", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "с": "c", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ѐ": "e",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ƅ": "b", "ꞵ": "b", "օ": "o", "ս": "u", "ո": "n", "հ": "h",
}
# Signs that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Clean rows for each toxic one that a strong and a weak pattern may have; clean rows that an exception phrase must have.
STRONG, WEAK, LEAST_CLEAN = 0.05, 0.5, 5
#: How likely any exception phrase may be learned by chance.
PHRASE_CHANCE = 0.01
_LETTERS = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(STAND_INS)
# Runs before a letter, and runs after one without the signs of punctuation at their end.
_DISGUISED = re.compile(r"(?<![013457@$!|])[013457@$!|]++(?=[a-z])|(?<=[a-z])[013457@$!|]*[013457@$]")
_MARKS = re.compile("[̀-ͯ]+")
_BETWEEN = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The text's words in folded form, one space around each; one space if there are none."""
    if not text:
        return " "
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_LETTERS)
    else:
        text = text.lower()
    text = _DISGUISED.sub(lambda m: m[0].translate(_SIGNS), text)
    return f" {_BETWEEN.sub(' ', text).strip()} " if text else " "


def patterns_of(folded: str, shortest: int, longest: int) -> set[str]:
    """Beginnings of the words, a space in front, and whole words, a space on both sides."""
    found = set()
    for word in set(folded.split()):
        if len(word) >= shortest:
            found.update(f" {word[:n]}" for n in range(shortest, min(len(word), longest) + 1))
        if len(word) >= 2:
            found.add(f" {word} ")
    return found


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -30.0
    weak: dict[str, float] = field(default_factory=dict)
    weak_slope: float = 0.0

    def automaton(self):
        own = ahocorasick.Automaton()
        for strong, weights in ((True, self.weights), (False, self.weak)):
            for pattern, weight in weights.items():
                own.add_word(pattern, (len(pattern), strong, weight))
        for phrase in self.exceptions:
            own.add_word(f" {phrase} ", (len(phrase) + 2, None, 0.0))
        own.make_automaton()
        return own

    def strengths(self, folded: str, automaton) -> tuple[float, float]:
        """Sums of the strong and the weak weights of the words hit, over the square root of the number of words."""
        if not self.weights and not self.weak:
            return 0.0, 0.0
        hits, free = ({}, {}), []
        for end, (size, strong, weight) in automaton.iter(folded):
            start = end - size + 1
            if strong is None:
                free.append((start, end))
            else:
                own = hits[not strong]
                own[start] = max(weight, own.get(start, 0.0))
        scale = math.sqrt(folded.count(" "))
        return tuple(sum(w for at, w in own.items() if not any(a <= at < b for a, b in free)) / scale for own in hits)

    def strength(self, folded: str, automaton) -> float:
        return self.strengths(folded, automaton)[0]

    def score(self, strong: float, weak: float = 0.0) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * math.log1p(strong) + self.weak_slope * math.log1p(weak)))))

    def scores(self, texts: list, automaton) -> list[float]:
        return [self.score(*self.strengths(fold(t), automaton)) for t in texts]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~F.coalesce(held_out(F.col("id")), F.lit(True)))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, 0.95 * max_labelled / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def folded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(fold, batch.column(0).to_pylist()), pa.string()), batch.column(1)], names=["folded", "toxic"])

    # One text for each id keeps the bound. Copies say nothing new: rows with the same folded words count once for each label.
    texts = rows.join(marks, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    return texts.mapInArrow(folded, "folded string, toxic int").groupBy("folded", "toxic").agg(F.count(F.lit(1)).alias("copies"))


class Evidence:
    """What the rows with a pattern say, by how many toxic and clean ones there are."""

    def __init__(self, n_toxic: int, n_clean: int, min_surprise: float):
        self.n_toxic, self.n_clean, self.min_surprise = n_toxic, n_clean, min_surprise
        self.base = math.log10((n_toxic + n_clean) / n_toxic)

    def surprise(self, toxic: int, clean: int) -> float:
        """How unlikely it is that so many of the rows are toxic by chance, in powers of ten."""
        return toxic * self.base - math.log10(math.comb(toxic + clean, clean))

    def weight(self, toxic: int, clean: int) -> float:
        return math.log((toxic + 0.5) / (self.n_toxic + 1)) - math.log((clean + 0.5) / (self.n_clean + 1))


def _prune(found: list[tuple[str, int, int]], evidence: Evidence) -> tuple[dict[str, float], dict[str, float]]:
    """The strong and the weak patterns that speak for toxicity, with their weights: of strong ones that hold each other the
    shortest that is sure, made as long as nearly all of its rows allow, of weak ones the least likely by chance."""
    likely = [x for x in found if evidence.surprise(*x[1:]) >= evidence.min_surprise]
    sure = {pattern: (toxic, clean) for pattern, toxic, clean in likely if clean <= STRONG * toxic}
    counts = {pattern: toxic for pattern, toxic, clean in found if clean <= STRONG * toxic}
    strong: dict[str, float] = {}
    for pattern in sorted(sure, key=lambda p: (len(p), p)):
        if not any(pattern[:n] in strong for n in range(2, len(pattern))):
            strong[pattern] = evidence.weight(*sure[pattern])
    longer = {p: max((q for q in counts if q.startswith(p) and (q == p or q[-1] != " ") and counts[q] >= 0.9 * counts[p]), key=len) for p in strong}
    weak: dict[str, float] = {}
    for pattern, toxic, clean in sorted(likely, key=lambda x: (-evidence.surprise(*x[1:]), x[0])):
        if pattern not in sure and clean <= WEAK * toxic and not any(pattern.startswith(q) or q.startswith(pattern) for q in (*strong, *weak)):
            weak[pattern] = evidence.weight(toxic, clean)
    return {longer[p]: weight for p, weight in strong.items()}, {p: w for p, w in weak.items() if w > 1}


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Offset and slopes by Newton steps, with a little shrinkage so that separable rows have an end."""
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(design.shape[1])
    beta[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return beta.tolist()


def _counted(rows: DataFrame, found_in) -> DataFrame:
    """pattern, clean, toxic: how many rows of each label have each of the patterns that found_in(folded) gives."""

    def counted(batches):
        seen = (Counter(), Counter())

        def rows_of():
            names = list(seen[0] | seen[1])
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)], names=["pattern", "clean", "toxic"]
            )

        for batch in batches:
            for folded, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(found_in(folded))
            if len(seen[0]) + len(seen[1]) > 250_000:
                yield rows_of()
                seen[0].clear(), seen[1].clear()
                release()
        yield rows_of()
        seen[0].clear(), seen[1].clear()
        release()

    found = rows.select("folded", "toxic").mapInArrow(counted, "pattern string, clean long, toxic long")
    return found.groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def without(phrases: tuple[str, ...]):
    """A function that takes the phrases out of folded texts."""
    if not phrases:
        return lambda folded: folded
    out = re.compile("(?<= )(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + ") ")
    return lambda folded: out.sub("", folded)


def _by_chance(toxic: int, clean: int, phrase_toxic: int, phrase_clean: int) -> float:
    """The chance that of a word's rows, toxic and clean, so many as have a phrase have so few toxic ones among them or fewer, in powers of ten."""
    size = phrase_toxic + phrase_clean
    ways = sum(math.comb(toxic, k) * math.comb(clean, size - k) for k in range(phrase_toxic + 1) if size - k <= clean)
    return math.log10(ways) - math.log10(math.comb(toxic + clean, size)) if ways else 0.0


def _exceptions(rows: DataFrame, counts: DataFrame, evidence: Evidence) -> tuple[str, ...]:
    """Phrases of two words, in LEAST_CLEAN clean rows at least and hardly any toxic one, though one of their words speaks for
    toxic rows, more so where it stands without them. That the phrase's rows are so clean by chance must be unlikely, below PHRASE_CHANCE for all phrases tried together."""
    base = evidence.base
    some = counts.filter(F.col("pattern").rlike("^ .* $") & (F.col("toxic") * base >= evidence.min_surprise) & (F.col("clean") > STRONG * F.col("toxic")) & (F.col("clean") >= LEAST_CLEAN))
    some = some.filter(F.col("toxic") * evidence.n_clean > 2 * F.col("clean") * evidence.n_toxic)
    suspects = {r.pattern.strip(): (r.toxic, r.clean) for r in some.collect()}
    if not suspects:
        return ()

    def phrases(folded: str) -> set[str]:
        words = folded.split()
        return {f"{a} {b}" for a, b in zip(words, words[1:]) if a in suspects or b in suspects}

    tried = _counted(rows, phrases).filter(F.col("clean") >= LEAST_CLEAN).collect()
    limit = math.log10(PHRASE_CHANCE / max(1, len(tried)))

    def helps(r) -> bool:
        own = [suspects[w] for w in r.pattern.split() if w in suspects]
        own = [(t, c) for t, c in own if t >= r.toxic and c >= r.clean]
        return any(evidence.surprise(t - r.toxic, c - r.clean) > evidence.surprise(t, c) and _by_chance(t, c, r.toxic, r.clean) < limit for t, c in own)

    return tuple(sorted(r.pattern for r in tried if r.toxic <= STRONG * r.clean and helps(r)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    shortest: int = 4,
    longest: int = 9,
    min_surprise: float = 6.0,
    exceptions: tuple[str, ...] | None = None,
) -> Lexicon:
    """Learn from labels (doc_id, toxic) of rows that are not held out. exceptions: phrases to use in place of those learned."""
    scratch.bounded_batches(docs.sparkSession)
    rows, path = scratch.written(_labelled(docs, labels, max_labelled), "toxicity-rows")
    sizes = {r.toxic: (r.n, r.copies) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).collect()}
    (n_toxic, all_toxic), (n_clean, all_clean) = sizes.get(1, (0, 0)), sizes.get(0, (0, 0))
    if not n_toxic or not n_clean:
        scratch.drop(docs.sparkSession, path)
        share = (n_toxic + 1e-9) / (n_toxic + n_clean + 1e-6)
        return Lexicon(offset=math.log(share / (1 - share)) if n_toxic + n_clean else -30.0)
    evidence = Evidence(n_toxic, n_clean, min_surprise)
    counts, counts_path = scratch.written(_counted(rows, lambda folded: patterns_of(folded, shortest, longest)), "toxicity-counts")
    used = [path, counts_path]
    if exceptions is None:
        exceptions = _exceptions(rows, counts, evidence)
    if exceptions:
        bare = without(tuple(exceptions))
        counts, counts_path = scratch.written(_counted(rows, lambda folded: patterns_of(bare(folded), shortest, longest)), "toxicity-counts")
        used.append(counts_path)
    likely = counts.filter((F.col("toxic") * evidence.base >= min_surprise) & (F.col("clean") <= WEAK * F.col("toxic")))

    def pruned(table):
        both = _prune(list(zip(*(table.column(x).to_pylist() for x in ("pattern", "toxic", "clean")))), evidence)
        kept = [(p, w, strong) for strong, own in zip((True, False), both) for p, w in own.items()]
        columns = list(zip(*kept)) if kept else [()] * 3
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("pattern", "weight", "strong"), columns, (pa.string(), pa.float64(), pa.bool_()))})

    # Patterns that hold each other begin alike, up to the shortest beginning at least.
    nested = likely.withColumn("stem", F.substring("pattern", 1, shortest + 1)).groupBy("stem").applyInArrow(pruned, "pattern string, weight double, strong boolean")
    kept = sorted(tuple(r) for r in nested.collect())
    model = Lexicon({p: w for p, w, strong in kept if strong}, tuple(exceptions), weak={p: w for p, w, strong in kept if not strong})
    if not kept:
        scratch.drop(docs.sparkSession, *used)
        share = (all_toxic + 0.5) / (all_toxic + all_clean + 2)
        return Lexicon(offset=math.log(share / (1 - share)))

    def measured(batches):
        automaton = model.automaton()
        for batch in batches:
            x = [model.strengths(folded, automaton) for folded in batch.column(0).to_pylist()]
            strong, weak = zip(*x) if x else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(strong, pa.float64()), pa.array(weak, pa.float64()), batch.column(1)], names=["strong", "weak", "toxic"])

    pairs = sorted(tuple(r) for r in rows.select("folded", "toxic").mapInArrow(measured, "strong double, weak double, toxic int").collect())
    scratch.drop(docs.sparkSession, *used)
    table = np.array(pairs, "f8")
    model.offset, model.slope, model.weak_slope = _logistic(np.log1p(table[:, :2]), table[:, 2])
    return model


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scratch.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scored(batches):
        automaton = model.automaton()
        for batch in batches:
            found = model.scores(batch.column(1).to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    found = rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents whose score is under 0.5, with all their columns."""
    scratch.bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(batches):
        automaton = model.automaton()
        for batch in batches:
            stays = [x < 0.5 for x in model.scores(batch.column(at).to_pylist(), automaton)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
