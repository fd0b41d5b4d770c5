"""How quality filters work on each other: what each one removes in every order that they can be applied in.

Word filters are a relational pipeline. Equal texts are reduced to one row with the smallest id before the shuffle, words
are exploded from there, counted by (document, word), and these rows by document for totals and distinct
words. Both groupings lie within the partitioning by text, so that words are never shuffled. The counts are joined
outer with the other flags of every document and with its labels. Each part of the table is then one row of conditional counts, one for each
combination of failed filters (32 for five); all orders, steps and Shapley sums follow from these.

Defined results. A null text counts as empty. A text without words has 0 of 0 distinct words and passes B and C. A null id has no smaller one, and is
no smaller one. Repeated rows count each. Of several labels of one id the highest counts; a document without labels is neither good
nor toxic. Null sources are the part ''. Without documents there are no parts, hence no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch

#: The filters, their letters in the order of the bits of a combination.
NAMES = "ABCDE"
WORD, SIGNS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"


def _text_id(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def word_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different text: text_id (its SHA-256), first_id (the smallest id that has it), n_words, n_distinct."""
    rows = docs.select(F.col(id_col).alias("first_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_id", _text_id(F.col("text")))
    texts = rows.groupBy("text_id").agg(F.min("first_id").alias("first_id"), F.first("text").alias("text"))
    words = texts.select("text_id", "first_id", F.explode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    by_word = words.groupBy("text_id", "first_id", "word").agg(F.count("word").alias("n"))
    return by_word.groupBy("text_id", "first_id").agg(F.sum("n").alias("n_words"), F.count("word").alias("n_distinct"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and one boolean for each of NAMES: whether the document fails that filter.

    A: under 50 words; B: under 65 % distinct words; C: over 5 % capital letters A-Z; D: holds a sign of SIGNS; E: a smaller id has the same text.
    """
    totals, _ = scratch.written(word_totals(docs, id_col, text_col), "word-totals")
    text = F.coalesce(F.col(text_col), F.lit(""))
    flags = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        _text_id(text).alias("text_id"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text)).alias("C"),
        text.rlike(SIGNS).alias("D"),
    )
    words, distinct = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_words", "n_distinct"))
    return flags.join(totals, "text_id", "left").select(
        "doc_id",
        "part",
        (words < 50).alias("A"),
        (100 * distinct < 65 * words).alias("B"),
        "C",
        "D",
        F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("E"),
    )


def _labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed with good and toxic."""
    each = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return failed.join(each, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def interactions(failed: DataFrame, labels: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    failed has doc_id, part and a boolean column for each letter of names, which are six at most.
    """
    n = len(names)
    combination = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate(names)), F.lit(0))
    rows = _labelled(failed, labels).select("part", "good", "toxic", combination.alias("c"))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = rows.groupBy("part").agg(*[F.count_if((F.col("c") == c) & on).alias(f"{kind}_{c}") for kind, on in kinds.items() for c in range(1 << n)])
    parts = counts.select("part", *[F.array(*[f"{kind}_{c}" for c in range(1 << n)]).alias(kind) for kind in kinds])
    orders = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])))
    steps = orders.withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(n)])))
    bits = lambda text: sum((F.when(F.instr(text, c) > 0, 1 << k).otherwise(0) for k, c in enumerate(names)), F.lit(0))
    own = steps.withColumns({"own": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})

    def total(kind: str, counted: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda c: F.lit(1)) -> Column:
        """The sum over the combinations that are counted."""
        add = lambda at, c: at + F.when(counted(c), F.get(kind, c) * weight(c)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), add)

    fails = lambda c: c.bitwiseAND(F.col("own")) != 0
    earlier = lambda c: c.bitwiseAND(F.col("before")) != 0
    removed = lambda c: fails(c) & ~earlier(c)
    # Of the orders of all filters, a filter comes first of the k that a document fails in one of k.
    share = lambda c: (F.lit(factorial(n)) / F.bit_count(c)).cast("long")
    return own.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("all", lambda c: ~fails(c) & ~earlier(c)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda c: fails(c) & earlier(c)).alias("redundant"),
        F.get("all", F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", fails, share).alias("shapley"),
    )
