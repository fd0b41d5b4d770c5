"""Exact duplicates of documents, with DataFrame expressions only.

Rows group by a 128-bit hash of the normalised text together with that text itself, so the hash does
the work and the bytes decide: two texts that share a hash but differ in a byte stay apart. Spark
combines copies on the map side, so a group that holds a third of all rows leaves each map task as one
row. The way back from groups to rows is an equi-join on fixed-width digests, which adaptive execution
splits where one digest is hot; no list of a group's rows is ever built.

Defined results. A null text counts as empty, and empty texts are equal to each other. A null id never
stays in front of another id: keep_id is the smallest id that is not null, null only if the group has no
other, and then its rows count as kept. Repeated rows (same id, same text) are each returned, alike.
Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch

#: One space stands for each run of these characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _digest(hexadecimal: Column) -> Column:
    """Bytes of a digest, never null: otherwise each join on it would compute it once more to look for nulls."""
    return F.coalesce(F.unhex(hexadecimal), F.lit(b""))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h128, sha, keep_id, group_size of each different text."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("h128", _digest(F.md5("norm")))
    groups = hashed.groupBy("h128", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("h128", _digest(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(F.md5(norm)).alias("h128"), _digest(F.sha2(norm, 256)).alias("sha"))
    return rows.join(_groups(docs, id_col, text_col), ["h128", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows with the same id and equal texts are one document that was read twice: one of them stays.
    """
    sha, own = (scratch.unused(name, docs) for name in ("own_sha", "own_id"))
    text_id = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    kept = _groups(docs, id_col, text_col).select(text_id(F.col("keep_id")).alias(own), F.col("sha").alias(sha))
    marked = docs.withColumns({sha: _digest(F.sha2(normalised(F.col(text_col)), 256)), own: text_id(F.col(id_col))})
    # Rows are dealt by id and digest for the join, and stay so for the last step.
    return marked.join(kept, [own, sha], "left_semi").dropDuplicates([own, sha]).select(*docs.columns)
