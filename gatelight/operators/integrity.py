"""Digests of texts and files, checks against a manifest, and the syntax of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions import variants as V


def newline_digest(content: Column) -> Column:
    """SHA-256 of bytes; of valid UTF-8 with every kind of line end as \\n."""
    text = content.cast("string")
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.is_valid_utf8(text), F.sha2(unix.cast("binary"), 256)).otherwise(F.sha2(content, 256))


def checksum_lines(lines: DataFrame) -> DataFrame:
    """digest and path of the lines of a checksum manifest (column value), without blank lines and comments."""
    kept = lines.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    parts = F.split("value", "  ", 2)
    return kept.select(F.get(parts, F.lit(0)).alias("digest"), F.get(parts, F.lit(1)).alias("path"))


def mismatches(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of expected (digest, path) without an equal digest in observed (path, digest): path, expected, found."""
    seen = observed.select("path", F.col("digest").alias("found"))
    return expected.join(seen, "path", "left").filter(~F.col("digest").eqNullSafe(F.col("found"))).select("path", F.col("digest").alias("expected"), "found")


def path_error(path: Column) -> Column:
    """Why a path isn't a normal relative one, or null. Links that leave the folder are for whoever lists the files."""
    odd = path.rlike("^/") | F.contains(path, F.lit(":")) | F.exists(F.split(path, "/"), lambda x: x.isin(".", ".."))
    empty = path.isNull() | ~path.rlike(r"(?U)\S")
    return F.when(empty, "path_missing_or_invalid").when(F.contains(path, F.lit("\\")), "path_not_posix").when(odd, "path_not_normalized_relative")


def pinned(records: DataFrame, manifests: DataFrame, field: str = "evidence_manifest_sha256") -> DataFrame:
    """records (record_key, record, manifest_key) with the digest of their manifest in a field, the keys of each object in order.

    A record without a manifest, or that is no object, stays as it is.
    """
    rows = records.join(manifests.select("manifest_key", "digest"), "manifest_key", "left")
    parsed = F.try_parse_json("record")
    own = F.map_filter(V.members(parsed), lambda name, _: name != field)
    made = F.map_concat(own, F.create_map(F.lit(field), F.try_parse_json(F.concat(F.lit('"'), F.col("digest"), F.lit('"')))))
    text = F.to_json(F.to_variant_object(made))
    fits = (V.kind(parsed) == "object") & F.col("digest").isNotNull()
    return rows.select("record_key", F.when(fits, text).otherwise(F.col("record")).alias("record"), "manifest_key")
