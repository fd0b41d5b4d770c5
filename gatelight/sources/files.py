"""Sources and sinks: record and manifest files, digests of files around them, checksum manifests, CSV tables and reports.

Record and manifest files are read by Spark's binaryFile source, one file in each row: they are small. Digests of files are made in pieces (`gatelight.sources.chunked`), so
that evidence may have any size.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gatelight.functions.registry_values import Registry
from gatelight.operators import integrity
from gatelight.sources import chunked

#: Columns of a request-outcome table; times are nanoseconds since the epoch and stay integers.
REQUEST_SCHEMA = (
    "block int, completion_tokens int, dispatch_first string, finish_reason string, format string, phase int, physical_gpu int, prompt_tokens int,"
    " request_end_ns bigint, request_index int, request_start_ns bigint, session_end_ns bigint, session_start_ns bigint, total_tokens int"
)
#: Columns of the two tables of contrasts.
MATRIX_SCHEMA = (
    "comparison string, cell string, workload string, concurrency int, n_paired_repeats int, mean_percent_change double, min_percent_change double,"
    " max_percent_change double, repeat_1_percent_change double, repeat_2_percent_change double, repeat_3_percent_change double"
)
CONFIRMATION_SCHEMA = (
    "target string, workload string, concurrency int, n_blocks int, mean_reduction_percent double, p05_reduction_percent double, p95_reduction_percent double,"
    " block_permutation_p_value double"
)


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content and length of the files below a folder, or of one file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content", "length")


def below(path: Column, folder: str) -> Column:
    """The part of a path that follows the folder."""
    mark = folder.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(path, mark, -1)


def digests(spark: SparkSession, folder: str, canonical: bool = False, whole: bool = False) -> DataFrame:
    """path relative to the folder and SHA-256 digest; of text with unified line ends if canonical.

    Files are read in pieces, so that any size will do. whole: by Spark's own source instead, for stores that only Spark reads; a file is then one row, and empty files are left out.
    """
    if not whole:
        return chunked.file_digests(spark, folder).select("path", F.col("canonical_sha256" if canonical else "sha256").alias("digest"))
    files = binary(spark, folder)
    digest = integrity.newline_digest(F.col("content")) if canonical else F.sha2("content", 256)
    return files.select(below(F.col("path"), folder).alias("path"), digest.alias("digest"))


def record_files(spark: SparkSession, path: str, manifest_key: Column | None = None) -> DataFrame:
    """record_key (the path), record (JSON text) and manifest_key (by default the folder) of record files."""
    key = manifest_key if manifest_key is not None else F.regexp_replace("path", "/[^/]*$", "")
    return binary(spark, path, "*.json").select(F.col("path").alias("record_key"), F.col("content").cast("string").alias("record"), key.alias("manifest_key"))


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """manifest_key (the folder), manifest (JSON text) and the digest of its bytes."""
    files = binary(spark, path, "*manifest*.json")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("manifest_key"), F.col("content").cast("string").alias("manifest"), F.sha2("content", 256).alias("digest"))


def escaping_links(folder: str) -> list[str]:
    """Relative paths below a local folder that lead out of it by a link; for listings on one machine."""
    root, found = os.path.realpath(folder), []
    for at, dirs, names in os.walk(folder):
        for name in [*dirs, *names]:
            full = os.path.join(at, name)
            if os.path.islink(full) and not os.path.realpath(full).startswith(root + os.sep):
                found.append(os.path.relpath(full, folder))
    return found


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return integrity.checksum_lines(spark.read.text(path))


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, written by as many tasks as the rows have partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a report: JSON lines, or one document over several lines."""
    lines = spark.read.text(path, wholetext=True)
    several = F.try_parse_json("value").isNotNull()
    texts = lines.select(F.explode(F.when(several, F.array("value")).otherwise(F.split("value", "\n"))).alias("value")).filter(F.trim("value") != "")
    return texts.select(F.from_json("value", schema).alias("x")).select("x.*")


def _document(spark: SparkSession, path: str):
    """A small JSON document; an error if it isn't there or isn't JSON."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one document")
    return json.loads(rows[0].value)


def registry(spark: SparkSession, path: str) -> Registry:
    """The registry in a JSON document with levels and required_reviewer_roles; an error if it breaks the contract."""
    found = _document(spark, path)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not an object")
    return Registry(found.get("levels"), found.get("required_reviewer_roles"))


def shape(spark: SparkSession, path: str) -> dict | None:
    """The formal shape of records in a JSON-Schema document; None if it can't be read."""
    try:
        found = _document(spark, path)
    except (AnalysisException, ValueError):
        return None
    return found if isinstance(found, dict) else None


def write_checksums(spark: SparkSession, folder: str, path: str) -> None:
    """A checksum manifest of the files below a folder, without itself, sorted by path: one range of paths in each of its parts."""
    own = below(F.lit(path), folder)
    files = digests(spark, folder, canonical=True).withColumn("own", own).filter((F.col("path") != F.col("own")) & ~F.startswith("path", F.concat("own", F.lit("/"))))
    files.orderBy("path").select(F.concat_ws("  ", "digest", "path").alias("value")).write.mode("overwrite").text(path)


def verify_checksums(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """path, expected and found of every file that is missing or differs, and of every line whose path leads out of the folder or isn't one."""
    lines = checksums(spark, manifest)
    bad = lines.filter(integrity.path_error(F.col("path")).isNotNull()).select("path", F.col("digest").alias("expected"), F.lit(None).cast("string").alias("found"))
    good = lines.filter(integrity.path_error(F.col("path")).isNull())
    return integrity.mismatches(good, digests(spark, folder, canonical=True)).unionByName(bad)


def require_checksums(spark: SparkSession, manifest: str, folder: str, shown: int = 20) -> None:
    """An error that names the first files that are missing or differ, by path, or that says that the manifest lists none."""
    if checksums(spark, manifest).isEmpty():
        raise ValueError(f"{manifest} lists no files")
    wrong = verify_checksums(spark, manifest, folder).orderBy("path").limit(shown).collect()
    if wrong:
        raise ValueError("files are missing or differ: " + ", ".join(f"{r.path} ({r.found or 'missing'})" for r in wrong))
