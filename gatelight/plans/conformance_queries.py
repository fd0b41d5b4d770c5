"""Queries on records, gates, evidence and reviewers, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelight.functions import registry_values as R
from gatelight.operators import conformance as C
from gatelight.operators import integrity as I
from gatelight.sources.tables import GATES_SQL, gate_rows, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


def _quoted(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


REGISTRY_SQL = f"registry(level, family, family_ord, gate, gate_ord) AS (VALUES {_quoted(R.gate_rows())})"
POLICY_SQL = f"policy(key, role) AS (VALUES {_quoted(R.ROLES.items())})"
STATE_SQL = f"""
states AS (
    SELECT record_id, CASE
        WHEN bool_or(family = 'validity' AND status <> 'pass') THEN '{R.STATES["not_assessable"]}'
        WHEN bool_or(family = 'substantive' AND status IN ('missing', 'invalid')) THEN '{R.STATES["not_assessable"]}'
        WHEN bool_or(family = 'substantive' AND status = 'fail') THEN '{R.STATES["failed"]}'
        WHEN bool_or(family = 'precision' AND status <> 'pass') THEN '{R.STATES["inconclusive"]}'
        ELSE '{R.STATES["complete"]}' END AS state
    FROM gates GROUP BY record_id
)"""


def _level(key):
    return F.concat(F.lit("L"), (key % 5).cast("string"))


@query(f"""WITH {REGISTRY_SQL}
SELECT o_orderkey AS record_id, level, family, gate, family_ord * 100 + gate_ord AS place
FROM orders JOIN registry ON level = 'L' || CAST(o_orderkey % 5 AS VARCHAR)""")
def q_required_gates(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), _level(F.col("o_orderkey")).alias("level"))
    return C.required_gates(records).select("record_id", "level", "family", "gate", (F.col("family_ord") * 100 + F.col("gate_ord")).alias("place"))


@query(f"""WITH {GATES_SQL}, slots(gate_ord) AS (VALUES (1), (2), (3), (4), (5), (6), (7))
SELECT o_orderkey AS record_id, s.gate_ord, coalesce(g.status, 'missing') AS status, g.status IS NULL AS not_submitted, g.reviewer
FROM orders CROSS JOIN slots s LEFT JOIN gates g ON g.record_id = o_orderkey AND g.gate_ord = s.gate_ord""")
def q_gate_left_outer(spark, sf_dir):
    slots = F.explode(F.array(*[F.lit(k) for k in range(1, 8)])).alias("gate_ord")
    needed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), slots)
    gates = gate_rows(spark, sf_dir).select("record_id", "gate_ord", C.known_status(F.col("status")).alias("status"), "reviewer")
    out = needed.join(gates, ["record_id", "gate_ord"], "left")
    return out.select("record_id", "gate_ord", F.coalesce("status", F.lit("missing")).alias("status"), F.col("status").isNull().alias("not_submitted"), "reviewer")


@query(f"""WITH {GATES_SQL}
SELECT record_id, gate_ord, evidence_id, p_brand AS version, p_partkey IS NOT NULL AS in_manifest
FROM gates LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = evidence_id""")
def q_evidence_lookup(spark, sf_dir):
    manifest = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("version"), F.lit(True).alias("found"))
    out = gate_rows(spark, sf_dir, "l_partkey").select("record_id", "gate_ord", "evidence_id").join(manifest, "evidence_id", "left")
    return out.select("record_id", "gate_ord", "evidence_id", "version", F.coalesce("found", F.lit(False)).alias("in_manifest"))


@query(f"""WITH {GATES_SQL}
SELECT record_id, gate_ord, reviewer, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_acctbal <= 0 THEN 'not_active' ELSE 'active' END AS authorization_status
FROM gates LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON s_suppkey = reviewer""")
def q_auth_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("reviewer"), "s_acctbal")
    out = gate_rows(spark, sf_dir).select("record_id", "gate_ord", "reviewer").join(known, "reviewer", "left")
    status = F.when(F.col("s_acctbal").isNull(), "missing").when(F.col("s_acctbal") <= 0, "not_active").otherwise("active")
    return out.select("record_id", "gate_ord", "reviewer", status.alias("authorization_status"))


@query(f"""WITH {REGISTRY_SQL}, {POLICY_SQL}
SELECT r.level, r.family, r.gate, coalesce(e.role, f.role) AS role, e.role IS NOT NULL AS by_gate, count(*) AS records
FROM orders JOIN registry r ON r.level = 'L' || CAST(o_orderkey % 5 AS VARCHAR)
LEFT JOIN policy e ON e.key = r.family || '.' || r.gate LEFT JOIN policy f ON f.key = r.family || '.*'
GROUP BY ALL""")
def q_role_fallback(spark, sf_dir):
    records = table(spark, sf_dir, "orders").groupBy(_level(F.col("o_orderkey")).alias("level")).agg(F.count(F.lit(1)).alias("records"))
    rows = C.required_roles(C.required_gates(records))
    by_gate = F.concat_ws(".", "family", "gate").isin(*[k for k in R.ROLES if not k.endswith(".*")])
    return rows.select("level", "family", "gate", "role", by_gate.alias("by_gate"), "records")


@query("""SELECT o_orderkey AS record_id, CASE
    WHEN c_custkey IS NULL OR c_custkey % 13 = 0 THEN 'claim_manifest_id_mismatch'
    WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' THEN 'claim_manifest_digest_mismatch'
    WHEN c_nationkey % 10 = o_orderkey % 10 THEN 'claim_manifest_version_mismatch'
    WHEN c_acctbal < 500 THEN 'sequence_rollback_detected' ELSE 'ok' END AS guard
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def q_manifest_guards(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    out = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    guard = (
        F.when(F.col("c_custkey").isNull() | (F.col("c_custkey") % 13 == 0), "claim_manifest_id_mismatch")
        .when((F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderstatus") == "F"), "claim_manifest_digest_mismatch")
        .when(F.col("c_nationkey") % 10 == F.col("o_orderkey") % 10, "claim_manifest_version_mismatch")
        .when(F.col("c_acctbal") < 500, "sequence_rollback_detected")
        .otherwise("ok")
    )
    return out.select(F.col("o_orderkey").alias("record_id"), guard.alias("guard"))


@query("""WITH d AS (SELECT l_orderkey AS record_id, list_sort(list_distinct(list(l_linenumber))) AS declared FROM lineitem GROUP BY 1),
e AS (SELECT record_id, declared, range(1, CAST(4 + record_id % 5 AS BIGINT)) AS expected FROM d)
SELECT record_id, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(declared, CAST(x AS INTEGER)))), ',') AS omitted,
       array_to_string(list_sort(list_filter(declared, lambda x: NOT list_contains(expected, CAST(x AS BIGINT)))), ',') AS unregistered
FROM e""")
def q_omitted_unregistered(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_set("l_linenumber").alias("declared"))
    expected = F.sequence(F.lit(1), (3 + F.col("record_id") % 5).cast("int"))
    joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return rows.select("record_id", joined(C.set_difference(expected, F.col("declared"))).alias("omitted"), joined(C.set_difference(F.col("declared"), expected)).alias("unregistered"))


@query(f"""WITH {GATES_SQL}
SELECT record_id, gate_ord, list_contains([CAST(p_size % 7 + 1 AS BIGINT), p_partkey % 7 + 1, 4], CAST(gate_ord AS BIGINT)) AS bound_to_gate
FROM gates JOIN part ON p_partkey = evidence_id""")
def q_permission_membership(spark, sf_dir):
    permitted = F.array((F.col("p_size") % 7 + 1).cast("long"), (F.col("p_partkey") % 7 + 1).cast("long"), F.lit(4).cast("long"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), permitted.alias("permitted"))
    out = gate_rows(spark, sf_dir, "l_partkey").select("record_id", "gate_ord", "evidence_id").join(parts, "evidence_id")
    return out.select("record_id", "gate_ord", F.array_contains("permitted", F.col("gate_ord").cast("long")).alias("bound_to_gate"))


@query("""SELECT doc_id, sha256(text) AS digest, lag(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS prior_id FROM documents""")
def q_copied_digest_lag(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return C.copied_digests(used, [], "digest", "doc_id", ["doc_id"])


AGE_SQL = "floor((epoch_us(o_orderdate) - epoch_us(reviewed_at)) / 86400000000)"


@query(f"""WITH {GATES_SQL}
SELECT record_id, gate_ord, CAST({AGE_SQL} AS BIGINT) AS age_days,
       reviewed_at > o_orderdate OR {AGE_SQL} > {R.MAX_REVIEW_AGE_DAYS} AS stale_or_after
FROM gates JOIN orders ON o_orderkey = record_id""")
def q_review_age(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderdate")
    out = gate_rows(spark, sf_dir, "l_partkey").select("record_id", "gate_ord", "reviewed_at").join(orders, "record_id")
    age = C.elapsed_days(F.col("o_orderdate"), F.col("reviewed_at"))
    return out.select("record_id", "gate_ord", age.cast("long").alias("age_days"), ((F.col("reviewed_at") > F.col("o_orderdate")) | (age > R.MAX_REVIEW_AGE_DAYS)).alias("stale_or_after"))


@query(f"""WITH {GATES_SQL}, t AS (
SELECT record_id, family, gate_ord, list_filter([
    CASE WHEN p_partkey IS NULL THEN family || ':' || CAST(gate_ord AS VARCHAR) || ':evidence_id_not_in_manifest' END,
    CASE WHEN reviewed_at > o_orderdate OR {AGE_SQL} > {R.MAX_REVIEW_AGE_DAYS} THEN family || ':' || CAST(gate_ord AS VARCHAR) || ':review_timestamp_stale_or_after_assessment' END,
    CASE WHEN reviewer % 50 = o_custkey % 50 THEN family || ':' || CAST(gate_ord AS VARCHAR) || ':self_review_not_permitted' END,
    CASE WHEN status <> 'pass' THEN family || ':' || CAST(gate_ord AS VARCHAR) || '=' || status END], lambda x: x IS NOT NULL) AS tags
FROM gates JOIN orders ON o_orderkey = record_id LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = evidence_id)
SELECT record_id, coalesce(string_agg(array_to_string(tags, ' '), ' ' ORDER BY gate_ord) FILTER (WHERE len(tags) > 0), '') AS audit_tags, sum(len(tags))::BIGINT AS n_tags
FROM t GROUP BY record_id""")
def q_attestation_tags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderdate", "o_custkey")
    manifest = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("evidence_id"), F.lit(True).alias("found"))
    rows = gate_rows(spark, sf_dir).join(orders, "record_id").join(manifest, "evidence_id", "left")
    prefix = F.concat_ws(":", "family", F.col("gate_ord").cast("string"))
    stale = (F.col("reviewed_at") > F.col("o_orderdate")) | (C.elapsed_days(F.col("o_orderdate"), F.col("reviewed_at")) > R.MAX_REVIEW_AGE_DAYS)
    made = C.tags(
        (F.col("found").isNull(), F.concat(prefix, F.lit(":evidence_id_not_in_manifest"))),
        (stale, F.concat(prefix, F.lit(":review_timestamp_stale_or_after_assessment"))),
        (F.col("reviewer") % 50 == F.col("o_custkey") % 50, F.concat(prefix, F.lit(":self_review_not_permitted"))),
        (F.col("status") != "pass", F.concat_ws("=", prefix, "status")),
    )
    out = C.ordered_tags(rows.select("record_id", "gate_ord", made.alias("tags")), ["record_id"], ["gate_ord"])
    return out.select("record_id", F.array_join("tags", " ").alias("audit_tags"), F.size("tags").cast("long").alias("n_tags"))


@query(f"WITH {GATES_SQL}, {STATE_SQL} SELECT record_id, state FROM states")
def q_state_fold(spark, sf_dir):
    return C.fold_states(gate_rows(spark, sf_dir, "l_partkey").select("record_id", "family", "status"), ["record_id"])


def _component_sql(name: str, cond: str) -> str:
    return f"""CASE WHEN NOT coalesce(bool_or({cond}), false) THEN 'not_required_for_profile'
        WHEN bool_or({cond} AND status IN ('missing', 'invalid')) THEN 'not_assessable'
        WHEN bool_or({cond} AND status = 'fail') THEN 'conflicts_with_declared_component' ELSE 'submitted_gate_passes' END AS {name}"""


@query(f"""WITH {GATES_SQL} SELECT record_id, {_component_sql("validity", "family = 'validity'")}, {_component_sql("service_quality", "gate_ord = 4")},
    {_component_sql("sla_feasibility", "gate_ord = 5")}, {_component_sql("energy_subclaim", "family = 'substantive'")}, {_component_sql("precision_status", "family = 'precision'")}
FROM gates GROUP BY record_id""")
def q_component_status(spark, sf_dir):
    family = F.col("family")
    return gate_rows(spark, sf_dir, "l_partkey").groupBy("record_id").agg(
        C.component(family == "validity").alias("validity"), C.component(F.col("gate_ord") == 4).alias("service_quality"), C.component(F.col("gate_ord") == 5).alias("sla_feasibility"),
        C.component(family == "substantive").alias("energy_subclaim"), C.component(family == "precision").alias("precision_status"),
    )


@query("SELECT l_orderkey AS record_id, count(*) AS declared, count(DISTINCT l_linenumber) AS distinct_gates, count(*) <> count(DISTINCT l_linenumber) AS duplicate_gate_name FROM lineitem GROUP BY 1")
def q_duplicate_declared(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.count(F.lit(1)).alias("declared"), F.size(F.collect_set("l_linenumber")).cast("long").alias("distinct_gates"))
    return out.withColumn("duplicate_gate_name", F.col("declared") != F.col("distinct_gates"))


@query(f"""WITH {GATES_SQL}, {STATE_SQL} SELECT record_id, CASE state
    WHEN '{R.STATES["complete"]}' THEN 'Locally provenance-complete--L' || CAST(record_id % 5 AS VARCHAR) || '; evidence not independently validated'
    WHEN '{R.STATES["failed"]}' THEN 'Attested criterion failed under the declared boundary'
    WHEN '{R.STATES["inconclusive"]}' THEN 'Inconclusive due to precision or replication'
    ELSE 'Not assessable with available evidence' END AS display_state FROM states""")
def q_display_state(spark, sf_dir):
    return q_state_fold(spark, sf_dir).select("record_id", C.display_state(F.col("state"), _level(F.col("record_id"))).alias("display_state"))


@query(r"""SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest,
    sha256(text) <> sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS newline_changed FROM documents""")
def q_checksum_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    observed = docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    expected = docs.select(F.col("doc_id").alias("path"), I.newline_digest(F.col("text").cast("binary")).alias("digest"))
    changed = I.mismatches(expected, observed).select("path", F.lit(True).alias("changed"))
    out = expected.join(changed, "path", "left")
    return out.select(F.col("path").alias("doc_id"), "digest", F.coalesce("changed", F.lit(False)).alias("newline_changed"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || split_part(url, '//', 2) WHEN 1 THEN '../' || split_part(url, '//', 2) WHEN 2 THEN replace(split_part(url, '//', 2), '/', '\')
    WHEN 3 THEN ' ' WHEN 4 THEN url ELSE split_part(url, '//', 2) END AS path FROM pages)
SELECT page_id, CASE WHEN path IS NULL OR NOT regexp_matches(path, '\S') THEN 'path_missing_or_invalid' WHEN contains(path, '\') THEN 'path_not_posix'
    WHEN starts_with(path, '/') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('.', '..'))) > 0 OR contains(path, ':') THEN 'path_not_normalized_relative' ELSE 'ok' END AS path_status FROM p""")
def q_path_safety(spark, sf_dir):
    bare = F.get(F.split("url", "//"), F.lit(1))
    kind = F.col("page_id") % 6
    path = F.when(kind == 0, F.concat(F.lit("/"), bare)).when(kind == 1, F.concat(F.lit("../"), bare)).when(kind == 2, F.translate(bare, "/", "\\"))
    path = path.when(kind == 3, " ").when(kind == 4, F.col("url")).otherwise(bare)
    out = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return out.select("page_id", F.coalesce(I.path_error(F.col("path")), F.lit("ok")).alias("path_status"))


@query(f"WITH {REGISTRY_SQL} SELECT s_suppkey AS reviewer, level AS profile, family, gate, '' AS relevance_1_to_4, '' AS clarity_1_to_4, '' AS necessity FROM supplier JOIN registry ON level = 'L' || CAST(s_suppkey % 5 AS VARCHAR)")
def q_scorecard(spark, sf_dir):
    """A blank line for each gate of the profile that each reviewer is given."""
    reviewers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reviewer"), F.concat(F.lit("L"), (F.col("s_suppkey") % 5).cast("string")).alias("level"))
    return C.required_gates(reviewers).select("reviewer", F.col("level").alias("profile"), "family", "gate", *[F.lit("").alias(c) for c in ("relevance_1_to_4", "clarity_1_to_4", "necessity")])
