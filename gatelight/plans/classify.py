"""Classification of nested JSON records against the registry, a manifest and file digests, all as joins and columns.

Inputs: records(record_key, record, manifest_key) and manifests(manifest_key, manifest, digest) hold JSON text, files(manifest_key,
path, digest[, escapes]) the digests of the files around each manifest. Output: one row per record with state, ordered tags,
required gates and component statuses. Malformed input is tagged, never an error: what is no JSON has the tags of a record
that is no object, or of a manifest that can't be read.

Each file is digested once, by whoever lists the files, and joined; evidence and reviewers join by their ids. Rows of a record
meet only in two places, both keyed by the record: the look at the use of a digest just before, and the final fold. What is
found in a record's text is written to a table (looked-records) that the result is read from. Records that each have a manifest and
files of their own are classified within their rows instead (classify_own): the same rules, and no row meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.functions import record_schema as S
from gatelight.functions import registry_values as R
from gatelight.functions import variants as V
from gatelight.functions.schema_rules import all_of, read_typed, typed, violation_tags, written_alike
from gatelight.operators import conformance as C
from gatelight.operators.integrity import path_error
from gatelight.sources import shared

_TAGS = "array<string>"


def _no_tags() -> Column:
    return F.expr("array()").cast(_TAGS)


def text_key(record: Column, manifest_key: Column) -> Column:
    """What tells records apart: the digest of their text and of the key of their manifest, which may be null."""
    told = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(" "), c), F.lit("-"))
    return F.sha2(F.concat(told(manifest_key), F.lit(" "), told(record)), 256)


def apart(records: DataFrame, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The different records, once each, with their text_key as record_key, and record_key and text_key of every record.

    For tables with many equal records: what depends on the text alone is worked out once for each text. Of equal records one is
    picked by numbers alone; no text is sorted or grouped.

    pool: texts (record, manifest_key) that records name by their manifest_key instead of holding them. Then digests are those of the pool,
    texts are written for no record, and further columns of records are kept. A record that names no text has none.
    """
    if pool is not None:
        told = pool.select("manifest_key", "record", text_key(F.col("record"), F.col("manifest_key")).alias("text_key"))
        members = records.join(told.drop("record"), "manifest_key").drop("manifest_key")
        texts = told.dropDuplicates(["text_key"]).join(members.select("text_key").distinct(), "text_key", "left_semi")
        return texts.select(F.col("text_key").alias("record_key"), "record", "manifest_key"), members
    own = records.withColumns({"text_key": text_key(F.col("record"), F.col("manifest_key")), "at_": F.xxhash64("record_key")})
    picked = own.groupBy("text_key").agg(F.min("at_").alias("at_"))
    texts = own.join(picked, ["text_key", "at_"]).dropDuplicates(["text_key"])
    return texts.select(F.col("text_key").alias("record_key"), "record", "manifest_key"), own.select("record_key", "text_key")


CONTAINERS = ("declared_required_gates", "gates", "evidence_adjudications")


def looked(base: DataFrame) -> tuple[DataFrame, dict]:
    """The records with columns for the parts of v that many rules look at, and (value, kind) of each by the names that lead to it."""
    v = F.col("v")
    base = V.once(base, root_kind=V.kind(v), **{f"p_{name}": V.field(v, name) for name in S.RECORD["required"]})
    kinds = {f"k_{name}": V.kind(F.col(f"p_{name}")) for name in S.RECORD["required"]}
    base = V.once(base, **kinds, **{f"p_{holder}_{f}": V.field(F.col(f"p_{holder}"), f) for holder in CONTAINERS for f in R.FAMILIES})
    base = V.once(base, **{f"k_{holder}_{f}": V.kind(F.col(f"p_{holder}_{f}")) for holder in CONTAINERS for f in R.FAMILIES})
    given = {(): (v, F.col("root_kind"))} | {(name,): (F.col(f"p_{name}"), F.col(f"k_{name}")) for name in S.RECORD["required"]}
    return base, given | {(h, f): (F.col(f"p_{h}_{f}"), F.col(f"k_{h}_{f}")) for h in CONTAINERS for f in R.FAMILIES}


def schema_tags(given: dict, registry: R.Registry = R.PUBLISHED, shape: dict | None = S.RECORD) -> Column:
    """All violations of the shape of a record (see looked), formal ones first; shape is None if its document can't be read."""
    v, root_kind = given[()]
    if shape is None:
        return F.when(F.coalesce(root_kind != "object", F.lit(True)), F.array(F.lit("schema:root_not_object"))).otherwise(F.array(F.lit("schema:formal_schema_unavailable")))
    f = lambda name: given[name,][0]
    boundary, profile, sequence = f("boundary"), f("evidence_profile"), f("minimum_manifest_sequence")
    checks = [(f(name).isNull(), f"schema:missing_field={name}") for name in S.RECORD["required"]]
    checks += [(f(name).isNotNull() & ~V.filled(V.text(f(name))), f"schema:empty_or_invalid={name}") for name in S.TEXT_FIELDS]
    checks.append((V.utc(V.text(f("assessment_time_utc"))).isNull(), "schema:assessment_time_utc_invalid"))
    whole = F.coalesce(V.kind(sequence).isin("integer", "boolean"), F.lit(False)) & ~F.coalesce(V.number(sequence) < 0, F.lit(False))
    checks.append((~whole, "schema:minimum_manifest_sequence_invalid"))
    checks.append((~F.coalesce(V.text(profile).isin(*registry.levels), F.lit(False)), F.concat(F.lit("schema:unknown_evidence_profile="), V.shown(profile))))
    is_object = F.coalesce(V.kind(boundary) == "object", F.lit(False))
    checks.append((~is_object, "schema:boundary_not_object"))
    checks += [(is_object & ~V.filled(V.text(V.field(boundary, n))), f"schema:boundary_{n}_missing_or_empty") for n in ("energy", "service")]
    left_out = V.items(V.field(boundary, "exclusions"))
    checks.append((is_object & ((F.size(left_out) == 0) | F.exists(left_out, lambda x: ~V.filled(V.text(x)))), "schema:boundary_exclusions_missing_or_empty"))
    checks.append((F.size(V.members(f("threshold_rationale"))) == 0, "schema:threshold_rationale_missing_or_empty"))
    for name in CONTAINERS:
        wanted = "array" if name == "declared_required_gates" else "object"
        good = F.coalesce(given[name,][1] == "object", F.lit(False))
        checks.append((~good, f"schema:{name}_not_object"))
        checks += [(good & ~F.coalesce(given[name, x][1] == wanted, F.lit(False)), f"schema:{name}_{x}_missing_or_invalid") for x in R.FAMILIES]
    return F.when(F.coalesce(root_kind != "object", F.lit(True)), F.array(F.lit("schema:root_not_object"))).otherwise(F.concat(violation_tags(shape, "v"), C.tags(*checks)))


def manifest_tags(m: Column, there: Column) -> Column:
    """What keeps a manifest from being used. there: whether a text of it was found at all."""
    f = lambda name: V.field(m, name)
    sequence = f("sequence")
    whole = F.coalesce(V.kind(sequence).isin("integer", "boolean"), F.lit(False)) & ~F.coalesce(V.number(sequence) < 0, F.lit(False))
    found = C.tags(
        (~V.filled(V.text(f("manifest_id"))), "manifest:manifest_id_missing_or_empty"),
        (~V.filled(V.text(f("manifest_version"))), "manifest:manifest_version_missing_or_empty"),
        (~whole, "manifest:sequence_invalid"),
        (V.utc(V.text(f("created_at_utc"))).isNull(), "manifest:created_at_utc_invalid"),
        (F.coalesce(V.kind(f("evidence")) != "object", F.lit(True)), "manifest:evidence_not_object"),
        (F.coalesce(V.kind(f("authorized_reviewers")) != "object", F.lit(True)), "manifest:authorized_reviewers_not_object"),
    )
    return F.when(~there, F.array(F.lit("manifest:unreadable=FileNotFoundError"))).when(m.isNull(), F.array(F.lit("manifest:unreadable=JSONDecodeError"))).otherwise(found)


def _each(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda name: F.concat(F.lit(prefix), name))


def declaration_tags(listed: dict, level: Column, registry: R.Registry = R.PUBLISHED) -> Column:
    """How the gates that a record declares differ from those that its level requires. listed: names by container and family."""
    out = []
    for family in R.FAMILIES:
        expected = F.element_at(F.create_map(*[x for name, own in registry.levels.items() for x in (F.lit(name), F.array(*[F.lit(g) for g in own[family]]))]), level)
        declared = listed["declared_required_gates", family]
        out.append(C.tags((F.size(F.array_distinct(declared)) != F.size(declared), f"required_gate_declaration:{family}:duplicate_gate_name")))
        unlike = lambda names, found: F.when(names.eqNullSafe(expected), _no_tags()).otherwise(found)
        for name, gates in (("omitted", C.set_difference(expected, declared)), ("unregistered", C.set_difference(declared, expected))):
            out.append(unlike(declared, _each(gates, f"required_gate_declaration:{family}:{name}=")))
        for holder in ("gates", "evidence_adjudications"):
            names = listed[holder, family]
            out.append(C.tags((F.size(names) == 0, f"{holder}:{family}=empty")))
            out.append(unlike(names, _each(C.set_difference(names, expected), f"{holder}:{family}:unregistered=")))
    return F.concat(*out)


def normal_path(path: Column) -> Column:
    odd = F.contains(path, F.lit("//")) | F.endswith(path, F.lit("/"))
    return F.when(odd, F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")).otherwise(path)


def _known(files: DataFrame) -> DataFrame:
    escapes = F.col("escapes") if "escapes" in files.columns else F.lit(False)
    return files.select("manifest_key", normal_path(F.col("path")).alias("path_key"), "digest", escapes.alias("escapes"))


def _evidence_values(ev: Column) -> list[Column]:
    """What statements are held against of a piece of evidence, as plain values."""
    f = lambda name: V.field(ev, name)
    active = F.coalesce(V.text(f("status")) == "active", F.lit(False))
    texts = lambda name: F.transform(V.items(f(name)), lambda x: F.coalesce(V.text(x), F.lit(""))).alias(f"ev_{name}")
    return [
        V.is_object(ev).alias("is_ev"), active.alias("ev_active"), F.when(~active, V.shown(f("status"))).alias("ev_status"), V.exact(f("version")).alias("ev_version"),
        V.text(f("sha256")).alias("ev_sha256"), V.utc(V.text(f("expires_at_utc"))).alias("expires"), texts("permitted_gates"), texts("permitted_claim_ids"), V.text(f("path")).alias("path"),
    ]


EVIDENCE = ["is_ev", "ev_active", "ev_status", "ev_version", "ev_sha256", "expires", "ev_permitted_gates", "ev_permitted_claim_ids"]
REVIEWER = ["is_who", "who_active", "who_id", "who_role"]


def _bad_path(path: Column, escapes: Column) -> Column:
    return F.when(F.coalesce(escapes, F.lit(False)), "path_escapes_manifest_root").otherwise(path_error(path))


def _evidence(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """The values of each piece of evidence, and the digest of its file."""
    rows = manifests.select("manifest_key", F.explode(V.members(V.field(F.col("m"), "evidence"))).alias("evidence_id", "ev"))
    rows = rows.select("manifest_key", "evidence_id", *_evidence_values(F.col("ev"))).withColumn("path_key", normal_path(F.col("path")))
    rows = rows.join(_known(files), ["manifest_key", "path_key"], "left")
    return rows.withColumn("bad_path", _bad_path(F.col("path"), F.col("escapes"))).drop("path", "path_key", "escapes")


def _reviewer_values(who: Column) -> list[Column]:
    active = F.coalesce(V.text(V.field(who, "status")) == "active", F.lit(False))
    return [V.is_object(who).alias("is_who"), active.alias("who_active"), V.exact(V.field(who, "reviewer_id")).alias("who_id"), V.exact(V.field(who, "role")).alias("who_role")]


def _reviewers(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("manifest_key", F.explode(V.members(V.field(F.col("m"), "authorized_reviewers"))).alias("authorization_id", "who"))
    return rows.select("manifest_key", "authorization_id", *_reviewer_values(F.col("who")))


def _said(seen: Column) -> Column:
    """What a record says of a gate, as plain values."""
    status = F.when(V.is_object(seen), V.text(V.field(seen, "status"))).otherwise(V.text(seen))
    return F.struct(F.coalesce(V.kind(seen) == "null", F.lit(True)).alias("absent"), C.known_status(status).alias("status"))


def _statement(a: Column) -> Column:
    """A statement on a gate, as plain values: a part of a VARIANT has all names of its record with it, and weighs as much."""
    f = lambda name: V.field(a, name)
    attested = F.coalesce(V.text(f("disposition")) == "attested", F.lit(False))
    binding = V.members(f("claim_binding"))
    part = lambda name: V.text(F.try_element_at(binding, F.lit(name))).alias(name)
    return F.struct(
        V.is_object(a).alias("is_object"), F.when(~attested, V.shown(f("disposition"))).alias("disposition"), C.tags(*[(f(name).isNull(), name) for name in S.ATTESTATION_FIELDS]).alias("lacking"),
        V.text(f("evidence_id")).alias("evidence_id"), V.text(f("reviewer_authorization_id")).alias("authorization_id"), V.exact(f("evidence_version")).alias("version"), V.text(f("evidence_sha256")).alias("sha256"),
        V.text(f("reviewed_at_utc")).alias("reviewed"), V.exact(f("reviewer_id")).alias("reviewer"), V.exact(f("reviewer_role")).alias("role"), V.text(f("conflict_declaration")).alias("conflict"),
        F.struct(F.size(binding).alias("n"), part("claim_id"), part("evidence_profile"), part("gate")).alias("binding"),
    )


def _judged(x, once) -> Column:
    """status and tags of a gate, as a struct of plain values: tags before and behind the place of that on an earlier use of the digest, and what was used.

    x: the column of each name of what is known of the gate. once: applies a function to a column that is then worked out once.
    """
    key, a, binding = x("key"), x("a"), x("a")["binding"]
    prefix = F.concat(F.lit("attestation:"), x("family"), F.lit(":"), x("gate"))
    tag = lambda text: F.concat(prefix, text if isinstance(text, Column) else F.lit(text))
    is_ev, is_who = F.coalesce(x("is_ev"), F.lit(False)), F.coalesce(x("is_who"), F.lit(False))
    bound = (binding["n"] == 3) & binding["claim_id"].eqNullSafe(x("id")) & binding["evidence_profile"].eqNullSafe(x("level")) & binding["gate"].eqNullSafe(key)
    found = (
        F.when(~F.coalesce(a["is_object"], F.lit(False)), F.array(tag("=missing_or_invalid")))
        .when(a["disposition"].isNotNull(), F.array(tag(F.concat(F.lit(":disposition="), a["disposition"]))))
        .when(F.size(a["lacking"]) > 0, F.transform(a["lacking"], lambda name: tag(F.concat(F.lit(":missing="), name))))
        .when(~V.filled(a["evidence_id"]), F.array(tag(":evidence_id_invalid")))
        .when(~is_ev, F.array(tag(F.concat(F.lit(":evidence_id_not_in_manifest="), a["evidence_id"]))))
        .when(~x("ev_active"), F.array(tag(F.concat(F.lit(":evidence_status="), x("ev_status")))))
    )
    expires, assessed = x("expires"), x("assessed")
    allowed = lambda name, value: F.array_contains(x(f"ev_{name}"), value)
    absent, said = F.coalesce(x("seen")["absent"], F.lit(True)), x("seen")["status"]
    status = F.when(absent, "missing").otherwise(F.coalesce(said, F.lit("invalid")))
    name = F.concat(x("family"), F.lit(":"), x("gate"), F.lit("="))
    own = C.tags((absent, F.concat(name, F.lit("not_submitted"))), (~absent & said.isNull(), F.concat(name, F.lit("invalid_status"))), (status != "pass", F.concat(name, status)))

    def judged(told: Column) -> Column:
        early, reviewed = told["early"], told["reviewed"]
        # Only gates that reach their file take part in the look at earlier uses of its digest.
        used = early.isNull() & x("bad_path").isNull() & x("digest").isNotNull()
        stale = (reviewed > assessed) | (C.elapsed_days(assessed, reviewed) > R.MAX_REVIEW_AGE_DAYS)
        first = C.tags(
            (~a["version"].eqNullSafe(x("ev_version")), tag(":evidence_version_mismatch")),
            (x("bad_path").isNotNull(), tag(F.concat(F.lit(":evidence_"), x("bad_path")))),
            (x("bad_path").isNull() & x("digest").isNull(), tag(":evidence_file_missing")),
        )
        late = C.tags(
            (used & ~(x("ev_sha256").eqNullSafe(x("digest")) & a["sha256"].eqNullSafe(x("digest"))), tag(":evidence_digest_mismatch")),
            (~allowed("permitted_gates", key), tag(":evidence_not_bound_to_gate")),
            (~allowed("permitted_claim_ids", x("id")), tag(":evidence_not_bound_to_claim")),
            (~F.coalesce(bound, F.lit(False)), tag(":claim_binding_mismatch")),
            (reviewed.isNull(), tag(":reviewed_at_invalid")),
            (stale, tag(":review_timestamp_stale_or_after_assessment")),
            (expires.isNull() | (expires < assessed), tag(":evidence_expired_or_invalid_expiry")),
            (a["reviewer"].eqNullSafe(x("owner")), tag(":self_review_not_permitted")),
            (~is_who, tag(":reviewer_authorization_missing")),
            (is_who & ~x("who_active"), tag(":reviewer_authorization_not_active")),
            (is_who & ~x("who_id").eqNullSafe(a["reviewer"]), tag(":reviewer_authorization_identity_mismatch")),
            (is_who & ~x("who_role").eqNullSafe(a["role"]), tag(":reviewer_role_authorization_mismatch")),
            (~V.exact_text(a["role"]).eqNullSafe(x("wanted_role")), tag(":wrong_reviewer_role")),
            (~F.coalesce(a["conflict"].isin("none", "declared_and_managed"), F.lit(False)), tag(":conflict_unresolved_or_invalid")),
        )
        return F.struct(
            x("family").alias("family"), x("gate").alias("gate"), status.alias("status"), F.when(used, x("digest")).alias("used"), F.when(used, a["evidence_id"]).alias("evidence_id"),
            F.concat(own, F.coalesce(early, first)).alias("tags"), F.when(early.isNull(), late).otherwise(_no_tags()).alias("late"),
        )

    return once(F.struct(found.alias("early"), V.utc(a["reviewed"]).alias("reviewed")), judged)


def _copied(family: Column, gate: Column, before: Column) -> Column:
    return F.array(F.concat(F.lit("attestation:"), family, F.lit(":"), gate, F.lit(":duplicate_evidence_digest_under_distinct_ids="), before))


def gate_tags(ready: DataFrame, manifests: DataFrame, files: DataFrame, registry: R.Registry = R.PUBLISHED) -> DataFrame:
    """fold_key, place, family, gate, status and tags of every required gate of the records (fold_key, manifest_key, level, id, owner, assessed, and maps of what is said and stated by family)."""
    gates = C.required_roles(C.required_gates(ready, registry), registry)

    def of(holder: str) -> Column:
        chosen = F.lit(None)
        for family in R.FAMILIES:
            chosen = F.when(F.col("family") == family, F.try_element_at(F.col(f"{holder}_{family}"), F.col("gate"))).otherwise(chosen)
        return chosen

    rows = gates.select(
        "fold_key", "manifest_key", "level", "family", "gate", F.concat_ws(".", "family", "gate").alias("key"), F.col("role").alias("wanted_role"), (F.col("family_ord") * 100 + F.col("gate_ord")).alias("place"), of("gates").alias("seen"),
        of("evidence_adjudications").alias("a"), "id", "owner", "assessed",
    ).select("*", "a.evidence_id", "a.authorization_id")
    rows = rows.join(_evidence(manifests, files), ["manifest_key", "evidence_id"], "left").join(_reviewers(manifests), ["manifest_key", "authorization_id"], "left")
    # From here on a gate is its tags: those before and behind the place of that on an earlier use. Rows are dealt by record once, for the window and for the fold.
    made = {}

    def once(told: Column, then):
        made["rows"] = V.once(rows, told=told)
        return then(F.col("told"))

    judged = _judged(F.col, once)
    rows = made["rows"].select("fold_key", "place", judged.alias("g")).select("fold_key", "place", "g.*").repartition("fold_key")
    before = F.when(F.col("used").isNotNull(), F.lag("evidence_id").over(Window.partitionBy("fold_key", "used").orderBy("place")))
    rows = rows.withColumn("before", before)
    copied = F.when(F.col("before") != F.col("evidence_id"), _copied(F.col("family"), F.col("gate"), F.col("before"))).otherwise(_no_tags())
    return rows.select("fold_key", "place", "family", "gate", "status", F.concat("tags", copied, "late").alias("tags"))


def _components(state: Column, known: Column, provenance: Column) -> Column:
    """The seven component statuses of a record as a map."""
    none = F.lit("not_assessable")
    names = ["provenance", "validity", "energy_subclaim", "service_quality", "sla_feasibility", "precision"]
    values = [F.when(known, F.coalesce(F.col(f"c_{n}"), none)).otherwise(none) for n in names[1:]]
    first = F.when(known & provenance, "locally_consistent").otherwise(none)
    return F.create_map(F.lit("overall"), state, F.lit("provenance"), first, *[x for n, v in zip(names[1:], values) for x in (F.lit(n), v)])


def _manifest_values(m: Column, there: Column) -> dict[str, Column]:
    """What a record is held against of a manifest, as plain values."""
    token = V.field(m, "local_integrity_token")
    return {
        "found_tags": manifest_tags(m, there), "m_manifest_id": V.exact(V.field(m, "manifest_id")), "m_manifest_version": V.exact(V.field(m, "manifest_version")), "m_sequence": V.number(V.field(m, "sequence")),
        "m_token": F.coalesce(V.is_object(token), F.lit(False)), "m_token_path": V.text(V.field(token, "path")), "m_token_sha256": V.text(V.field(token, "sha256")),
    }


def _record_values(given: dict) -> dict[str, Column]:
    """What is asked of a record besides its shape, as plain values: lists and maps by container and family, single values by name."""
    f = lambda name: given[name,][0]
    plain = {"gates": lambda _, x: _said(x), "evidence_adjudications": lambda _, x: _statement(x)}
    out = {f"declared_required_gates_{x}": F.transform(V.items(given["declared_required_gates", x][0]), V.text) for x in R.FAMILIES}
    out |= {f"names_{holder}_{x}": F.map_keys(V.members(given[holder, x][0])) for holder in plain for x in R.FAMILIES}
    out |= {f"{holder}_{x}": F.transform_values(V.members(given[holder, x][0]), plain[holder]) for holder in plain for x in R.FAMILIES}
    return out | {
        "level": V.text(f("evidence_profile")), "claim_id": F.coalesce(V.text(f("id")), F.to_json(f("id")), F.lit("<invalid-claim-object>")), "id": V.text(f("id")), "owner": V.exact(f("claim_owner_id")),
        "assessed": V.utc(V.text(f("assessment_time_utc"))), "r_manifest_id": V.exact(f("evidence_manifest_id")), "r_manifest_sha256": V.text(f("evidence_manifest_sha256")),
        "r_manifest_version": V.exact(f("evidence_manifest_version")), "r_sequence": V.number(f("minimum_manifest_sequence")), "r_token_sha256": V.text(f("local_integrity_token_sha256")),
    }


TOLD = [f"{holder}_{f}" for holder in CONTAINERS[1:] for f in R.FAMILIES]
OWN = ["id", "owner", "assessed"]


def _read(base: DataFrame, keys: list[str], registry: R.Registry, shape: dict | None, typed: dict | None = None) -> DataFrame:
    """keys, claim_id, level, what keeps a record from being held against its gates (guard) and the tags of that or of its declaration, and
    what it says and states, as plain values. base has the record (v), the values of its manifest, and token_digest and token_escapes of its token's file.

    typed: the values of records for which the column fits holds; v is null for them.
    """
    base, given = looked(base)
    pick = lambda name, value: value if typed is None else F.when(F.col("fits"), typed[name]).otherwise(value)
    values = {name: pick(name, value) for name, value in _record_values(given).items()}
    singles = {name: value for name, value in values.items() if not name.endswith(R.FAMILIES)}
    violated = schema_tags(given, registry, shape)
    base = V.once(base, s_tags=violated if typed is None else F.when(F.col("fits"), _no_tags()).otherwise(violated), **singles)
    base = base.withColumn("m_tags", F.coalesce("found_tags", F.array(F.lit("manifest:unreadable=FileNotFoundError"))))
    bad, own = _bad_path(F.col("m_token_path"), F.col("token_escapes")), F.col("token_digest")
    matches = F.col("m_token_sha256").eqNullSafe(own) & F.col("r_token_sha256").eqNullSafe(own)
    token_tag = F.when(~F.coalesce("m_token", F.lit(False)), "missing_or_invalid").when(bad.isNotNull(), bad).when(own.isNull(), "file_missing").when(~matches, "digest_mismatch")
    guard = (
        F.when(F.size("m_tags") > 0, "manifest")
        .when(F.size("s_tags") > 0, "schema")
        .when(~F.col("r_manifest_id").eqNullSafe(F.col("m_manifest_id")), "manifest_id")
        .when(~F.col("r_manifest_sha256").eqNullSafe(F.col("manifest_digest")), "manifest_digest")
        .when(~F.col("r_manifest_version").eqNullSafe(F.col("m_manifest_version")), "manifest_version")
        .when(F.coalesce(F.col("m_sequence") < F.col("r_sequence"), F.lit(False)), "sequence")
        .when(token_tag.isNotNull(), "token")
    )
    base = base.withColumn("guard", guard)
    simple = {"manifest_id": "manifest:claim_manifest_id_mismatch", "manifest_digest": "manifest:claim_manifest_digest_mismatch", "manifest_version": "manifest:claim_manifest_version_mismatch", "sequence": "manifest:sequence_rollback_detected"}
    g_tags = F.when(F.col("guard") == "manifest", F.col("m_tags")).when(F.col("guard") == "schema", F.col("s_tags"))
    for name, text in simple.items():
        g_tags = g_tags.when(F.col("guard") == name, F.array(F.lit(text)))
    g_tags = g_tags.when(F.col("guard") == "token", F.array(F.concat(F.lit("manifest:local_integrity_token_"), token_tag)))
    usable = F.col("guard").isNull()
    listed = {(holder, f): values[f"{holder if n == 0 else f'names_{holder}'}_{f}"] for n, holder in enumerate(CONTAINERS) for f in R.FAMILIES}
    base = base.withColumn("guard_tags", g_tags).withColumn("d_tags", F.when(usable, declaration_tags(listed, F.col("level"), registry)))
    accepts = ~F.exists("s_tags", lambda t: F.startswith(t, F.lit("schema:jsonschema=")) | t.isin("schema:root_not_object", "schema:formal_schema_unavailable"))
    told = [F.when(usable, values[name]).alias(name) for name in TOLD]
    return base.select(*keys, "level", "guard", "guard_tags", "d_tags", "claim_id", accepts.alias("schema_accepts"), *OWN, *told)


ENERGY = ("functional_unit_declared", "fixed_work_unit", "benefit_threshold")


def _fold(some, open_) -> dict[str, Column]:
    """What a record's gates come to. some: whether any gate is as a function of its columns says; open_: whether any is that doesn't pass."""
    parts = {"validity": lambda g: g("family") == "validity", "energy_subclaim": lambda g: (g("family") == "substantive") & g("gate").isin(*ENERGY), "service_quality": lambda g: g("gate") == "paired_task_quality",
             "sla_feasibility": lambda g: g("gate") == "sla_feasibility", "precision": lambda g: g("family") == "precision"}
    return {
        "validity_open": open_(lambda g: (g("family") == "validity") & (g("status") != "pass")), "substantive_open": open_(lambda g: (g("family") == "substantive") & g("status").isin("missing", "invalid")),
        "substantive_failed": open_(lambda g: (g("family") == "substantive") & (g("status") == "fail")), "precision_open": open_(lambda g: (g("family") == "precision") & (g("status") != "pass")),
    } | {f"c_{name}": C.component(part, some, open_) for name, part in parts.items()}


def _result(out: DataFrame, registry: R.Registry) -> DataFrame:
    """The result of records with their tags (guard_tags, d_tags, gate_tags) and what their gates come to (see _fold)."""
    unproven = F.exists(F.coalesce("gate_tags", _no_tags()), lambda t: F.startswith(t, F.lit("attestation:")))
    rule = (
        F.when(F.col("guard").isNotNull(), F.col("guard"))
        .when(F.size("d_tags") > 0, "declaration").when(unproven, "attestation").when(F.col("validity_open"), "validity").when(F.col("substantive_open"), "substantive")
        .when(F.col("substantive_failed"), "failed").when(F.col("precision_open"), "precision").otherwise("complete")
    )
    out = out.withColumn("rule", rule)
    state = F.when(F.col("rule") == "failed", R.STATES["failed"]).when(F.col("rule") == "precision", R.STATES["inconclusive"]).when(F.col("rule") == "complete", R.STATES["complete"]).otherwise(R.STATES["not_assessable"])
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in S.REASONS.items() for x in pair]), F.col("rule"))
    known = F.col("guard").isNull()
    required = F.create_map(*[x for f in R.FAMILIES for x in (F.lit(f), F.when(F.col("guard").isin("manifest", "schema"), _no_tags()).otherwise(
        F.coalesce(F.try_element_at(F.create_map(*[y for name, own_ in registry.levels.items() for y in (F.lit(name), F.array(*[F.lit(g) for g in own_[f]]))]), F.col("level")), _no_tags())))])
    out = out.withColumn("state", state)
    return out.select(
        "record_key", "claim_id", "state", C.display_state(F.col("state"), F.col("level")).alias("display_state"), F.col("level").alias("claim_level"), reason.alias("reason"),
        F.coalesce("guard_tags", F.concat(F.coalesce("d_tags", _no_tags()), F.coalesce("gate_tags", _no_tags()))).alias("audit_tags"), required.alias("required_gates"),
        _components(F.col("state"), known, ~F.col("rule").isin("declaration", "attestation")).alias("component_statuses"),
        "schema_accepts",
    )


def classify(records: DataFrame, manifests: DataFrame, files: DataFrame, registry: R.Registry = R.PUBLISHED, shape: dict | None = S.RECORD) -> DataFrame:
    """record_key, claim_id, state, display_state, claim_level, reason, audit_tags, required_gates, component_statuses, schema_accepts."""
    m = manifests.select("manifest_key", F.try_parse_json("manifest").alias("m"), F.col("digest").alias("manifest_digest"), F.col("manifest").isNotNull().alias("there"))
    # Many records may share a manifest: they get the few values that they are held against, not the whole of it.
    few = m.select("manifest_key", "manifest_digest", *[c.alias(name) for name, c in _manifest_values(F.col("m"), F.col("there")).items()])
    tokens = _known(files).withColumnsRenamed({"digest": "token_digest", "escapes": "token_escapes"})
    few = few.withColumn("path_key", normal_path(F.col("m_token_path"))).join(tokens, ["manifest_key", "path_key"], "left").drop("path_key")
    # Records are told apart by their text as well: a key may be there twice, or null.
    fold_key = F.concat_ws(" ", F.coalesce("record_key", F.lit("")), F.hex(F.xxhash64("record_key", "record", "manifest_key")))
    base = records.select("record_key", fold_key.alias("fold_key"), "manifest_key", F.try_parse_json("record").alias("v")).join(few, "manifest_key", "left")
    # What the record's text was looked up for is written once: it is read for the gates and again for the result.
    base, _ = shared.written(_read(base, ["record_key", "fold_key", "manifest_key"], registry, shape), "looked-records")
    ready = base.filter("guard IS NULL").dropDuplicates(["fold_key"]).select("fold_key", "manifest_key", "level", *TOLD, *OWN)
    gates = gate_tags(ready, m.select("manifest_key", "m"), files, registry)
    ordered = F.array_sort(F.collect_list(F.struct("place", "tags")))
    some = lambda cond: F.coalesce(F.bool_or(cond(F.col)), F.lit(False))
    folds = _fold(some, some)
    folded = gates.groupBy("fold_key").agg(F.flatten(F.transform(ordered, lambda x: x["tags"])).alias("gate_tags"), *[c.alias(name) for name, c in folds.items()])
    return _result(base.drop(*TOLD, *OWN).join(folded, "fold_key", "left"), registry)


# Most records are written as the shape has them. Such a text is read as a plain Spark type, which takes a part of the time that a VARIANT takes;
# to know it, what was read is written again: if the same text comes out, nothing else was in it. All others are read as VARIANT.
_STATEMENT = "struct<disposition:string," + ",".join(f"{n}:string" for n in S.ATTESTATION_FIELDS[:-1]) + ",claim_binding:struct<claim_id:string,evidence_profile:string,gate:string>>"
_OPENED = {"/threshold_rationale": "map<string,string>"} | {f"/evidence_adjudications/{f}/*": _STATEMENT for f in R.FAMILIES}
_RECORD_TYPE, _record_fits = typed(S.RECORD, _OPENED)
_MANIFEST_TYPE, _manifest_fits = typed(S.MANIFEST, {})


def _fitting_record(r: Column, text: Column, registry: R.Registry) -> Column:
    """Whether a record breaks no rule on its shape."""
    filled = [V.filled(r[name]) for name in S.TEXT_FIELDS] + [V.filled(r["boundary"][n]) for n in ("energy", "service")] + [F.forall(r["boundary"]["exclusions"], V.filled)]
    known = r["evidence_profile"].isin(*registry.levels) & V.utc(r["assessment_time_utc"]).isNotNull() & (r["minimum_manifest_sequence"] >= 0)
    return F.coalesce(written_alike(r, text) & _record_fits(r) & known & all_of(*filled), F.lit(False))


def _fitting_manifest(m: Column, text: Column) -> Column:
    """Whether a manifest can be used."""
    known = V.filled(m["manifest_id"]) & V.filled(m["manifest_version"]) & (m["sequence"] >= 0) & V.utc(m["created_at_utc"]).isNotNull()
    return F.coalesce(written_alike(m, text) & _manifest_fits(m) & known, F.lit(False))


def _told(s: Column) -> Column:
    """What V.exact gives for a text."""
    return F.concat(F.lit("string "), s)


def _typed_statement(a: Column) -> Column:
    """See _statement."""
    attested, binding = F.coalesce(a["disposition"] == "attested", F.lit(False)), a["claim_binding"]
    whole = all_of(*[a[name].isNotNull() for name in S.ATTESTATION_FIELDS])
    n = sum((F.when(binding[name].isNotNull(), 1).otherwise(0) for name in ("claim_id", "evidence_profile", "gate")), F.lit(0))
    return F.struct(
        F.lit(True).alias("is_object"), F.when(~attested, V.shown_text(a["disposition"])).alias("disposition"), F.when(whole, _no_tags()).otherwise(C.tags(*[(a[name].isNull(), name) for name in S.ATTESTATION_FIELDS])).alias("lacking"),
        a["evidence_id"].alias("evidence_id"), a["reviewer_authorization_id"].alias("authorization_id"), _told(a["evidence_version"]).alias("version"), a["evidence_sha256"].alias("sha256"),
        a["reviewed_at_utc"].alias("reviewed"), _told(a["reviewer_id"]).alias("reviewer"), _told(a["reviewer_role"]).alias("role"), a["conflict_declaration"].alias("conflict"),
        F.struct(n.alias("n"), *[binding[name].alias(name) for name in ("claim_id", "evidence_profile", "gate")]).alias("binding"),
    )


def _typed_record_values(r: Column) -> dict[str, Column]:
    """See _record_values."""
    plain = {"gates": lambda _, x: F.struct(F.lit(False).alias("absent"), C.known_status(x["status"]).alias("status")), "evidence_adjudications": lambda _, x: _typed_statement(x)}
    out = {f"declared_required_gates_{x}": r["declared_required_gates"][x] for x in R.FAMILIES}
    out |= {f"names_{holder}_{x}": F.map_keys(r[holder][x]) for holder in plain for x in R.FAMILIES}
    out |= {f"{holder}_{x}": F.transform_values(r[holder][x], plain[holder]) for holder in plain for x in R.FAMILIES}
    return out | {
        "level": r["evidence_profile"], "claim_id": r["id"], "id": r["id"], "owner": _told(r["claim_owner_id"]), "assessed": V.utc(r["assessment_time_utc"]), "r_manifest_id": _told(r["evidence_manifest_id"]),
        "r_manifest_sha256": r["evidence_manifest_sha256"], "r_manifest_version": _told(r["evidence_manifest_version"]), "r_sequence": r["minimum_manifest_sequence"].cast("double"),
        "r_token_sha256": r["local_integrity_token_sha256"],
    }


def _typed_manifest_values(m: Column) -> dict[str, Column]:
    """See _manifest_values."""
    token = m["local_integrity_token"]
    return {
        "found_tags": _no_tags(), "m_manifest_id": _told(m["manifest_id"]), "m_manifest_version": _told(m["manifest_version"]), "m_sequence": m["sequence"].cast("double"), "m_token": token.isNotNull(),
        "m_token_path": token["path"], "m_token_sha256": token["sha256"],
    }


def _typed_evidence(ev: Column) -> Column:
    """See _evidence_values."""
    active = F.coalesce(ev["status"] == "active", F.lit(False))
    texts = lambda name: F.coalesce(F.transform(ev[name], lambda x: F.coalesce(x, F.lit(""))), F.expr("array()").cast("array<string>")).alias(f"ev_{name}")
    return F.struct(
        F.lit(True).alias("is_ev"), active.alias("ev_active"), F.when(~active, V.shown_text(ev["status"])).alias("ev_status"), _told(ev["version"]).alias("ev_version"), ev["sha256"].alias("ev_sha256"),
        V.utc(ev["expires_at_utc"]).alias("expires"), texts("permitted_gates"), texts("permitted_claim_ids"), ev["path"].alias("path"),
    )


def _typed_reviewer(who: Column) -> Column:
    active = F.coalesce(who["status"] == "active", F.lit(False))
    return F.struct(F.lit(True).alias("is_who"), active.alias("who_active"), _told(who["reviewer_id"]).alias("who_id"), _told(who["role"]).alias("who_role"))


def _let(value: Column, then) -> Column:
    """What a function makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def wanted(level: Column, family: str, registry: R.Registry) -> Column:
    """The gates that a level requires of a family, with their reviewers' roles."""
    role = lambda gate: next((r for r in map(registry.roles.get, (f"{family}.{gate}", f"{family}.*")) if r is not None), None)
    gates = lambda own: F.array(*[F.struct(F.lit(family).alias("family"), F.lit(gate).alias("gate"), F.lit(f"{family}.{gate}").alias("key"), F.lit(role(gate)).cast("string").alias("wanted_role")) for gate in own[family]])
    return F.try_element_at(F.create_map(*[x for name, own in registry.levels.items() for x in (F.lit(name), gates(own))]), level)


def classify_own(rows: DataFrame, registry: R.Registry = R.PUBLISHED, shape: dict | None = S.RECORD) -> DataFrame:
    """What classify gives, for records that each have a manifest and files of their own: rows have record_key, record, manifest, digest and files (an array of path, digest[, escapes]).

    All of a record is worked out within its row. Nothing is joined, grouped, sorted or written, so no text, statement or tag
    takes any disk, however many records there are.
    """
    base = rows.select("record_key", "record", "manifest", F.col("digest").alias("manifest_digest"), "files")
    base = V.once(base, r=read_typed(F.col("record"), _RECORD_TYPE), n=read_typed(F.col("manifest"), _MANIFEST_TYPE))
    fits = _fitting_record(F.col("r"), F.col("record"), registry) if shape == S.RECORD else F.lit(False)
    base = V.once(base, fits=fits, m_fits=_fitting_manifest(F.col("n"), F.col("manifest")))
    base = V.once(base, v=F.when(~F.col("fits"), F.try_parse_json("record")), m=F.when(~F.col("m_fits"), F.try_parse_json("manifest")))
    escapes = (lambda x: x["escapes"]) if "escapes" in rows.schema["files"].dataType.elementType.names else lambda _: F.lit(False)
    known = F.transform("files", lambda x: F.struct(normal_path(x["path"]).alias("path_key"), x["digest"].alias("digest"), escapes(x).alias("escapes")))
    pick = lambda typed_, value: F.when(F.col("m_fits"), typed_).otherwise(value)
    typed_, values = _typed_manifest_values(F.col("n")), _manifest_values(F.col("m"), F.col("manifest").isNotNull())
    values = {name: pick(typed_[name], value) for name, value in values.items()}
    evidence = pick(F.transform_values(F.col("n.evidence"), lambda _, ev: _typed_evidence(ev)), F.transform_values(V.members(V.field(F.col("m"), "evidence")), lambda _, ev: F.struct(*_evidence_values(ev))))
    reviewers = pick(F.transform_values(F.col("n.authorized_reviewers"), lambda _, who: _typed_reviewer(who)), F.transform_values(V.members(V.field(F.col("m"), "authorized_reviewers")), lambda _, who: F.struct(*_reviewer_values(who))))
    base = V.once(base, known=known, evidence=evidence, reviewers=reviewers, **values).drop("m", "n", "m_fits", "manifest", "files", "record")

    def file_of(path: Column) -> Column:
        key = normal_path(path)
        return F.get(F.filter("known", lambda x: x["path_key"] == key), F.lit(0))

    located = F.transform_values("evidence", lambda _, ev: _let(file_of(ev["path"]), lambda file: F.struct(
        *[ev[n].alias(n) for n in EVIDENCE], file["digest"].alias("digest"), _bad_path(ev["path"], file["escapes"]).alias("bad_path"))))
    base = V.once(base, located=located, token=file_of(F.col("m_token_path"))).drop("evidence", "known")
    base = base.select("*", F.col("token.digest").alias("token_digest"), F.col("token.escapes").alias("token_escapes")).drop("token")
    base = _read(base, ["record_key", "located", "reviewers"], registry, shape, _typed_record_values(F.col("r")))

    def stated(family: str) -> Column:
        return F.transform(wanted(F.col("level"), family, registry), lambda g: F.struct(
            g.alias("g"), F.try_element_at(F.col(f"gates_{family}"), g["gate"]).alias("seen"), F.try_element_at(F.col(f"evidence_adjudications_{family}"), g["gate"]).alias("a")))

    held = F.transform(F.concat(*[stated(f) for f in R.FAMILIES]), lambda s: F.struct(
        s["g"].alias("g"), s["seen"].alias("seen"), s["a"].alias("a"), F.try_element_at(F.col("located"), s["a"]["evidence_id"]).alias("ev"), F.try_element_at(F.col("reviewers"), s["a"]["authorization_id"]).alias("who")))
    base = V.once(base, held=F.when(F.col("guard").isNull(), held)).drop("located", "reviewers", *TOLD)

    def judged(s: Column) -> Column:
        part = {"family": "g", "gate": "g", "key": "g", "wanted_role": "g"} | dict.fromkeys([*EVIDENCE, "digest", "bad_path"], "ev") | dict.fromkeys(REVIEWER, "who")
        x = lambda name: s[part[name]][name] if name in part else s[name] if name in ("a", "seen") else F.col(name)
        return _judged(x, _let)

    base = V.once(base, judged=F.transform("held", judged)).drop("held")
    among = lambda gates: lambda cond: F.exists(gates, lambda j: cond(lambda name: j[name]))
    # Only where a digest is used under several ids is it looked who used it before.
    uses = F.array_distinct(F.transform(F.filter("judged", lambda j: j["used"].isNotNull()), lambda j: F.struct(j["used"].alias("used"), j["evidence_id"].alias("evidence_id"))))
    base = V.once(base, ids=uses, open_=F.filter("judged", lambda j: j["status"] != "pass"))
    base = V.once(base, shared=F.size(F.array_distinct(F.transform("ids", lambda x: x["used"]))) < F.size("ids")).drop("ids")

    def tags(j: Column, n: Column) -> Column:
        """The tags of gate n, with that on the id under which its digest was used just before, if it was another one."""
        earlier = F.filter(F.slice("judged", F.lit(1), n), lambda b: b["used"] == j["used"])
        before = F.try_element_at(F.transform(earlier, lambda b: b["evidence_id"]), F.lit(-1))
        copied = F.when(F.col("shared") & j["used"].isNotNull(), _let(before, lambda b: F.when(b != j["evidence_id"], _copied(j["family"], j["gate"], b))))
        return F.concat(j["tags"], F.coalesce(copied, _no_tags()), j["late"])

    gate_tags_ = F.flatten(F.transform("judged", tags)).alias("gate_tags")
    return _result(base.select("*", gate_tags_, *[c.alias(name) for name, c in _fold(among("judged"), among("open_")).items()]).drop("judged", "open_"), registry)
