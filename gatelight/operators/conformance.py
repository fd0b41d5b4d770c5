"""Records against a registry: required rows, lookups, ordered tags, components and the state fold.

Every function takes and returns DataFrames or columns and does no work on the driver. Dimensions that are broadcast are
the registry's own (72 and 12 rows); fact tables join by their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions import registry_values as R
from gatelight.operators import ordered


def registry_gates(spark, registry: R.Registry = R.PUBLISHED) -> DataFrame:
    return spark.createDataFrame(registry.gate_rows(), "level string, family string, family_ord int, gate string, gate_ord int")


def role_policy(spark, registry: R.Registry = R.PUBLISHED) -> DataFrame:
    return spark.createDataFrame(list(registry.roles.items()), "key string, role string")


def required_gates(records: DataFrame, registry: R.Registry = R.PUBLISHED) -> DataFrame:
    """Records (with level) and the rows that their level requires."""
    return records.join(F.broadcast(registry_gates(records.sparkSession, registry)), "level")


def required_roles(gates: DataFrame, registry: R.Registry = R.PUBLISHED) -> DataFrame:
    """gates (family, gate) with role: that of the gate itself, else of its family."""
    policy = role_policy(gates.sparkSession, registry)
    exact = F.broadcast(policy.select(F.col("key").alias("exact_key"), F.col("role").alias("exact_role")))
    family = F.broadcast(policy.select(F.col("key").alias("family_key"), F.col("role").alias("family_role")))
    out = gates.join(exact, F.concat_ws(".", "family", "gate") == F.col("exact_key"), "left")
    out = out.join(family, F.concat(F.col("family"), F.lit(".*")) == F.col("family_key"), "left")
    return out.withColumn("role", F.coalesce("exact_role", "family_role")).drop("exact_key", "exact_role", "family_key", "family_role")


def known_status(status: Column) -> Column:
    """A status of the four known ones, else null."""
    return F.when(status.isin("pass", "fail", "missing", "invalid"), status)


def tags(*pairs: tuple[Column, Column | str]) -> Column:
    """The tags whose condition holds, in the order given."""
    made = F.array(*[F.when(cond, F.lit(tag) if isinstance(tag, str) else tag) for cond, tag in pairs])
    return F.filter(made, lambda x: x.isNotNull())


def ordered_tags(per_gate: DataFrame, by: list[str], order: list[str], column: str = "tags") -> DataFrame:
    """All tags of a record, gate by gate."""
    parts = F.array_sort(F.collect_list(F.struct(*order, column)))
    return per_gate.groupBy(*by).agg(F.flatten(F.transform(parts, lambda x: x[column])).alias(column))


def set_difference(left: Column, right: Column) -> Column:
    """What left has and right has not, in order."""
    return F.array_sort(F.array_except(left, right))


def copied_digests(used: DataFrame, scope: list[str], digest: str, evidence: str, order: list[str], n_ranges: int | None = None) -> DataFrame:
    """prior_id: the id under which a record used the same digest just before, if it was another one. A digest with many uses is divided over tasks."""
    marked = ordered.running(used, [*scope, digest], order, lags={"before_": F.col(evidence)}, n_ranges=n_ranges)
    return marked.select(*used.columns, F.when(F.col("before_") != F.col(evidence), F.col("before_")).alias("prior_id"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole periods of 24 hours between two timestamps, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / 86_400_000_000)


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def component(family, some=None, open_=None) -> Column:
    """The status of the gate rows for which family holds, as an aggregate. Or, with some (see below), a column of whatever some looks through.

    some: whether any gate is as a function of its columns says, open_: whether any is that doesn't pass; then family is such a function too.
    """
    if some is None:
        part, some = family, lambda cond: _any(cond(F.col))
        open_ = some
        family = lambda _: part
    return (
        F.when(~some(family), "not_required_for_profile")
        .when(open_(lambda g: family(g) & g("status").isin("missing", "invalid")), "not_assessable")
        .when(open_(lambda g: family(g) & (g("status") == "fail")), "conflicts_with_declared_component")
        .otherwise("submitted_gate_passes")
    )


def fold_states(gates: DataFrame, by: list[str], blocked: Column | None = None) -> DataFrame:
    """state of each record by its gate rows (family, status): the first rule that holds decides.

    blocked: rows whose own tags make a record not assessable whatever the statuses are.
    """
    family, status = F.col("family"), F.col("status")
    state = (
        F.when(_any(blocked if blocked is not None else F.lit(False)), R.STATES["not_assessable"])
        .when(_any((family == "validity") & (status != "pass")), R.STATES["not_assessable"])
        .when(_any((family == "substantive") & status.isin("missing", "invalid")), R.STATES["not_assessable"])
        .when(_any((family == "substantive") & (status == "fail")), R.STATES["failed"])
        .when(_any((family == "precision") & (status != "pass")), R.STATES["inconclusive"])
        .otherwise(R.STATES["complete"])
    )
    return gates.groupBy(*by).agg(state.alias("state"))


def display_state(state: Column, level: Column) -> Column:
    return (
        F.when(state == R.STATES["complete"], F.concat(F.lit("Locally provenance-complete--"), level, F.lit("; evidence not independently validated")))
        .when(state == R.STATES["failed"], "Attested criterion failed under the declared boundary")
        .when(state == R.STATES["inconclusive"], "Inconclusive due to precision or replication")
        .otherwise("Not assessable with available evidence")
    )
