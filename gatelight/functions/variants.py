"""Columns that look into VARIANT values without ever failing on their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date (extended, basic or by weeks), a separator, time (extended or basic), fraction, offset.
ISO_UTC = (
    r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-?W(\d{2})(?:-?([1-7]))?)."
    r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)$"
)

PLAIN_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"


def field(v: Column, name: str) -> Column:
    """A member of an object; null if it is absent or v is no object, a variant null if it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


_SCALARS = "map('STRING', 'string', 'BOOLEAN', 'boolean', 'VOID', 'null', 'BIGINT', 'integer')"
#: The kind of a value in SQL. What is in objects and arrays isn't looked at: a schema, which would be, is worked out of scalars only.
KIND = f"""CASE WHEN {{0}} IS NULL THEN NULL WHEN try_variant_get({{0}}, '$', 'struct<>') IS NOT NULL THEN 'object' WHEN try_variant_get({{0}}, '$', 'array<struct<>>') IS NOT NULL THEN 'array'
    ELSE nvl(try_element_at({_SCALARS}, schema_of_variant({{0}})), 'number') END"""


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null; SQL null for what is absent."""
    scalar = F.coalesce(F.try_element_at(F.expr(_SCALARS), F.schema_of_variant(v)), F.lit("number"))
    return F.when(v.isNotNull(), F.when(is_object(v), "object").when(F.try_variant_get(v, "$", "array<struct<>>").isNotNull(), "array").otherwise(scalar))


def text(v: Column) -> Column:
    """The value of a string, null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def exact(v: Column) -> Column:
    """A text that two values share just if they are the same, in kind too; null for what is absent."""
    return F.coalesce(F.concat(F.lit("string "), text(v)), F.concat(kind(v), F.lit(" "), F.to_json(v)))


def exact_text(s: Column) -> Column:
    """The text of a value from what exact gives for it."""
    return F.when(F.startswith(s, F.lit("string ")), F.substring(s, 8, 2**31 - 1))


def number(v: Column) -> Column:
    return F.when(kind(v).isin("integer", "number"), F.try_variant_get(v, "$", "double"))


def members(v: Column) -> Column:
    """map<string, variant> of an object; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.expr("map_from_arrays(array(), array())").cast("map<string,variant>"))


def items(v: Column) -> Column:
    """array<variant> of an array; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("array()").cast("array<variant>"))


def filled(s: Column) -> Column:
    """Whether a string has anything but white space; false for null."""
    return F.coalesce(s.rlike(r"(?U)\S"), F.lit(False))


def utc(s: Column) -> Column:
    """A timestamp from ISO 8601 text with a date, a time and an offset; null for anything else."""
    part = lambda k: F.regexp_extract(s, ISO_UTC, k)
    or_zero = lambda x: F.when(x == "", "00").otherwise(x)
    week_year, week, day = part(7), F.try_to_number(part(8), F.lit("99")).cast("int"), F.coalesce(F.try_to_number(part(9), F.lit("9")), F.lit(1)).cast("int")
    monday = F.date_trunc("week", F.try_to_timestamp(F.concat(week_year, F.lit("-01-04"))))
    by_week = F.date_add(monday.cast("date"), (week - 1) * 7 + day - 1)
    # The days of week 53 may belong to the next year: then there is no such week.
    thursday = F.date_add(monday.cast("date"), (week - 1) * 7 + 3)
    valid = week.between(1, 53) & (F.date_format(thursday, "yyyy") == week_year)
    date = F.when(part(1) != "", F.concat_ws("-", part(1), part(2), part(3))).when(part(4) != "", F.concat_ws("-", part(4), part(5), part(6))).when(valid, F.date_format(by_week, "yyyy-MM-dd"))
    fraction = F.rpad(F.substring(part(13), 1, 6), 6, "0")
    time = F.concat_ws(":", part(10), or_zero(part(11)), F.concat(or_zero(part(12)), F.lit("."), fraction))
    raw = part(14)
    offset = F.when(raw == "Z", "+00:00").otherwise(F.concat(F.substring(raw, 1, 3), F.lit(":"), or_zero(F.regexp_replace(F.substring(raw, 4, 3), ":", ""))))
    # The usual form is read as it is.
    return F.when(s.rlike(PLAIN_UTC), F.try_to_timestamp(s)).when(s.rlike(ISO_UTC), F.try_to_timestamp(F.concat(date, F.lit("T"), time, offset)))


def _quoted(s: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))


def shown(v: Column) -> Column:
    """A value as it is written in tags: strings in single quotes, or in double ones if they hold single quotes only; None for null or absent."""
    k = kind(v)
    return F.when(k == "string", _quoted(text(v))).when(k.isNull() | (k == "null"), "None").when(k == "boolean", F.initcap(F.to_json(v))).otherwise(F.to_json(v))


def shown_text(s: Column) -> Column:
    """What shown gives for a text."""
    return F.coalesce(_quoted(s), F.lit("None"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with further columns that are worked out once for each row, however often later expressions use them.

    Expressions over plain columns are merged into those that use them; a generator of one row keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
