"""JSON-Schema keywords held against a VARIANT: the paths of all violations, from one expression whatever the size of the shape.

Supported: type, additionalProperties, required, minLength, enum, minProperties, pattern, minimum, minItems, items, properties and
references into $defs. required gives one violation for each absent property, additionalProperties: false one for each object.
A shape becomes a constant list of places; a value is walked from its root, each value with the place that it is held against,
so that the plan grows with the depth of the shape only. A shape that refers to itself has no depth and is refused.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelight.functions import variants as V

#: What a shape asks for at one place.
_PLACES = (
    "array<struct<type:string,min_length:int,enum:array<string>,min_properties:int,pattern:string,minimum:double,min_items:int,required:array<string>,closed:boolean,"
    "known:map<string,int>,extra:int,items:int>>"
)


def places(schema: dict) -> tuple[list[dict], int]:
    """The places of a shape, the root's first, each with the numbers of those below it, and the depth."""
    found: list[dict] = []

    def add(own: dict, above: tuple) -> tuple[int, int]:
        while "$ref" in own:
            if own["$ref"] in above:
                raise ValueError(f"the shape refers to itself: {own['$ref']}")
            above, own_ref, own = (*above, own["$ref"]), own["$ref"], schema
            for part in own_ref.removeprefix("#/").split("/"):
                own = own[part]
        number, extra = len(found), own.get("additionalProperties")
        keywords = {"type": "type", "minLength": "min_length", "enum": "enum", "minProperties": "min_properties", "pattern": "pattern", "minimum": "minimum", "minItems": "min_items"}
        place = {name: own.get(keyword) for keyword, name in keywords.items()} | {"required": own.get("required", []), "closed": extra is False}
        found.append(place)
        below = {name: add(inner, above) for name, inner in own.get("properties", {}).items()}
        place["known"] = {name: n for name, (n, _) in below.items()}
        for name, inner in (("extra", extra), ("items", own.get("items"))):
            below[name,] = add(inner, above) if isinstance(inner, dict) else (None, 0)
            place[name] = below[name,][0]
        return number, 1 + max(depth for _, depth in below.values())

    _, depth = add(schema, ())
    return found, depth


#: A value (c.v, of kind k, with members m if it is an object) held against its place (o): how many violations it has itself, not counting those of what is in it.
_COUNT = """(
    CASE k
    WHEN 'string' THEN nvl(int(char_length(try_variant_get(c.v, '$', 'string')) < o.min_length), 0) + nvl(int(NOT rlike(try_variant_get(c.v, '$', 'string'), o.pattern)), 0)
    WHEN 'array' THEN CASE WHEN o.min_items IS NULL THEN 0 ELSE int(size(try_variant_get(c.v, '$', 'array<variant>')) < o.min_items) END
    WHEN 'object' THEN CASE WHEN m IS NULL THEN 0 ELSE size(array_except(o.required, map_keys(m))) + nvl(int(size(m) < o.min_properties), 0) + int(o.closed AND size(array_except(map_keys(m), map_keys(o.known))) > 0) END
    ELSE CASE WHEN o.minimum IS NULL THEN 0 ELSE nvl(int(k IN ('integer', 'number') AND try_variant_get(c.v, '$', 'double') < o.minimum), 0) END END
    + CASE WHEN o.enum IS NULL THEN 0 ELSE int(NOT nvl(k = 'string' AND array_contains(o.enum, try_variant_get(c.v, '$', 'string')), false)) END
    + CASE WHEN o.type IS NULL THEN 0 WHEN o.type = 'number' THEN int(k NOT IN ('integer', 'number'))
        WHEN o.type = 'integer' THEN int(k <> 'integer' AND NOT (k = 'number' AND try_variant_get(c.v, '$', 'double') = floor(try_variant_get(c.v, '$', 'double'))))
        ELSE int(k <> o.type) END)"""
#: The members of an object that something is asked of.
_MEMBERS = """CASE WHEN k = 'object' AND (size(o.known) > 0 OR o.extra IS NOT NULL OR size(o.required) > 0 OR o.closed OR o.min_properties IS NOT NULL) THEN try_variant_get(c.v, '$', 'map<string,variant>') END"""
#: The values in a value that are held against a place.
_BELOW = """filter(CASE
    WHEN m IS NOT NULL AND (size(o.known) > 0 OR o.extra IS NOT NULL) THEN transform(map_entries(m), e -> struct(-1 AS n, e.key AS s, e.value AS v, nvl(try_element_at(o.known, e.key), o.extra) AS place))
    WHEN k = 'array' AND o.items IS NOT NULL THEN transform(try_variant_get(c.v, '$', 'array<variant>'), (y, i) -> struct(i AS n, string(i) AS s, y AS v, o.items AS place))
    ELSE array() END, c -> c.place IS NOT NULL)"""
_PATH = "array<struct<n:int,s:string>>"


def violations(schema: dict, name: str) -> Column:
    """The path of each violation of a column; nothing for an absent value. A path is a list of parts (n, s); n orders list indices as numbers, and is -1 for the names of members.

    What a function hands on for an element is copied, with all that is in it, but what it is given is not. So the shape (read once
    a record), the place, the kind and the members of a value are given by name, and only violations are handed on.
    """
    found, depth = places(schema)
    shape = "from_json('" + json.dumps(found).replace("\\", "\\\\").replace("'", "\\'") + f"', '{_PLACES}')"

    def given(value: str, name: str, then: str) -> str:
        return f"get(transform(array({value}), {name} -> {then}), 0)"

    def at(level: int, text: str) -> str:
        """The expression with the names of a level."""
        return re.sub(r"\b([ckmo])\b(?!')", rf"\g<1>{level}", text)

    def walk(values: str, level: int) -> str:
        path = f"CAST(array({', '.join(f'struct(c{i}.n AS n, c{i}.s AS s)' for i in range(1, level + 1))}) AS {_PATH})"
        out = given(at(level, _COUNT), f"n{level}", f"CASE WHEN n{level} > 0 THEN array_repeat({path}, n{level}) ELSE CAST(array() AS array<{_PATH}>) END")
        if level + 1 < depth:
            out = f"concat({out}, {walk(at(level, _BELOW), level + 1)})"
        for value, name in ((_MEMBERS, "m"), (V.KIND.format("c.v"), "k"), ("get(shape, c.place)", "o")):
            out = given(at(level, value), f"{name}{level}", out)
        return f"flatten(transform({values}, c{level} -> {out}))"

    root = f"array(struct(-1 AS n, '' AS s, {name} AS v, 0 AS place))"
    return F.expr(f"CASE WHEN {name} IS NULL THEN CAST(array() AS array<{_PATH}>) ELSE {given(shape, 'shape', walk(root, 0))} END")


def violation_tags(schema: dict, name: str) -> Column:
    """One tag for each violation, in the order of paths."""
    return F.transform(F.array_sort(violations(schema, name)), lambda p: F.concat(F.lit("schema:jsonschema="), F.when(F.size(p) == 0, "root").otherwise(F.array_join(F.transform(p, lambda x: x["s"]), "/"))))


_SCALAR = {"string": "string", "integer": "bigint"}


def typed(schema: dict, opened: dict[str, str], path: str = "") -> tuple[str, object]:
    """The Spark type of the values of a shape, and a function that tells from a value of it, not null, whether it breaks nothing.

    opened: the types of objects of which the shape asks nothing about what is in them, by their path. What is absent is null. The function also
    asks that no name is in a map twice, which the reader of the type lets pass.
    """
    kind = schema.get("type", "string" if all(isinstance(x, str) for x in schema.get("enum", [None])) else None)
    if path in opened:
        asked = schema.get("minProperties", 0)
        return opened[path], lambda c: (F.size(c) >= asked) & _map_fits(c, lambda _: F.lit(True)) if opened[path].startswith("map<") else F.lit(True)
    if kind in _SCALAR:

        def scalar(c: Column) -> Column:
            asked = {"minLength": lambda n: F.char_length(c) >= n, "enum": lambda own: c.isin(*own), "pattern": lambda p: c.rlike(p), "minimum": lambda n: c >= n}
            return all_of(*[test(schema[keyword]) for keyword, test in asked.items() if keyword in schema])

        return _SCALAR[kind], scalar
    if kind == "array":
        inner, fits = typed(schema["items"], opened, f"{path}/*")
        return f"array<{inner}>", lambda c: (F.size(c) >= schema.get("minItems", 0)) & F.forall(c, lambda x: x.isNotNull() & fits(x))
    if kind == "object" and isinstance(schema.get("additionalProperties"), dict):
        inner, fits = typed(schema["additionalProperties"], opened, f"{path}/*")
        return f"map<string,{inner}>", lambda c: (F.size(c) >= schema.get("minProperties", 0)) & _map_fits(c, fits)
    if kind == "object" and schema.get("additionalProperties") is False:
        parts = {name: typed(inner, opened, f"{path}/{name}") for name, inner in schema["properties"].items()}
        required = schema.get("required", [])

        def whole(c: Column) -> Column:
            present = lambda name, fits: c[name].isNotNull() & fits(c[name]) if name in required else c[name].isNull() | fits(c[name])
            return all_of(*[present(name, fits) for name, (_, fits) in parts.items()])

        return f"struct<{','.join(f'{name}:{inner}' for name, (inner, _) in parts.items())}>", whole
    raise ValueError(f"no type for the shape at {path or 'its root'}")


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _map_fits(c: Column, fits) -> Column:
    return (F.size(F.array_distinct(F.map_keys(c))) == F.size(c)) & F.forall(F.map_values(c), lambda x: x.isNotNull() & fits(x))


def read_typed(text: Column, kind: str) -> Column:
    """A text as a value of a type, null where it can't be read."""
    return F.from_json(text, kind, {"mode": "PERMISSIVE"})


def written_alike(value: Column, text: Column) -> Column:
    """Whether a value that was read from a text is written just as the text is. Then the text holds nothing else, and nothing of another kind."""
    return F.coalesce(F.to_json(value) == text, F.lit(False))
