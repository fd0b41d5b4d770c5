"""Near duplicates: SuperMinHash signatures, banding, exact verification and components.

Signatures. Each shingle of a document walks through a random permutation of the signature's slots; its
value in the j-th slot visited lies between j and j + 1. So the ranks of one shingle are correlated, slots
get values of lower variance than independent hashes give, and the walk stops for a document as soon as no slot
holds a value above the current step: long documents stop after one or two steps.

Candidates. Documents with equal shingle sets become one class first. Classes share a bucket if they agree on all
rows of a band. Every bucket names a pivot, the member that shares most buckets with others; all its members are
verified against it on the full shingle sets, and verified links join components. So a group of n near copies around
a centre costs about n comparisons. Buckets whose members are all in one component then are done.

The members of the other buckets form families (components of shared buckets), each with one pivot P. A set A is seen
as its difference to P's set there: of the d = |A xor P| shingles that only one of the two has, what two sets have in
common and what is peculiar to one can be told apart without looking at what all have. |A xor B| is d(A) + d(B) less twice
the shingles that both differences hold, so a link asks for so many common ones that one of them must be among the
first few of each difference, in the order from the rarest shingle on. Sets meet by these few, those positions bound
how many more can be in common, and only pairs that can still be links, of different components, are verified,
each once. This loses no link between members of a family: no bucket is capped, and what was refuted isn't tried again.

Nothing is collected to the driver but counts. Links, buckets and components are tables in the shared
folder, where lineage ends after each round.

Defined results. A null or empty text, or one of white space only, has no shingles: n_shingles 0, its own
component, kept. A row with a null id links with nothing: component_id null, kept. Rows with the same id are one document:
whatever one of them links with, all do. Repeated rows each give a row. Columns of the input
besides the two named ones are neither read nor returned, but by drop_near_copies, which keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gatelight.llm import scratch
from gatelight.llm.text import distinct, mix, shingles, words

#: Pairs for each copy of the set that they share: a set that many meet is read by as many tasks.
PAIRS_PER_COPY = 1024
#: Edges that one task connects by union-find in its memory.
EDGES = 500_000
_SALT = np.uint64(0x2545F4914F6CDD1D)


def superminhash(sets: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (rows x slots, unsigned 64-bit) of the sets sets[bounds[r]:bounds[r + 1]]. Empty sets get the largest value."""
    n = len(bounds) - 1
    best = np.full((n, slots), np.iinfo("u8").max, "u8")
    flat = best.reshape(-1)
    active = np.diff(bounds) > 0
    of = np.repeat(np.arange(n), np.diff(bounds))
    items, walk = sets, None
    for j in range(slots):
        if j:
            # A slot's value at step j is at least j, so rows without a value above are done.
            active = active & (best.max(axis=1) >= np.uint64(j << 56))
            stay = active[of]
            if not stay.all():
                of, items = of[stay], items[stay]
                walk = walk if walk is None else walk[stay]
        if not len(items):
            break
        draw = mix(items + np.uint64((j + 1) * int(_SALT) % (1 << 64)))
        other = j + (mix(draw ^ _SALT) >> np.uint64(40)).astype("i8") % (slots - j)
        if walk is None:
            walk = np.broadcast_to(np.arange(slots, dtype="u2"), (len(items), slots)).copy()
        rows = np.arange(len(items))
        slot = walk[rows, other]
        walk[rows, other] = walk[:, j]
        np.minimum.at(flat, of * slots + slot, np.uint64(j << 56) | (draw >> np.uint64(8)))
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), "u8")
    for r in range(rows):
        keys = mix(keys + mix(signatures[:, r : bands * rows : rows] + np.uint64(r + 1)))
    return mix(keys + np.arange(1, bands + 1, dtype="u8") * _SALT)


def banding(similarity: float) -> tuple[int, int]:
    """Bands and rows that miss a pair at the similarity with a chance under 1e-6."""
    rows = 5 if similarity >= 0.85 else 4
    return (24, 5) if rows == 5 else (32, 4)


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), set_a and set_b (a 128-bit digest of the set), bands."""

    def signed(batches):
        for batch in batches:
            for part in words(batch.column(1), lower=True):
                found, of = shingles(part, size)
                total = part.last - part.first
                sets, bounds = distinct(found, of, total)
                keys = band_keys(superminhash(sets, bounds, bands * rows), bands, rows)
                sums = np.zeros((2, len(sets) + 1), "u8")
                np.cumsum(sets, out=sums[0, 1:], dtype="u8")
                np.cumsum(mix(sets ^ _SALT), out=sums[1, 1:], dtype="u8")
                digest = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                flat = pa.array(keys.reshape(-1).view("i8"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, total),
                        pa.array(np.diff(bounds).astype("i8")),
                        pa.array(digest[0].view("i8")),
                        pa.array(digest[1].view("i8")),
                        pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype="i4") * bands), flat),
                    ],
                    names=["id", "n", "set_a", "set_b", "bands"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(signed, f"id {kind}, n long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """id and set, the distinct shingle hashes; rows with the same id and set give one."""

    def listed(batches):
        for batch in batches:
            for part in words(batch.column(1), lower=True):
                total = part.last - part.first
                sets, bounds = distinct(*shingles(part, size), total)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), pa.array(sets.view("i8")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, total), lists], names=["id", "set"])

    return docs.mapInArrow(listed, f"id {docs.schema['id'].dataType.simpleString()}, set array<long>").distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (a, b) by union-find as edges from nodes a to the smallest node b that they reach there."""
    schema = to_arrow_schema(edges.schema)

    def united(batches):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(parent) if find(x) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(0).type) for x in zip(*pairs)], names=["a", "b"])

    return edges.mapInArrow(united, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node on an edge (a, b), a <> b.

    Union-find comes first, in partitions of at most EDGES edges; if one partition holds all, that is all. Otherwise
    each component repeatedly joins the smallest of its neighbours and chains of such steps are halved, so
    rounds grow with the logarithm of the longest path. Tables are written to the shared folder between rounds.
    """
    spark = edges.sparkSession
    parts = max(1, -(-edges.count() // EDGES))
    forest, path = scratch.written(_forest(edges.select("a", "b").repartition(parts)), "forest")
    used, rest = [path], forest
    labels = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    if parts == 1:
        labels = labels.join(rest, labels["node"] == rest["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
    while parts > 1:
        hooks, path = scratch.written(rest.groupBy(F.greatest("a", "b").alias("root")).agg(F.min(F.least("a", "b")).alias("to")), "hooks")
        used.append(path)
        if hooks.isEmpty():
            break
        while True:  # halve the chains
            onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            halved, path = scratch.written(hooks.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            used.append(path)
            hooks = halved.select("root", "to")
            if halved.filter("moved").isEmpty():
                break
        step = hooks.select(F.col("root").alias("component"), "to")
        labels, path = scratch.written(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        used.append(path)
        a, b = (hooks.select(F.col("root").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        moved = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        rest, path = scratch.written(moved.filter("a <> b").distinct(), "edges")
        used.append(path)
    labels, _ = scratch.written(labels, "components")
    scratch.drop(spark, *used)
    return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their id, which is the id itself as long as no link is known."""
    if labels is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _copied(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """The sets of the ids that copies (id, copies) names, as often as it says: id, copy, set."""
    return sets.join(copies, "id").select("id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "set")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, copies) whose whole sets are similar enough; b may be in many pairs, as copies (one number for each b) says."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = _copied(sets, pairs.select(F.col("b").alias("id"), "copies").distinct()).select(F.col("id").alias("b"), "copy", F.col("set").alias("set_b"))
    dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return dealt.join(one, "a").join(two, ["b", "copy"]).filter(common * 100 >= union * percent).select("a", "b").distinct()


def _families(rows: DataFrame) -> DataFrame:
    """id and family of the ids of rows (key, id): those that a chain of shared keys connects."""
    first = rows.groupBy("key").agg(F.min("id").alias("b"))
    edges = rows.select("key", F.col("id").alias("a")).join(first, "key").filter("a <> b").select("a", "b").distinct()
    return components(edges).withColumnRenamed("node", "id").withColumnRenamed("component", "family")


def _apart(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """family, pivot, id, component, which, n, near, apart: each set's difference to the set of its family's pivot, and
    whether it is a link to it. which tells the sets of one id apart, n is the size of the set."""
    docs = rows.groupBy("id").agg(F.max("component").alias("component"), F.max("weight").alias("weight")).join(_families(rows), "id")
    tops = docs.groupBy("family").agg(F.max(F.struct("weight", "id"))["id"].alias("pivot"), (1 + F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("copies"))
    owned = sets.join(tops.select(F.col("pivot").alias("id"), "family", "copies"), "id").groupBy("family", "copies").agg(F.max("set").alias("pivot_set"))
    owned = owned.select("family", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "pivot_set")
    dealt = docs.select("family", "id", "component").join(tops, "family").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
    full = sets.join(dealt, "id").join(owned, ["family", "copy"])
    apart = F.concat(F.array_except("set", "pivot_set"), F.array_except("pivot_set", "set"))
    full = full.withColumn("apart", apart).withColumn("n", F.size("set").cast("long"))
    near = F.size("apart") * (100 + percent) <= (F.col("n") + F.size("pivot_set")) * (100 - percent)
    return full.select("family", "pivot", "id", "component", F.xxhash64("set").alias("which"), "n", near.alias("near"), "apart")


def _rarest(apart: DataFrame, percent: int) -> DataFrame:
    """family, shingle, place, id, component, which, n, near, d: the first few shingles of each difference, the rarest of
    the family first, without those that no other difference has. d is the size of the difference."""
    own = ("family", "id", "component", "which", "n", "near", "d")
    each = apart.withColumn("d", F.size("apart").cast("long")).select(*own, F.explode("apart").alias("shingle"))
    often = each.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("often"))
    ordered = each.join(often, ["family", "shingle"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("all"))
    # Beyond the place n (1 - t) / t, t the similarity, no first common shingle of a link can stand.
    first = F.slice("all", F.lit(1), (F.floor(F.col("n") * (100 - percent) / percent) + 1).cast("int"))
    found = ordered.select(*own, F.posexplode(first).alias("place", "x")).filter("x.often > 1")
    return found.select(*own, F.col("x.shingle").alias("shingle"), F.col("place").cast("long").alias("place"))


def _may_link(found: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b in found (see _rarest) that can be links and aren't known to be in one component, directly or by the pivot.

    With s = (1 - t) / (1 + t), A and B are a link if |A xor B| <= s (|A| + |B|). Let e be d - s n: then twice the common shingles
    of the differences are e(A) + e(B) at least, so the one with the smaller e has its first common shingle at the place s n
    at most. All numbers here are 100 + percent times as large, to stay whole.
    """
    e = F.col("d") * (100 + percent) - F.col("n") * (100 - percent)
    rows = found.withColumn("e", e)
    names = ("place", "id", "component", "which", "n", "near", "d", "e")
    low = rows.filter(F.col("place") * (100 + percent) <= F.col("n") * (100 - percent)).select("family", "shingle", *[F.col(c).alias(f"{c}_a") for c in names])
    high = rows.select("family", "shingle", *[F.col(c).alias(f"{c}_b") for c in names])
    wanted = F.col("e_a") + F.col("e_b")
    can = (
        (F.struct("e_a", "id_a", "which_a") < F.struct("e_b", "id_b", "which_b"))
        & (F.col("component_a") != F.col("component_b"))
        & ~(F.col("near_a") & F.col("near_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (2 * (100 + percent) * (F.col("d_a") - F.col("place_a")) >= wanted)
        & (2 * (100 + percent) * (F.col("d_b") - F.col("place_b")) >= wanted)
    )
    pairs = low.join(high, ["family", "shingle"]).filter(can)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (key, id, n, weight) of keys with different components, with component and top, the key's pivot."""
    named = _labelled(rows, labels)
    ends = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("weight", "id", "n", "component")).alias("top"))
    return named.join(ends.filter("low <> high").drop("low", "high"), "key")


def _merged(labels: DataFrame | None, links: DataFrame, new: DataFrame) -> DataFrame:
    known = links if labels is None else labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(new))


def _link(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """node and component by the links given and all that the pairs in a bucket have. members: key, id, n."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = members.join(sizes, "key")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    rows, path = scratch.written(shared.select("key", "id", "n").join(weight, "id"), "buckets")
    used = [path]
    labels = None if links.isEmpty() else components(links)
    pairs = _open(rows, labels).filter((F.col("component") != F.col("top.component")) & (F.least("n", "top.n") * 100 >= F.greatest("n", "top.n") * percent))
    # A pivot is met by no more than its buckets hold.
    copies = (1 + F.col("top.weight") / (8 * PAIRS_PER_COPY)).cast("int")
    pairs = pairs.select(F.col("id").alias("a"), F.col("top.id").alias("b"), copies.alias("copies")).distinct()
    new, path = scratch.written(_verified(pairs, sets, percent), "links")
    used.append(path)
    labels = _merged(labels, links, new)
    rest, path = scratch.written(_open(rows, labels).select("key", "id", "weight", "component"), "open")
    used.append(path)
    if not rest.isEmpty():
        apart, path = scratch.written(_apart(rest, sets, percent), "differences")
        used.append(path)
        pairs = _may_link(_rarest(apart, percent), percent)
        new, path = scratch.written(_verified(pairs.withColumn("copies", F.lit(1)), sets, percent), "links")
        used.append(path)
        to_pivot = apart.filter("near AND id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        labels = _merged(labels, links, new.unionByName(to_pivot))
    scratch.drop(members.sparkSession, *used)
    return labels


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked if their sets of size-word shingles have a
    Jaccard similarity of percent / 100 at least."""
    with scratch.last_stays(docs.sparkSession):
        return _near_groups(docs, size, percent, id_col, text_col)


def _near_groups(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    scratch.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bands, rows = banding(percent / 100)
    signed, _ = scratch.written(_signed(texts, size, bands, rows), "signatures")
    named = signed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    # A class of equal sets is known by its smallest id.
    classes = named.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "n", "bands")).alias("top"))
    classes, _ = scratch.written(classes.select("set_a", "set_b", "top.*"), "classes")
    owners = classes.select("set_a", "set_b", F.col("id").alias("rep"))
    found = signed.select("id", "n", "set_a", "set_b").join(owners, ["set_a", "set_b"], "left").select("id", "n", "rep")
    # Rows with one id and several texts connect the classes of these texts.
    many = found.filter("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last")
    links, _ = scratch.written(found.join(many.drop("last"), "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "links")

    exploded = classes.select(F.explode("bands").alias("key"), "id", "n")
    full = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members, _ = scratch.written(exploded.join(full, "key", "left_semi").distinct(), "members")
    sets = _sets(texts.join(members.select("id").distinct(), "id", "left_semi"), size)
    sets, _ = scratch.written(sets, "sets")
    labels = _link(members, sets, links, percent)
    out = found.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    out, _ = scratch.written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-groups")
    return out


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all columns; rows with a null id stay."""
    name = scratch.unused("dropped", docs)
    dropped = near_groups(docs, size, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs[id_col] == F.col(name), "left_anti")
