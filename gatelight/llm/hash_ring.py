"""Shards of documents by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VIRTUAL nodes on a ring; their places depend on the shard and the node alone. A document belongs to the first
node clockwise from the hash of its id. A shard holds its quota of rows and no more: the quotas are the rows divided by the shards, so that
counts differ by one at most. Rows for which their own shard has no room continue clockwise to the next node whose shard has. Rows of shards with room thus never move for the sake of
others, and one more shard moves little more than what it takes (`moved` in the tests).

The rows of each arc between two nodes are counted in Spark. The driver walks the ring once with these counts (arcs only, a parameter's
number) and cuts each arc into pieces: which of its rows, in the order of a second hash, go to which shard, and to which slots there. A row's place in its arc comes from running sums:
arcs are divided by that hash into cells of about CELL rows, cells are summed, and only within a cell rows are ordered.
So an id that a third of all rows has, which is one place on the ring, is spread by the bounds over the shards behind it, and by the cells over tasks.

Defined results. A null text has no bytes, hence size 1. Null ids share one place on the ring. Repeated rows (same id, same text) are placed each, as neighbours where a
shard has room. Without documents there are no rows. Columns besides the named ones are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.llm import scratch

#: Virtual nodes of a shard, places on the ring, rows of a cell, and repeated rows that one task writes.
VIRTUAL, TICKS, CELL, CHUNK = 64, 1 << 14, 20_000, 10_000


def nodes(n_shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """Place on the ring and shard of every node, clockwise."""
    place = lambda shard, k: int.from_bytes(hashlib.md5(f"{shard}/{k}".encode()).digest()[:8], "big") % TICKS
    return sorted((place(shard, k), shard) for shard in range(n_shards) for k in range(virtual))


def quotas(total: int, n_shards: int) -> list[int]:
    low, more = divmod(total, n_shards)
    return [low + (k < more) for k in range(n_shards)]


def cut_arcs(owners: list[int], loads: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first row, end, shard, slot of the first row) of all pieces. The sum of room is that of loads at least.

    Own rows come first in every shard; what is left over goes clockwise from its arc, arcs in the order of the ring.
    """
    room, used, pieces, over = list(room), [0] * len(room), [], []

    def put(arc: int, first: int, rows: int, shard: int) -> None:
        if rows:
            pieces.append((arc, first, first + rows, shard, used[shard]))
            used[shard] += rows
            room[shard] -= rows

    for arc, shard in enumerate(owners):
        own = min(loads[arc], room[shard])
        put(arc, 0, own, shard)
        over.append(own)
    for arc, first in enumerate(over):
        at = arc
        while first < loads[arc]:
            at = (at + 1) % len(owners)
            more = min(loads[arc] - first, room[owners[at]])
            put(arc, first, more, owners[at])
            first += more
    return pieces


def _keys(docs: DataFrame, owners_at: list[int], id_col: str, text_col: str) -> DataFrame:
    """One row for equal rows: doc_id, text_id, size, text_crc32, copies, arc, turn (the hash that orders an arc's rows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("text_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    each = rows.groupBy("doc_id", "text_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    tick = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.lit(TICKS)).cast("int")
    arc = F.get(F.lit(owners_at), tick)
    return each.withColumns({"arc": arc, "turn": F.xxhash64("doc_id", "text_id", F.lit("turn"))})


def _firsts(keys: DataFrame, loads: list[int]) -> DataFrame:
    """keys with first, the rows of the arc before each."""
    bits = F.lit([max(0, (load // CELL).bit_length()) for load in loads])
    # The leading bits of the hash as a number from 0, as many as the arc's rows ask for.
    unsigned = F.col("turn").bitwiseXOR(F.lit(-(1 << 63)))
    cell = F.when(F.get(bits, "arc") == 0, 0).otherwise(F.call_function("shiftrightunsigned", unsigned, 64 - F.get(bits, "arc")))
    dealt = keys.withColumn("cell", cell.cast("long"))
    sums = dealt.groupBy("arc", "cell").agg(F.sum("copies").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = sums.select("arc", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("arc", "cell").orderBy("turn", "doc_id", "text_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(cells, ["arc", "cell"]).withColumn("first", F.col("before") + F.sum("copies").over(inside) - F.col("copies"))


def place(docs: DataFrame, n_shards: int = 16, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_id (SHA-256), size (bytes of UTF-8 and one), text_crc32, shard, slot (gapless from 0 in the shard)."""
    spark = docs.sparkSession
    ring = nodes(n_shards, virtual)
    places, owners = [p for p, _ in ring], [s for _, s in ring]
    owners_at = [bisect_left(places, tick) % len(ring) for tick in range(TICKS)]
    keys, _ = scratch.written(_keys(docs, owners_at, id_col, text_col), "ring-keys")
    counts = keys.groupBy("arc").agg(F.sum("copies").alias("rows"), F.max("copies").alias("most")).collect()
    loads = [0] * len(ring)
    for row in counts:
        loads[row["arc"]] = row["rows"]
    by_arc: dict[int, list] = {}
    for arc, *piece in cut_arcs(owners, loads, quotas(sum(loads), n_shards)):
        by_arc.setdefault(arc, []).append(tuple(piece))
    # At most one row for each node of the ring.
    table = spark.createDataFrame(list(by_arc.items()), "arc int, pieces array<struct<start:long,end:long,shard:int,slot:long>>")
    ranked = _firsts(keys, loads).join(F.broadcast(table), "arc")
    end = F.col("first") + F.col("copies")
    met = ranked.withColumn("piece", F.explode(F.filter("pieces", lambda x: (x["start"] < end) & (x["end"] > F.col("first")))))
    low, high = F.greatest("first", "piece.start"), F.least(end, F.col("piece.end")) - 1
    chunks = met.withColumns({"high": high, "low": F.explode(F.sequence(low, high, F.lit(CHUNK).cast("long")))})
    if max((row["most"] for row in counts), default=0) > CHUNK:  # rows repeated so often are written by many tasks
        chunks = chunks.repartition("arc", "cell", "turn", "low")
    rows = chunks.withColumn("at", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + CHUNK - 1, F.col("high")))))
    return rows.select("doc_id", "text_id", "size", "text_crc32", F.col("piece.shard").alias("shard"), (F.col("piece.slot") + F.col("at") - F.col("piece.start")).alias("slot"))


def write(docs: DataFrame, placed: DataFrame, path: str, slots: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, text and slot of every placed row to a folder for each shard, in files of runs of slots in order. path is a folder that all executors share."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.sha2(text, 256).alias("own"))
    texts = texts.dropDuplicates(["own_id", "own"])
    rows = placed.join(texts, (F.lower(F.hex("text_id")) == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    run = F.floor(F.col("slot") / slots)
    ordered = rows.select("doc_id", "text", "shard", "slot").repartition("shard", run).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def digests(placed: DataFrame, law: str = "rows") -> DataFrame:
    """The placed rows with the law that holds, and without text_id. Shards are bounded by all rows, so growth isn't known from a row alone: grown_shard is null."""
    none: Column = F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", none.alias("grown_shard"))
