"""Alignment of two tokenizers' tokens: which tokens of one overlap which of the other, document by document.

Tokens are intervals of bytes. DuckDB aligns them within each Arrow batch, in slices that end where both tokenizers end a token: an ASOF join
finds the B token in which an A token begins, a range join the B tokens that begin inside an A token, and a window sum over the common
beginnings numbers the groups. Together the two joins give every overlapping pair once. DuckDB also counts, for each batch,
in how many documents an id pair is linked. Spark sums these partial counts, compares them with the highest of their A id, and gives
every batch the totals of its own pairs back, so what is shuffled are pairs by batch, not links, and a pair that every document has
comes once from each batch.

Ids of A come from a tokenizers file of a byte-level vocabulary, ids of B from a sentencepiece model that adds a space and in no piece
has a space behind another character; units from spaces to the next are then encoded apart and remembered.

Defined results. Null and empty texts, and those that the tokens don't give back byte for byte, have no tokens: zeros and an empty string. Null ids and repeated rows count as documents of their own.
Without documents there are no rows. Columns besides the named ones are neither read nor returned. A text is tokenized whole, however long; only slices of it are joined at a time.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch
from gatelight.llm.text import release
from gatelight.llm.tokens import tokenizer

#: Bytes that are tokenized and joined at a time, units that a worker remembers, and megabytes that DuckDB may take in a worker.
SLICE, MAX_UNITS, DUCK_MB = 1 << 19, 200_000, 200
#: Spaces and what follows up to the next.
UNITS = re.compile(r" +[^ ]*").findall
_SPACE = "▁"


class Pieces(dict):
    """Numbers of the units seen, and their ids under a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        if any(_SPACE in name.lstrip(_SPACE) for name in names):
            raise ValueError("a piece has a space behind another character: units can't be encoded apart")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else b"" if self.model.is_control(k) else n.replace(_SPACE, " ").encode() for k, n in enumerate(names)]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.first, self.count = array("i"), array("q"), array("q")

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self]
        for unit, ids in zip(new, self.model.encode([u[1:] for u in new], num_threads=1)):
            if len(unit) == 1:
                ids = [self.model.piece_to_id(_SPACE)]
            self[unit] = len(self.count)
            self.first.append(len(self.ids))
            self.count.append(len(ids))
            self.ids.extend(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that begin with a space, and how many each has."""
        if len(self) > MAX_UNITS:
            self.forget()
        found = [UNITS(text) for text in texts]
        units = list(chain.from_iterable(found))
        self.learn(set(units))
        number = np.fromiter(map(self.__getitem__, units), "i8", len(units))
        first, count, ids = np.array(self.first, "i8"), np.array(self.count, "i8"), np.array(self.ids, "i4")
        sizes = count[number]
        before = np.cumsum(sizes) - sizes
        out = ids[np.repeat(first[number] - before, sizes) + np.arange(int(sizes.sum()))]
        ends = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, found)])]
        return out, np.diff(ends)


class Vocabulary:
    """The bytes of ids, for lengths and for texts joined from ids."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), "u1")

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))]


class Aligner:
    """Both tokenizers and a DuckDB of one worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = tokenizer(a_path, spaced=True), Pieces(b_path)
        own = self.a.tokenizer
        value = {c: k for k, c in enumerate(self.a.letters)}
        entries = [own.id_to_token(k) or "" for k in range(own.get_vocab_size())]
        self.a_bytes = Vocabulary([bytes(value[c] for c in e) if all(c in value for c in e) else b"" for e in entries])
        self.b_bytes = Vocabulary(self.b.bytes)
        if max(len(entries), len(self.b.bytes)) > 1 << 16:
            raise ValueError("a vocabulary has more than 65,536 ids")
        # Without a folder for temporary files: slices bound what the joins need.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCK_MB}MB", "temp_directory": "", "preserve_insertion_order": True})

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, their number in each text, B ids, their number; none for texts that the tokens don't give back."""
        # The library's ids are followed by an end id here, which goes again.
        ids, bounds = self.a.encode_column(pa.array(texts, pa.large_string()), 0)
        a, n_a = np.delete(ids, bounds[1:] - 1).astype("i4"), np.diff(bounds) - 1
        b, n_b = self.b.encode(texts)
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw], "i8")
        whole = np.frombuffer(b"".join(raw), "u1")
        good = np.ones(len(texts), bool)
        for ids, n, vocabulary in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            of = np.repeat(np.arange(len(texts)), n)
            good &= np.bincount(of, vocabulary.sizes[ids], len(texts)).astype("i8") == sizes
        for ids, n, vocabulary in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            joined = vocabulary.joined(ids[np.repeat(good, n)])
            kept = np.repeat(good, sizes)
            wrong = np.flatnonzero(joined != whole[kept])
            good[np.flatnonzero(good)[np.unique(np.searchsorted(np.cumsum(sizes[good]), wrong, "right"))]] = False
            a, n_a, b, n_b = a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good
        return a, n_a, b, n_b

    def begin(self) -> None:
        self.db.execute("CREATE OR REPLACE TEMP TABLE linked (doc INTEGER, pair BIGINT, n BIGINT)")

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, row: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Groups of the A tokens and of the B tokens, counted through the texts; their links go to the table linked, the first text being the row of that number."""
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        a_of, b_of = (np.repeat(np.arange(row, row + len(n), dtype="i4"), n) for n in (n_a, n_b))
        groups, found, before = ([], []), (0, 0), 0
        for cut in _cuts(a_ends, b_ends):
            mine = [slice(low, high) for low, high in zip(found, cut)]
            sides = [_intervals(ids[part], ends[part], sizes, of[part]) for ids, ends, sizes, of, part in zip((a, b), (a_ends, b_ends), (self.a_bytes.sizes, self.b_bytes.sizes), (a_of, b_of), mine)]
            for out, own in zip(groups, self._slice(*sides)):
                out.append(own + before)
            before, found = int(groups[0][-1][-1]) + 1, cut
        none = np.zeros(0, "i8")
        return tuple(np.concatenate([none, *own]) for own in groups)

    def links(self) -> tuple[np.ndarray, ...]:
        """(text, pair, links) of all texts' id pairs since begin(), pairs by their number, and (pair, texts) of all pairs in that order, a pair being A id * 65536 + B id."""
        pairs = self.db.execute("SELECT pair, count(DISTINCT doc) AS docs FROM linked GROUP BY pair ORDER BY docs DESC, pair").fetchnumpy()
        self.db.register("numbered", pa.table({"pair": pairs["pair"], "nr": np.arange(len(pairs["pair"]), dtype="i4")}))
        links = self.db.execute("SELECT doc, nr, sum(n)::INTEGER AS n FROM linked JOIN numbered USING (pair) GROUP BY doc, nr ORDER BY doc, nr").fetchnumpy()
        self.db.unregister("numbered")
        return links["doc"], links["nr"], links["n"], pairs["pair"], pairs["docs"]

    def _slice(self, a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Groups of the A and B tokens of a slice, from 0; its links go to the table linked."""
        db = self.db
        db.register("a", a)
        db.register("b", b)
        # begun: how many B tokens begin inside an A token, by the numbers of those in which it and the next one begin.
        db.execute("""
            CREATE OR REPLACE TEMP TABLE aligned AS
            SELECT *, sum(common::INTEGER) OVER w - 1 AS grp, lead(b_nr - common::INTEGER, 1, (SELECT count(*)::INTEGER - 1 FROM b)) OVER w - b_nr AS begun
            FROM (SELECT a.*, b.nr AS b_nr, b.id AS b_id, b.first = a.first AS common FROM a ASOF JOIN b ON a.first >= b.first)
            WINDOW w AS (ORDER BY first)
        """)
        db.execute("""
            CREATE OR REPLACE TEMP TABLE inner_links AS
            SELECT x.doc, x.id, x.grp, y.nr AS b_nr, y.id AS b_id
            FROM (SELECT * FROM aligned WHERE begun > 0) x
            JOIN (SELECT * FROM b ANTI JOIN (SELECT b_nr FROM aligned WHERE common) c ON b.nr = c.b_nr) y ON y.first > x.first AND y.first < x.stop
        """)
        db.execute("""
            INSERT INTO linked
            SELECT doc, id::BIGINT * 65536 + b_id AS pair, count(*) FROM (SELECT doc, id, b_id FROM aligned UNION ALL SELECT doc, id, b_id FROM inner_links) GROUP BY ALL
        """)
        own = db.execute("SELECT grp::BIGINT AS grp FROM aligned ORDER BY nr").fetchnumpy()["grp"]
        other = db.execute("SELECT grp::BIGINT AS grp FROM (SELECT b_nr, grp FROM aligned WHERE common UNION ALL SELECT b_nr, grp FROM inner_links) ORDER BY b_nr").fetchnumpy()["grp"]
        db.unregister("a")
        db.unregister("b")
        return np.asarray(own), np.asarray(other)


def _parts(column: pa.Array):
    """Runs of whole texts of about SLICE bytes, with a space before every text that isn't empty."""
    texts, size = [], 0
    for value in column:
        text = value.as_py()
        texts.append(f" {text}" if text else "")
        size += len(texts[-1])
        if size >= SLICE:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _cuts(a_ends: np.ndarray, b_ends: np.ndarray):
    """Numbers of A and B tokens up to places about SLICE bytes apart where both end one, the last being the end."""
    at = 0
    while at < len(a_ends):
        place = (a_ends[at - 1] if at else 0) + SLICE
        at = int(np.searchsorted(a_ends, place)) if a_ends[-1] - place > SLICE // 2 else len(a_ends)
        while at < len(a_ends) - 1:  # a few tokens at most, where words end
            same = int(np.searchsorted(b_ends, a_ends[at]))
            if b_ends[same] == a_ends[at]:
                break
            at += 1
        at = min(at, len(a_ends) - 1) + 1
        yield at, int(np.searchsorted(b_ends, a_ends[at - 1])) + 1


def _intervals(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> pa.Table:
    return pa.table({"nr": np.arange(len(ids), dtype="i4"), "id": ids.astype("i4"), "first": ends - sizes[ids], "stop": ends, "doc": of})


#: Decimal digits of ids, five bytes each, and how many count.
_DIGITS = np.array([list(f"{k:<5}".encode()) for k in range(1 << 16)], "u1")
_N_DIGITS = np.array([len(str(k)) for k in range(1 << 16)], "i8")


def group_texts(a: np.ndarray, n_a: np.ndarray, a_groups: np.ndarray, b: np.ndarray, n_b: np.ndarray, b_groups: np.ndarray) -> list[bytes]:
    """The groups of each text as decimal ids: a1,a2|b1;a3|b2,b3. Every group has tokens of both sides."""
    per_a, per_b = np.bincount(a_groups), np.bincount(b_groups)
    ends_a, ends_b = np.cumsum(per_a), np.cumsum(per_b)
    total = len(a) + len(b)
    ids, signs = np.zeros(total, "i8"), np.full(total, ord(","), "u1")
    place_a = np.arange(len(a)) + (ends_b - per_b)[a_groups]
    place_b = np.arange(len(b)) + ends_a[b_groups]
    ids[place_a], ids[place_b] = a, b
    signs[place_a[ends_a - 1]] = ord("|")
    signs[place_b[ends_b - 1]] = ord(";")
    letters = np.concatenate([_DIGITS[ids], signs[:, None]], axis=1)
    used = np.arange(6) < _N_DIGITS[ids][:, None]
    used[:, 5] = True
    out = letters[used].tobytes()
    ends = np.append(0, np.cumsum(_N_DIGITS[ids] + 1))[np.append(0, np.cumsum(n_a + n_b))].tolist()
    return [out[low : high - 1] if high > low else b"" for low, high in zip(ends, ends[1:])]


_made: dict[tuple, Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _made:
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


def _blocks(docs: DataFrame, a_path: str, b_path: str, texts_too: bool) -> DataFrame:
    """One row per Arrow batch: block; doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and groups of its documents as arrays; pairs and docs
    of its id pairs; and link_bounds, link_pair, link_n, each document's pairs and how many links each is, as little-endian integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def aligned(batches):
        own, partition = _aligner(a_path, b_path), TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            rows, at = batch.num_rows, 0
            sums = [np.zeros(rows, "i8") for _ in range(3)]
            strings, digests = [], []
            own.begin()
            for texts in _parts(batch.column(1)):
                a, n_a, b, n_b = own.tokens(texts)
                a_groups, b_groups = own.align(a, n_a, b, n_b, at)
                new = np.ones(len(a_groups), bool)
                new[1:] = a_groups[1:] != a_groups[:-1]
                n_groups = np.bincount(np.repeat(np.arange(len(texts)), n_a)[new], minlength=len(texts))
                for out, counts in zip(sums, (n_a, n_b, n_groups)):
                    out[at : at + len(texts)] = counts
                groups = group_texts(a, n_a, a_groups, b, n_b, b_groups)
                digests += [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                strings += [g.decode() for g in groups] if texts_too else []
                at += len(texts)
            doc, nr, n, pairs, docs_of = own.links()
            listed = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(partition << 32) + number], pa.int64()),
                "doc_id": pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), batch.column(0)),
                **{name: listed(counts, pa.int64()) for name, counts in zip(("n_a", "n_b", "n_groups"), sums)},
                "n_links": listed(np.bincount(doc, n, rows).astype("i8"), pa.int64()),
                "groups_sha256": listed(digests, pa.string()),
                "groups": listed(strings, pa.string()),
                "pairs": listed(pairs, pa.int64()),
                "docs": listed(docs_of, pa.int64()),
                "link_bounds": pa.array([np.searchsorted(doc, np.arange(rows + 1)).astype("<i8").tobytes()], pa.binary()),
                "link_pair": pa.array([nr.astype("<i4").tobytes()], pa.binary()),
                "link_n": pa.array([n.astype("<i4").tobytes()], pa.binary()),
            })
            release()

    numbers = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>"
    schema = f"block long, doc_id array<{kind}>, {numbers}, groups_sha256 array<string>, groups array<string>, pairs array<long>, docs array<long>, link_bounds binary, link_pair binary, link_n binary"
    return docs.mapInArrow(aligned, schema)


def _a_id(pair: Column) -> Column:
    return F.shiftright(pair, 16).cast("int")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a_id, n_docs, best: in how many documents a pair is linked, and whether no pair of its A id is in more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n_docs"))
    counts, _ = scratch.written(each.withColumn("a_id", _a_id(F.col("pair"))), "pair-counts")
    # At most one row for each id of A's vocabulary, which has 65,536 ids at most.
    highest = counts.groupBy("a_id").agg(F.max("n_docs").alias("highest"))
    return counts.join(F.broadcast(highest), "a_id").select("pair", "a_id", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and pair counts.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (a1,a2|b1;a3|b2,b3) if asked for. Pair counts: pair, a_id, n_docs, best.
    """
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    blocks, _ = scratch.written(_blocks(own, a_path, b_path, groups), "aligned-blocks")
    counts = pair_counts(blocks)
    # A batch's pairs in their order, with the totals; best is the sign.
    listed = blocks.select("block", F.posexplode("pairs").alias("nr", "pair")).join(counts, "pair")
    signed = F.when(F.col("best"), F.col("n_docs")).otherwise(-F.col("n_docs"))
    totals = listed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("nr", signed.alias("n")))).alias("totals")).select("block", F.col("totals.n").alias("totals"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    joined = blocks.drop("pairs", "docs").join(totals, "block", "left").select(*columns, "link_bounds", "link_pair", "link_n", "totals")

    def summed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
                bounds, nr, n = (np.frombuffer(at[c][0].as_py(), t) for c, t in (("link_bounds", "<i8"), ("link_pair", "<i4"), ("link_n", "<i4")))
                totals = at["totals"].flatten().to_numpy(zero_copy_only=False).astype("i8")[nr]
                sums = [np.append(0, np.cumsum(v)) for v in (n * (totals > 0), n * np.abs(totals))]
                n_best, count_sum = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                own = [at[c].flatten() for c in columns[: 7 if groups else 6]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*columns[: len(own)], "n_best", "count_sum"])

    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = joined.mapInArrow(summed, f"doc_id {kind}, {numbers}{', groups string' if groups else ''}, n_best long, count_sum long")
    return found, counts
