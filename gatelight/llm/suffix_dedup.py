"""Passages that repeat across documents, by a sparse suffix array over words.

Only suffixes at content-selected positions are kept: of every run of WINDOW starts of HEAD words, the start
whose head has the smallest hash. Equal text has equal minimisers, and HEAD + WINDOW - 1 is the least length of a
passage, so each repeated passage holds a kept suffix whose head repeats too.

1. The kept suffixes of all documents are sorted by the hash of their head; those whose head is in one document only go.
2. What is left gets its text: as many words to both sides of the head as a passage of the least length can reach. Suffixes
   with equal heads meet in a task, sorted by their words. Neighbours are compared word by word and matches extended to the
   left and to the right. One with the longest match to the right may have a short one to the left; so a stretch of the array
   whose suffixes share more words to the right is searched for matches that lie mostly there, and one whose suffixes share
   more words to the left, in the order of the words read backwards, for the others, each cut in halves in turn.
3. Matches of min_words words or more are repeated passages; those that overlap or touch in a document are one span.

Heads that more than HOT suffixes have (a passage in a third of all documents) don't meet in a task: they are cut by all the
further words at once, an aggregation over every passage of min_words around them that Spark combines before it
shuffles, and the way back is an equi-join that adaptive execution can split. The bytes of words decide in step 2, 128-bit digests for such heads;
head hashes only bring candidates together.

Defined results. Null, empty and short texts have no spans. Words are runs of bytes other than space and \\t to
\\r, compared as they are. Rows with a null id are left out of the count and have no spans. Rows with the same id
are one document, so a passage in no other document doesn't repeat; each different text of one id has its own spans and
cuts, and equal rows have theirs once. Columns of the input besides the two named ones are neither read nor
returned, but by drop_repeats, which keeps all.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch
from gatelight.llm.text import WHITE, Words, mix, release, words

MIN_WORDS, HEAD = 50, 20
#: Suffixes with one head that may meet in a task.
HOT = 100_000
_STEP = 0xD1342543DE82EF95


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size words, by doubling: each starts at its index."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    done, parts, at = None, mix(hashes), 0
    width = 1
    while True:
        if size & width:
            own = parts[at : at + n]
            done = own if done is None else mix(done * np.uint64(_STEP) + own)
            at += width
        if 2 * width > size:
            return done
        parts = mix(parts[:-width] * np.uint64(_STEP) + parts[width:])
        width *= 2


def minimisers(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest value of each window, the last of equals; all windows if there are fewer values."""
    n = len(values)
    if n == 0:
        return np.zeros(0, "i8")
    window = min(window, n)
    best, width, at = np.arange(n), 1, window
    # Smallest of power-of-two stretches by doubling, then of two that overlap.
    while 2 * width <= window:
        a, b = best[:-width], best[width:]
        best = np.where(values[b] <= values[a], b, a)
        width *= 2
    a, b = best[: n - at + 1], best[at - width : at - width + n - at + 1]
    chosen = np.where(values[b] <= values[a], b, a)
    return np.unique(chosen)


def _heads(part: Words, min_words: int, head: int):
    """Rows, word positions and hashes of the kept suffixes of a part."""
    rows, places, codes = [], [], []
    for r in np.flatnonzero(np.diff(part.bounds) >= min_words):
        values = run_hashes(part.hashes[part.bounds[r] : part.bounds[r + 1]], head)
        at = minimisers(values, min_words - head + 1)
        rows.append(np.full(len(at), r))
        places.append(at)
        codes.append(values[at])
    if not rows:
        return (np.zeros(0, "i8"),) * 2 + (np.zeros(0, "u8"),)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(codes)


def _suffixes(texts: DataFrame, min_words: int, head: int) -> DataFrame:
    def kept(batches):
        for batch in batches:
            for part in words(batch.column(2), lower=False):
                rows, places, codes = _heads(part, min_words, head)
                at = pa.array(rows + part.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places.astype("i4")), pa.array(codes.view("i8"))], names=["id", "text_code", "place", "code"])

    return texts.mapInArrow(kept, f"id {texts.schema['id'].dataType.simpleString()}, text_code long, place int, code long")


def _contexts(texts: DataFrame, min_words: int, head: int) -> DataFrame:
    """The suffixes of each text (id, text_code, text, places of code, place and hot) with the bytes that passages around their heads can reach:
    code, hot, id, text_code, place, first (the word that these bytes begin with), begin (its place in the text), around."""
    reach = min_words - head

    def cut(batches):
        for batch in batches:
            lists = batch.column(3)
            texts_ = batch.column(2)
            for part in words(texts_, lower=False):
                rows, out = [], []
                for r in range(part.last - part.first):
                    lo, hi = part.bounds[r], part.bounds[r + 1]
                    data = texts_[part.first + r].as_py().encode()
                    starts, ends = part.starts[lo:hi], part.ends[lo:hi]
                    for x in lists[part.first + r].as_py():
                        place = x["place"]
                        first, last = max(0, place - reach), min(hi - lo, place + min_words) - 1
                        begin = int(starts[first])
                        rows.append(part.first + r)
                        out.append((x["code"], x["hot"], place, first, begin, data[begin : ends[last]]))
                at = pa.array(rows, pa.int64())
                codes, hot, places, firsts, begins, around = zip(*out) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes, pa.int64()), pa.array(hot, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int32()) for x in (places, firsts, begins)), pa.array(around, pa.binary())],
                    names=["code", "hot", "id", "text_code", "place", "first", "begin", "around"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"code long, hot boolean, id {kind}, text_code long, place int, first int, begin int, around binary")


def shared(sides: list[tuple[tuple, tuple]], lows: list, highs: list, reach: int) -> list[dict]:
    """For suffixes with one head, given by the words to the left (nearest first) and to the right of it and the smallest
    and largest id that has them: by k, the smallest id, for each k such that another id has the same k words to the
    left and reach - k to the right."""
    found: list[dict] = [{} for _ in sides]

    def search(members: list[int], low: int, high: int) -> None:
        # All members have the nearest low words to the left and reach - high to the right in common.
        if len(members) == 1:
            (x,) = members
            if lows[x] != highs[x]:
                left, right = sides[x]
                for k in range(max(low, reach - len(right)), min(high, len(left)) + 1):
                    found[x][k] = lows[x]
        elif low == high:
            first, last = min(lows[x] for x in members), max(highs[x] for x in members)
            if first != last:
                for x in members:
                    found[x][low] = first
        elif len({(lows[x], highs[x]) for x in members}) > 1 or lows[members[0]] != highs[members[0]]:
            middle = (low + high) // 2
            for side, size, a, b in ((1, reach - middle, low, middle), (0, middle + 1, middle + 1, high)):
                words_of = lambda x: sides[x][side][:size]  # noqa: B023, E731
                for key, near in groupby(sorted((x for x in members if len(sides[x][side]) >= size), key=words_of), words_of):
                    search(list(near), a, b)

    if len(sides) == 2:  # neighbours and nothing else: extend both ways
        (left, right), (left_2, right_2) = sides
        both = [next((n for n, (x, y) in enumerate(zip(*pair)) if x != y), min(map(len, pair))) for pair in ((left, left_2), (right, right_2))]
        first, last = min(lows), max(highs)
        for x in (0, 1):
            search([x], 0, reach)
            if first != last:
                found[x].update({k: first for k in range(max(0, reach - both[1]), min(reach, both[0]) + 1)})
    else:
        search(list(range(len(sides))), 0, reach)
    return found


def _split(around: bytes) -> tuple[list[int], list[int]]:
    """Where the words of some text begin and end."""
    inside = ~WHITE[np.frombuffer(around, "u1")]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view("i1"), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


_RUNS = ["id", "text_code", "word", "last_word", "begin", "end", "first_id"]


def _runs_of(kind: str) -> str:
    return f"id {kind}, text_code long, word int, last_word int, begin int, end int, first_id {kind}"


def _met(contexts: DataFrame, min_words: int, head: int) -> DataFrame:
    """Suffixes that are not hot, a head's in one task: id, text_code, word and last_word (first words of the first and the last of a
    series of repeated runs of min_words words), begin, end (bytes of all of them), first_id."""
    reach = min_words - head
    parts = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = contexts.schema["id"].dataType.simpleString()

    def compared(batches):
        held: list[tuple] = []
        ids = None

        def solved():
            classes: dict[tuple, list[int]] = {}
            for n, (_, _, _, place, first, _, around) in enumerate(held):
                classes.setdefault((place - first, b" ".join(around.split())), []).append(n)
            rows = []
            if len({x[1] for x in held}) > 1:
                same: dict[bytes, bytes] = {}  # equal words are held once
                sides = {}
                for key in classes:
                    own = [same.setdefault(w, w) for w in key[1].split(b" ")]
                    sides[key] = tuple(own[: key[0]][::-1]), tuple(own[key[0] + head :])
                order = sorted(classes, key=lambda key: sides[key][1])
                lows, highs = ([f(held[n][1] for n in classes[x]) for x in order] for f in (min, max))
                for key, by_k in zip(order, shared([sides[x] for x in order], lows, highs, reach)):
                    series = []  # consecutive passages with one first document
                    for first_id, ks in groupby(sorted(by_k, reverse=True), by_k.get):
                        for k in ks:
                            if series and series[-1][1] == k + 1 and series[-1][2] == first_id:
                                series[-1][1] = k
                            else:
                                series.append([k, k, first_id])
                    size = len(sides[key][0]) + head + len(sides[key][1])
                    for n in classes[key] if series else ():
                        _, doc, which, place, first, begin, around = held[n]
                        at = None
                        for k, last_k, first_id in series:
                            a, b = key[0] - k, key[0] - last_k
                            if a == 0 and b + min_words == size:
                                start, end = 0, len(around)
                            else:
                                at = at or _split(around)
                                start, end = at[0][a], at[1][b + min_words - 1]
                            rows.append((doc, which, first + a, first + b, begin + start, begin + end, first_id))
            held.clear()
            return rows

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [ids, pa.int64(), *[pa.int32()] * 4, ids]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=_RUNS)

        for batch in batches:
            ids, out = batch.schema.field("id").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += solved()
                held.append(row)
            yield batch_of(out)
            release()
        if held:
            yield batch_of(solved())

    rows = contexts.filter("NOT hot").select("code", "id", "text_code", "place", "first", "begin", "around")
    return rows.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(compared, _runs_of(kind))


def _apart(contexts: DataFrame, min_words: int) -> DataFrame:
    """The same for hot suffixes, from every run of min_words words around them; each row is one run."""
    kind = contexts.schema["id"].dataType.simpleString()

    def listed(batches):
        for batch in batches:
            ids = batch.schema.field("id").type
            out = []
            for doc, which, first, begin, around in zip(*(c.to_pylist() for c in batch.columns)):
                starts, ends = _split(around)
                own = [around[a:b] for a, b in zip(starts, ends)]
                for k in range(len(own) - min_words + 1):
                    digest = hashlib.blake2b(b" ".join(own[k : k + min_words]), digest_size=16).digest()
                    out.append((digest, doc, which, first + k, begin + starts[k], begin + ends[k + min_words - 1]))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.binary(), ids, pa.int64(), *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["run", "id", "text_code", "word", "begin", "end"])

    runs = contexts.filter("hot").select("id", "text_code", "first", "begin", "around").mapInArrow(listed, f"run binary, id {kind}, text_code long, word int, begin int, end int").distinct()
    runs, _ = scratch.written(runs, "hot-runs")
    many = runs.groupBy("run").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id <> last_id").select("run", "first_id")
    return runs.join(many, "run").select("id", "text_code", "word", F.col("word").alias("last_word"), "begin", "end", "first_id")


def text_code(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text, F.length(text))


def _repeated_runs(docs: DataFrame, min_words: int, head: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_code, word, last_word, begin, end, first_id: series of runs of min_words words, each of which is in several documents."""
    with scratch.last_stays(docs.sparkSession):
        return _found_runs(docs, min_words, head, id_col, text_col)


def _found_runs(docs: DataFrame, min_words: int, head: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), text_code(F.col(text_col)).alias("text_code"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    suffixes, path = scratch.written(_suffixes(texts, min_words, head), "suffixes")
    heads = suffixes.groupBy("code").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    heads = heads.filter("first_id <> last_id").select("code", (F.col("n") > HOT).alias("hot"))
    places = suffixes.join(heads, "code").groupBy("id", "text_code").agg(F.collect_set(F.struct("code", "place", "hot")).alias("places"))
    places, places_path = scratch.written(places, "places")
    scratch.drop(spark, path)  # most suffixes are in one document only: their table goes before the texts move
    found = texts.join(places, ["id", "text_code"])
    contexts, _ = scratch.written(_contexts(found.select("id", "text_code", "text", "places"), min_words, head), "contexts")
    scratch.drop(spark, places_path)
    runs, _ = scratch.written(_met(contexts, min_words, head).unionByName(_apart(contexts, min_words)).distinct(), "runs")
    return runs


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end (bytes of the text in UTF-8), n_words, first_doc_id and removable: the spans of text, of
    min_words words or more, that also stand in another document. removable is false where the span is the first copy of
    all its parts, by id. A document without such spans has no row."""
    runs = _repeated_runs(docs, min_words, head, id_col, text_col)
    per_text = runs.groupBy("id", "text_code").agg(F.collect_list(F.struct("word", "last_word", "begin", "end", "first_id")).alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()

    def merged(batches):
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                span = None
                for run in sorted(found, key=lambda x: (x["word"], x["end"])):
                    word, last, other = run["word"], run["last_word"] + min_words, run["first_id"] != doc
                    if span is None or word > span[5]:
                        if span is not None:
                            out.append(span)
                        span = [doc, run["begin"], run["end"], word, run["first_id"], last, other]
                    else:
                        span[2] = max(span[2], run["end"])
                        span[4] = min(span[4], run["first_id"])
                        span[5] = max(span[5], last)
                        span[6] |= other
                out.append(span)
            columns = list(zip(*out)) if out else [()] * 7
            sizes = [b - a for a, b in zip(columns[3], columns[5])]
            kinds = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kinds), *(pa.array(x, pa.int64()) for x in (columns[1], columns[2], sizes)), pa.array(columns[4], kinds), pa.array(columns[6], pa.bool_())],
                names=["doc_id", "begin", "end", "n_words", "first_doc_id", "removable"],
            )

    schema = f"doc_id {kind}, begin long, end long, n_words long, first_doc_id {kind}, removable boolean"
    return per_text.select("id", "runs").mapInArrow(merged, schema)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents and columns; from each text go the runs of min_words words that a document with a smaller id has too.

    What stays of a text is put together as it is, without the words cut out. A text without such runs isn't touched.
    """
    runs = _repeated_runs(docs, min_words, head, id_col, text_col).filter("first_id <> id")
    id_, code, cuts = (scratch.unused(x, docs) for x in ("cut_id", "cut_code", "cuts"))
    of = runs.groupBy(F.col("id").alias(id_), F.col("text_code").alias(code)).agg(F.collect_list(F.struct("begin", "end")).alias(cuts))
    same = (docs[id_col] == F.col(id_)) & (text_code(docs[text_col]) == F.col(code))
    marked = docs.join(of, same, "left").select(*[docs[c] for c in docs.columns], F.col(cuts))
    at = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if runs:
                    data, keep, done = text.encode(), [], 0
                    for begin, end in sorted((x["begin"], x["end"]) for x in runs):
                        if begin > done:
                            keep.append(data[done:begin])
                        done = max(done, end)
                    text = b"".join([*keep, data[done:]]).decode()
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return marked.mapInArrow(cut, docs.schema)
