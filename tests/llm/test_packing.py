import itertools
import random

import numpy as np
import public_tokenizers as P
from gatelight.llm import packing
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")


def test_hilbert_keys_visit_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(len(points)))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(pieces, rows, length):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    per_doc, per_sequence = {}, {}
    for r in pieces:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        per_doc.setdefault(r.doc_id, []).append((r.start, got))
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in per_doc.items():
        assert [x for _, p in sorted(parts) for x in p] == ids[i]
    assert set(per_doc) == set(ids)
    sizes = []
    for parts in per_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == length or (s < length and s & (s - 1) == 0) for s in sizes) and sum(sizes) == sum(map(len, ids.values()))


def test_pieces_hold_every_id_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("river town old bird stone Quiet école 12 ***".split(), k=rng.randint(0, 90)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "long text " * 20_000), *((2000 + i, "copy of a text") for i in range(40))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int").repartition(5)
    check(packing.pack(docs, PATH).collect(), rows, 2048)
    check(packing.pack(docs.limit(0), PATH).collect(), [], 2048)


def test_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c"), (None, None)], "doc_id long, text string")
    found = packing.digests(packing.pack(docs, PATH, length=4)).collect()
    assert sum(r.length for r in found) == 2 + 2 + 3 + 1 and len({(r.sequence_id, r.offset) for r in found}) == len(found)


def test_alike_documents_are_neighbours(spark):
    rng = random.Random(6)
    kinds = [[f"{c}{k}" for k in range(30)] for c in "abcd"]
    rows = [(i, " ".join(rng.choices(kinds[i % 4], k=200))) for i in range(80)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    order = [r.doc_id % 4 for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.6 * len(order)
