import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from gatelight.llm import toxicity
from tokenizers import Tokenizer

from tests.llm import test_near_dedup, test_suffix_dedup, test_toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled documents, and among them copies, near copies and shared passages."""
    rng = random.Random(12)
    docs, labels = test_toxicity.corpus(120, seed=3)
    rows = [(i, t) for i, t, _ in docs]
    word = lambda: f"u{rng.randint(0, 5000)}"
    passage = [word() for _ in range(70)]
    for i in range(12):
        rows.append((1000 + i, " ".join([word() for _ in range(200)] + passage + [word() for _ in range(i)])))
    near = [word() for _ in range(150)]
    for i in range(6):
        near[rng.randrange(150)] = word()
        rows.append((2000 + i, " ".join(near)))
    rows += [(3000, rows[-1][1]), (3001, rows[-1][1].replace(" ", "\n ")), (3002, None), (3003, "")]
    rng.shuffle(rows)
    at = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_stages_in_turn_match_brute_force(spark, folder, tmp_path):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, texts = docs.columns, dict(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            check_pieces(out.collect(), texts)
            break
        assert out.columns == columns
        left = {r.doc_id: r for r in out.collect()}
        assert len(left) == out.count()
        if name == "toxicity":
            bad = {i for i, t in texts.items() if any(b in (t or "") for b in test_toxicity.BAD)}
            expected = {i: t for i, t in texts.items() if i not in bad}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(texts):
                first.setdefault(" ".join((texts[i] or "").split()), i)
            expected = {i: texts[i] for i in first.values()}
        elif name == "near_dedup":
            kept = {r[0] for r in test_near_dedup.brute_force(list(texts.items()), 5, 80) if r[3]}
            expected = {i: texts[i] for i in kept}
        else:
            _, later = test_suffix_dedup.brute_force(list(texts.items()), 50)
            assert later
            for i, t in texts.items():
                words = [w for j, w in enumerate((t or "").split()) if j not in later.get(i, ())]
                assert (left[i].text or "").split() == words and left[i].n_chars in (None, len(left[i].text or ""))
            expected = {i: left[i].text for i in texts}
        assert {i: r.text for i, r in left.items()} == expected, name
        assert name == "suffix_dedup" or len(expected) < len(texts)
        docs, texts = out, expected


def check_pieces(pieces, texts):
    """Every id of every text, by the library, is in just one piece; sequences have no gaps and only powers of two are short."""
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.encode_special_tokens = True
    assert {r.doc_id for r in pieces} == set(texts)
    filled = {}
    for r in pieces:
        ids = [*own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids) and len(part) == r.length > 0 and r.ids_crc32 == zlib.crc32(part.tobytes())
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == total.get(r.doc_id, 0)
        total[r.doc_id] = r.start + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_run_is_the_stages_in_turn(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus_pipeline.run(spark, at)) == rows(docs)


def test_odd_tables(spark, tmp_path):
    """No rows; and null ids, repeated ids and rows, null texts, and columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, cuts int, kept boolean, own_sha string, cut_id int, dropped int, id long, toxic int"
    rest = ("en", "s", 3, 1, True, "x", 2, 3, 4, 5)
    other = lambda c: " ".join(f"{c}{i}" for i in range(80))
    words = other("w")
    rows = [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, words), (3, words), (3, "a second text of 3"), (4, f"{words} {other('y')}"), (5, f"ü {other('z')} {words}"), (6, "long " * 30_000)]
    for name, own in (("none", []), ("odd", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([r + rest for r in own], schema).repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        found = corpus_pipeline.run(spark, at).collect()
        left = [r for r in found if r.start == 0]
        assert all(r.length > 0 for r in found) and bool(found) == bool(own)
        if own:
            # 1 and 2 are both empty, as is the row without an id; the long text and the others are like none.
            assert sorted(str(r.doc_id) for r in left) == sorted(["None", "1", "3", "3", "4", "5", "6"]), found
