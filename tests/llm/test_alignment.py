import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gatelight.llm import alignment
from gatelight.llm.tokens import byte_letters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, pair int, block string, docs int"
TEXTS = [
    "Plain words, and some numb3rs 12345.", None, "", " ", "   two  spaces \n\n\tand lines\r\n", "<|endoftext|> </s> <unk> <s>", "déjà vu – naïve café ﬁ Å", "日本語 テキスト 🙂👍🏽", "a▁b", "▁",
    "unbrokenword" * 3000, "x" * 5000, "Plain words, and some numb3rs 12345.", "the cat the cat the cat", "\x00\x01\x1c\x1d a\x1fb", "don't can't I'll", "trailing   ", "퟿", " é" * 400,
]


def brute(texts):
    own, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own.encode_special_tokens = True
    value = {c: k for k, c in enumerate(byte_letters())}
    docs = []
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(value[c] for c in own.id_to_token(i))) for i in own.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
            full = (" " + text).encode()
            if b"".join(x for _, x in a) != full or b"".join(x for _, x in b) != full:
                a = b = []
        spans = []
        for tokens in (a, b):
            at, own_spans = 0, []
            for i, raw in tokens:
                own_spans.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own_spans)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        ids = lambda side, low, high: ",".join(str(i) for i, s, e in spans[side] if low <= s and e <= high)
        groups = ";".join(f"{ids(0, low, high)}|{ids(1, low, high)}" for low, high in zip([0, *cuts], cuts))
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        docs.append((len(a), len(b), len(cuts), links, groups))
    counts = Counter(pair for *_, links, _ in docs for pair in set(links))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = [(n_a, n_b, n, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, n, links, g in docs]
    return rows, [d[-1] for d in docs], counts, best


def frame(spark, texts):
    return spark.createDataFrame([(k if k % 7 else None, t, "n", 1, None, None) for k, t in enumerate(texts)], SCHEMA)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    rows, groups, counts, best = brute(TEXTS)
    texts = frame(spark, TEXTS) if size > 40 else frame(spark, TEXTS).coalesce(1)
    alignment._made.clear()
    found, pairs = alignment.align(texts, *PATHS, groups=True)
    want = [((k if k % 7 else None), *row, group) for k, (row, group) in enumerate(zip(rows, groups))]
    assert sorted(map(tuple, found.select("doc_id", *COLUMNS, "groups").collect()), key=repr) == sorted(want, key=repr)
    assert {(r.a_id, r.pair & 0xFFFF, r.n_docs, r.best) for r in pairs.collect()} == {(a, b, n, n == best[a]) for (a, b), n in counts.items()}


def test_slices_of_one_text(monkeypatch):
    """Slices end where both tokenizers end a token, and links of one text in many slices count once."""
    text = TEXTS[0] * 50
    whole = alignment.Aligner(*PATHS)
    tokens = whole.tokens([" " + text])
    found = []
    for size in (1 << 20, 64):
        monkeypatch.setattr(alignment, "SLICE", size)
        whole.begin()
        found.append([*whole.align(*tokens), *whole.links()])
    one, many = found
    assert all((x == y).all() for x, y in zip(one, many)) and len(list(alignment._cuts(*[v.sizes[i].cumsum() for v, i in ((whole.a_bytes, tokens[0]), (whole.b_bytes, tokens[2]))]))) > 10


def test_given_documents_and_empty_table(spark):
    folder = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(folder)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    found = alignment.align(docs, *PATHS)[0]
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert list(map(tuple, found.orderBy("doc_id").select(*COLUMNS).collect())) == brute(texts)[0]
    assert alignment.align(spark.createDataFrame([], SCHEMA), *PATHS)[0].count() == 0
