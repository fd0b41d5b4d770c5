import random

import numpy as np
import pytest
from gatelight.llm import suffix_dedup as S


def brute_force(rows, size):
    """Per document the words covered by runs of size words that are in another document too."""
    where = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            where.setdefault(tuple(w[k : k + size]), set()).add(i)
    covered, later = {}, {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            ids = where[tuple(w[k : k + size])]
            if len(ids) > 1:
                covered.setdefault(i, set()).update(range(k, k + size))
                if min(ids) != i:
                    later.setdefault(i, set()).update(range(k, k + size))
    return covered, later


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"é{rng.randint(0, 3000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 85, 120, 300)]
    rows = []
    for i in range(90):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [word() for _ in range(rng.randint(0, 60))]
            p = rng.choice(passages)
            cut = rng.randint(0, max(0, len(p) - 45)) if rng.random() < 0.5 else 0
            text += p[cut:]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    w = [word() for _ in range(55)]
    return [*rows, (200, " ".join(w + ["x"] + w)), (201, None), (202, ""), (203, "a " * 70_000), (204, "b")]


@pytest.mark.parametrize("hot", [S.HOT, 5])
def test_spans_and_cuts_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(3)
    texts = dict(rows)
    covered, later = brute_force(rows, 50)
    found = {}
    for r in S.repeated_spans(docs).collect():
        data = texts[r.doc_id].encode()
        first = len(data[: r.begin].split())
        assert r.n_words == len(data[r.begin : r.end].split()) >= 50
        assert r.first_doc_id <= r.doc_id and (r.removable or r.first_doc_id == r.doc_id)
        found.setdefault(r.doc_id, set()).update(range(first, first + r.n_words))
    assert found == covered
    left = {r.doc_id: r for r in S.drop_repeats(docs).collect()}
    assert len(left) == len(rows)
    for i, t in rows:
        words = (t or "").split()
        assert (left[i].text or "").split() == [w for k, w in enumerate(words) if k not in later.get(i, ())]
        if i not in later:
            assert left[i].text == t


def test_edge_tables(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long), (1, long), (None, long), (2, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.repeated_spans(docs).count() == 0 and S.drop_repeats(docs).count() == 4
    assert S.repeated_spans(docs.limit(0)).count() == 0 and S.drop_repeats(docs.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    rng = random.Random(5)
    passage = " ".join(f"é{rng.randint(0, 999)}" for _ in range(60))
    rows = [(1, f"{passage} one"), (2, None), (2, f"ü ü {passage}  two"), (2, "short é text"), (2, f"{passage} and more of it, {passage}"), (3, ""), (3, passage), (3, passage), (None, passage)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, cut_id int, cuts string").repartition(3)
    left = S.drop_repeats(docs)
    assert left.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert found == sorted([(1, f"{passage} one"), (2, None), (2, "ü ü   two"), (2, "short é text"), (2, " and more of it, "), (3, ""), (3, ""), (3, ""), (None, passage)], key=str)
    spans = sorted((r.doc_id, r.begin, r.n_words, r.removable) for r in S.repeated_spans(docs).collect())
    again = len(f"{passage} and more of it, ".encode())
    assert spans == [(1, 0, 60, False), (2, 0, 60, True), (2, 6, 60, True), (2, again, 60, True), (3, 0, 60, True)]


def test_matches_by_both_sides():
    rng = random.Random(9)
    for _ in range(300):
        reach, n = rng.choice([1, 2, 5, 8]), rng.randint(1, 12)
        side = lambda: tuple(rng.choice("ab") if rng.random() < 0.3 else "a" for _ in range(rng.randint(0, reach)))
        sides = list({(side(), side()) for _ in range(n)})
        lows = [rng.randint(0, 5) for _ in sides]
        highs = [x + rng.choice([0, 0, 1]) for x in lows]
        expected = []
        for left, right in sides:
            own = {}
            for k in range(reach + 1):
                same = [j for j, (a, b) in enumerate(sides) if len(left) >= k and len(right) >= reach - k and a[:k] == left[:k] and len(a) >= k and b[: reach - k] == right[: reach - k] and len(b) >= reach - k]
                if same and min(lows[j] for j in same) != max(highs[j] for j in same):
                    own[k] = min(lows[j] for j in same)
            expected.append(own)
        assert S.shared(sides, lows, highs, reach) == expected


def test_minimisers_and_runs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 31, 32, 33, 100):
        values = rng.integers(0, 20, n).astype("u8")
        w = min(31, n)
        expected = {max(range(k, k + w), key=lambda j: (-int(values[j]), j)) for k in range(n - w + 1)}
        assert S.minimisers(values, 31).tolist() == sorted(expected)
    h = rng.integers(0, 2**63, 40).astype("u8")
    runs = S.run_hashes(np.concatenate([h, h]), 20)
    assert len(runs) == 61 and (runs[:21] == runs[40:]).all() and len(set(runs.tolist())) == 40
