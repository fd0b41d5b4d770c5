import random
import re

import numpy as np
import pyarrow as pa
import pytest
from gatelight.llm import near_dedup, text


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        out.setdefault(i, []).append(own)
    return out


def brute_force(rows, size, percent):
    sets = [(i, s) for i, many in sets_of([r for r in rows if r[0] is not None], size).items() for s in many]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    flat = sets_of([(k, t) for k, (_, t) in enumerate(rows)], size)
    return sorted(((i, len(flat[k][0]), None if i is None else find(i), i is None or find(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.6:
            words = list(rng.choice(made[-40:]))
            for _ in range(rng.randint(0, max(1, len(words) // 14))):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
        else:
            words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))]
        made.append(words)
        rows.append((i * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(words).replace("w1", rng.choice(["w1", "W1"]))))
    return rows


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "é É"), (9, "é é"), (None, "one"), (None, None),
        (10, "same id here now"), (10, "other text of it"), (11, "same id here now"), (12, "other text of it"), (12, "other text of it"), (13, "x " * 60_000)]


@pytest.mark.parametrize(("size", "percent", "rows"), [(3, 85, corpus(1)), (5, 80, EDGE)])
def test_components_match_brute_force(spark, size, percent, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n int").repartition(5)
    found = sorted(map(tuple, near_dedup.near_groups(docs, size, percent).collect()), key=str)
    assert found == brute_force(rows, size, percent)


def test_large_group_around_a_centre(spark):
    rng = random.Random(4)
    centre = [f"w{rng.randint(0, 10_000)}" for _ in range(150)]
    rows = [(500, " ".join(centre))]
    for i in range(160):
        words = list(centre)
        for at in rng.sample(range(150), rng.randint(1, 9)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_groups(docs, 3, 85).collect()), key=str) == brute_force(rows, 3, 85)


def test_repeated_rows_lose_no_link(spark, monkeypatch):
    # Pairs at 0.851 in one bucket whose first pivot, 99, is like none of them: only their differences can link them.
    rows = [(98, "one more text that is like none"), (99, "a text that is like no other")]
    for k in range(6):
        words = [f"w{k}-{i}" for i in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(f"x{w}" if i % 30 == 5 and i < 240 else w for i, w in enumerate(words)))]
    rows += [(i, t.replace(" ", "  ")) for i, t in rows]
    docs = spark.createDataFrame(rows, "id long, text string")
    members = spark.createDataFrame([(1, i, 298) for i in [*range(12), 99]] + [(2, 98, 298), (2, 99, 298)], "key long, id long, n long")
    turns, own = [], near_dedup._may_link
    monkeypatch.setattr(near_dedup, "_may_link", lambda *a: turns.append(1) or own(*a))
    labels = near_dedup._link(members, near_dedup._sets(docs, 3), spark.createDataFrame([], "a long, b long"), 85)
    found = {r.node: r.component for r in labels.collect()}
    assert turns and [(i, found.get(i, i)) for i, *_ in brute_force(rows, 3, 85)] == [(i, c) for i, _, c, _ in brute_force(rows, 3, 85)]
    assert found[1] == 0


def family(seed, n, changes, centre=None, length=150):
    """Texts that each change some words of one text, which is among them only if it is asked for."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(length)]
    rows = [] if centre is None else [(centre, " ".join(base))]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(length), changes(rng)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(
    ("n", "changes", "centre", "share"),
    [(300, lambda rng: rng.randint(5, 8), None, 0.05), (200, lambda rng: 4, None, 0.15), (250, lambda rng: rng.randint(1, 9), 900, 0.1), (120, lambda rng: rng.randint(0, 4), 900, 0.3)],
)
def test_pairs_grow_with_links(spark, monkeypatch, n, changes, centre, share):
    rows = family(n, n, changes, centre)
    tried, own = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a: tried.append(pairs.count()) or own(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, near_dedup.near_groups(docs, 3, 85).collect()), key=str)
    assert found == brute_force(rows, 3, 85)
    assert sum(tried) < share * n * n / 2


def test_components_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "EDGES", 40)
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(90)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_dropping_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e f", 1, "x"), (1, "A b c d e f", 2, "x"), (2, "other words than these are", 3, "x"), (None, "a b c d e f", 4, "x"), (4, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, dropped string")
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.kept for r in left.collect()) == [2, 3, 4, 5]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900, dtype="u8")
    sets = np.concatenate([a[:600], a[300:900], a[:5]])
    s = near_dedup.superminhash(sets, np.array([0, 600, 1200, 1205, 1205]), 128)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.13
    assert (s[2] != np.iinfo("u8").max).all() and (s[3] == np.iinfo("u8").max).all()
    assert (near_dedup.superminhash(a[:5], np.array([0, 5]), 128)[0] == s[2]).all()


def test_words_and_positions():
    column = pa.array(["", "Ab  cd\ne", None, " x ", "ab", "éa"])
    parts = list(text.words(column, lower=True))
    assert len(parts) == 1
    p = parts[0]
    assert p.of.tolist() == [1, 1, 1, 3, 4, 5] and p.starts.tolist() == [0, 4, 7, 1, 0, 0] and p.ends.tolist() == [2, 6, 8, 2, 2, 3]
    assert p.hashes[0] == p.hashes[4] and len(set(p.hashes.tolist())) == 5
    assert list(text.words(column.slice(4, 1), lower=False))[0].hashes[0] == p.hashes[4]
