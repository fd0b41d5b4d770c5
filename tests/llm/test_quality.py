import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from gatelight.llm import quality
from gatelight.llm.text import words


def corpus(n):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = rng.choices("a river runs by the old town".split() if good else "buy*** now&&& cheap%%% click$$$ the".split(), k=rng.randint(3, 60))
        rows.append((i, " ".join(words), 0.0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_good_documents_are_drawn(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.resample(docs, marks, share=0.75).collect()}
    assert len(found) == 400 and sum(r.kept for r in found.values()) == 300
    good = [i for i in found if i % 4 != 0]
    assert sum(found[i].kept for i in good) >= 0.95 * len(good)
    again = {r.doc_id: r.kept for r in quality.resample(docs.repartition(2), marks, share=0.75).collect()}
    assert again == {i: r.kept for i, r in found.items()}


def test_weights_match_brute_force(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key double")
    ratios = np.random.default_rng(1).normal(size=quality.BUCKETS)
    for r in quality.weights(docs, ratios).collect():
        part = next(words(pa.array([rows[r.doc_id][1]]), True))
        codes, _ = quality._grams(part)
        n = len(rows[r.doc_id][1].split())
        assert r.n_grams == len(codes) == 2 * n - 1 and abs(r.log_weight - quality.LENGTH * ratios[codes].mean()) < 1e-9


def test_models_and_draw_match_brute_force(spark):
    rows, labels = corpus(300)
    grams = lambda text: [*(w := text.split()), *zip(w, w[1:])]
    target, raw = Counter(), Counter()
    good = {i for i, q in labels if q}
    for i, text, _ in rows:
        raw.update(grams(text))
        target.update(grams(text) if i in good else ())
    shown = [g if isinstance(g, str) else " ".join(g) for g in raw]
    place = {}
    for gram, text in zip(raw, shown):
        codes, _ = quality._grams(next(words(pa.array([text]), True)))
        place[gram] = int(codes[-1])
    assert len(set(place.values())) == len(place)  # no bucket holds two, so buckets are n-grams
    docs = spark.createDataFrame(rows, "doc_id long, text string, key double").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    ratios = quality.fit(docs, marks)
    size = quality.BUCKETS
    ratio = {g: math.log((target[g] + 1) / (target.total() + size)) - math.log((raw[g] + 1) / (raw.total() + size)) for g in raw}
    assert all(abs(ratios[place[g]] - x) < 1e-9 for g, x in ratio.items())
    found = {r.doc_id: r for r in quality.resample(docs, marks, share=0.4).collect()}
    noise = []
    for i, text, _ in rows:
        own = [ratio[g] for g in grams(text)]
        assert abs(found[i].log_weight - quality.LENGTH * sum(own) / len(own)) < 1e-6
        noise.append(found[i].key - found[i].log_weight)
    first = sorted(found.values(), key=lambda r: -r.key)[:120]
    assert {r.doc_id for r in first} == {i for i, r in found.items() if r.kept}
    # Noise has the shape of -log(-log(u)): mean 0.577, standard deviation 1.283.
    assert abs(np.mean(noise) - 0.577) < 0.25 and abs(np.std(noise) - 1.283) < 0.25


def test_labels_that_were_not_fitted(spark):
    # Fitted on one half of the labels, told apart on the other.
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.weights(docs, quality.fit(docs, labels.filter("doc_id % 2 = 0"))).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.log_weight for r in found if r.quality == q] for q in (1, 0))
    area = np.mean([(np.array(good) > x).mean() for x in bad])
    assert len(bad) > 10 and area > 0.98, area


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=500).tolist(), [1.0] * 50, [1.0, 2.0] * 20, [0.0, 1e-300, 1e300], [5.0]):
        frame = spark.createDataFrame([(float(v),) for v in values], "key double")
        for k in {1, 2, len(values) // 2 + 1, len(values)}:
            assert quality.kth_largest(frame, k) == sorted(values)[-min(k, len(values))], (values[:3], k)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, None), (3, "x " * 50_000), (3, "dup"), (3, "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.resample(docs, marks).collect()
    assert len(found) == 7 and all(r.kept and r.log_weight == 0 for r in found)
    assert quality.resample(docs.limit(0), marks).count() == 0
