import math
import random
import zlib

import pytest
from gatelight.llm import toxicity

WORDS = "the river walks over a quiet stone and sings to every small bird that path leads".split()
BAD = ["grumbolt", "snarfing", "vexlow"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 80)) + [f"w{rng.randint(0, 10**6)}"]
        rng.shuffle(words)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ing"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, None if i == 3 else int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus(600)
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    return frame, toxicity.fit(frame, spark.createDataFrame([*labels, (None, 1), (9999, 1)], "doc_id long, toxic int")), dict(labels)


def test_held_out_rows_are_told_apart(learned):
    frame, model, labels = learned
    found = toxicity.score(frame, model).collect()
    assert len(found) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and labels[r.doc_id] is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_lexicon_holds_only_the_bad_words(learned):
    assert learned[1].weights and all(any(p.strip() in b or b in p for b in BAD) for p in learned[1].weights)


def test_folding_undoes_disguise(learned):
    model = learned[1]
    auto = model.automaton()
    plain = model.strength(toxicity.fold("you grumbolt"), auto)
    for text in ("You GRUMB0LT!", "you gгumвоlt", "you ｇｒｕｍｂｏｌｔ", "you grúmbôlt...", "you gru​mbolt".replace("​", "")):
        assert model.strength(toxicity.fold(text), auto) == pytest.approx(plain), text
    assert toxicity.fold("room 101 costs 5$") == " room 101 costs 5 "


def test_exceptions_cancel_hits(learned):
    model = toxicity.Lexicon({" trash": 5.0}, ("trash can",), 10.0, -2.0)
    auto = model.automaton()
    assert model.strength(toxicity.fold("the trash can is full"), auto) == 0
    assert model.strength(toxicity.fold("you trash, can it"), auto) == 0  # folding drops signs
    assert model.strength(toxicity.fold("trash can of trash"), auto) > 0


def test_exceptions_are_learned_from_clean_rows(spark):
    # "grumbolt" is toxic but in "grumbolt can" and "class grumbolt", which clean rows have.
    docs, labels = corpus(900, 4)
    rng = random.Random(4)
    docs = [(i, t.replace("snarfing", "grumbolt").replace("vexlow", "grumbolt").replace("grumbolts", "grumbolt").replace("grumbolting", "grumbolt"), x) for i, t, x in docs]
    docs = [(i, t + " " + rng.choice(["the grumbolt can", "a class grumbolt"]) if i % 5 and rng.random() < 0.4 else t, x) for i, t, x in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string, x string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.exceptions) == {"grumbolt can", "class grumbolt"} and any("grumbolt".startswith(p.strip()[:8]) for p in model.weights)
    held = [r for r in toxicity.score(frame, model).collect() if r.held_out and dict(labels)[r.doc_id] is not None]
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)


def test_weak_words_add_up(spark):
    # No word is in toxic rows alone: "dimmel" is in each of them and in some clean ones.
    rng = random.Random(6)
    ids = [i for i in range(3000)]
    rows = [(i, " ".join([*rng.choices(WORDS, k=30), *["dimmel"] * ((i % 10 == 0) * rng.randint(2, 4) + (rng.random() < 0.03))])) for i in ids]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids], "doc_id long, toxic int"))
    assert not model.weights and list(model.weak) and all("dimmel".startswith(p.strip()) for p in model.weak)
    automaton = model.automaton()
    assert model.scores(["dimmel dimmel dimmel and a river", "a quiet river"], automaton)[0] > 0.5 > model.scores(["a quiet river"], automaton)[0]


def test_hits_match_a_naive_matcher():
    rng = random.Random(7)
    for _ in range(200):
        word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 6)))
        strong, weak = ({f" {word()}{rng.choice(['', ' '])}": rng.random() * 5 for _ in range(5)} for _ in range(2))
        weak = {p: w for p, w in weak.items() if p not in strong}
        model = toxicity.Lexicon(strong, (f"{word()} {word()}",), weak=weak)
        folded = f" {' '.join(word() for _ in range(rng.randint(1, 30)))} "
        starts = [k for k, c in enumerate(folded[:-1]) if c == " "]
        covered = {k for k in starts for p in model.exceptions for at in starts if folded.startswith(f" {p} ", at) and at <= k < at + len(p) + 1}
        expected = []
        for own in (strong, weak):
            best = [max((w for p, w in own.items() if folded.startswith(p, k)), default=0.0) for k in starts if k not in covered]
            expected.append(sum(best) / len(folded.split()) ** 0.5 if best else 0.0)
        found = model.strengths(folded, model.automaton())
        scale = (folded.count(" ") / len(folded.split())) ** 0.5
        assert [x * scale for x in found] == pytest.approx(expected)


def test_labels_that_no_word_explains(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, "another text"), (3, "a third"), (4, "a fourth")], "doc_id long, text string")
    for rows in ([(1, 1), (2, 0)], [(1, 1), (1, 0), (2, 0)], [(1, 1), (2, 0), (3, 0), (4, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def test_length_normalises(learned):
    model = toxicity.Lexicon({" bad": 5.0})
    auto = model.automaton()
    assert model.strength(" bad word ", auto) > model.strength(toxicity.fold("bad " + "word " * 500), auto) > 0


def test_edge_rows_and_dropping(spark, learned):
    frame, model, _ = learned
    rows = [(1, None, None), (2, "", "x"), (2, "", "x"), (None, "grumbolt grumbolt", "x"), (4, "quiet " * 100_000, "x")]
    edge = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = toxicity.score(edge, model).collect()
    assert [r.predicted for r in found] == [0, 0, 0, 1, 0]
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    left = toxicity.drop_toxic(edge, model)
    assert left.columns == edge.columns and sorted(map(str, left.collect())) == sorted(map(str, edge.filter("doc_id is not null").collect()))


def test_no_labels(spark, learned):
    frame = learned[0]
    for rows in ([], [(1, 0), (2, 0)], [(1, 1), (2, 1), (3, 1), (4, 1)]):
        model = toxicity.fit(frame, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(frame, model).collect()} == {int(bool(rows) and rows[0][1])}
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_rows_that_begin_alike_all_count(spark):
    docs, labels = corpus(600, 2)
    header = "All texts of this source begin with one and the same licence line, word by word. "
    frame = spark.createDataFrame([(i, header + t.replace("w", "W", i % 2)) for i, t, _ in docs] + [(i + 1000, header + t) for i, t, _ in docs], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(i + 1000, v) for i, v in labels], "doc_id long, toxic int")
    rows = toxicity._labelled(frame, marks, 20_000).collect()
    used = {(toxicity.fold(header + docs[i % 1000][1]), v) for i, v in labels + [(i + 1000, v) for i, v in labels] if v is not None and zlib.crc32(str(i).encode()) % 5}
    assert len(rows) == len(used) and {(r.folded, r.toxic) for r in rows} == used
    assert toxicity.fit(frame, marks).weights


def test_folding_reaches_all_places_of_a_word():
    for text, folded in (
        ("worthle55", "worthless"), ("worthle$$!", "worthless"), ("idio7", "idiot"), ("IDIO7!!!", "idiot"), ("1d10t", "idiot"), ("a55555b", "asssssb"), ("$$$$a", "ssssa"),
        ("idiot!", "idiot"), ("a | b", "a b"), ("room 101 costs 5$, or $500", "room 101 costs 5 or 500"), ("1,000,000", "1 000 000"), ("!" * 50_000, ""),
    ):
        assert toxicity.fold(text).strip() == folded, text


def test_short_words_can_be_learned(spark):
    docs, labels = corpus(600, 3)
    short = [(i, t.replace("grumbolt", "zug").replace("snarfing", "zug").replace("vexlow", "qi").replace("zuging", "zug").replace("zugs", "zug").replace("qiing", "qi").replace("qis", "qi")) for i, t, _ in docs]
    model = toxicity.fit(spark.createDataFrame(short, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {" zug ", " qi "} == set(model.weights)


def test_a_wide_vocabulary_is_learned_whole(spark):
    # 1,300 toxic words in 13 rows or more bring over 5,000 patterns that pass; 40 words in 9 rows pass as well.
    letters = "bcdfghjklmnprstvwxz"
    word = lambda k: letters[k % 19] + letters[k // 19 % 19] + letters[k // 361] + "oxy"
    toxic = [" ".join(word((j * 50 + n) % 1300) for n in range(50)) + f" {word(1300 + j % 40)} common{j % 7} u{j}" for j in range(360)]
    clean = [f"common{j % 7} quiet stone u{j}" for j in range(1000, 3000)]
    ids = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5][: len(toxic) + len(clean)]
    docs = spark.createDataFrame(list(zip(ids, toxic + clean)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(k < len(toxic))) for k, i in enumerate(ids)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, marks).weights
    model = toxicity.Lexicon(weights)
    automaton = model.automaton()
    assert all(model.strength(f" {word(k)} ", automaton) > 0 for k in range(1340))


def test_phrases_by_chance_are_no_exceptions():
    assert abs(toxicity._by_chance(10, 10, 0, 5) - math.log10(math.comb(10, 5) / math.comb(20, 5))) < 1e-12
    assert toxicity._by_chance(10, 10, 5, 0) == 0.0 and toxicity._by_chance(2, 100, 0, 6) > -1


def test_conflicting_labels_and_several_texts_of_one_id(spark):
    """The highest label of an id counts, and of its texts the least one; repeated rows say nothing new."""
    docs = [(k, f"plain words number {k} here") for k in range(40)] + [(100 + k, f"you {w} grumbolt {k}") for k, w in enumerate("silly nasty awful dull odd".split() * 6)]
    labels = [(k, 0, 0) for k, _ in docs] + [(k, 0, 1) for k, _ in docs if k >= 100]
    schemas = "doc_id long, text string", "doc_id long, quality int, toxic int"
    plain = toxicity.fit(spark.createDataFrame(docs, schemas[0]), spark.createDataFrame([(k, 0, int(k >= 100)) for k, _ in docs], schemas[1]))
    more = docs + docs + [(100 + k, f"zzz later text {k}") for k in range(30)]
    mixed = toxicity.fit(spark.createDataFrame(more, schemas[0]), spark.createDataFrame(labels, schemas[1]))
    assert plain.weights and mixed == plain
