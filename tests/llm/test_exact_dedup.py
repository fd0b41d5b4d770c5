import hashlib
import re

from gatelight.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, norm int"


def expected(rows):
    groups = {}
    for i, t in ((r[0], r[1]) for r in rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [
    (5, "a  b", "x", 1), (3, "a\t\nb", "y", 2), (9, "a b ", None, None), (4, None, "z", 1), (8, "", "z", 1),
    (8, "", "z", 1), (None, "a b", "q", 1), (None, "only null", "q", 1), (None, "only null", "q", 2),
    (10, " a b", "n", 0), (11, "é" * 50_000, "l", 0), (12, "é" * 50_000 + " ", "l", 0),
]


def test_groups_match_brute_force(spark):
    found = exact_dedup.exact_groups(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == expected(ROWS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == 0


def test_dropping_keeps_columns_and_one_row_each(spark):
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert left.columns == ["doc_id", "text", "keep_id", "norm"]
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == [
        (3, "a\t\nb"), (4, None), (9, "a b "), (10, " a b"), (11, "é" * 50_000), (12, "é" * 50_000 + " "),
    ]
    assert [r.text for r in left.collect() if r.doc_id is None] == ["only null"]
