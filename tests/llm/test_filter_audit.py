import re
from itertools import permutations

from gatelight.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, word string, part int, good string, C int"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (5, LONG, "x", None, 1, "g", 0), (3, LONG, "y", "w", 1, "g", 0), (9, LONG, None, None, None, None, None), (9, LONG, "", None, 1, None, 1),
    (None, LONG, "x", "w", 1, "g", 1), (4, None, "x", "w", 1, "g", 1), (8, "", "x", "w", 1, "g", 1), (8, "", "x", "w", 1, "g", 1),
    (10, "AAA " * 80, "x", "w", 1, "g", 1), (11, "a b c " * 40_000 + "$", "z", "w", 1, "g", 1), (12, " \t\x0b\x0c\r\n x#", "z", None, 1, "g", 1),
    (13, "Ab " * 10 + LONG, "z", None, 1, "g", 1), (14, " \t\n", "z", None, 1, "g", 1), (15, LONG + "|", "x", None, 1, "g", 1),
]
MARKS = [(5, 1, 0, "p"), (5, 0, 1, "p"), (9, 1, 1, "p"), (None, 1, 1, "p"), (12, 0, 1, None), (77, 1, 1, "p"), (8, None, None, "p"), (11, 0, None, "p")]


def failed(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": any(c in text for c in "#$%&*|"),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows),
    }


def expected(rows, marks):
    docs = []
    for i, text, source, *_ in rows:
        mine = [m for m in marks if i is not None and m[0] == i]
        docs.append((source or "", failed(text or "", i, rows), any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                lost = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                own = [d for d in docs if d[0] == part and d[1][letter]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), len(own) - len(lost), sum(sum(d[1].values()) == 1 for d in own), sum(d[2] for d in lost), sum(d[3] for d in lost)]
    return sorted((part, order, step, *values, shapley[part, order[step - 1]]) for (part, order, step), values in out.items())


def audit(spark, rows, marks):
    return filter_audit.interactions(filter_audit.failures(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(marks, LABELS))


def test_all_orders_match_brute_force(spark):
    found = audit(spark, ROWS, MARKS)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = sorted(map(tuple, found.collect()))
    assert rows == expected(ROWS, MARKS) and len(rows) == 4 * 600
    assert any(r[-1] for r in rows) and any(r[7] for r in rows)


def test_repeated_table_doubles_counts_without_copies(spark):
    once = [(k, f"{LONG} {k} {'$' * (k % 2)}", "s", None, None, None, None) for k in range(6)]
    one, two = (sorted(map(tuple, audit(spark, rows, MARKS).collect())) for rows in (once, once + once))
    assert [tuple(2 * x for x in r[3:]) for r in one] == [r[3:] for r in two]


def test_empty_tables(spark):
    assert audit(spark, [], MARKS).count() == 0
    assert {r.good_lost for r in audit(spark, ROWS, []).collect()} == {0}


def test_other_filters(spark):
    rows = spark.createDataFrame([(1, "p", True, True), (2, "p", False, True), (3, "p", False, False)], "doc_id long, part string, X boolean, Y boolean")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.interactions(rows, spark.createDataFrame([], LABELS), "XY").collect()}
    assert found == {("XY", 1): (2, 1, 0, 1), ("XY", 2): (1, 1, 1, 3), ("YX", 1): (1, 2, 0, 3), ("YX", 2): (1, 0, 1, 1)}


def test_same_rows_as_sql(spark):
    import duckdb

    from gatelight.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op12_filter_audit"])
    found = queries.QUERIES["op12_filter_audit"](spark, folder)
    assert sorted(map(tuple, found.select(*sql.columns).collect())) == sorted(sql.fetchall())
