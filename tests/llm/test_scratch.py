import os
import threading

import pytest
from gatelight.llm import near_dedup, scratch, suffix_dedup
from gatelight.sources import shared


def tables(spark):
    return {x for x in os.listdir(scratch.root(spark)) if not x.startswith(".")}


def test_finished_tables_go(spark):
    words = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(i, f"{words} {'x' * i}") for i in range(6)], "doc_id long, text string")
    for run in (near_dedup.near_groups, suffix_dedup.repeated_spans):
        before = tables(spark)
        out = run(docs)
        assert len(tables(spark) - before) == 1 and out.count() == 6


def test_tables_of_inner_blocks(spark):
    df, before = spark.range(3), tables(spark)
    with scratch.last_stays(spark):
        scratch.written(df, "one")
        with scratch.last_stays(spark):
            scratch.written(df, "two")
            inner, _ = scratch.written(df, "three")
        assert inner.count() == 3
        last, path = scratch.written(inner, "four")
    assert tables(spark) - before == {path.rsplit("/", 1)[-1]} and last.count() == 3
    with pytest.raises(RuntimeError), scratch.last_stays(spark):
        scratch.written(df, "five")
        raise RuntimeError
    assert not shared._scopes.get() and scratch.unused("id", spark.range(1)) == "id_"


def test_threads_have_their_own_blocks(spark):
    """What one thread writes isn't dropped when another one's block ends."""
    begun, ended = threading.Event(), threading.Event()
    kept = []

    def other():
        with scratch.last_stays(spark):
            begun.set()
            ended.wait(60)
            kept.append(scratch.written(spark.range(3), "b")[0].count())

    thread = threading.Thread(target=other)
    thread.start()
    begun.wait(60)
    with scratch.last_stays(spark):
        scratch.written(spark.range(2), "a")
        last, _ = scratch.written(spark.range(5), "last")
    ended.set()
    thread.join(60)
    assert kept == [3] and last.count() == 5
