"""Operators at once in one session, and what a failure leaves behind."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from lectern.llm import line_dedup
from lectern.llm.common import scope, written
from lectern.sources.tables import shared_dir

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_operators_in_threads_of_one_session(spark):
    queries = entry.queries()
    names = ["op2_mix", "op6_line_dedup", "op7_main_text", "op8_near_dup", "op13_vector_codes", "pipeline"]
    alone = {n: rows(queries[n](spark, SF)) for n in names}
    with ThreadPoolExecutor(len(names)) as pool:
        together = dict(zip(names, pool.map(lambda n: rows(queries[n](spark, SF)), names)))
    assert {n: together[n] == alone[n] for n in names} == dict.fromkeys(names, True)


def test_inner_scopes_and_kept_tables(spark):
    there = lambda df: os.path.isdir(df._written_to.removeprefix("file:"))
    one = spark.range(3)
    with scope(spark):
        a = written(one, "a")
        with scope(spark) as kept:
            b, c = kept(written(one, "b")), written(one, "c")
        assert there(a) and there(b) and not there(c)
    assert not there(a) and not there(b)


def test_failing_batch_leaves_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a line of document {k % 7}\nanother line {k}") for k in range(40)], "doc_id long, text string")
    before = line_dedup.LineRuns.add
    calls = []

    def add(self, lines):
        calls.append(1)
        if len(calls) == 3:
            self._write(lines.groupBy("hash").agg({"id": "min"}).withColumnRenamed("min(id)", "owner").repartition(self.buckets, "hash"))
            raise RuntimeError("lost")
        return before(self, lines)

    monkeypatch.setattr(line_dedup.LineRuns, "add", add)
    folder = f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}".removeprefix("file:")
    there, tables = set(os.listdir(folder)) if os.path.isdir(folder) else set(), {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(docs)
    assert set(os.listdir(folder)) == there and {t.name for t in spark.catalog.listTables()} == tables
