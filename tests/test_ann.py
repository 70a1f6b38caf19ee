"""The inverted file: recall against all pairs, exactness with all lists, pruning of partitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import ann, retrieval
from lectern.plans import queries


def results(df):
    return {(r.question_id, r["rank"]): (r.collection, r["index"], round(r.score, 6)) for r in df.collect()}


def exact(vectors, questions, metric="l2"):
    return results(retrieval.merged(retrieval.scored(vectors, questions, top=retrieval.TOP, metric=metric)))


def data(spark, n=900, dim=12):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, dim))
    rows = [(int(k % 7), k, (centers[k % 30] + 0.25 * rng.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)] + [(1, 5000, None)]
    vectors = spark.createDataFrame(rows, "content_hash int, chunk_index int, embedding array<float>").repartition(3)
    questions = vectors.where("chunk_index % 50 = 0").select(F.col("chunk_index").alias("question_id"), "embedding")
    return vectors, questions


def test_all_lists_are_exact_and_few_find_nearly_all(spark, tmp_path):
    vectors, questions = data(spark)
    index = ann.build(vectors, str(tmp_path / "index"), lists=25)
    want = exact(vectors, questions)
    assert results(ann.search(questions, index, probes=25)) == want
    got = results(ann.search(questions, index, probes=4))
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)
    assert spark.read.parquet(index.path).count() == 900 and index.centroids.shape == (25, 12)


def test_only_probed_partitions_are_read(spark, tmp_path):
    vectors, questions = data(spark)
    index = ann.build(vectors, str(tmp_path / "index"), lists=20)
    asked = ann.probed(questions.where("question_id = 0"), index.centroids, 2)
    rows = ann.opened(spark, index, asked)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    lists = sorted(r[0] for r in asked.select("list").collect())
    assert len(lists) == 2 and "PartitionFilters: [list#" in plan and f"IN ({lists[0]},{lists[1]})" in plan
    assert {r[0] for r in rows.select("list").distinct().collect()} == set(lists)


def test_small_sample_ties_and_empty_tables(spark, tmp_path):
    same = spark.createDataFrame([(k % 3, k, [1.0, 0.0]) for k in range(40)], "content_hash int, chunk_index int, embedding array<float>")
    index = ann.build(same, str(tmp_path / "same"), lists=8, sample=5)
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id int, embedding array<float>")
    assert len(index.centroids) == 1 and results(ann.search(questions, index)) == exact(same, questions)
    none = ann.build(same.where("false"), str(tmp_path / "none"))
    assert none.centroids.size == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_recall_on_the_given_vectors(spark, tmp_path, metric):
    sf_dir = "/root/testdata/sf0.1"
    vectors, questions = queries.vectors(spark, sf_dir), queries.many_vectors(spark, sf_dir)
    index = ann.build(vectors, str(tmp_path / "index"), metric=metric)
    want = exact(vectors, questions, metric)
    got = results(ann.search(questions, index, metric=metric))
    found = sum(v in {got.get((q, r)) for r in range(1, 6)} for (q, _), v in want.items()) / len(want)
    print(f"recall@5 {metric}: {found:.3f}, {index.probes} of {len(index.centroids)} lists")
    assert found >= 0.9


def test_slices_bound_what_lists_make_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"embedding": [[float(k), 1.0] for k in range(5000)]})
    made = [*ann._slices(iter([batch, batch.slice(0, 0)]), 1024)]
    assert max(b.num_rows for b in made) * 1024 <= ann.AT_ONCE
    assert np.array_equal(np.concatenate([ann._matrix(b.column("embedding")) for b in made]), ann._matrix(batch.column("embedding")))
    assert [b.num_rows for b in ann._slices(iter([batch.slice(0, 3)]), 10 * ann.AT_ONCE)] == [1, 1, 1]
