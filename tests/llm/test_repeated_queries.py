"""Query rows that are repeated, or share an id."""

from pyspark.sql import functions as F

from vecloom.llm import ann

ROWS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 3.0]), (None, [1.0, 1.0])]


def answers(spark, rows):
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2)
    return sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())


def test_a_repeated_query_is_answered_once(spark):
    assert answers(spark, ROWS) == [(0, 1, 1), (0, 2, 2)]


def test_queries_of_one_id_have_k_each(spark):
    assert answers(spark, [*ROWS, (0, [0.0, 4.0])]) == [(0, 1, 1), (0, 1, 3), (0, 2, 2), (0, 2, 2)]
