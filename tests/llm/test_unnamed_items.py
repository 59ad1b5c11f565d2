"""Benchmark items without an id, against the operator's own SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm import SF

from vecloom.llm import decontaminate, queries


@pytest.mark.parametrize("bound", [100_000, 0])
def test_items_without_an_id_hit(spark, bound):
    items = spark.createDataFrame([(1, "alpha beta"), (None, "gamma delta"), (None, "beta gamma"), (2, "gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x alpha beta y"), (2, "x beta gamma y"), (3, "x gamma delta"), (4, "alpha beta gamma"), (5, "x"), (6, None)], "doc_id long, text string")
    got = decontaminate.find_contamination(df, items, literal_windows=bound, unnamed=True)
    assert {r.doc_id: (r.n_hit, list(r.item_ids), r.contaminated) for r in got.collect()} == {1: (2, ["1"], True), 2: (2, [], True), 3: (2, ["2"], True), 4: (3, ["1"], True), 5: (0, [], False), 6: (0, [], False)}
    con = duckdb.connect()
    for name, rows in (("documents", df), ("benchmark", items)):
        data = rows.toArrow()
        con.register(name, data)
    want = {r[0]: r[1:] for r in con.sql(queries.CONTAMINATION_SQL).fetchall()}
    own = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
    assert {r[0]: tuple(r[1:]) for r in own.collect()} == want


def test_query_counts_items_without_an_id(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("item_id", F.lit(None).cast("long")).write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = [queries.queries()["op1_decontamination"](spark, d).filter("contaminated").count() for d in (SF, str(tmp_path))]
    assert hit[0] == hit[1] > 0
