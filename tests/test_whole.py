"""Queries over whole tables, against plain products."""

import numpy as np
import pytest

from vecloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def operands(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    return rows, [rows[i] for i in sorted(rows)[: Q.K]]


def test_products_have_every_embedding(spark, operands):
    rows, centres = operands
    assert len(rows) > 32
    want = {(i, j): x @ c for i, x in rows.items() for j, c in enumerate(centres)}
    for name, least in (("gemm_coo", 1e-6), ("gemm_ozaki_fold", 1e-5)):
        got = {(r.i, r.j): r.v for r in Q.queries()[name](spark, SF).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) <= least
    got = {(r.i, r.j): r.v for r in Q.queries()["gemm_bf16_prefix"](spark, SF).filter("terms = 9").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) <= 1e-6


def test_slices_have_every_embedding(spark, operands):
    rows, _ = operands
    assert {r.i: r.e for r in Q.queries()["oz_exponents"](spark, SF).collect()} == {i: int(np.frexp(np.abs(x).max())[1]) for i, x in rows.items()}
    assert Q.queries()["oz_slices"](spark, SF).count() == len(rows) * Q.D * Q.COUNT
    assert {r.i: r.within for r in Q.queries()["oz_reconstruct"](spark, SF).collect()} == dict.fromkeys(rows, True)
