"""Near duplicates of rows whose keys are null or shared, against a plain version."""

from test_llm import plain_components

from vecloom.llm import jaccard_join

WORDS = [f"w{i}" for i in range(400)]


def shifted(at):
    return " ".join(WORDS[at : at + 100])


def test_links_through_null_keys(spark):
    rows = [(1, shifted(0)), (None, shifted(8)), (2, shifted(16)), (None, shifted(200)), (None, shifted(208)), (None, shifted(208)), (3, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(plain_components(rows), key=order)
    assert len({r.cls for r in got}) == 6 and {r.doc_id: r.component_id for r in got}[2] == 1


def test_rows_of_one_key_are_dropped_by_their_own_text(spark):
    rows = [(1, shifted(0)), (5, shifted(8)), (5, shifted(200)), (5, shifted(200)), (5, ""), (6, shifted(208)), (None, shifted(0))]
    left = jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, shifted(0)), (5, shifted(200)), (5, ""), (None, shifted(0))], key=str)
