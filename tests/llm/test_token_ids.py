"""Token ids at the edges of normalisation, and rows without a key."""

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm import sstable

PATH = P.path("word_bpe_49k.json")


def test_every_code_point_before_a_full_stop_or_a_comma():
    lib = Tokenizer.from_file(PATH)
    words = sstable.Words(open(PATH, encoding="utf-8").read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{chr(c)}. x{chr(c)}," for c in points[at : at + 512]) for at in range(0, len(points), 512)]
    want = lib.encode_batch_fast(texts, add_special_tokens=False)
    for text, ids, e in zip(texts, words.encode(texts), want):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(text[:40])


def test_a_row_without_a_key_stays_without_one(spark, tmp_path):
    rows = [(None, "b"), (-(2**63), "a"), (None, ""), (3, "c"), (2**63 - 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = sstable.write_shards(df, PATH, 1, f"file://{tmp_path}/s").cache()
    got = sstable.scan_shards(shards).orderBy("start").collect()
    assert [r.key for r in got] == [None, None, -(2**63), 3, 2**63 - 1] and [r.n_tokens for r in got] in ([1, 2, 2, 2, 1], [2, 1, 2, 2, 1])
    paths = [r.path for r in shards.collect()]
    found = {k: sum(len(sstable.open_shard(p).get(k)) for p in paths) for k in (None, -(2**63), 3, 4, 2**63 - 1)}
    assert found == {None: 2, -(2**63): 1, 3: 1, 4: 0, 2**63 - 1: 1}
    assert shards.agg(F.sum("entries")).first()[0] == 5


def test_shards_follow_the_size_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 100)
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10).alias("text"))
    shards = sstable.write_shards(df, PATH, 1, f"file://{tmp_path}/n").cache()
    assert shards.count() > 8 and sstable.scan_shards(shards).count() == 60
