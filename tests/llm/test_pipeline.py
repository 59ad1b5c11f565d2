"""The pipeline and its stages against plain versions, and on odd tables."""

import hashlib
import json
import os
import shutil
import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_brute_force import plain_phrases, plain_score
from test_llm import plain_components, plain_hits

import corpus_pipeline
from vecloom.llm import byte_bpe, language_id, quality
from vecloom.llm.queries import remainder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, predicted string, row string"


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """The small tables, with odd documents and with columns that have the operators' names."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars")).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    some = max(docs, key=lambda r: len(r.text or "")).text
    rows = [(*r, "s", "p", "r") for r in docs]
    good = [r.text for r in docs if r.text and len(r.text) > 400][:6]
    rows += [(None, good[0], "en", "x", 1, "s", "p", "r"), (10**9, None, "en", "x", 0, "s", "p", "r"), (10**9 + 1, "", None, "x", 0, "s", "p", "r"), (10**9 + 2, " \n\t ", "en", "x", 0, "s", "p", "r")]
    rows += [(10**9 + 3, good[1], "en", "x", 0, "s", "p", "r")] * 3 + [(10**9 + 3, good[2] + " tail", "en", "x", 0, "s", "p", "r")]
    rows += [(10**9 + 4, f"{good[3]} {item} {good[4]}", "en", "x", 0, "s", "p", "r"), (10**9 + 5, " ".join([some] * 12), "en", "x", 0, "s", "p", "r"), (10**9 + 6, "12345 67890 !!! 999 " * 5, None, "x", 0, "s", "p", "r")]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_and_the_whole_against_plain_versions(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{odd_folder}/labels.parquet")
    at = {c: i for i, c in enumerate(columns)}
    kept = {}

    network = quality.train(docs, labels, remainder("doc_id", 5) != 0)
    kept["quality"] = [r for r in rows_of(docs) if plain_score(network, r[at["text"]]) >= quality.THRESHOLD]
    left = spark.createDataFrame(kept["quality"], docs.schema)

    samples = language_id.sample_languages(left, remainder("doc_id", 3) != 1)
    model = language_id.Model(samples)

    def known(text):
        raw, letters = model.letters_of(text or "")
        return letters and (len(text) < corpus_pipeline.MIN_CHARS or len(text) > 60_000 or min(plain_phrases(model, samples, text)) / len(raw) <= corpus_pipeline.MAX_PHRASE_RATE)

    kept["language"] = [r for r in kept["quality"] if known(r[at["text"]])]

    groups = plain_components([(r[at["doc_id"]], r[at["text"]]) for r in kept["language"]])
    unique = {}
    for r, (key, n, component) in zip(kept["language"], groups):
        if key is None or not n:
            unique.setdefault((key, r[at["text"]], len(unique) if key is None else 0), r)
        elif component == key:
            unique.setdefault((key, r[at["text"]], 0), r)
    kept["near_duplicates"] = sorted(unique.values(), key=str)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{odd_folder}/benchmark.parquet").collect()]
    kept["decontamination"] = [r for r in kept["near_duplicates"] if not plain_hits(r[at["text"]], items)[1]]

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, odd_folder)
        assert now.columns == columns
        got = rows_of(now)
        assert got == sorted(kept[name], key=str), name
        now = spark.createDataFrame(got, docs.schema)
    assert len(kept["decontamination"]) < len(kept["near_duplicates"]) < len(kept["language"]) < len(kept["quality"]) < docs.count()

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in kept["decontamination"]:
        ids = lib.encode_ordinary(r[at["text"]] or "")
        want.append((r[at["doc_id"]], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[at["text"]] or "").encode()).hexdigest()))
    assert rows_of(corpus_pipeline.run(spark, odd_folder)) == sorted(want, key=str)


def test_every_stage_on_an_empty_table(spark, odd_folder):
    none = spark.read.parquet(f"{odd_folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, none, odd_folder)
        assert found.count() == 0 and (found.columns == none.columns or name == "byte_bpe")


def test_tasks_need_nothing_of_this_repository(tmp_path):
    """Workers that start in another folder, without this one on their path, run every query."""
    shown = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
import json
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/c").getOrCreate()
out = {{}}
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name in ("pipeline", "centroid_update", "fill_normal", "gemm_transposed"):
        out[name] = query(spark, {SF!r}).count()
print("COUNTS" + json.dumps(out))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", shown], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    counts = json.loads(run.stdout.rpartition("COUNTS")[2]) if "COUNTS" in run.stdout else pytest.fail(run.stderr[-3000:])
    assert len(counts) == 14 and all(counts.values())


def test_very_long_texts(spark):
    """Texts of a megabyte, in every operator of texts."""
    from vecloom.llm import decontaminate, jaccard_join, sstable, token_count

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words, 200_000))
    near = " ".join(long.split(" ")[:-2000])
    rows = [(1, long, "a"), (2, near, "a"), (3, "x" * 1_000_000, "b"), (4, "short text", "b"), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert found[1][1] == found[2][1] == found[5][1] == 1 and found[3] == (1, 3)
    items = spark.createDataFrame([(7, " ".join(long.split(" ")[-10:]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.find_contamination(docs, items).collect()}
    assert hits[1] == hits[5] == 10 and hits[2] == hits[3] == 0
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in token_count.count_tokens(docs, P.path("piece_bpe_32k.model")).collect():
        assert r.n_tokens == len(lib.encode(r.text))
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    assert all(bytes(r.decoded) == r.text.encode() for r in byte_bpe.encode_texts(docs, ranks, P.PATTERN).collect())
    assert language_id.identify(docs, {"a": long[:2000], "b": "x" * 50}).filter("(lang_pred = 'a') <> (doc_id <> 3)").filter("doc_id <> 4").count() == 0
    assert quality.score_quality(docs, quality.Network(3)).filter("score between 0 and 1").count() == 5
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    words_ = sstable.Words(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert np.frombuffer(words_.encode([near])[0], "<u4").tolist() == lib.encode(near, add_special_tokens=False).ids
