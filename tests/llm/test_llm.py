"""Each operator against its library, SQL, or a plain version; and nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm import ann, byte_bpe, decontaminate, html_extract, jaccard_join, language_id, quality, queries, sstable, token_count, url_filter

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b", "a \n b", " x", "x ", "\n\nfoo", "▁▁x ▁", "日本語 テキスト", "a" * 3000, "foo　bar  \n\n  z", "x y <s> </s>", "<|endoftext|> hi", "'s don't  I'LL", " \n \n", "é ́x", "ﬁ Å İstanbul ΣΑΣ ς", "a\x1cb\x85c", "1234567 89", " " * 20 + "k", "Word, word.,. WORD", "🎉🎉 x"]
SCHEMA = "doc_id long, text string, N_TOKENS string, Score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(ODD + ODD[-2:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    got, want = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


# 1
def plain_hits(text, items, window=10):
    words = [w for w in re.split(decontaminate.SEPARATOR, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    covered, found = set(), set()
    for item, body in items:
        own = [w for w in re.split(decontaminate.SEPARATOR, re.sub("[A-Z]", lambda m: m[0].lower(), body or "")) if w]
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                covered |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(covered), sorted(found)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_contamination(spark, bound):
    long_item = " ".join(f"w{i}" for i in range(14))
    items = [(1, long_item), (2, "Two, words"), (3, None), (4, ""), (5, long_item), (6, "two words"), (None, "w1 w2")]
    texts = ["a two WORDS b two-words", f"x {long_item} y", " ".join(f"w{i}" for i in range(9)), None, "", "two", f"{long_item} {long_item}", "über two words"] * 2
    df = spark.createDataFrame([(i % 8, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, N_HIT string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(df, bench, literal_windows=bound).collect()
    assert len(got) == 16
    for r in got:
        want = plain_hits(r.text, [i for i in items if i[0] is not None])
        assert (r.n_words, r.n_hit, list(r.item_ids)) == want and r.contaminated == (want[1] > 0)
    found = decontaminate.find_contamination(df.limit(8), bench)
    assert decontaminate.remove_contamination(found).count() == 4
    spans = {r.doc_id: r.text for r in decontaminate.remove_contamination(found, mode="spans").collect()}
    assert spans[0] == "a b" and spans[1] == "x y" and spans[3] is None and spans[7] == "über"
    assert decontaminate.find_contamination(df, bench.limit(0)).filter("contaminated").count() == 0


# 2
def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.NET/x", "http://net/", "http://net", "http://xnet/", "http://a.example.net/en/q?x", "http://foo.com/x.net/", "http://example.com/de/#f", "https://a.b.org/fr/é", "x://org/fr", "http://" + "a" * 5000 + ".net/" + "b" * 5000]
    got = [(r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "i int, url string, HOST string")).orderBy("i").collect()]
    no = (None, "allow")
    assert got == [no, no, no, ("net/", "block"), ("net/", "block"), no, no, ("example.net/en/", "allow"), no, ("example.com/de/", "block"), ("org/fr/", "allow"), no, ("net/", "block")]
    many = tuple(url_filter.Rule("block", f"h{i}.test", f"/p{i}/*x") for i in range(80))
    df = spark.createDataFrame([(f"http://s.h{i}.test/p{i}/aax", f"h{i}.test/p{i}/*x") for i in range(80)], "url string, want string")
    assert url_filter.judge_urls(df, many).filter("rule <> want OR rule IS NULL").count() == 0
    assert url_filter.judge_urls(df, ()).filter("verdict <> 'allow'").count() == 0


# 3
def test_html(spark):
    page = """<html><body><header>top</header><nav><a href=x>Home</a></nav><div class="cookie-notice">ok?</div><article class="p7"><h1>T &amp; U</h1><p>One
    two <b>three</b><p>Four &#233;<script>var a="</p>"</script><div class="share">no</div><form>f</form></article><div id="comments"><p>first! a very long comment that goes on and on and on</p></div><aside>s</aside><footer>end</footer>"""
    assert html_extract.extract(page, None) == "T & U\nOne two three\nFour é"
    rows = [(1, "http://h/1", page, "old"), (2, "http://h/2", None, "old"), (3, None, "", "old"), (4, "http://h/4", "plain <", "old"), (4, "http://h/4", "plain <", "old"), (5, "x", "<p>a<br>b" + "<div>" * 3000, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect())
    assert got == [(1, "T & U\nOne two three\nFour é", 26), (2, "", 0), (3, "", 0), (4, "plain <", 7), (4, "plain <", 7), (5, "a\nb", 3)]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


# 4
def plain_components(rows):
    sets, label = [], {}
    for _, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    for i, (key, _) in enumerate(rows):
        keys = [k for k in least[root(i)] if k is not None]
        label[i] = min(keys) if keys else None
    return [(key, len(sets[i]), label[i]) for i, (key, _) in enumerate(rows)]


def test_jaccard(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = [(None, "Null key text one two three four five six"), (7, None), (8, ""), (9, " \t\n"), (10, "one TWO"), (11, "one two"), (12, "one"), (12, "null key text one two three four five six"), (13, "x" * 4000)]
    shared = list(rng.choice(vocabulary, 60))
    for size in (6, 12, 30, 90, 400, 1500):
        for _ in range(6):
            base = list(rng.choice(vocabulary, size))
            for edits in range(6):
                copy = list(base)
                for at in rng.integers(0, size, edits * max(1, size // 60)):
                    copy[at] = str(rng.choice(vocabulary))
                rows.append((len(rows) + 20, " ".join(copy)))
    for _ in range(40):  # a passage that many texts share
        rows.append((len(rows) + 20, " ".join([*rng.choice(vocabulary, 20), *shared, *rng.choice(vocabulary, 20)])))
    rows += rows[-30:]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(plain_components(rows), key=order)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


def test_signatures_never_miss():
    rng = np.random.default_rng(9)
    for _ in range(3000):
        size = int(rng.integers(1, 300))
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[: size - int(rng.integers(0, size // 8 + 1))], rng.integers(0, 2**64, int(rng.integers(0, size // 8 + 2)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if jaccard_join.links(a, b):
            assert np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)).size


# 5
def test_language(spark, docs, odd, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 3
    samples = language_id.sample_languages(docs, held != 1)
    got = language_id.identify(docs.filter(held == 1), samples).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert got.a > 0.95 and 0 <= got.lo and got.hi <= 1
    rows = language_id.identify(odd, samples).collect()
    assert len(rows) == len(ODD) + 2
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    assert language_id.identify(empty, samples).count() == 0 and language_id.identify(odd, {}).filter("lang_pred <> 'und'").count() == 0


def test_phrases():
    model = language_id.Model({"x": "abab"})
    assert model.predict(["abab"])[0][2] == 1 / 4 and model.predict(["aabb"])[0][2] == 3 / 4


# 6
def test_token_counts(spark, docs, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (docs.select("doc_id", "text"), odd):
        for r in token_count.count_tokens(df, P.path("piece_bpe_32k.model")).collect():
            assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(lib.encode(r.text or "")))
            assert r.over_limit == (r.n_tokens > 4096)
    assert token_count.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0


# 7
def test_quality(spark, docs, odd, empty):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    net = quality.train(data, labels, rest != 0)
    got = quality.score_quality(data.filter(rest == 0), net).join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.93
    rows = quality.score_quality(odd, net).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.score_quality(empty, net).count() == 0
    alone = quality.train(docs, labels.filter("quality = 1"), F.lit(True))
    assert 0 <= alone.score("x") <= 1 and quality.train(docs, labels.limit(0), F.lit(True)).score(None) == 0.5


# 8
def test_shards(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = docs.select("doc_id", "text").collect() + [r for r in odd.select((F.col("doc_id") - 10**12).alias("doc_id"), "text").collect()] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = sstable.write_shards(df, P.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/s").cache()
    got = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in sstable.scan_shards(shards).collect())
    want, start = {}, 0
    for r in rows:
        want.setdefault(r[0], []).append(np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    order = lambda k: (k is not None, k or 0)
    assert [g[1] for g in got] == sorted((k for k, v in want.items() for _ in v), key=order)
    for at, key, n, crc in got:
        assert at == start and (n, crc) in [(len(i), zlib.crc32(i.tobytes())) for i in want[key]]
        start += n
    paths = [r.path for r in shards.orderBy("shard").collect()]
    some = sorted(want, key=order)[:: max(1, len(want) // 40)]
    for key in some:
        found = [i for p in paths for i in sstable.open_shard(p).get(key)]
        assert sorted(map(bytes, found)) == sorted(map(bytes, want[key]))
    assert all(sstable.open_shard(p).get(5 * 10**12) == [] for p in paths)
    none = sstable.write_shards(empty, P.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/e").cache()
    assert none.count() == 0 and sstable.scan_shards(none).count() == 0


# 9
def test_byte_bpe(spark, docs, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for df in (docs.select("doc_id", "text"), odd):
        for r in byte_bpe.encode_texts(df, path, P.PATTERN).collect():
            assert r.token_ids == lib.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        for r in byte_bpe.encode_digests(df, path, P.PATTERN).collect():
            ids = lib.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert byte_bpe.encode_texts(empty, path, P.PATTERN).count() == 0


def test_folded_merges_and_vocabulary(spark, docs, monkeypatch):
    ranks, rng = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), np.random.default_rng(3)
    words = [bytes(rng.integers(0, 256, n).tolist()) for n in rng.integers(1, 33, 150)] + [b"a" * n for n in range(1, 33)]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary").select("w", byte_bpe.fold_merges(F.col("w"), byte_bpe.rank_literal(ranks)).alias("ids"))
    assert all(r.ids == byte_bpe.merge_word(bytes(r.w), ranks) for r in df.collect())
    found = Counter()
    for r in docs.collect():
        found.update(regex.findall(P.PATTERN, r.text or ""))
    found = {w: n for w, n in found.items() if len(w.encode()) <= byte_bpe.WORD_BYTES}
    assert {r.word: r.n for r in byte_bpe.count_words(docs, P.PATTERN, "text").collect()} == found
    monkeypatch.setattr(byte_bpe, "VOCABULARY", 500)
    folded = byte_bpe.fold_vocabulary(docs, ranks, P.PATTERN, "text")
    assert 0 < len(folded) <= 500 and min(found[w] for w in folded) >= max(found[w] for w in found.keys() - folded.keys())
    assert all(ids == b",".join(b"%d" % i for i in byte_bpe.merge_word(w.encode(), ranks)) for w, ids in folded.items())


# 10
def test_nearest(spark):
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len({i for i, _ in found} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0])) and all(abs(s - d[ids == i][0]) < 1e-12 for i, s in found)
    assert len(got) == 20 and hits / 200 >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "old") for i, v in rows], "vec_id long, embedding array<double>, RANK string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df.dropDuplicates(["vec_id"]), F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 1.414214), (0, 2, 2, 1.414214)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


# the pipeline
def test_pipeline_keeps_clean_documents(spark, docs):
    folder = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in folder.select("doc_id").collect()}
        folder = stage(spark, folder, SF).cache()
        assert folder.columns == docs.columns
        kept[name] = len({r.doc_id for r in folder.select("doc_id").collect()}) / len(before)
    assert kept["quality"] > 0.75 and kept["language"] > 0.97 and kept["decontamination"] > 0.9
    want = {r.doc_id for r in folder.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want
