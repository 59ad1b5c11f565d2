"""All queries of the engine, and SQL that gives the same rows.

Points are the embeddings table, centroids its ten rows of least id. Real numbers are rounded,
as sums over rows have no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import numerics as N
from vecloom.functions import vectors as V
from vecloom.functions import fills as L
from vecloom.operators import clustering as C
from vecloom.operators import exclusion as E
from vecloom.operators import products as M
from vecloom.plans import results as P
from vecloom.plans import runs as R
from vecloom.sources import vectors as S

K, D, DIGITS = 10, 64, 6
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("x"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p, C.initial_centroids(p, K)


def shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    p = p.withColumn("x", V.add(F.col("x"), E.shift_of(p)))
    return p, C.initial_centroids(p, K)


def r(col, digits: int = DIGITS):
    return F.round(col, digits)


# SQL fragments -----------------------------------------------------------------------------
def total(x: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {x}), lambda p, q: p + q)"


def dot(a: str, b: str) -> str:
    return total(f"list_transform({a}, lambda v, n: v * {b}[n])")


def direct(a: str, b: str) -> str:
    return total(f"list_transform({a}, lambda v, n: (v - {b}[n]) * (v - {b}[n]))")


def rounding(v: str, bits: int, least: int) -> str:
    q = f"pow(2.0::DOUBLE, greatest(floor(log2(abs({v}))), {least}) - {bits})"
    return f"(CASE WHEN {v} = 0 THEN {v} ELSE round_even({v} / {q}, 0) * {q} END)"


def fp16_sql(v: str) -> str:
    return f"(CASE WHEN abs({v}) >= 65520 THEN sign({v}) * 'inf'::DOUBLE ELSE {rounding(v, 10, -14)} END)"


def bf16_sql(v: str) -> str:
    return rounding(v, 7, -126)


PTS = "pts AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
CEN = "cen AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cid, x AS c FROM (SELECT * FROM pts ORDER BY id LIMIT 10))"
SHIFT = "raw AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), top AS (SELECT max(list_max(list_transform(x, lambda v: abs(v)))) AS m FROM raw), pts AS (SELECT id, list_transform(x, lambda v: v + m) AS x FROM raw, top)"
PAIR = f"pair AS (SELECT id, cid, x, c, {dot('c', 'c')} - 2 * {dot('x', 'c')} AS s FROM pts, cen)"
NEAR = "near AS (SELECT id, cid, x, s FROM pair QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1)"


@query(f"WITH {PTS}, {CEN}, {PAIR}, {NEAR} SELECT id AS vec_id, cid, round(s, 6) AS dist FROM near")
def nn_assign(spark, d):
    return C.assign(*both(spark, d)).select(F.col("id").alias("vec_id"), "cid", r("dist").alias("dist"))


@query(f"WITH {PTS} SELECT id, round({dot('x', 'x')}, 6) AS n2 FROM pts")
def vec_norm2(spark, d):
    return points(spark, d).select("id", r(V.norm2(F.col("x"))).alias("n2"))


@query(f"WITH {PTS}, {CEN} SELECT id, cid, round({dot('x', 'c')}, 6) AS g FROM pts, cen")
def vec_dot(spark, d):
    p, c = both(spark, d)
    return C.with_centroids(p, c).select("id", F.explode(F.transform("cs", lambda s: F.struct(s["cid"].alias("cid"), V.dot(F.col("x"), s["c"]).alias("g")))).alias("t")).select("id", "t.cid", r("t.g").alias("g"))


@query(f"WITH {PTS}, {CEN} SELECT id, cid, round({direct('x', 'c')}, 6) AS d2 FROM pts, cen")
def direct_dist(spark, d):
    p, c = both(spark, d)
    return C.with_centroids(p, c).select("id", F.explode(F.transform("cs", lambda s: F.struct(s["cid"].alias("cid"), V.direct_distance(F.col("x"), s["c"]).alias("d2")))).alias("t")).select("id", "t.cid", r("t.d2").alias("d2"))


@query(f"WITH {PTS}, {CEN} SELECT id, cid, round({dot('x', 'x')} + {dot('c', 'c')} - 2 * {dot('x', 'c')}, 6) + 0.0 AS d2 FROM pts, cen")
def expanded_dist(spark, d):
    p, c = both(spark, d)
    return C.with_centroids(p, c).select("id", F.explode(F.transform("cs", lambda s: F.struct(s["cid"].alias("cid"), V.expanded_distance(V.norm2(F.col("x")), s["n2"], V.dot(F.col("x"), s["c"])).alias("d2")))).alias("t")).select("id", "t.cid", (r("t.d2") + F.lit(0.0)).alias("d2"))


@query(f"WITH {SHIFT} SELECT id, round(list_min(x), 6) + 0.0 AS lo, round({total('x')}, 6) AS s FROM pts")
def shift_nonneg(spark, d):
    return shifted(spark, d)[0].select("id", (r(F.array_min("x")) + F.lit(0.0)).alias("lo"), r(V.total(F.col("x"))).alias("s"))


_FEATURES = "SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS f, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem"


@query(f"WITH t AS ({_FEATURES}), s AS (SELECT f, avg(v) AS m, stddev_pop(v) AS sd FROM t GROUP BY f) SELECT l_orderkey, l_linenumber, f, round((v - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 5) + 0.0 AS z FROM t JOIN s USING (f)")
def zscore(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*names).alias("x"))
    z = V.standardised(rows, "x").select("l_orderkey", "l_linenumber", F.posexplode("x").alias("pos", "v"))
    return z.select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("f"), (r("v", 5) + F.lit(0.0)).alias("z"))


@query(f"WITH {SHIFT} SELECT id, round(list_max(list_transform(x, lambda v: v / greatest(sqrt({dot('x', 'x')}), 1e-12))), 6) AS top FROM pts")
def l2_normalise(spark, d):
    return shifted(spark, d)[0].select("id", r(F.array_max(V.normalise(F.col("x")))).alias("top"))


@query(f"WITH {PTS} SELECT id FROM pts ORDER BY md5(id::VARCHAR), id LIMIT 100")
def subsample_hash(spark, d):
    return C.subsample(points(spark, d), 100).select("id")


@query(f"WITH {PTS}, {CEN} SELECT cid, round(c[1], 6) AS c0, round({dot('c', 'c')}, 6) AS n2 FROM cen")
def init_centroids(spark, d):
    return both(spark, d)[1].select("cid", r(F.element_at("c", 1)).alias("c0"), r(V.norm2(F.col("c"))).alias("n2"))


_MEANS = "SELECT cid, n, avg(x[n]) AS m FROM near, range(1, 65) t(n) GROUP BY cid, n"


@query(f"WITH {PTS}, {CEN}, {PAIR}, {NEAR} SELECT cid, (n - 1)::INTEGER AS pos, round(m, 6) + 0.0 AS v FROM ({_MEANS})")
def centroid_update(spark, d):
    p, c = both(spark, d)
    return C.update(C.assign(p, c), c).select("cid", F.posexplode("c").alias("pos", "v")).select("cid", "pos", (r("v") + F.lit(0.0)).alias("v"))


@query(f"WITH {PTS}, {CEN}, {PAIR}, {NEAR}, far AS (SELECT unnest([100, 101]) AS cid, unnest([50.0, -50.0]) AS h), dist AS (SELECT id, cid, {dot("c", "c")} - 2 * {dot("x", "c")} AS s FROM pts, cen UNION ALL SELECT id, cid, 64 * h * h - 2 * h * {total("x")} FROM pts, far), won AS (SELECT id, cid, x FROM dist JOIN pts USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1) SELECT far.cid, coalesce(sum((m - h) ** 2), 0.0)::DOUBLE AS moved FROM far LEFT JOIN (SELECT cid, n, avg(x[n]) AS m FROM won, range(1, 65) t(n) GROUP BY cid, n) USING (cid) GROUP BY far.cid")
def empty_cluster_update(spark, d):
    p, c = both(spark, d)
    far = spark.createDataFrame([(100, [50.0] * D), (101, [-50.0] * D)], "cid int, c array<double>")
    every = c.unionByName(far)
    return C.update(C.assign(p, every), every).filter("cid >= 100").select("cid", F.col("moved2").alias("moved"))


@query(f"WITH {PTS}, {CEN}, {PAIR}, {NEAR}, m AS ({_MEANS}) SELECT round(sum((x[n] - m.m) * (x[n] - m.m)), 5) AS inertia FROM near JOIN m USING (cid)")
def inertia(spark, d):
    p, c = both(spark, d)
    near = C.assign(p, c)
    return C.inertia(near, C.update(near, c)).select(r("inertia", 5).alias("inertia"))


def _step(n: int) -> str:
    return f"""mean{n} AS (SELECT cid, list(m ORDER BY n) AS c FROM (SELECT cid, n, avg(x[n]) AS m FROM near{n - 1}, range(1, 65) t(n) GROUP BY cid, n) GROUP BY cid),
cen{n} AS (SELECT o.cid, coalesce(k.c, o.c) AS c FROM cen{n - 1} o LEFT JOIN mean{n} k USING (cid)),
near{n} AS (SELECT id, cid, x FROM (SELECT id, cid, x, {dot("c", "c")} - 2 * {dot("x", "c")} AS s FROM pts, cen{n}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1)"""


_LLOYD = f"WITH {PTS}, {CEN}, {PAIR}, {NEAR}, cen0 AS (SELECT * FROM cen), near0 AS (SELECT id, cid, x FROM near), {_step(1)}, {_step(2)}, {_step(3)}"


@query(f"{_LLOYD} SELECT a.id, a.cid FROM near2 a")
def lloyd_3iter(spark, d):
    assigned, _, _ = C.lloyd(*both(spark, d), C.Params(max_iter=3))
    return assigned.select("id", "cid")


@query(f"{_LLOYD} SELECT count(*) FILTER (WHERE a.cid <> b.cid) AS changed, count(*) AS n FROM near0 a JOIN near2 b USING (id)")
def label_diff(spark, d):
    p, c = both(spark, d)
    first = C.assign(p, c).select("id", F.col("cid").alias("a"))
    last, _, _ = C.lloyd(p, c, C.Params(max_iter=3))
    return first.join(last.select("id", "cid"), "id").agg(F.count_if(F.col("a") != F.col("cid")).alias("changed"), F.count("*").alias("n"))


@query(f"{_LLOYD} SELECT round(sqrt(sum({direct('a.c', 'b.c')})), 6) AS shift FROM cen0 a JOIN cen1 b USING (cid)")
def frobenius_shift(spark, d):
    p, c = both(spark, d)
    return C.update(C.assign(p, c), c).agg(r(F.sqrt(F.sum("moved2"))).alias("shift"))


@query(f"WITH {PTS}, {CEN}, {PAIR}, {NEAR} SELECT cid AS la, label AS lb, count(*) AS n FROM near JOIN embeddings ON vec_id = id GROUP BY ALL")
def contingency(spark, d):
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("lb"))
    return C.contingency(C.assign(*both(spark, d)).select("id", F.col("cid").alias("la")), truth)


_GREEDY = f"""WITH RECURSIVE {PTS}, {CEN}, {PAIR}, {NEAR}, cells AS (SELECT la, lb, n, row_number() OVER (ORDER BY n DESC, la, lb) AS at FROM (SELECT cid AS la, label AS lb, count(*) AS n FROM near JOIN embeddings ON vec_id = id GROUP BY ALL)),
walk AS (SELECT 0::BIGINT AS at, []::INTEGER[] AS used_a, []::INTEGER[] AS used_b, 0::BIGINT AS matched
UNION ALL SELECT c.at, CASE WHEN hit THEN list_append(used_a, la) ELSE used_a END, CASE WHEN hit THEN list_append(used_b, lb) ELSE used_b END, matched + CASE WHEN hit THEN n ELSE 0 END
FROM (SELECT w.*, c.la, c.lb, c.n, c.at AS next_at, NOT list_contains(w.used_a, c.la) AND NOT list_contains(w.used_b, c.lb) AS hit FROM walk w JOIN cells c ON c.at = w.at + 1) q JOIN cells c ON c.at = q.next_at)"""


@query(f"{_GREEDY.replace('CASE WHEN hit THEN list_append(used_a, la)', 'CASE WHEN hit THEN list_append(used_a, q.la)').replace('list_append(used_b, lb)', 'list_append(used_b, q.lb)').replace('THEN n ELSE 0', 'THEN q.n ELSE 0')} SELECT max(matched) / (SELECT count(*) FROM near)::DOUBLE AS agreement FROM walk")
def label_agreement(spark, d):
    return spark.createDataFrame([(C.agreement(contingency(spark, d)),)], "agreement double")


@query()
def mllib_kmeans(spark, d):
    """The outside implementation: its inertia, for comparison."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points(spark, d).select("id", array_to_vector("x").alias("features"))
    model = KMeans(k=K, seed=1, maxIter=20, tol=1e-4).fit(rows)
    return spark.createDataFrame([(K, float(model.summary.trainingCost))], "k int, inertia double")


_EVENTS = "SELECT event_id, value AS v FROM events WHERE value IS NOT NULL"


def events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("value").alias("v")).filter("v IS NOT NULL")


@query(f"SELECT event_id, {fp16_sql('v')} AS h FROM ({_EVENTS})")
def fp16_round(spark, d):
    return events(spark, d).select("event_id", N.fp16(F.col("v")).alias("h"))


@query(f"SELECT event_id, {bf16_sql('v')} AS h FROM ({_EVENTS})")
def bf16_round(spark, d):
    return events(spark, d).select("event_id", N.bf16(F.col("v")).alias("h"))


def _split_sql(f, words: int) -> str:
    inner = "SELECT event_id, v AS r0 FROM (SELECT event_id, v::FLOAT::DOUBLE AS v FROM (" + _EVENTS + "))"
    for n in range(words):
        inner = f"SELECT *, {f(f'r{n}')} AS b{n}, r{n} - b{n} AS r{n + 1} FROM ({inner})"
    return f"SELECT event_id, {', '.join(f'b{n}' for n in range(words))}, r{words} AS rest FROM ({inner})"


def _split(df, words, rounding):
    parts = N.split(F.col("x"), words, rounding)
    rest = F.col("x")
    for p in parts:
        rest = rest - p
    return df.withColumn("x", F.col("v").cast("float").cast("double")).select("event_id", *(p.alias(f"b{n}") for n, p in enumerate(parts)), rest.alias("rest"))


@query(_split_sql(bf16_sql, 3))
def bf16_split3(spark, d):
    return _split(events(spark, d), 3, N.bf16)


@query(_split_sql(fp16_sql, 2))
def fp16_split2(spark, d):
    return _split(events(spark, d), 2, N.fp16)


_TOP = f"(SELECT max(abs(v)) AS top FROM ({_EVENTS}))"
_SCALE = "(CASE WHEN top > 0 THEN pow(2.0::DOUBLE, floor(log2(4096.0 / top))) ELSE 1.0 END)"


def scaled(spark, d):
    rows = events(spark, d)
    top = rows.agg(F.max(F.abs("v")).alias("top")).select(N.autoscale(F.col("top")).alias("scale"))
    return rows.join(F.broadcast(top))


@query(f"SELECT {_SCALE} AS scale FROM {_TOP}")
def autoscale(spark, d):
    return scaled(spark, d).select("scale").distinct()


_SPLIT_SCALED = f"SELECT event_id, s, b0, s - b0 AS r, {fp16_sql('(s - b0)')} AS b1 FROM (SELECT event_id, s, {fp16_sql('s')} AS b0 FROM (SELECT event_id, v * {_SCALE} AS s FROM ({_EVENTS}), {_TOP}))"


@query(f"SELECT event_id, b0, b1 FROM ({_SPLIT_SCALED})")
def fp16_split_scaled(spark, d):
    parts = N.split(F.col("v") * F.col("scale"), 2, N.fp16)
    return scaled(spark, d).select("event_id", parts[0].alias("b0"), parts[1].alias("b1"))


@query(f"SELECT CASE WHEN isinf(b1) THEN 'overflow' WHEN (b1 = 0 AND r <> 0) OR (b1 <> 0 AND abs(b1) < pow(2.0, -14)) THEN 'subnormal' ELSE 'ok' END AS class, count(*) AS n FROM ({_SPLIT_SCALED}) GROUP BY ALL")
def word_class(spark, d):
    s = F.col("v") * F.col("scale")
    parts = N.split(s, 2, N.fp16)
    return scaled(spark, d).select(N.word_class(parts[1], s - parts[0]).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def sides(spark, d):
    """Every embedding as rows (i, x), and the centroids as rows (j, y)."""
    p, c = both(spark, d)
    return p.select(F.col("id").alias("i"), "x"), c.select(F.col("cid").alias("j"), F.col("c").alias("y"))


def entry_sides(spark, d):
    a, b = sides(spark, d)
    return M.entries(a), M.entries(b.select(F.col("j").alias("i"), F.col("y").alias("x")))


AB = f"{PTS}, {CEN}, a AS (SELECT id AS i, n AS l, x[n] AS v FROM pts, range(1, 65) t(n)), b AS (SELECT cid AS j, n AS l, c[n] AS w FROM cen, range(1, 65) t(n))"
PRODUCT = "SELECT i, j, sum(v * w) AS v FROM a JOIN b USING (l) GROUP BY i, j"


def shown(rows):
    return rows.select(*(c for c in rows.columns if c != "v"), (r("v") + F.lit(0.0)).alias("v"))


@query(f"WITH {AB} SELECT i, j, round(v, 6) + 0.0 AS v FROM ({PRODUCT})")
def gemm_coo(spark, d):
    a, b = entry_sides(spark, d)
    return shown(M.product(a, F.broadcast(b)))


@query(f"WITH {AB} SELECT i, j, round(2 * v + 0.5 * (i + j), 6) + 0.0 AS v FROM ({PRODUCT})")
def gemm_alpha_beta(spark, d):
    a, b = sides(spark, d)
    c = a.select("i", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("j")).select("i", "j", (F.col("i") + F.col("j")).cast("double").alias("v"))
    return shown(M.gemm(a, b, 2.0, 0.5, c))


@query(f"WITH {PTS}, e AS (SELECT id, n - 1 AS l, x[n] AS v FROM pts, range(1, 65) t(n)) SELECT a.l AS i, b.l AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM e a JOIN e b USING (id) GROUP BY ALL")
def gemm_transposed(spark, d):
    a, _ = sides(spark, d)
    out = M.gemm_of_columns(a, a.select("i", F.col("x").alias("y")))
    return out.select("i", "j", (r("v", 4) + F.lit(0.0)).alias("v"))


def _planes_sql(f, words: int, scale: str = "1") -> str:
    def one(source: str, key: str, value: str) -> str:
        inner = f"SELECT {key}, l, {value} * {scale} AS r0 FROM {source}"
        for n in range(words):
            inner = f"SELECT *, {f(f'r{n}')} AS b{n}, r{n} - b{n} AS r{n + 1} FROM ({inner})"
        return f"SELECT {key}, l, unnest(range({words})) AS p, unnest([{', '.join(f'b{n}' for n in range(words))}]) AS {value} FROM ({inner})"

    values = ", ".join(f"({n}, {p}, {q})" for n, (p, q) in enumerate(N.terms(words)))
    return f"pa AS ({one('a', 'i', 'v')}), pb AS ({one('b', 'j', 'w')}), sched AS (SELECT * FROM (VALUES {values}) s(pos, p, q)), prod AS (SELECT i, j, pos, pa.p + pb.p AS bin, sum(v * w) AS v FROM pa JOIN pb USING (l) JOIN sched ON sched.p = pa.p AND sched.q = pb.p GROUP BY ALL)"


def _prefix_sql(counts: list[int], unscale: str = "1") -> str:
    return f"SELECT i, j, terms::INTEGER AS terms, round(sum(v) * {unscale}, 6) + 0.0 AS v FROM prod, (SELECT unnest({counts}) AS terms) WHERE pos < terms GROUP BY i, j, terms"


_BF16 = f"WITH {AB}, {_planes_sql(bf16_sql, 3)}"


def bf16_sides(spark, d):
    a, b = sides(spark, d)
    return M.worded(a, "x", 3, N.bf16), M.worded(b, "y", 3, N.bf16)


@query(f"{_BF16} {_prefix_sql([1, 3, 6, 9])}")
def gemm_bf16_prefix(spark, d):
    return shown(M.prefix_rows(*bf16_sides(spark, d), 3, [1, 3, 6, 9]))


@query(f"{_BF16} SELECT i, j, pos::INTEGER AS pos, bin::INTEGER AS bin, round(v, 6) + 0.0 AS v FROM prod")
def gemm_bf16_terms(spark, d):
    """The same terms as joins of entries."""
    a, b = entry_sides(spark, d)
    return shown(M.term_products(M.planes(a, 3, N.bf16), F.broadcast(M.planes(b, 3, N.bf16)), 3))


@query(f"WITH {AB}, {_planes_sql(fp16_sql, 2, '1024.0')} {_prefix_sql([1, 3], '(1 / 1048576.0)')}")
def gemm_multiword_prefix(spark, d):
    a, b = sides(spark, d)
    return shown(M.prefix_rows(M.worded(a, "x", 2, N.fp16, 1024.0), M.worded(b, "y", 2, N.fp16, 1024.0), 2, [1, 3], 1 / 1048576.0))


@query(f"WITH {AB}, sa AS (SELECT pow(2.0, floor(log2(4096.0 / max(abs(v))))) AS s FROM a), sb AS (SELECT pow(2.0, floor(log2(4096.0 / max(abs(w))))) AS s FROM b), {_planes_sql(fp16_sql, 2, '(SELECT s FROM sx)').replace('(SELECT s FROM sx) AS r0 FROM a', '(SELECT s FROM sa) AS r0 FROM a').replace('(SELECT s FROM sx) AS r0 FROM b', '(SELECT s FROM sb) AS r0 FROM b')} SELECT i, j, round(1.5 * sum(v) / ((SELECT s FROM sa) * (SELECT s FROM sb)), 6) + 0.0 AS v FROM prod WHERE pos < 3 GROUP BY i, j")
def gemm_multiword_autoscaled(spark, d):
    a, b = sides(spark, d)
    scales = tuple(rows.agg(F.max(V.max_abs(F.col(c))).alias("m")).select(N.autoscale(F.col("m"))).first()[0] for rows, c in ((a, "x"), (b, "y")))
    return shown(M.split_gemm(a, b, 2, N.fp16, 0, 3, alpha=1.5, scales=scales))


@query(f"{_BF16} SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM prod WHERE pos < 6 GROUP BY i, j")
def gemm_range_refined(spark, d):
    """Terms 0 to 2, then 2 to 6 on top of their result."""
    a, b = sides(spark, d)
    first = M.split_gemm(a, b, 3, N.bf16, 0, 2)
    return shown(M.split_gemm(a, b, 3, N.bf16, 2, 6, beta=1.0, c=first))


@query(f"WITH {AB} SELECT i, j, 0.25 * (i + j) AS v FROM ({PRODUCT})")
def gemm_empty_range(spark, d):
    a, b = sides(spark, d)
    c = a.select("i", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("j")).select("i", "j", (F.col("i") + F.col("j")).cast("double").alias("v"))
    return M.split_gemm(a, b, 3, N.bf16, 4, 4, beta=0.25, c=c)


@query(f"{_BF16} SELECT i, j, bin::INTEGER AS bin, round(sum(v), 6) + 0.0 AS v FROM prod GROUP BY i, j, bin")
def gemm_concat_bins(spark, d):
    return shown(M.concat_bins(*sides(spark, d), 3, N.bf16, D))


@query(f"{_BF16} SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM prod WHERE pos >= 1 AND pos < 6 GROUP BY i, j")
def gemm_batched(spark, d):
    return shown(M.batched(*sides(spark, d), 3, N.bf16, 1, 6))


@query(f"{_BF16}, flat AS (SELECT j, (2 - p) * 64 + l - 1 AS pos, w AS v FROM pb) SELECT j::INTEGER AS j, pos::INTEGER AS pos, v FROM flat")
def stacked_planes(spark, d):
    _, b = sides(spark, d)
    return M.stacked(b, "y", 3, N.bf16).select("j", F.posexplode("y").alias("pos", "v"))


@query(f"{_BF16}, full_ AS ({PRODUCT}), pre AS (SELECT i, j, terms, sum(v) AS v FROM prod, (SELECT unnest([1, 3]) AS terms) WHERE pos < terms GROUP BY ALL) SELECT terms::INTEGER AS terms, round(sqrt(sum((p.v - f.v) ** 2) / sum(f.v * f.v)), 8) AS rel_frob, round(max(abs(p.v - f.v)) / max(abs(f.v)), 8) AS rel_max FROM pre p JOIN full_ f USING (i, j) GROUP BY terms")
def error_norms(spark, d):
    found = M.error_norms(M.prefix_rows(*bf16_sides(spark, d), 3, [1, 3]), M.gemm(*sides(spark, d)), "terms")
    return found.select("terms", r("rel_frob", 8).alias("rel_frob"), r("rel_max", 8).alias("rel_max"))


BITS, COUNT = 7, 4
_EXP = "CASE WHEN m > 0 THEN (floor(log2(m)) + 1)::INTEGER END AS e"
_OZ = f"ea AS (SELECT i, {_EXP} FROM (SELECT i, max(abs(v)) AS m FROM a GROUP BY i)), eb AS (SELECT j, {_EXP} FROM (SELECT j, max(abs(w)) AS m FROM b GROUP BY j))"


def _slice_sql(source: str, exps: str, key: str, value: str) -> str:
    whole = f"coalesce(floor(abs({value}) * pow(2.0, -e) * pow(2.0, {BITS * COUNT}))::BIGINT, 0)"
    return f"SELECT {key}, l, e, p, (((({whole}) >> ({COUNT - 1} - p)::INTEGER * {BITS}) & {(1 << BITS) - 1}) * CASE WHEN {value} < 0 THEN -1 ELSE 1 END)::BIGINT AS {value} FROM {source} JOIN {exps} USING ({key}), range({COUNT}) t(p)"


_SLICES = f"{_OZ}, sa AS ({_slice_sql('a', 'ea', 'i', 'v')}), sb AS ({_slice_sql('b', 'eb', 'j', 'w')})"
_FOLD = f"SELECT i, j, round(sum(coalesce(v * w * pow(2.0, sa.e + sb.e - (sa.p + sb.p + 2) * {BITS}), 0)), 6) + 0.0 AS v FROM sa JOIN sb USING (l) WHERE sa.p + sb.p < {COUNT} GROUP BY i, j"
#: Every seventh row zeros.
AB_ZEROS = AB.replace("x[n] AS v FROM pts", "CASE WHEN id % 7 = 0 THEN 0.0 ELSE x[n] END AS v FROM pts")


def with_zeros(spark, d):
    a, b = sides(spark, d)
    return a.withColumn("x", F.when(F.col("i") % 7 == 0, F.transform("x", lambda v: v * 0.0)).otherwise(F.col("x"))), b


def sliced_sides(operands):
    a, b = operands
    return M.sliced_rows(a, "x", COUNT, BITS), M.sliced_rows(b, "y", COUNT, BITS)


@query(f"WITH {AB}, {_OZ} SELECT * FROM ea")
def oz_exponents(spark, d):
    return sides(spark, d)[0].select("i", M.row_exponent(F.col("x")).alias("e"))


@query(f"WITH {AB_ZEROS}, {_SLICES} SELECT i, (l - 1)::INTEGER AS l, p::INTEGER AS p, v FROM sa")
def oz_slices(spark, d):
    a, _ = sliced_sides(with_zeros(spark, d))
    return a.select("i", F.posexplode("x").alias("p", "s")).select("i", "p", F.posexplode("s").alias("l", "v"))


@query(f"WITH {AB_ZEROS}, {_SLICES} SELECT i, coalesce(max(abs(g))::DOUBLE < pow(2.0, max(e) - {BITS * COUNT}), max(abs(g)) = 0) AS within FROM (SELECT sa.i, sa.l, sa.e, max(a.v) - sum(coalesce(sa.v * pow(2.0, sa.e - (p + 1) * {BITS}), 0)) AS g FROM sa JOIN a ON a.i = sa.i AND a.l = sa.l GROUP BY ALL) GROUP BY i")
def oz_reconstruct(spark, d):
    a, _ = with_zeros(spark, d)
    cut = M.sliced_rows(a.withColumn("own", F.col("x")), "x", COUNT, BITS)
    def weighed(p: int):
        weight = F.pow(F.lit(2.0), (F.coalesce("e", F.lit(0)) - (p + 1) * BITS).cast("double"))
        return F.transform(F.element_at("x", p + 1), lambda v: v * weight)

    back = [weighed(p) for p in range(COUNT)]
    total = back[0]
    for plane in back[1:]:
        total = F.zip_with(total, plane, lambda u, v: u + v)
    gap = F.array_max(F.zip_with("own", total, lambda u, v: F.abs(u - v)))
    return cut.select("i", F.coalesce(gap < F.pow(F.lit(2.0), (F.col("e") - BITS * COUNT).cast("double")), gap == 0).alias("within"))


@query(f"WITH {AB_ZEROS}, {_SLICES} SELECT i, j, (sa.p + sb.p)::INTEGER AS bin, sum(v * w)::BIGINT AS t FROM sa JOIN sb USING (l) WHERE sa.p + sb.p < {COUNT} GROUP BY ALL")
def gemm_ozaki_prefix(spark, d):
    return M.slice_rows(*sliced_sides(with_zeros(spark, d)), COUNT).select("i", "j", "bin", "t")


@query(f"WITH {AB}, {_SLICES} {_FOLD}")
def gemm_ozaki_fold(spark, d):
    return shown(M.folded(M.slice_rows(*sliced_sides(sides(spark, d)), COUNT), BITS))


@query(f"WITH {AB_ZEROS}, {_SLICES} {_FOLD}")
def gemm_ozaki_zero_rows(spark, d):
    """By entries: a row of zeros gives zeros, and isn't lost."""
    a, b = with_zeros(spark, d)
    a, b = M.entries(a), M.entries(b.select(F.col("j").alias("i"), F.col("y").alias("x")))
    return shown(M.folded(M.slice_products(M.sliced(a, COUNT, BITS), F.broadcast(M.sliced(b, COUNT, BITS)), COUNT), BITS))


def _norms_sql(products: str, values: str) -> str:
    """Errors of values (i, j, terms, v) that products make, against the exact product."""
    return f"({products}, full_ AS ({PRODUCT}), pre AS ({values}) SELECT terms::INTEGER AS terms, round(sqrt(sum((p.v - f.v) ** 2) / sum(f.v * f.v)), 8) + 0.0 AS rel_frob, round(max(abs(p.v - f.v)) / max(abs(f.v)), 8) + 0.0 AS rel_max FROM pre p JOIN full_ f USING (i, j) GROUP BY terms)"


def _some_terms(counts: list[int], unscale: str = "1") -> str:
    return f"SELECT i, j, terms, sum(v) * {unscale} AS v FROM prod, (SELECT unnest({counts}) AS terms) WHERE pos < terms GROUP BY ALL"


_ERRORS = " UNION ALL ".join(
    f"SELECT '{name}' AS scheme, * FROM {norms}"
    for name, norms in (
        ("bf16", _norms_sql(_BF16, _some_terms([1, 3, 6, 9]))),
        ("fp16", _norms_sql(f"WITH {AB}, {_planes_sql(fp16_sql, 2, '1024.0')}", _some_terms([1, 3], "(1 / 1048576.0)"))),
        ("slices", _norms_sql(f"WITH {AB}, {_SLICES}", f"SELECT i, j, terms, sum(v * w * pow(2.0, sa.e + sb.e - (sa.p + sb.p + 2) * {BITS})) AS v FROM sa JOIN sb USING (l), (SELECT unnest([2, 3, 4]) AS terms) WHERE sa.p + sb.p < terms GROUP BY i, j, terms")),
    )
)


@query(_ERRORS)
def error_table(spark, d):
    """Errors of all schemes by the terms, or slices, that they take, against pairs of doubles."""
    a, b = sides(spark, d)
    x = F.col("x")
    exact = M.each_pair(a, b, lambda t: F.struct(V.double_double_dot(x, t["y"])["hi"].alias("v")))
    halves = M.worded(a, "x", 2, N.fp16, 1024.0), M.worded(b, "y", 2, N.fp16, 1024.0)
    bins = M.slice_rows(*sliced_sides((a, b)), COUNT)
    out = None
    for scheme, found in (
        ("bf16", M.prefix_rows(*bf16_sides(spark, d), 3, [1, 3, 6, 9])),
        ("fp16", M.prefix_rows(*halves, 2, [1, 3], 1 / 1048576.0)),
        *(("slices", M.folded(bins.filter(F.col("bin") < n), BITS).withColumn("terms", F.lit(n))) for n in (2, 3, 4)),
    ):
        one = M.error_norms(found, exact, "terms").select(F.lit(scheme).alias("scheme"), "terms", (r("rel_frob", 8) + F.lit(0.0)).alias("rel_frob"), (r("rel_max", 8) + F.lit(0.0)).alias("rel_max"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT (row_number() OVER (ORDER BY i + j, i) - 1)::INTEGER AS pos, i::INTEGER AS i, j::INTEGER AS j FROM range(3) a(i), range(3) b(j)")
def term_schedule(spark, d):
    return spark.createDataFrame([(n, p, q) for n, (p, q) in enumerate(N.terms(3))], "pos int, i int, j int")


@query(f"WITH {PTS} SELECT id, round({total('x')}, 6) + 0.0 AS s FROM pts")
def neumaier_sum(spark, d):
    """Each vector's sum between 1e18 and -1e18, which a plain sum loses."""
    far = F.concat(F.array(F.lit(1e18)), "x", F.array(F.lit(-1e18)))
    return points(spark, d).select("id", (r(V.neumaier(far)) + F.lit(0.0)).alias("s"))


# Bounds --------------------------------------------------------------------------------------
def _bound_sql(eps: float, scale: float = 1.0) -> str:
    factor, gfac = E.bounds_of(D, eps)
    s, value, unscale = N.SLACK, fp16_sql(f"(v * {scale!r})") if scale != 1 else fp16_sql("v"), f" / {scale * scale!r}" if scale != 1 else ""
    return f"""WITH {SHIFT}, {CEN},
hp AS (SELECT id, x, list_transform(x, lambda v: {value}) AS h FROM pts), hc AS (SELECT cid, c, {dot("c", "c")} AS cn, list_transform(c, lambda v: {value}) AS ch FROM cen),
low AS (SELECT id, cid, cn, x, c, {dot("h", "ch")}{unscale} AS g FROM hp, hc),
lows AS (SELECT *, cn - 2 * g AS dt FROM low),
best AS (SELECT id, cid AS bid, dt AS db, g AS gb, cn AS bn, {dot("x", "c")} AS ge FROM lows QUALIFY row_number() OVER (PARTITION BY id ORDER BY dt, cid) = 1),
tests AS (SELECT *, db + {s!r} * (abs(db) + abs(dt)) <= dt - {factor!r} * (greatest(g, 0) + gb) AS x3, u + {s!r} * (abs(u) + abs(dt)) <= dt - {factor!r} * greatest(g, 0) AS x6 FROM (SELECT *, bn - 2 * ge + {gfac!r} * ge AS u FROM lows JOIN best USING (id)) WHERE cid <> bid),
left_ AS (SELECT id, bid, count(*) FILTER (WHERE NOT x3) AS n3, count(*) FILTER (WHERE NOT x6) AS n6, count(*) FILTER (WHERE NOT x3 AND NOT x6) AS n36 FROM tests GROUP BY id, bid),
exact AS (SELECT id, cid, cn, cn - 2 * {dot("x", "c")} AS s FROM lows), truth AS (SELECT id, cid FROM exact QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1)"""


_BOUND = _bound_sql(N.epsilon(D))


def bounded(spark, d):
    return E.survivors(*shifted(spark, d), D, N.epsilon(D))


def _count(name: str, left: str) -> Callable:
    def run(spark, d):
        return bounded(spark, d).select("id", F.size(left).cast("long").alias("survivors"))

    run.__name__ = name
    return run


query(f"{_BOUND} SELECT id, n3 AS survivors FROM left_")(_count("excl_cond3", "s3"))
query(f"{_BOUND} SELECT id, n6 AS survivors FROM left_")(_count("excl_cond6", "s6"))
query(f"{_BOUND} SELECT id, n36 AS survivors FROM left_")(_count("excl_both", "s36"))


@query(f"{_BOUND} SELECT count(*) FILTER (WHERE n3 > 0) AS priced, count(*) AS n FROM left_")
def cascade_reference_count(spark, d):
    return bounded(spark, d).agg(F.count_if(F.size("s3") > 0).alias("priced"), F.count("*").alias("n"))


@query(f"{_BOUND} SELECT id, bid AS cid FROM best")
def raw_assign(spark, d):
    return bounded(spark, d).select("id", "cid")


@query(f"{_BOUND} SELECT id, cid FROM truth")
def mixed_assign(spark, d):
    """Equal to the exact assignment: what the bounds drop can't be nearest."""
    return E.mixed_step(*shifted(spark, d), D).select("id", "cid")


@query(f"{_BOUND} SELECT count(*) AS tested, count(*) FILTER (WHERE x3) AS by3, count(*) FILTER (WHERE x6) AS by6, count(*) FILTER (WHERE x3 OR x6) AS either FROM tests")
def excl_attribution(spark, d):
    rows = bounded(spark, d).select((F.size("ts") - 1).alias("n"), *(F.size(s).alias(s) for s in ("s3", "s6", "s36")))
    return rows.agg(F.sum("n").alias("tested"), F.sum(F.col("n") - F.col("s3")).alias("by3"), F.sum(F.col("n") - F.col("s6")).alias("by6"), F.sum(F.col("n") - F.col("s36")).alias("either"))


@query(f"{_BOUND} SELECT count(*) AS violations FROM tests JOIN truth USING (id, cid) WHERE x3 OR x6")
def excl_violations(spark, d):
    return P.attribution(*shifted(spark, d), D).select("violations")


_RT = f"""WITH {PTS}, {CEN}, hp AS (SELECT id, x, {dot("x", "x")} AS xn, list_transform(x, lambda v: {fp16_sql("v")}) AS h FROM pts), hc AS (SELECT cid, c, {dot("c", "c")} AS cn, list_transform(c, lambda v: {fp16_sql("v")}) AS ch FROM cen),
low AS (SELECT id, cid, xn + cn AS m, xn + cn - 2 * {dot("h", "ch")} AS dl, {direct("x", "c")} AS d2 FROM hp, hc),
priced AS (SELECT id, cid, dl > {N.reliability(D)!r} * m AS ok, CASE WHEN dl > {N.reliability(D)!r} * m THEN dl ELSE d2 END AS s FROM low)"""


@query(f"{_RT} SELECT id, count(*) FILTER (WHERE NOT ok) AS rejected FROM priced GROUP BY id")
def rt_accept(spark, d):
    return E.reliability_rows(*both(spark, d), D).select("id", F.col("rejected").cast("long").alias("rejected"))


@query(f"{_RT} SELECT id, cid FROM priced QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1")
def rt_assign(spark, d):
    return E.reliability_rows(*both(spark, d), D).select("id", "cid")


@query(f"{_bound_sql(N.multiword_epsilon(D, 1), 1024.0)} SELECT id, n36 > 0 AS undecided FROM left_")
def mw_undecided_rows(spark, d):
    return E.multiword_rows(*shifted(spark, d), D, (1024.0, 1024.0)).select("id", "undecided")


@query(f"{_BOUND} SELECT id, cid FROM truth")
def mw_assign(spark, d):
    return E.multiword_rows(*shifted(spark, d), D, (1024.0, 1024.0)).select("id", "cid")


# Fits ------------------------------------------------------------------------------------------
_TRUE_FIT = _LLOYD.replace(f"WITH {PTS}", f"WITH {SHIFT}")
PARAMS = C.Params(max_iter=3)


def fitted(spark, d, scheme: str, params: C.Params = PARAMS, **more) -> C.Fit:
    p, c = both(spark, d) if scheme in ("fp32", "rt") else shifted(spark, d)
    return P.fit_scheme(p, c, scheme, params, D, **more)


@query(f"{_TRUE_FIT} SELECT id, cid FROM near2")
def lloyd_mixed(spark, d):
    """Three iterations of the cascade: the labels of the exact fit."""
    return fitted(spark, d, "(3)->(6)").assigned.select("id", "cid")


@query(f"{_TRUE_FIT} SELECT id, cid FROM near2")
def lloyd_cond6(spark, d):
    return fitted(spark, d, "(6)").assigned.select("id", "cid")


@query(f"{_TRUE_FIT} SELECT id, cid FROM near2")
def lloyd_mw(spark, d):
    return fitted(spark, d, "mw", scales=(1024.0, 1024.0)).assigned.select("id", "cid")


def _low_steps(first: str, near: str) -> str:
    """Three iterations of an assignment: near with @ for the iteration's number, from cen@ and pts."""
    out = [first, "cen0 AS (SELECT * FROM cen)", near.replace("@", "0")]
    for n in (1, 2):
        out += [_step(n).split("\nnear")[0].rstrip(","), near.replace("@", str(n))]
    return ", ".join(out)


_RT_NEAR = f"""near@ AS (SELECT id, cid, x FROM (SELECT id, cid, x, CASE WHEN dl > {N.reliability(D)!r} * m THEN dl ELSE d2 END AS s FROM
(SELECT id, cid, x, xn + cn AS m, xn + cn - 2 * {dot("h", "ch")} AS dl, {direct("x", "c")} AS d2 FROM hp, (SELECT cid, c, {dot("c", "c")} AS cn, list_transform(c, lambda v: {fp16_sql("v")}) AS ch FROM cen@))) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1)"""
_RT_FIT = _low_steps(f"WITH {PTS}, {CEN}, hp AS (SELECT id, x, {dot('x', 'x')} AS xn, list_transform(x, lambda v: {fp16_sql('v')}) AS h FROM pts)", _RT_NEAR)
_RAW_NEAR = f"""near@ AS (SELECT id, cid, x FROM (SELECT id, cid, x, cn - 2 * {dot("h", "ch")} AS s FROM hp, (SELECT cid, c, {dot("c", "c")} AS cn, list_transform(c, lambda v: {fp16_sql("v")}) AS ch FROM cen@)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, cid) = 1)"""
_RAW_FIT = _low_steps(f"WITH {SHIFT}, {CEN}, hp AS (SELECT id, x, list_transform(x, lambda v: {fp16_sql('v')}) AS h FROM pts)", _RAW_NEAR)


@query(f"{_RT_FIT} SELECT id, cid FROM near2")
def lloyd_rt(spark, d):
    return fitted(spark, d, "rt").assigned.select("id", "cid")


@query(f"{_RAW_FIT} SELECT id, cid FROM near2")
def lloyd_raw(spark, d):
    return fitted(spark, d, "raw").assigned.select("id", "cid")


def _theta_sql(theta: float) -> str:
    return f"SELECT {theta!r}::DOUBLE AS theta, count(*) FILTER (WHERE dl <= {N.reliability(D, theta)!r} * m) AS rejected, count(*) AS tested FROM low"


@query(f"{_RT} SELECT * FROM ({' UNION ALL '.join(_theta_sql(t) for t in (0.5, 1.0, 2.5, 5.0))})")
def theta_sweep(spark, d):
    out = None
    for theta in (0.5, 1.0, 2.5, 5.0):
        one = E.reliability_rows(*both(spark, d), D, theta).agg(F.sum(F.col("rejected").cast("long")).alias("rejected"), F.sum(F.col("tested").cast("long")).alias("tested")).select(F.lit(theta).alias("theta"), "rejected", "tested")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{_BOUND} SELECT count(*) * 9 AS tested, sum(CASE WHEN n3 > 0 THEN n36 ELSE 0 END)::BIGINT AS priced, count(*) FILTER (WHERE n3 > 0) AS reference FROM left_")
def mixed_work(spark, d):
    """Counters of one iteration of the cascade."""
    found = fitted(spark, d, "(3)->(6)", C.Params(max_iter=1)).work
    return spark.createDataFrame([tuple(found[c] for c in E.MIXED_WORK)], ", ".join(f"{c} long" for c in E.MIXED_WORK))


@query(f"{_BOUND} SELECT count(*) FILTER (WHERE bid <> truth.cid) AS label_diff, round(coalesce(sum(CASE WHEN bid <> truth.cid THEN a.s - b.s END), 0), 9) + 0.0 AS excess FROM truth JOIN left_ USING (id) JOIN exact a ON a.id = truth.id AND a.cid = bid JOIN exact b ON b.id = truth.id AND b.cid = truth.cid")
def raw_excess(spark, d):
    """What the labels of plain half precision cost."""
    p, c = shifted(spark, d)
    raw = E.mixed_step(p, c, D, C.Params(cond3=False, cond6=False)).select("id", "x", "cid")
    return P.excess(raw, c).select("label_diff", (r("excess", 9) + F.lit(0.0)).alias("excess"))


@query(f"{_TRUE_FIT}, mean1_ AS (SELECT cid, n, avg(x[n]) AS m FROM near0, range(1, 65) t(n) GROUP BY cid, n), inert AS (SELECT sum((x[n] - m.m) * (x[n] - m.m)) AS v FROM near0 JOIN mean1_ m USING (cid)) SELECT 'embeddings' AS dataset, count(*)::INTEGER AS n, 64 AS d, 10 AS k, '(3)+(6)' AS cond, 1 AS iters, count(*) * 10 AS hp_baseline, count(*) AS hp_reference, 0::BIGINT AS violations, 0::BIGINT AS label_diff, (SELECT round(v, 5) FROM inert) AS inertia, 0.0::DOUBLE AS rel_inertia FROM near0")
def result_row(spark, d):
    """What a run's row says of its work and its labels; times aside."""
    row = P.result_row(*shifted(spark, d), "(3)+(6)", C.Params(max_iter=1), {"dataset": "embeddings"})
    return P.result_table(spark, [row]).select("dataset", "n", "d", "k", "cond", "iters", "hp_baseline", "hp_reference", "violations", "label_diff", r("inertia", 5).alias("inertia"), r("rel_inertia", 9).alias("rel_inertia"))


@query(f"{_BOUND}, prices AS (SELECT id, cid, {direct('x', 'c')} AS d2, {dot('x', 'x')} + cn - 2 * {dot('x', 'c')} AS e2, {dot('x', 'x')} + dt AS h2 FROM lows), rated AS (SELECT id, cid, d2, unnest(['expanded', 'half']) AS formula, unnest([e2, h2]) AS v FROM prices), firsts AS (SELECT id, formula, arg_min(cid, (d2, cid)) AS t, arg_min(cid, (v, cid)) AS f FROM rated GROUP BY ALL) SELECT formula, round(max(abs(v - d2) / greatest(d2, 1e-300)) FILTER (WHERE d2 > 0), 5) AS max_rel, round(avg(abs(v - d2) / greatest(d2, 1e-300)) FILTER (WHERE d2 > 0), 7) AS mean_rel, max(wrong) AS wrong FROM rated JOIN (SELECT formula, count(*) FILTER (WHERE t <> f) AS wrong FROM firsts GROUP BY formula) USING (formula) GROUP BY formula")
def distance_accuracy(spark, d):
    out = E.accuracy(*shifted(spark, d)).withColumn("max_rel", r("max_rel", 5)).withColumn("mean_rel", r("mean_rel", 7))
    return out


@query(f"WITH {PTS}, {CEN}, hp AS (SELECT id, list_transform(x, lambda v: {fp16_sql('v')}) AS h FROM pts), hc AS (SELECT cid, list_transform(c, lambda v: {fp16_sql('v')}) AS ch FROM cen) SELECT id, cid, list_reduce(list_prepend(0.0::DOUBLE, list_transform(h, lambda v, n: {fp16_sql('(v * ch[n])')})), lambda p, q: {fp16_sql('(p + q)')}) AS g FROM hp, hc")
def half_accumulated(spark, d):
    """Products whose every product and sum is rounded to half precision."""
    p, c = both(spark, d)
    rows, _ = E.scored(p, c, accum="fp16")
    return rows.select("id", F.explode("ts").alias("t")).select("id", F.col("t.j").alias("cid"), "t.g")


@query("SELECT macs, d, round(CASE WHEN e < 1 THEN e ELSE -1 END, 12) AS epsilon FROM (SELECT macs, d, (1 + o) * (1 + g / (1 - g)) - 1 AS e FROM (SELECT macs, d, (d + CASE macs WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) * pow(2.0, -24) AS g, CASE macs WHEN 1 THEN 2 * pow(2.0, -11) + pow(2.0, -22) WHEN 2 THEN pow(2.0, -11) + pow(2.0, -22) ELSE 3 * pow(2.0, -22) END AS o FROM (SELECT unnest([1, 2, 3]) AS macs), (SELECT unnest([32, 64, 512, 3072]) AS d)))")
def multiword_bounds(spark, d):
    rows = [(m, n, round(N.multiword_epsilon(n, m), 12)) for m in (1, 2, 3) for n in (32, 64, 512, 3072)]
    return spark.createDataFrame(rows, "macs int, d int, epsilon double")


@query("SELECT k, greatest(0, least(floor((31 - ceil(log2(k))) / 2), 7))::INTEGER AS bits, floor(2147483647 / pow(pow(2, greatest(1, least(floor((31 - ceil(log2(k))) / 2), 7))) - 1, 2))::BIGINT AS longest FROM (SELECT unnest([1, 64, 1000, 131072, 1000000, 536870912]) AS k)")
def slice_limits(spark, d):
    return spark.createDataFrame([(k, N.bits_per_slice(k), N.longest_inner(max(1, N.bits_per_slice(k)))) for k in (1, 64, 1000, 131072, 1000000, 536870912)], "k int, bits int, longest long")


@query("SELECT n, CASE WHEN n <= 16 THEN n * n ELSE 0 END AS terms, CASE WHEN n <= 4 THEN n * (n + 1) // 2 ELSE 0 END AS half_terms, n * (n + 1) // 2 AS slice_terms FROM (SELECT unnest([1, 2, 3, 4, 5, 16, 17]) AS n)")
def product_counts(spark, d):
    return spark.createDataFrame([(n, N.term_count(n), N.half_term_count(n), N.slice_terms(n)) for n in (1, 2, 3, 4, 5, 16, 17)], "n int, terms int, half_terms int, slice_terms int")


@query(f"WITH s AS ({_split_sql(bf16_sql, 3)}), t AS ({_split_sql(bf16_sql, 2)}) SELECT 3 AS words, count(*) FILTER (WHERE rest <> 0) AS inexact, round(max(abs(rest) / abs(b0 + b1 + b2 + rest)) FILTER (WHERE b0 <> 0), 9) + 0.0 AS rel FROM s UNION ALL SELECT 2, count(*) FILTER (WHERE rest <> 0), round(max(abs(rest) / abs(b0 + b1 + rest)) FILTER (WHERE b0 <> 0), 9) + 0.0 FROM t")
def split_reconstruction(spark, d):
    out = None
    for words in (3, 2):
        rows = events(spark, d).select(F.col("v").cast("float").cast("double").alias("v"))
        back = rows.withColumn("back", V.total(N.words_of(F.col("v"), words, N.bf16)))
        one = M.split_report(back, "v", "back").select(F.lit(words).alias("words"), "inexact", (r("rel", 9) + F.lit(0.0)).alias("rel"))
        out = one if out is None else out.unionByName(one)
    return out


def _hash_sql(x: str) -> str:
    wrap, big = "18446744073709551616::UHUGEINT", "::UHUGEINT"
    out = f"((({x}){big} + {L.STEP}{big}) % {wrap})::UBIGINT"
    for shift, by in ((30, L.FIRST), (27, L.SECOND)):
        out = f"(SELECT (((xor(q, q >> {shift})){big} * {by}{big}) % {wrap})::UBIGINT FROM (SELECT {out} AS q))"
    return f"(SELECT xor(q, q >> 31) FROM (SELECT {out} AS q))"


def _unit_sql(h: str) -> str:
    return f"(({h}) >> 11)::DOUBLE / 9007199254740992.0"


_SEEDED = "xor(event_id::UBIGINT, 7::UBIGINT)"


@query(f"SELECT event_id, (-1.0 + ({_unit_sql(_hash_sql(_SEEDED))}) * 2.0)::FLOAT::DOUBLE AS v FROM events")
def fill_uniform(spark, d):
    return table(spark, d, "events").select("event_id", L.uniform(F.col("event_id"), 7).alias("v"))


@query(f"SELECT event_id, 2.0 * ({_unit_sql(_hash_sql(_SEEDED))}) - 1.0 AS v FROM events")
def fill_double(spark, d):
    return table(spark, d, "events").select("event_id", L.uniform_double(F.col("event_id"), 7).alias("v"))


@query(f"SELECT event_id, round(sqrt(-2.0 * ln(greatest({_unit_sql('h')}, 1e-300))) * cos(2 * pi() * ({_unit_sql(_hash_sql(f'xor(h, {L.STEP}::UBIGINT)'))})), 6) + 0.0 AS v FROM (SELECT event_id, {_hash_sql(_SEEDED)} AS h FROM events)")
def fill_normal(spark, d):
    return table(spark, d, "events").select("event_id", (r(L.normal(F.col("event_id"), 7)) + F.lit(0.0)).alias("v"))


@query(f"SELECT event_id, round(({_unit_sql(_hash_sql(_SEEDED))} - 0.5) * exp(0.5 * (2 * ({_unit_sql(_hash_sql(f'xor(((event_id::UHUGEINT * {L.WIDE_STRIDE}) % 18446744073709551616::UHUGEINT)::UBIGINT, {L.WIDE_SEED ^ 7}::UBIGINT)'))}) - 1) * 3.0), 6) + 0.0 AS v FROM events")
def fill_wide(spark, d):
    return table(spark, d, "events").select("event_id", (r(L.wide(F.col("event_id"), 7, 0.5)) + F.lit(0.0)).alias("v"))


@query(f"WITH {PTS} SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cid, round(x[1], 6) AS c0 FROM (SELECT * FROM pts ORDER BY md5(id::VARCHAR || ':' || '5'), id LIMIT 10)")
def seeded_centroids(spark, d):
    return C.seeded_centroids(points(spark, d), K, 5).select("cid", r(F.element_at("c", 1)).alias("c0"))


@query(f"WITH {PTS}, {CEN} SELECT id, cid, round({dot('x', 'c')}, 12) + 0.0 AS hi FROM pts, cen")
def double_double(spark, d):
    p, c = both(spark, d)
    rows = C.with_centroids(p, c).select("id", F.explode(F.transform("cs", lambda s: F.struct(s["cid"].alias("cid"), V.double_double_dot(F.col("x"), s["c"]).alias("p")))).alias("t"))
    return rows.select("id", "t.cid", (r("t.p.hi", 12) + F.lit(0.0)).alias("hi"))


def order_results(spark, d):
    """Orders as rows of results: a ratio of each, under names such as runs have."""
    rows = table(spark, d, "orders")
    return rows.select(F.concat(F.lit("data_"), "o_orderpriority", F.lit(".bin")).alias("dataset"), F.concat(F.lit("rt-mp-k"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise((F.col("o_custkey") % 3).cast("string"))).alias("cond"), F.col("o_totalprice").alias("ms_total"), F.when(F.col("o_orderkey") % 11 != 0, F.lit(1000.0)).otherwise(F.lit(0.0)).alias("ms_total_fp32"))


_RUNS = "SELECT o_orderpriority AS dataset, (o_custkey % 3)::DOUBLE AS kappa, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS ratio, o_totalprice AS ms_total FROM orders WHERE o_orderkey % 5 <> 0"


@query(f"SELECT dataset, kappa, count(*) AS n, round(sum(ratio), 3) AS ratios FROM ({_RUNS}) GROUP BY ALL")
def named_runs(spark, d):
    return P.named_runs(order_results(spark, d), "rt-mp-k").groupBy("dataset", "kappa").agg(F.count("*").alias("n"), r(F.sum("ratio"), 3).alias("ratios"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE ratio > 1) AS slower, list_sort(list(ratio))[count(*) // 2 + 1] AS median, max(ratio) AS worst, max(ratio) FILTER (WHERE false) IS NULL AS worst_known, min(ratio) AS best FROM ({_RUNS}) WHERE ratio IS NOT NULL")
def report_scalars(spark, d):
    out = P.scalars(P.named_runs(order_results(spark, d), "rt-mp-k"))
    return out.select("n", "slower", "median", "worst", F.col("worst_name").isNotNull().alias("worst_known"), "best")


@query(f"SELECT dataset, round((max(ms_total) - min(ms_total)) / 1000.0, 6) AS spread FROM ({_RUNS}) GROUP BY dataset")
def spread_report(spark, d):
    runs_ = P.named_runs(order_results(spark, d), "rt-mp-k")
    reference = runs_.select("dataset").distinct().withColumn("ref", F.lit(1000.0))
    return P.spread_against(runs_, ["dataset"], "ms_total", reference).withColumn("spread", r("spread"))


@query("SELECT l_shipmode_ AS dataset, round(median(l_extendedprice), 4) AS speedup, round(median(l_quantity), 4) AS pct_eliminated, round(median(l_tax), 4) AS rel_inertia, max(l_linenumber)::BIGINT AS violations, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode_, * FROM lineitem) GROUP BY 1")
def report_medians(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_extendedprice").alias("speedup"), F.col("l_quantity").alias("pct_eliminated"), F.col("l_tax").alias("rel_inertia"), F.col("l_linenumber").cast("long").alias("violations"))
    return P.medians(rows, ["dataset"]).select("dataset", *(r(c, 4).alias(c) for c in ("speedup", "pct_eliminated", "rel_inertia")), "violations", "n")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def manifest_lookup(spark, d):
    manifest = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return S.lookup(manifest, table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))).select("c_custkey", "n_name")


@query(f"WITH {PTS} SELECT id, round(CASE WHEN id % 3 = 0 THEN list_max(list_transform(x, lambda v: 3 * v / greatest(sqrt(9 * {dot('x', 'x')}), 1e-12))) ELSE 3 * list_max(x) END, 6) AS top FROM pts")
def listed_normalise(spark, d):
    rows = points(spark, d).withColumn("x", F.transform("x", lambda v: v * 3)).withColumn("dataset", F.concat(F.lit("d"), (F.col("id") % 3).cast("string")))
    return S.normalised_where(rows, ["d0"]).select("id", r(F.array_max("x")).alias("top"))


# Sources and tables of runs --------------------------------------------------------------------
@query("SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber::DOUBLE AS label, l_quantity AS x1, l_tax AS x2, l_discount AS x3 FROM lineitem")
def libsvm_parse(spark, d):
    text = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.lit("qid:3"), F.concat(F.lit("1:"), "l_quantity"), F.lit("3:9"), F.concat(F.lit("3:"), "l_discount"), F.concat(F.lit("2:"), "l_tax"), F.lit("0:5 # 4:4"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), text.alias("value"))
    return S.parse_libsvm(lines, 3).select("id", "label", *(F.element_at("x", n).alias(f"x{n}") for n in (1, 2, 3)))


def runs(spark):
    return R.grid(spark, {"box": ("double", [0.0, 2.0, 10.0]), "n": ("long", [20000, 200000]), "d": ("long", [32, 64, 512]), "k": ("long", [16, 64, 256])})


_GRID = "SELECT * FROM (SELECT unnest([0.0, 2.0, 10.0])::DOUBLE AS box), (SELECT unnest([20000, 200000])::BIGINT AS n), (SELECT unnest([32, 64, 512])::BIGINT AS d), (SELECT unnest([16, 64, 256])::BIGINT AS k)"


@query(f"SELECT * FROM ({_GRID}) WHERE k = 64 OR d = 64")
def config_grid(spark, d):
    return R.sweep(runs(spark), 64, 64)


@query(f"SELECT *, CASE WHEN k >= n THEN 'infeasible' WHEN need <= 100000000 THEN 'run' WHEN n_max > k THEN 'subsample' ELSE 'infeasible' END AS verdict FROM (SELECT *, 12 * n * d + 8 * n * k + 44 * n AS need, floor(100000000 / (12 * d + 8 * k + 44))::BIGINT AS n_max FROM ({_GRID}))")
def feasibility(spark, d):
    return R.feasible(runs(spark), 100_000_000)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_anti(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.to_do(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT o_orderpriority, round(median(o_totalprice), 2) AS median, min(o_totalprice) AS least, max(o_totalprice) AS largest, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, count(*) AS n FROM orders GROUP BY 1")
def summary_median(spark, d):
    out = R.summary(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return out.withColumn("median", r("median", 2)).withColumn("spread", r("spread", 2))


@query("WITH v AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS v FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) > 1) GROUP BY 1) SELECT l_orderkey, v[len(v) // 2 + 1] AS middle, list_min(v) AS least, list_max(v) AS largest FROM v")
def upper_middle(spark, d):
    return R.upper_middle(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice", "l_linenumber")


_BEST = "SELECT l_suppkey, l_returnflag, min(l_extendedprice) AS cost FROM lineitem GROUP BY ALL"


@query(f"SELECT a.l_suppkey, a.l_returnflag, round(b.cost / a.cost, 6) AS speedup FROM ({_BEST}) a JOIN ({_BEST}) b USING (l_suppkey) WHERE a.l_returnflag <> 'N' AND b.l_returnflag = 'N'")
def speedup_selfjoin(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_extendedprice").alias("cost"))
    return R.speedups(rows, ["l_suppkey"], "l_returnflag", "cost", "N").withColumn("speedup", r("speedup"))


@query()
def blob_points(spark, d):
    return S.blobs(spark, 2000, 8, 4)


@query("SELECT i AS id, (i * 4 // 2000)::INTEGER AS label, 8 AS width, true AS near FROM range(2000) t(i)")
def blob_labels(spark, d):
    """Points' blobs, and whether all lie as far from a centre in the box as normal values do."""
    return S.blobs(spark, 2000, 8, 4).select("id", "label", F.size("x").alias("width"), (V.max_abs(F.col("x")) < 10.0 + 6.5).alias("near"))


@query("SELECT l_suppkey, l_returnflag, min(l_extendedprice) AS least, count(*) AS repeats FROM lineitem GROUP BY ALL")
def least_of_repeats(spark, d):
    return R.least_of_repeats(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
