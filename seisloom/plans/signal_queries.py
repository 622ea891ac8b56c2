"""Framing, features and vector queries over the driver tables, and their SQL.

Signal: a channel is a supplier; a sample is the quantity around its mean, in hundredths. Every second channel is
quieter, or rides on a slow square wave, so that all wave types occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kernels as K
from ..operators import framing as P
from ..operators import vectors as V

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ch"), F.round((F.col("l_quantity") - 25.5) * F.when(F.col("l_suppkey") % 4 == 1, 0.25).otherwise(100.0)).cast("int").alias("v"), *ORDER)
    placed = P.ordinal(rows, "ch", ORDER, F.year("l_shipdate"))
    wave = lambda half: F.when(F.floor(F.col("i") / half) % 2 == 0, 3000).otherwise(-3000)
    carrier = F.when(F.col("ch") % 4 == 2, wave(25)).when(F.col("ch") % 4 == 3, wave(100)).otherwise(0)
    return placed.select("ch", "i", (F.col("v") + carrier).cast("int").alias("v"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frames(samples(spark, sf_dir))


SIG = """noise AS (SELECT l_suppkey AS ch, CAST(round((l_quantity - 25.5) * CASE WHEN l_suppkey % 4 = 1 THEN 0.25::DOUBLE ELSE 100.0::DOUBLE END) AS INTEGER) AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem),
sig AS (SELECT ch, CAST(v + CASE WHEN ch % 4 = 2 THEN CASE WHEN (i // 25) % 2 = 0 THEN 3000 ELSE -3000 END WHEN ch % 4 = 3 THEN CASE WHEN (i // 100) % 2 = 0 THEN 3000 ELSE -3000 END ELSE 0 END AS INTEGER) AS v, i FROM noise),
spread AS (SELECT ch, k, CAST(i - 128 * k AS BIGINT) AS p, v FROM (SELECT ch, i, v, unnest([i // 128, i // 128 - 1]) AS k FROM sig) WHERE k >= 0),
whole AS (SELECT ch, k FROM spread GROUP BY ch, k HAVING count(*) = 256),
fr AS (SELECT s.ch, CAST(s.k AS BIGINT) AS k, s.p, s.v FROM spread s JOIN whole USING (ch, k))"""
META = SIG + """, zc AS (SELECT ch, k, p, v, CASE WHEN (lag(v) OVER (PARTITION BY ch, k ORDER BY p) >= 0) != (v >= 0) THEN 1 ELSE 0 END AS x FROM fr),
meta AS (SELECT ch, k, sqrt(avg(v::DOUBLE * v)) AS rms, sum(x)::DOUBLE / (2.0::DOUBLE * 255 / 100.0::DOUBLE) AS hz, sum(x)::BIGINT AS crossings FROM zc GROUP BY ch, k),
cls AS (SELECT *, CASE WHEN rms < 10 THEN 'Unknown' WHEN hz > 3 THEN 'P' WHEN hz >= 1 THEN 'S' ELSE 'Surface' END AS wave_type, (k + 1) * 1280000 AS timestamp_us FROM meta)"""
DFT = SIG + """, win AS (SELECT ch, k, p, v * (0.5::DOUBLE * (1 - cos(2 * pi() * p / 255))) AS w FROM fr),
bins AS (SELECT ch, k, b, log10(1 + sqrt(pow(sum(w * cos(2 * pi() * ((b * p) % 256) / 256)), 2) + pow(sum(w * sin(2 * pi() * ((b * p) % 256) / 256)), 2))) AS m FROM win, range(128) r(b) GROUP BY ch, k, b)"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def exploded(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """(keep..., j, x): an array's elements, rounded to six places."""
    return df.select(*keep, F.posexplode(array).alias("j", "x")).select(*keep, "j", r6("x").alias("x"))


@query(f"WITH {SIG} SELECT ch, count(*) AS n_frames FROM whole GROUP BY ch")
def frame_counts(spark, sf_dir):
    return framed(spark, sf_dir).groupBy("ch").agg(F.count("*").alias("n_frames"))


@query(f"WITH {META} SELECT ch, k, round(rms, 6) AS rms FROM meta")
def frame_rms(spark, sf_dir):
    return framed(spark, sf_dir).select("ch", "k", r6(P.rms(F.col("samples"))).alias("rms"))


@query(f"WITH {META} SELECT ch, k, crossings, round(hz, 6) AS hz FROM meta")
def frame_zcr(spark, sf_dir):
    s = F.col("samples")
    return framed(spark, sf_dir).select("ch", "k", P.crossings(s).cast("long").alias("crossings"), r6(P.zero_crossing_hz(s)).alias("hz"))


@query(f"WITH {META} SELECT ch, k, wave_type FROM cls")
def wave_class(spark, sf_dir):
    return P.metadata(framed(spark, sf_dir)).select("ch", "k", "wave_type")


@query(f"WITH {META} SELECT wave_type, count(*) AS n FROM cls GROUP BY wave_type")
def wave_class_counts(spark, sf_dir):
    return P.metadata(framed(spark, sf_dir)).groupBy("wave_type").agg(F.count("*").alias("n"))


@query(f"WITH {META} SELECT ch, k, timestamp_us FROM cls")
def frame_timestamps(spark, sf_dir):
    return framed(spark, sf_dir).select("ch", "k", P.frame_time_us(F.col("k")).alias("timestamp_us"))


@query(f"WITH {META} SELECT ch, k, wave_type, timestamp_us, CAST(1 AS BIGINT) AS station_id, round(rms, 6) AS amplitude_rms, round(hz, 6) AS dominant_freq_hz FROM cls")
def frame_metadata(spark, sf_dir):
    m = P.metadata(framed(spark, sf_dir))
    return m.select("ch", "k", "wave_type", "timestamp_us", "station_id", r6("amplitude_rms").alias("amplitude_rms"), r6("dominant_freq_hz").alias("dominant_freq_hz"))


@query(f"WITH {SIG}, t AS (SELECT ch, v, row_number() OVER (PARTITION BY ch ORDER BY i DESC) AS r FROM sig) SELECT ch, count(*) AS n, sum(v)::BIGINT AS total FROM t WHERE r <= 100 GROUP BY ch")
def ring_overflow_tail(spark, sf_dir):
    return P.ring_tail(samples(spark, sf_dir), 100).groupBy("ch").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {DFT} SELECT ch, k, CAST(b AS INTEGER) AS j, round(m, 6) AS x FROM bins")
def fft_log_mag(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.spectrum("samples"), "ch", "k")


@query(f"WITH {DFT} SELECT ch, k, CAST(b AS INTEGER) AS j, round((m - avg(m) OVER w) / greatest(stddev_pop(m) OVER w, 1e-8), 6) AS x FROM bins WINDOW w AS (PARTITION BY ch, k)")
def fft_zscore(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.spectrum_z("samples"), "ch", "k")


@query(f"WITH {DFT} SELECT ch, k, CAST(arg_max(b, round(m, 9)) AS INTEGER) AS peak FROM bins GROUP BY ch, k")
def fft_peak_bin(spark, sf_dir):
    m = F.transform(K.spectrum("samples"), lambda x: F.round(x, 9))
    return framed(spark, sf_dir).withColumn("_m", m).select("ch", "k", (F.array_position("_m", F.array_max("_m")) - 1).cast("int").alias("peak"))


def _envelope_sql(points: int, radius: int, halvings: int) -> str:
    levels = ", e0 AS (SELECT ch, k, p, abs(v)::DOUBLE AS a FROM fr)"
    for h in range(halvings):
        levels += f", e{h + 1} AS (SELECT ch, k, p // 2 AS p, avg(a) AS a FROM e{h} GROUP BY ch, k, p // 2)"
    n = 256 >> halvings
    return f"""WITH {SIG}{levels}, m AS (SELECT e.ch, e.k, j, avg(a) AS x FROM e{halvings} e, range({points}) r(j) WHERE p BETWEEN floor(j * {n / points}::DOUBLE + {n / points / 2}::DOUBLE) - {radius} AND floor(j * {n / points}::DOUBLE + {n / points / 2}::DOUBLE) + {radius} GROUP BY e.ch, e.k, j)
SELECT ch, k, CAST(j AS INTEGER) AS j, round(CASE WHEN max(x) OVER w > 1e-8 THEN x / max(x) OVER w ELSE x END, 6) AS x FROM m WINDOW w AS (PARTITION BY ch, k)"""


@query(_envelope_sql(16, 8, 0))
def envelope_fine(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.envelope_fine("samples"), "ch", "k")


@query(_envelope_sql(8, 4, 1))
def envelope_medium(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.envelope_medium("samples"), "ch", "k")


@query(_envelope_sql(8, 4, 2))
def envelope_coarse(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.envelope_coarse("samples"), "ch", "k")


@query(f"""WITH {SIG}, m AS (SELECT ch, k, j, avg(abs(v)::DOUBLE) FILTER (WHERE p BETWEEN 16 * j + 3 AND 16 * j + 12) AS sta, avg(abs(v)::DOUBLE) FILTER (WHERE p BETWEEN 16 * j - 42 AND 16 * j + 57) AS lta FROM fr, range(16) r(j) GROUP BY ch, k, j),
q AS (SELECT ch, k, j, CASE WHEN lta > 1e-8 THEN sta / lta ELSE 0 END AS x FROM m)
SELECT ch, k, CAST(j AS INTEGER) AS j, round(CASE WHEN max(x) OVER w > 1e-8 THEN x / max(x) OVER w ELSE x END, 6) AS x FROM q WINDOW w AS (PARTITION BY ch, k)""")
def sta_lta(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.sta_lta("samples"), "ch", "k")


@query(f"""WITH {SIG}, c AS (SELECT ch, k, p, v - avg(v::DOUBLE) OVER (PARTITION BY ch, k) AS d FROM fr), va AS (SELECT ch, k, sum(d * d) AS ss FROM c GROUP BY ch, k),
l AS (SELECT a.ch, a.k, b.p - a.p AS lag, sum(a.d * b.d) AS s FROM c a JOIN c b ON a.ch = b.ch AND a.k = b.k AND b.p - a.p BETWEEN 1 AND 32 GROUP BY a.ch, a.k, b.p - a.p)
SELECT l.ch, l.k, CAST(lag - 1 AS INTEGER) AS j, round(CASE WHEN ss / 256 < 1e-10 THEN 0 ELSE s / ss END, 6) AS x FROM l JOIN va ON l.ch = va.ch AND l.k = va.k""")
def autocorr32(spark, sf_dir):
    return exploded(framed(spark, sf_dir), K.autocorrelation("samples"), "ch", "k")


_TURNS = ", ".join(f"{f}(s * (2 * pi() * {m} / {p}))" for p in (86400, 3600) for m in (1, 2, 4, 8) for f in ("sin", "cos"))


@query(f"WITH e AS (SELECT event_id, (epoch_us(ts) // 1000000 % 86400)::DOUBLE AS s FROM events), a AS (SELECT event_id, [{_TURNS}] AS v FROM e) SELECT event_id, CAST(unnest(range(16)) AS INTEGER) AS j, round(unnest(v), 6) AS x FROM a")
def tod_encoding(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return exploded(read(spark, sf_dir, "events"), A.time_of_day(micros), "event_id")


@query(f"WITH {SIG}, a AS (SELECT ch, k, list(v ORDER BY p) AS l FROM fr GROUP BY ch, k) SELECT ch, k, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(l, lambda x: CASE WHEN x < 0 THEN 18446744073709551616::UHUGEINT - (-x)::UHUGEINT ELSE x::UHUGEINT END)), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS window_hash FROM a")
def window_hash(spark, sf_dir):
    return framed(spark, sf_dir).select("ch", "k", K.window_hash("samples").alias("window_hash"))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS j, round(unnest(list_transform(v, lambda x: CASE WHEN n > 1e-8 THEN x / n ELSE x END)), 6) AS x FROM n")
def l2_normalize(spark, sf_dir):
    return exploded(read(spark, sf_dir, "embeddings"), A.normalized(F.col("embedding")), "vec_id")


@query("SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", "other_id", r6(A.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


_QUANT = "q AS (SELECT vec_id, v, s, list_transform(v, lambda x: CAST(greatest(-127, least(127, round(x / s))) AS INTEGER)) AS q FROM (SELECT vec_id, v, CASE WHEN m <= 1e-10 THEN 1.0::DOUBLE / 127 ELSE m / 127 END AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)))"


@query(f"WITH {_QUANT} SELECT vec_id, round(s, 9) AS scale, CAST(unnest(range(len(q))) AS INTEGER) AS j, unnest(q) AS code FROM q")
def int8_quant(spark, sf_dir):
    q = read(spark, sf_dir, "embeddings").select("vec_id", A.quantized(F.col("embedding")).alias("z"))
    return q.select("vec_id", F.round("z.scale", 9).alias("scale"), F.posexplode("z.q").alias("j", "code")).withColumn("code", F.col("code").cast("int"))


@query(f"WITH {_QUANT} SELECT vec_id, round(list_avg(list_transform(range(1, len(v) + 1), lambda i: pow(v[i] - q[i] * s, 2))) * 1e6, 6) AS mse_millionths FROM q")
def int8_roundtrip_mse(spark, sf_dir):
    z = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", A.quantized(F.col("embedding")).alias("z"))
    errors = F.zip_with("embedding", A.dequantized(F.col("z.scale"), F.col("z.q")), lambda x, y: F.pow(x.cast("double") - y, 2))
    return z.select("vec_id", r6(A.mean_of(errors) * 1e6).alias("mse_millionths"))


def _knn_sql(k: int, queries: str, where: str, distance: str, digits: int = 6) -> str:
    return f"WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, {distance} AS x FROM embeddings a, embeddings b WHERE {queries} AND {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, vec_id) AS r FROM d) SELECT query_id, vec_id, CAST(r AS INTEGER) AS rank, round(x, {digits}) AS distance FROM r WHERE r <= {k}"


_COS = "1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_L2 = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))"


@query(_knn_sql(16, "a.vec_id % 20 = 0", "true", _COS))
def knn_top16(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.nearest(e.where("vec_id % 20 = 0"), e, 16)


@query(_knn_sql(16, "a.vec_id % 20 = 0", "a.label = b.label AND a.vec_id != b.vec_id", _COS))
def knn_filtered_label(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.nearest(e.where("vec_id % 20 = 0"), e, 16, same="label", skip_self=True)


@query(_knn_sql(5, "true", "a.vec_id != b.vec_id", _COS))
def knn_self_join(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.nearest(e, e, 5, skip_self=True)


@query(_knn_sql(16, "a.vec_id % 20 = 0", "true", _L2))
def l2_top16(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.nearest(e.where("vec_id % 20 = 0"), e, 16, metric="l2")


@query(_knn_sql(16, "a.vec_id % 20 = 0", "b.vec_id <= a.vec_id", _COS))
def knn_causal(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.nearest(e.where("vec_id % 20 = 0"), e, 16, earlier=True)


_EDGES = "e AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id != b.vec_id), top AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY x, dst) AS r FROM e)"


@query(f"WITH {_EDGES} SELECT src, dst FROM top WHERE r <= 8")
def prune_degree_m(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = V.nearest(e.where("vec_id % 20 = 0"), e, 16, skip_self=True).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "distance", "rank")
    return V.pruned(near, 8, "rank").select("src", "dst")


@query(f"WITH {_EDGES}, k AS (SELECT src, dst, (row_number() OVER (ORDER BY src, r)) - 1 AS edge_id FROM top WHERE r <= 4) SELECT src, dst, CAST(src * 100000 + dst AS BIGINT) AS edge_id FROM k UNION ALL SELECT dst, src, CAST(src * 100000 + dst AS BIGINT) FROM k")
def symmetric_adjacency(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = V.nearest(e.where("vec_id % 20 = 0"), e, 4, skip_self=True)
    edges = near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), (F.col("query_id") * 100000 + F.col("vec_id")).alias("edge_id"))
    return V.symmetric(edges)


@query("WITH m AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY user_id), n AS (SELECT max(epoch_us(ts)) AS now FROM events) SELECT user_id, CASE WHEN now - last > 43200000000 THEN 'Warm' ELSE 'Hot' END AS tier FROM m, n")
def tier_assignment(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return V.tiers(e, "user_id", "us", 12 * 3600 * 1_000_000)


@query("SELECT count(*) AS nodes FROM embeddings")
def node_count(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.count("*").alias("nodes"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 77, 100000)")
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(3, 77, 100000)).select("vec_id", "label")


@query()
def sharded_graph_search(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return V.graph_search(e, e.where("vec_id % 20 = 0"), 16)


@query()
def embedding_vectors(spark, sf_dir):
    from ..operators import embedding as E

    return E.embedded(P.metadata(framed(spark, sf_dir))).select("ch", "k", "vector", "source_window_hash", "norm")


@query(f"""WITH {META}, o AS (SELECT list(rms ORDER BY k, ch) FILTER (WHERE wave_type = 'Unknown') AS l FROM cls) SELECT round(list_reduce(list_prepend(0.0::DOUBLE, l), lambda f, x: 0.99::DOUBLE * f + 0.01::DOUBLE * x), 6) AS noise_floor FROM o""")
def adaptive_noise_floor(spark, sf_dir):
    from ..operators import embedding as E

    return E.noise_floor(P.metadata(framed(spark, sf_dir)), ["k", "ch"]).select(r6("noise_floor").alias("noise_floor"))
