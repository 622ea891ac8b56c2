"""Graph, state, alert, adaptation and operations queries over the driver tables, and their SQL.

An event is an observation: station = user, amplitude = value, probability = value / 100 up to 1, magnitude = value / 50.
Gaps between events are hours, so time constants are scaled to hours here; the operators default to seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import adaptation as D
from ..operators import alerts as L
from ..operators import folds as W
from ..operators import framing as P
from ..operators import graph as G
from ..operators import runtime as R
from ..operators import transitions as T
from ..operators import vectors as V
from .signal_queries import r6, read

HOUR = 3_600_000_000
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = F.when(F.col("event_type").isin("purchase", "click"), "P").when(F.col("event_type") == "signup", "S").when(F.col("event_type") == "view", "Surface").otherwise("Unknown")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", us.alias("us"), "value", "event_type", F.least(F.lit(1.0), F.col("value") / 100).alias("probability"), (F.col("value") / 50).alias("magnitude"), wave.alias("wave"))


def day():
    return F.floor(F.col("us") / (24 * HOUR))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordinal(events(spark, sf_dir), "user_id", ["us", "event_id"], day(), "rn").withColumn("rn", F.col("rn") + 1)


EV = """ev AS (SELECT event_id, user_id, epoch_us(ts) AS us, value, event_type, least(1.0::DOUBLE, value / 100) AS probability, value / 50 AS magnitude, CASE WHEN event_type IN ('purchase', 'click') THEN 'P' WHEN event_type = 'signup' THEN 'S' WHEN event_type = 'view' THEN 'Surface' ELSE 'Unknown' END AS wave, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
ED = EV + f""", ed AS (SELECT a.event_id AS src_id, b.event_id AS dst_id, b.us - a.us AS delta_us, a.wave AS from_wave, b.wave AS to_wave, CASE WHEN a.value <= 1e-8 THEN 1 ELSE b.value / a.value END AS amplitude_ratio, b.value / 10 - a.value / 10 AS freq_shift_hz FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_id != b.event_id AND b.us BETWEEN a.us AND a.us + {6 * HOUR})"""


def _nodes(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), "us", "user_id", "wave", F.col("value").alias("amplitude"), (F.col("value") / 10).alias("freq"))


@query(f"WITH {EV} SELECT a.event_id AS src_id, b.event_id AS dst_id FROM ev a JOIN ev b ON a.event_id != b.event_id AND b.us BETWEEN a.us AND a.us + {HOUR // 6}")
def causal_edges(spark, sf_dir):
    return G.causal_edges(_nodes(spark, sf_dir).select("id", "us"), HOUR // 6).select("src_id", "dst_id")


@query(f"WITH {ED} SELECT src_id, dst_id, delta_us, from_wave, to_wave, round(amplitude_ratio, 6) AS amplitude_ratio, round(freq_shift_hz, 6) AS freq_shift_hz FROM ed")
def edge_features(spark, sf_dir):
    f = G.edge_features(G.causal_edges(_nodes(spark, sf_dir), 6 * HOUR, by="user_id"))
    return f.withColumn("amplitude_ratio", r6("amplitude_ratio")).withColumn("freq_shift_hz", r6("freq_shift_hz"))


@query(f"WITH {ED}, w(w) AS (VALUES ('P'), ('S'), ('Surface')), c AS (SELECT CASE from_wave WHEN 'Unknown' THEN 'P' ELSE from_wave END AS f, CASE to_wave WHEN 'Unknown' THEN 'P' ELSE to_wave END AS t, count(*) AS n FROM ed GROUP BY 1, 2), g AS (SELECT a.w AS f, b.w AS t, coalesce(n, 0) AS n FROM w a CROSS JOIN w b LEFT JOIN c ON c.f = a.w AND c.t = b.w) SELECT f AS from_wave, t AS to_wave, round(CASE WHEN sum(n) OVER (PARTITION BY f) > 0 THEN n::DOUBLE / sum(n) OVER (PARTITION BY f) ELSE 1.0 / 3 END, 6) AS p FROM g")
def transition_matrix(spark, sf_dir):
    f = G.edge_features(G.causal_edges(_nodes(spark, sf_dir), 6 * HOUR, by="user_id"))
    return G.transition_matrix(f).withColumn("p", r6("p"))


@query(f"""WITH {EV}, up AS (SELECT CASE a.wave WHEN 'S' THEN 'S' WHEN 'Surface' THEN 'Surface' ELSE 'P' END AS f, CASE b.wave WHEN 'S' THEN 2 WHEN 'Surface' THEN 3 ELSE 1 END AS c, (b.probability - 0.3::DOUBLE) / 5 AS d, b.us, b.event_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.rn = a.rn + 1),
l AS (SELECT f, list([c::DOUBLE, d, 0::DOUBLE] ORDER BY us, event_id) AS l FROM up GROUP BY f),
m AS (SELECT f, list_reduce(list_prepend([1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE], l), lambda v, x: list_transform([list_transform([1, 2, 3], lambda k: CASE WHEN k = x[1] THEN greatest(v[k] + x[2], 0) ELSE v[k] END)], lambda u: list_transform(u, lambda q: CASE WHEN list_sum(u) > 1e-8 THEN q / list_sum(u) ELSE 1 / 3::DOUBLE END))[1]) AS v FROM l),
w(w, k) AS (VALUES ('P', 1), ('S', 2), ('Surface', 3)) SELECT a.w AS from_wave, b.w AS to_wave, round(coalesce(v[b.k], 1 / 3::DOUBLE), 6) AS p FROM w a CROSS JOIN w b LEFT JOIN m ON m.f = a.w""")
def transition_learning(spark, sf_dir):
    """Each event after another of its user moves the share of that transition by how sure it is."""
    e = ranked(spark, sf_dir)
    back = e.select("user_id", (F.col("rn") + 1).alias("rn"), F.col("wave").alias("from_wave"))
    updates = e.join(back, ["user_id", "rn"]).select("us", "event_id", "from_wave", F.col("wave").alias("to_wave"), ((F.col("probability") - 0.3) / 5).alias("delta"))
    return T.ordered_transitions(updates, ["us", "event_id"]).withColumn("p", r6("p"))


@query("""WITH d AS (SELECT a.vec_id AS centre, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS o FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
u AS (SELECT vec_id AS centre, vec_id AS id, 0 AS kind, 0 AS o FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT centre, id, 1, o FROM d WHERE o <= 16 UNION ALL SELECT a.vec_id, b.vec_id, 2, b.vec_id - a.vec_id + 99 FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id BETWEEN a.vec_id - 99 AND a.vec_id),
f AS (SELECT centre, id, min(kind * 1000 + o) AS o FROM u GROUP BY centre, id) SELECT centre, id, CAST(row_number() OVER (PARTITION BY centre ORDER BY o, id) - 1 AS INTEGER) AS place FROM f""")
def subgraph_nodes(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    centres = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("centre"))
    near = V.nearest(e.where("vec_id % 20 = 0"), e, 16).select(F.col("query_id").alias("centre"), F.col("vec_id").alias("id"), F.col("rank").alias("order"))
    past = G.recent(e.select(F.col("vec_id").alias("id")), 100).join(centres, "centre")  # ids have no gaps here
    return G.neighbourhood(centres, near, past).withColumn("place", F.col("place").cast("int"))


_SUB = f"""WITH sn AS ({SQL["subgraph_nodes"]}), nd AS (SELECT centre, id, (['P', 'S', 'Surface', 'Unknown'])[label % 4 + 1] AS wave, embedding[1]::DOUBLE AS amplitude, embedding[2]::DOUBLE AS freq FROM sn JOIN embeddings ON vec_id = id),
se AS (SELECT a.centre, a.id AS src_id, b.id AS dst_id, b.id - a.id AS delta_us, a.wave AS from_wave, b.wave AS to_wave, CASE WHEN a.amplitude <= 1e-8 THEN 1 ELSE b.amplitude / a.amplitude END AS amplitude_ratio, b.freq - a.freq AS freq_shift_hz FROM nd a JOIN nd b ON a.centre = b.centre AND a.id != b.id AND b.id BETWEEN a.id AND a.id + 60)"""


def _subgraph_edges(spark, sf_dir):
    """Edges of the graphs of subgraph_nodes; ids are the times, and what else an observation has comes from its row."""
    wave = F.element_at(F.array(*[F.lit(w) for w in (*G.WAVES, "Unknown")]), (F.col("label") % 4 + 1).cast("int"))
    seen = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("us"), wave.alias("wave"), F.col("embedding")[0].cast("double").alias("amplitude"), F.col("embedding")[1].cast("double").alias("freq"))
    return G.subgraph_edges(subgraph_nodes(spark, sf_dir).join(seen, "id"), 60)


@query(_SUB + " SELECT centre, src_id, dst_id, delta_us, from_wave, to_wave, round(amplitude_ratio, 6) AS amplitude_ratio, round(freq_shift_hz, 6) AS freq_shift_hz FROM se")
def subgraph_edges(spark, sf_dir):
    """Causal edges by centre, among the nodes of its graph only."""
    return _subgraph_edges(spark, sf_dir).withColumn("amplitude_ratio", r6("amplitude_ratio")).withColumn("freq_shift_hz", r6("freq_shift_hz"))


@query(_SUB + ", ad AS (SELECT centre, src_id AS id, dst_id AS other FROM se UNION SELECT centre, dst_id, src_id FROM se) SELECT centre, id, count(*) AS n_linked, string_agg(other::VARCHAR, ',' ORDER BY other) AS linked FROM ad GROUP BY centre, id")
def subgraph_adjacency(spark, sf_dir):
    """The partners of each node within its graph, in either direction."""
    found = G.adjacency(_subgraph_edges(spark, sf_dir))
    return found.select("centre", "id", F.size("linked").cast("long").alias("n_linked"), F.array_join(F.transform("linked", lambda x: x.cast("string")), ",").alias("linked"))


@query("""WITH d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_avg(a.embedding::DOUBLE[]) + list_avg(b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS o FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id != b.vec_id),
e AS (SELECT src, dst, CASE WHEN s > 0 THEN s ELSE 0.2::DOUBLE * s END AS e FROM d WHERE o <= 8), x AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY src)) AS x FROM e) SELECT src, dst, round(x / sum(x) OVER (PARTITION BY src), 6) AS weight FROM x""")
def attention_softmax(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = V.nearest(e.where("vec_id % 20 = 0"), e, 8, skip_self=True)
    means = e.select("vec_id", A.mean_of(F.col("embedding")).alias("m"))
    edges = near.join(means.select(F.col("vec_id").alias("query_id"), F.col("m").alias("_a")), "query_id").join(means, "vec_id")
    return G.attention(edges.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), (F.col("_a") + F.col("m")).alias("score"))).withColumn("weight", r6("weight"))


@query()
def gat_predict(spark, sf_dir):
    """Every row is a centre, with its 16 nearest and the last 100 rows up to it in the order of ids."""
    e = read(spark, sf_dir, "embeddings")
    near = V.nearest(e, e, 16).select(F.col("query_id").alias("centre"), F.col("vec_id").alias("id"), F.col("rank").alias("order"))
    nodes = G.neighbourhood(e.select(F.col("vec_id").alias("centre")), near, G.recent(e.select(F.col("vec_id").alias("id")), 100))
    # observation times are the ids here; an edge runs from the earlier to the later within 60
    return G.predictions(nodes, e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("us"), F.col("embedding").alias("vector")), 60)


@query(f"WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS recent_mean FROM ev")
def history_last_n(spark, sf_dir):
    seen = P.trailing(events(spark, sf_dir), "user_id", ["us", "event_id"], day(), 100, lambda w: F.avg("value").over(w), "recent_mean")
    return seen.select("event_id", F.round("recent_mean", 8).alias("recent_mean"))  # no mean of up to 100 hundredths has a tie there


@query(f"WITH {EV} SELECT user_id, round(list_reduce(list(value ORDER BY us, event_id), lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a), 6) AS ema FROM ev GROUP BY user_id")
def ema_rate(spark, sf_dir):
    e = events(spark, sf_dir)
    return W.smoothed(e, "user_id", ["us", "event_id"], F.col("value"), 0.1, day()).withColumn("ema", r6("ema"))


@query(f"WITH {EV} SELECT user_id, round(list_reduce(list(value ORDER BY us, event_id), lambda f, x: CASE WHEN x < 2 * f OR f = 0 THEN 0.1::DOUBLE * x + 0.9::DOUBLE * f ELSE f END), 6) AS floor FROM ev GROUP BY user_id")
def noise_floor_gated(spark, sf_dir):
    return W.gated_floor(events(spark, sf_dir), "user_id", ["us", "event_id"], "value").withColumn("floor", r6("floor"))


RUNS = EV + """, m AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM ev),
rr AS (SELECT user_id, run, sum(bad::INT)::BIGINT AS n FROM m GROUP BY user_id, run), runs AS (SELECT user_id, max(n) AS longest, arg_max(n, run) AS current FROM rr GROUP BY user_id)"""


@query(f"WITH {RUNS} SELECT user_id, longest, current FROM runs")
def failure_runs(spark, sf_dir):
    return W.failure_runs(events(spark, sf_dir), "user_id", ["us", "event_id"], F.col("event_type") != "error", day())


@query(f"WITH {RUNS}, e AS (SELECT user_id, list_reduce(list(value ORDER BY us, event_id), lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a) AS ema FROM ev GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 10 = 0 OR current > 1 THEN 'Failed' WHEN abs(ema - 50) / 50 > 0.5 THEN 'Degraded' ELSE 'Active' END AS status FROM runs JOIN e USING (user_id)")
def sensor_health(spark, sf_dir):
    e = events(spark, sf_dir)
    runs = W.failure_runs(e, "user_id", ["us", "event_id"], F.col("event_type") != "error", day())
    rates = W.smoothed(e, "user_id", ["us", "event_id"], F.col("value"), 0.1, day())
    registered = e.select("user_id").distinct().where("user_id % 10 != 0").withColumn("expected", F.lit(50.0))
    joined = runs.join(rates, "user_id").join(registered, "user_id", "left")
    return joined.select("user_id", W.sensor_status(F.col("current"), F.col("ema"), F.col("expected"), 1, 0.5).alias("status"))


_SIG = "[probability - 0.5, magnitude - 3, value / 10 - 5, probability - 0.5]"


@query(f"WITH {EV} SELECT event_id, CAST(unnest(range(4)) AS INTEGER) AS j, round(unnest({_SIG}), 6) AS x FROM ev")
def error_signal(spark, sf_dir):
    return _signals(spark, sf_dir).select("event_id", F.posexplode("gradient").alias("j", "x")).withColumn("x", r6("x"))


def _signals(spark, sf_dir):
    g = D.error_signal(F.col("probability"), F.col("magnitude"), F.col("value") / 10, F.col("probability"))
    return events(spark, sf_dir).withColumn("gradient", g).withColumn("features", F.array(F.col("value"), F.col("probability"), F.col("magnitude"), F.lit(1.0)))


_FEAT = "f AS (SELECT user_id, unnest(range(4)) AS r, unnest([avg(value), avg(probability), avg(magnitude), 1.0]) AS m FROM ev GROUP BY user_id)"


@query(f"WITH {EV}, {_FEAT}, l AS (SELECT user_id, unnest(range(4)) AS i, unnest({_SIG}) AS g FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1)) SELECT user_id, CAST(i AS INTEGER) AS i, CAST(r AS INTEGER) AS r, round(g * 0.01::DOUBLE * m, 6) AS a FROM l JOIN f USING (user_id)")
def lora_delta_micro(spark, sf_dir):
    s = _signals(spark, sf_dir)
    last = W.last_of_each(s.select("user_id", "us", "event_id", "gradient"), "user_id", ["us", "event_id"])
    return D.low_rank_delta(last, s, "user_id", 4, 0.01).withColumn("a", r6("a"))


@query(f"WITH {EV}, {_FEAT}, l AS (SELECT user_id, unnest(range(4)) AS i, unnest([avg(probability - 0.5), avg(magnitude - 3), avg(value / 10 - 5), avg(probability - 0.5)]) AS g FROM ev GROUP BY user_id) SELECT user_id, CAST(i AS INTEGER) AS i, CAST(r AS INTEGER) AS r, round(g * 0.001::DOUBLE * m, 9) AS a FROM l JOIN f USING (user_id)")
def lora_delta_base(spark, sf_dir):
    s = _signals(spark, sf_dir)
    means = s.groupBy("user_id").agg(F.array(*[F.avg(F.col("gradient")[k]) for k in range(4)]).alias("gradient"))
    return D.low_rank_delta(means, s, "user_id", 16, 0.001).withColumn("a", F.round("a", 9))


@query("WITH a AS (SELECT i, r, (i * 2 + r + 1) / 10.0::DOUBLE AS a FROM range(3) x(i), range(2) y(r)), b AS (SELECT r, j, (r + j) / 4.0::DOUBLE AS b FROM range(2) x(r), range(4) y(j)) SELECT i, j, round(1 + sum(a * b), 6) AS w FROM a JOIN b USING (r) GROUP BY i, j")
def lora_apply(spark, sf_dir):
    grid = lambda n, m, x, y: spark.range(n).select(F.col("id").alias(x)).join(spark.range(m).select(F.col("id").alias(y)))
    a = grid(3, 2, "i", "r").withColumn("a", (F.col("i") * 2 + F.col("r") + 1) / 10)
    b = grid(2, 4, "r", "j").withColumn("b", (F.col("r") + F.col("j")) / 4)
    return D.applied(grid(3, 4, "i", "j").withColumn("w", F.lit(1.0)), a, b).withColumn("w", r6("w"))


@query(f"""WITH {EV}, p AS (SELECT a.event_id AS id, a.user_id, a.probability, (SELECT min(b.us) FROM ev b WHERE b.user_id = a.user_id AND b.us > a.us) AS f FROM ev a),
g AS (SELECT p.id, coalesce(bool_or(e.wave = 'S' AND e.us - f BETWEEN {10 * HOUR} AND {100 * HOUR}), false) AS sh, coalesce(bool_or(e.wave = 'Surface' AND e.us - f >= {50 * HOUR}), false) AS su, max(e.value) AS top, max(e.us) AS last FROM p JOIN ev e ON e.user_id = p.user_id AND e.us BETWEEN f AND f + {300 * HOUR} GROUP BY p.id)
SELECT p.id, CASE WHEN probability <= 0.3::DOUBLE THEN false WHEN last IS NOT NULL THEN sh AND su END AS event, CASE WHEN probability > 0.3::DOUBLE AND sh AND su AND top > 0 THEN round(log10(top), 6) END AS magnitude, CASE WHEN probability <= 0.3::DOUBLE THEN coalesce(last, 0) ELSE last END AS labeled_at FROM p LEFT JOIN g ON g.id = p.id""")
def ground_truth_labels(spark, sf_dir):
    """Every event is a prediction; the later events of its user are the waves."""
    e = events(spark, sf_dir).withColumn("station", F.col("user_id"))
    asked = e.select(F.col("event_id").alias("id"), "station", "us", "probability")
    return D.followed(asked, e.select("station", "us", "wave", F.col("value").alias("amplitude")), 10 * HOUR).withColumn("magnitude", r6("magnitude"))


_ARMS = "o AS (SELECT CASE user_id % 2 WHEN 0 THEN 'candidate' ELSE 'current' END AS arm, (probability >= 0.5) = (event_type IN ('purchase', 'signup')) AS ok FROM ev)"


def _outcomes(spark, sf_dir):
    return events(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "candidate").otherwise("current").alias("arm"), "probability", F.col("event_type").isin("purchase", "signup").alias("event"))


@query(f"WITH {EV}, {_ARMS} SELECT arm, count(*) AS samples, sum(ok::INT)::BIGINT AS correct, round(avg(ok::INT), 6) AS accuracy FROM o GROUP BY arm")
def probation_accuracy(spark, sf_dir):
    return D.accuracy(_outcomes(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query(f"WITH {EV}, {_ARMS}, a AS (SELECT avg(ok::INT) FILTER (WHERE arm = 'candidate') AS c, avg(ok::INT) FILTER (WHERE arm = 'current') AS u FROM o) SELECT round(c, 6) AS candidate, round(u, 6) AS current, CASE WHEN c >= u THEN 'Promote' ELSE 'Rollback' END AS result FROM a")
def probation_decision(spark, sf_dir):
    return D.probation(D.accuracy(_outcomes(spark, sf_dir)), F.lit(3600)).withColumn("candidate", r6("candidate")).withColumn("current", r6("current"))


_LEVEL = "CASE WHEN probability >= 0.9::DOUBLE THEN 'Critical' WHEN probability >= 0.7::DOUBLE THEN 'High' WHEN probability >= 0.5::DOUBLE THEN 'Medium' WHEN probability >= 0.3::DOUBLE THEN 'Low' END"


@query(f"WITH {EV} SELECT event_id, {_LEVEL} AS level FROM ev")
def alert_level(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", L.level(F.col("probability")).alias("level"))


def _decisions_sql(mesh: bool) -> str:
    high = "'DeferForConsensus'" if mesh else "'EmitCappedAtMedium'"
    fold = f"""WITH RECURSIVE {EV}, lv AS (SELECT *, {_LEVEL} AS level, CASE WHEN probability >= 0.9::DOUBLE THEN 3 WHEN probability >= 0.7::DOUBLE THEN 2 WHEN probability >= 0.5::DOUBLE THEN 1 WHEN probability >= 0.3::DOUBLE THEN 0 END AS lr FROM ev),
st(user_id, rn, event_id, level, kind, last, mag, since) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, -1, 0.0::DOUBLE, 0::BIGINT FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT user_id, rn, event_id, level, kind, CASE WHEN kind = 'EmitLocal' THEN lr WHEN kind = 'EmitCappedAtMedium' THEN 1 ELSE last END, CASE WHEN kind IN ('EmitLocal', 'EmitCappedAtMedium') THEN magnitude ELSE mag END, CASE WHEN kind IN ('EmitLocal', 'EmitCappedAtMedium') THEN us ELSE since END FROM
(SELECT l.user_id, l.rn, l.event_id, l.level, l.lr, l.us, l.magnitude, s.last, s.mag, s.since, CASE WHEN l.level IS NULL THEN 'NoAlert' WHEN s.last >= 0 AND l.us - s.since < {12 * HOUR} AND s.last >= l.lr AND NOT l.magnitude >= s.mag + 0.5::DOUBLE THEN 'Suppressed' WHEN l.lr >= 2 THEN {high} ELSE 'EmitLocal' END AS kind FROM st s JOIN lv l ON l.user_id = s.user_id AND l.rn = s.rn + 1))"""
    return fold


def _decided(spark, sf_dir, mesh):
    p = events(spark, sf_dir).select(F.col("user_id").alias("station"), "us", F.col("event_id").alias("id"), "probability", "magnitude")
    return L.decisions(p, L.Cooldown(12 * HOUR), mesh)


@query(_decisions_sql(False) + " SELECT event_id AS id, level, kind FROM st WHERE rn > 0")
def alert_decision(spark, sf_dir):
    return _decided(spark, sf_dir, False).select("id", "level", "kind")


@query(_decisions_sql(True) + " SELECT event_id AS id, level, kind FROM st WHERE rn > 0")
def alert_decision_mesh(spark, sf_dir):
    return _decided(spark, sf_dir, True).select("id", "level", "kind")


@query(_decisions_sql(False) + " SELECT kind, count(*) AS n FROM st WHERE rn > 0 GROUP BY kind")
def cooldown_fold(spark, sf_dir):
    return _decided(spark, sf_dir, False).groupBy("kind").agg(F.count("*").alias("n"))


@query(_decisions_sql(False) + ", al AS (SELECT event_id AS id, CASE kind WHEN 'EmitCappedAtMedium' THEN 'Medium' ELSE level END AS level FROM st WHERE kind IN ('EmitLocal', 'EmitCappedAtMedium')) SELECT id, unnest(CASE level WHEN 'Medium' THEN [17] WHEN 'High' THEN [27] WHEN 'Critical' THEN [27, 22] ELSE []::INTEGER[] END) AS pin FROM al")
def gpio_pins(spark, sf_dir):
    sent = _decided(spark, sf_dir, False).where(F.col("kind").isin("EmitLocal", "EmitCappedAtMedium"))
    return L.pins(sent.select("id", F.when(F.col("kind") == "EmitCappedAtMedium", "Medium").otherwise(F.col("level")).alias("level")))


def _claims(spark, sf_dir):
    """Predictions that wait for consensus, with the level they were made at."""
    return _decided(spark, sf_dir, True).where("kind = 'DeferForConsensus'").select(F.col("id").alias("claim_id"), "station", "us", "level")


def _votes(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").alias("station"), "us")


_CLAIMS = _decisions_sql(True) + ", cl AS (SELECT s.event_id AS claim_id, s.user_id AS station, e.us, s.level FROM st s JOIN ev e USING (event_id) WHERE s.kind = 'DeferForConsensus')"
_VOTED = _CLAIMS + f", vo AS (SELECT c.claim_id, count(DISTINCT e.user_id) AS n FROM cl c JOIN ev e ON e.us > c.us AND e.us - c.us < {HOUR // 6} GROUP BY c.claim_id)"


@query(f"{_VOTED} SELECT cl.claim_id, coalesce(n, 0) AS stations, CASE WHEN coalesce(n, 0) >= 1 THEN 'Reached' ELSE 'Pending' END AS status FROM cl LEFT JOIN vo USING (claim_id)")
def claim_confirmations(spark, sf_dir):
    return L.confirmations(_claims(spark, sf_dir), _votes(spark, sf_dir), HOUR // 6)


@query(f"{_VOTED} SELECT claim_id, station, us AS timestamp_us, CAST(2 AS BIGINT) AS consensus_stations, level FROM cl JOIN vo USING (claim_id)")
def consensus_alerts(spark, sf_dir):
    judged = L.judged(_claims(spark, sf_dir), _votes(spark, sf_dir), HOUR // 6)
    return L.reached(judged).withColumn("consensus_stations", F.col("consensus_stations").cast("long"))


@query(f"{_VOTED}, n AS (SELECT max(us) AS now FROM ev) SELECT claim_id, 'Medium' AS level, 0.0::DOUBLE AS magnitude FROM cl LEFT JOIN vo USING (claim_id), n WHERE vo.n IS NULL AND now - us >= {HOUR // 6}")
def claim_expiry(spark, sf_dir):
    """Claims that no vote reached within the window."""
    now = events(spark, sf_dir).agg(F.max("us").alias("now"))
    waiting = L.judged(_claims(spark, sf_dir), _votes(spark, sf_dir), HOUR // 6).where("status = 'Pending'")
    return L.expired(waiting.join(F.broadcast(now)), F.col("now"), HOUR // 6)


@query()
def consensus_fold(spark, sf_dir):
    """Each station's predictions, and the votes for its claims."""
    return L.consensus(_said(spark, sf_dir), L.Cooldown(12 * HOUR), HOUR)


def _said(spark, sf_dir):
    """All predictions, and an event as a vote for the one with the id before it."""
    e = events(spark, sf_dir).select("user_id", "us", "event_id", "probability", "magnitude")
    made = e.select(F.col("user_id").alias("station"), "us", F.col("event_id").alias("id"), F.lit("prediction").alias("kind"), "probability", "magnitude", F.lit(None).cast("long").alias("voter"))
    owner = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("station"))
    votes = e.select((F.col("event_id") - 1).alias("id"), "us", F.col("user_id").alias("voter")).join(owner, "id")
    votes = votes.select("station", "us", "id", F.lit("vote").alias("kind"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("magnitude"), "voter")
    return made.unionByName(votes)


@query()
def consensus_expiries(spark, sf_dir):
    """consensus_fold with two votes needed, and a row for each claim that expires."""
    return L.consensus_events(_said(spark, sf_dir), L.Cooldown(12 * HOUR), HOUR, 2)


_ROUTE = "CASE event_type WHEN 'signup' THEN 'drain' WHEN 'error' THEN 'urgent' ELSE 'push' END"


@query(f"""WITH RECURSIVE {EV}, st(user_id, rn, q, gone, fate, cause) AS (SELECT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], '', NULL::BIGINT FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.event_type = 'signup' THEN []::BIGINT[] WHEN e.event_type = 'error' THEN list_concat([e.event_id], q[1:4]) WHEN len(q) >= 5 THEN list_concat(q[2:], [e.event_id]) ELSE list_concat(q, [e.event_id]) END,
CASE WHEN e.event_type = 'signup' THEN q WHEN len(q) < 5 THEN []::BIGINT[] WHEN e.event_type = 'error' THEN [q[5]] ELSE [q[1]] END, CASE WHEN e.event_type = 'signup' THEN 'drained' ELSE 'evicted' END, e.event_id FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1),
o AS (SELECT user_id, gone AS g, fate, cause FROM st WHERE len(gone) > 0 UNION ALL SELECT user_id, q, 'held', NULL FROM st WHERE len(q) > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1 AND rn = (SELECT max(rn) FROM ev WHERE ev.user_id = st.user_id))
SELECT user_id, unnest(g) AS event_id, fate, cause, CAST(unnest(range(len(g))) AS INTEGER) AS place FROM o""")
def outbound_queue(spark, sf_dir):
    """An event is a message of its user's queue of five: errors are urgent, and a signup drains."""
    e = events(spark, sf_dir).withColumn("op", F.expr(_ROUTE))
    return W.outbound(e, "user_id", ["us", "event_id"], "event_id", "op", 5)


@query(f"""WITH RECURSIVE {EV}, st(user_id, rn, event_id, known, rate, floor, failures, heard) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, false, 0.0::DOUBLE, 0.0::DOUBLE, 0, false FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT e.user_id, e.rn, e.event_id, known OR e.event_type = 'signup',
CASE WHEN e.event_type = 'signup' THEN 50 WHEN NOT known OR e.event_type = 'error' THEN rate WHEN NOT heard THEN e.value ELSE 0.1::DOUBLE * e.value + 0.9::DOUBLE * rate END,
CASE WHEN e.event_type = 'signup' THEN 0 WHEN NOT known OR e.event_type = 'error' THEN floor WHEN NOT heard THEN e.value WHEN e.value < 2 * floor OR floor = 0 THEN 0.1::DOUBLE * e.value + 0.9::DOUBLE * floor ELSE floor END,
CASE WHEN e.event_type = 'error' AND known THEN failures + 1 WHEN e.event_type != 'error' THEN 0 ELSE failures END, e.event_type != 'signup' AND (heard OR (known AND e.event_type != 'error'))
FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, CASE WHEN NOT known OR failures > 1 THEN 'Failed' WHEN abs(rate - 50) / 50 > 0.5::DOUBLE THEN 'Degraded' ELSE 'Active' END AS status, round(floor, 6) AS noise_floor FROM st WHERE rn > 0""")
def sensor_registry(spark, sf_dir):
    """Each user is a sensor that a signup registers at a rate of 50, again and again; an error is a failed read."""
    op = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "failure").otherwise("success")
    rate = F.when(F.col("event_type") == "signup", F.lit(50.0)).otherwise(F.col("value"))
    e = events(spark, sf_dir).withColumns({"op": op, "rate": rate, "level": F.col("value")})
    return W.registry(e, "user_id", ["us", "event_id"], most=1, tolerance=0.5).select("event_id", "status", r6("noise_floor").alias("noise_floor"))


@query(f"""WITH RECURSIVE {EV}, st(user_id, rn, event_id, kind, cand, since, cr, ca, ur, ua, version, result) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, '', NULL::BIGINT, 0::BIGINT, 0, 0, 0, 0, 0::BIGINT, '' FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT user_id, rn, event_id, event_type, CASE WHEN event_type = 'signup' THEN event_id WHEN result IN ('Promote', 'Rollback') THEN NULL ELSE cand END, CASE WHEN event_type = 'signup' THEN us ELSE since END,
CASE WHEN event_type = 'signup' THEN 0 ELSE cr + (counts AND arm AND ok)::INT END, CASE WHEN event_type = 'signup' THEN 0 ELSE ca + (counts AND arm)::INT END, CASE WHEN event_type = 'signup' THEN 0 ELSE ur + (counts AND NOT arm AND ok)::INT END, CASE WHEN event_type = 'signup' THEN 0 ELSE ua + (counts AND NOT arm)::INT END,
CASE WHEN result = 'Promote' THEN cand ELSE version END, result FROM (SELECT e.user_id, e.rn, e.event_id, e.event_type, e.us, s.cand, s.since, s.cr, s.ca, s.ur, s.ua, s.version, e.event_id % 2 = 0 AS arm, e.probability >= 0.5::DOUBLE AS ok, s.cand IS NOT NULL AND e.event_type NOT IN ('signup', 'purchase') AS counts,
CASE WHEN e.event_type != 'purchase' THEN '' WHEN s.cand IS NULL OR e.us - s.since < {48 * HOUR} THEN 'InProgress' WHEN (CASE WHEN s.ca = 0 THEN 0 ELSE s.cr / s.ca END) >= (CASE WHEN s.ua = 0 THEN 0 ELSE s.ur / s.ua END) THEN 'Promote' ELSE 'Rollback' END AS result FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
SELECT event_id, result, version FROM st WHERE kind = 'purchase'""")
def probation_lifecycle(spark, sf_dir):
    """A signup starts the probation of a version, a purchase evaluates it, all else are outcomes of an arm."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "evaluate").otherwise("outcome")
    arm = F.when(F.col("event_id") % 2 == 0, "candidate").otherwise("current")
    e = events(spark, sf_dir).withColumns({"kind": kind, "version": F.col("event_id"), "arm": arm, "ok": F.col("probability") >= 0.5})
    return D.probation_lifecycle(e, "user_id", ["us", "event_id"], 48 * HOUR).select("event_id", "result", "version")


@query("SELECT event_id AS claim_id, CASE WHEN value / 100 >= 0.7::DOUBLE THEN 'Known' ELSE 'UnknownClaim' END AS status FROM events")
def claim_lookup(spark, sf_dir):
    return L.claim_status(events(spark, sf_dir).select(F.col("event_id").alias("claim_id")), _claims(spark, sf_dir))


_PEERS = EV + f", pe AS (SELECT user_id, max(us) AS last FROM ev GROUP BY user_id), ph AS (SELECT user_id, CASE WHEN (SELECT max(us) FROM ev) - last <= {6 * HOUR} THEN 'Healthy' WHEN (SELECT max(us) FROM ev) - last <= {24 * HOUR} THEN 'Stale' ELSE 'Lost' END AS health FROM pe)"


def _peers(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.groupBy("user_id").agg(F.max("us").alias("last")).join(F.broadcast(e.agg(F.max("us").alias("now"))))
    return last.select("user_id", L.peer_health(F.col("last"), F.col("now"), 6 * HOUR, 24 * HOUR).alias("health"))


@query(f"""WITH {EV}, o AS (SELECT *, user_id % 16 AS m, row_number() OVER (ORDER BY us, event_id) AS g FROM ev), ac AS (SELECT * FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 0 ELSE us END AS last, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY g) AS adds FROM o WHERE event_type != 'error') WHERE adds > 0),
h AS (SELECT r.event_id, r.us - a.last AS gone FROM (SELECT r.event_id, r.us, r.g, p.user_id FROM o r JOIN (SELECT DISTINCT m, user_id FROM ac) p ON p.m = r.m WHERE r.event_type = 'error') r ASOF JOIN ac a ON a.user_id = r.user_id AND r.g >= a.g)
SELECT o.event_id, count(*) FILTER (gone <= {6 * HOUR})::INT AS healthy, count(*) FILTER (gone > {6 * HOUR} AND gone <= {24 * HOUR})::INT AS stale, count(*) FILTER (gone > {24 * HOUR})::INT AS lost FROM o LEFT JOIN h ON h.event_id = o.event_id WHERE o.event_type = 'error' GROUP BY o.event_id""")
def peer_registry(spark, sf_dir):
    """Sixteen stations, whose peers are the users: a signup adds one, an error refreshes all of its station, all else is heard from it."""
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "refresh").otherwise("seen")
    e = events(spark, sf_dir).select((F.col("user_id") % 16).alias("station"), "us", F.col("event_id").alias("id"), op.alias("op"), F.col("user_id").alias("peer"))
    return L.peer_registry(e, L.Peers(6 * HOUR, 24 * HOUR)).select(F.col("id").alias("event_id"), "healthy", "stale", "lost")


@query(f"WITH {_PEERS} SELECT user_id, health FROM ph")
def peer_health(spark, sf_dir):
    return _peers(spark, sf_dir)


@query(f"WITH {_PEERS} SELECT coalesce(bool_or(health = 'Healthy'), false) AS available FROM ph")
def mesh_available(spark, sf_dir):
    return _peers(spark, sf_dir).agg(F.coalesce(F.bool_or(F.col("health") == "Healthy"), F.lit(False)).alias("available"))


@query("SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'UnknownPeer' WHEN event_id % 11 = 0 THEN 'InvalidKey' WHEN event_id % 7 = 0 THEN 'InvalidSignature' WHEN event_type = 'error' THEN 'InvalidPayload' ELSE event_type END AS event FROM events")
def mesh_events(spark, sf_dir):
    e = events(spark, sf_dir)
    messages = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("station"), (F.col("event_id") % 11 != 0).alias("key_ok"), (F.col("event_id") % 7 != 0).alias("signature_ok"), (F.col("event_type") != "error").alias("payload_ok"), F.col("event_type").alias("kind"))
    return L.received(messages, e.select(F.col("user_id").alias("station")).distinct().where("station % 3 != 0"))


@query(f"WITH {EV}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM ev) SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) - r AS place FROM b WHERE r <= 5")
def bounded_queue(spark, sf_dir):
    return W.fifo(events(spark, sf_dir), "user_id", ["us", "event_id"], 5).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {EV}, q AS (SELECT user_id, list_reduce(list_prepend([]::BIGINT[], list([event_id, (event_type = 'error')::BIGINT] ORDER BY us, event_id)), lambda s, x: CASE WHEN x[2] = 1 THEN list_concat([x[1]], s[1:4]) WHEN len(s) >= 5 THEN list_concat(s[2:], [x[1]]) ELSE list_concat(s, [x[1]]) END) AS q FROM ev GROUP BY user_id) SELECT user_id, CAST(unnest(range(len(q))) AS INTEGER) AS place, unnest(q) AS event_id FROM q""")
def priority_queue(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("urgent", F.col("event_type") == "error")
    return W.priority_queue(e, "user_id", ["us", "event_id"], "event_id", "urgent", 5).select("user_id", F.posexplode("items").alias("place", "event_id"))


@query(f"WITH {EV} SELECT event_id, us FROM ev WHERE probability >= 0.3::DOUBLE ORDER BY us DESC, event_id DESC LIMIT 100")
def latest_100_alerts(spark, sf_dir):
    return R.newest(events(spark, sf_dir).where("probability >= 0.3").select("event_id", "us"), ["us", "event_id"], 1000)


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS w FROM events GROUP BY 1), u AS (SELECT day, w / (SELECT max(w) * 1.02 FROM d) AS u FROM d) SELECT CAST(day AS VARCHAR) AS day, round(u, 6) AS used, CASE WHEN u > 0.95 THEN 4 WHEN u > 0.8 THEN 2 ELSE 1 END AS factor FROM u")
def wear_interval(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("w"))
    budget = days.agg((F.max("w") * 1.02).alias("budget"))
    share = days.join(F.broadcast(budget)).select(F.col("day").cast("string").alias("day"), (F.col("w") / F.col("budget")).alias("u"))
    return share.select("day", r6("u").alias("used"), R.interval_factor(F.col("u")).alias("factor"))


@query("WITH c AS (SELECT c_custkey, greatest(0, c_acctbal) / 10000 AS u FROM customer) SELECT c_custkey, CASE WHEN u > 0.9 THEN 'Critical' WHEN u > 0.8 THEN 'Warning' ELSE 'Normal' END AS level, CASE WHEN u > 0.9 THEN 16 WHEN u > 0.8 THEN 32 ELSE 64 END AS ef FROM c")
def degradation_level(spark, sf_dir):
    level = R.degradation(F.greatest(F.lit(0.0), F.col("c_acctbal")) / 10000)
    return read(spark, sf_dir, "customer").select("c_custkey", level.alias("level")).withColumn("ef", R.search_width(F.col("level")))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM r GROUP BY event_type, n")
def latency_percentiles(spark, sf_dir):
    return R.latencies(read(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", r6("mean"))


@query(f"SELECT epoch_us(ts) // {HOUR} AS hour, count(*) AS n FROM events GROUP BY 1")
def windows_per_hour(spark, sf_dir):
    w = read(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.floor(F.unix_micros("w.start") / HOUR).alias("hour"), "n")


@query(f"WITH {_PEERS} SELECT user_id, last FROM pe WHERE (SELECT max(us) FROM ev) - last > {12 * HOUR}")
def heartbeat_staleness(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg(F.max("us").alias("now"))
    return R.stale(e.join(F.broadcast(now)), "user_id", "us", F.max("now"), 12 * HOUR)


@query("SELECT o_custkey, max_by(o_orderkey % 3, o_orderkey) AS slot, max(o_orderkey) AS sequence FROM orders WHERE o_orderstatus != 'F' GROUP BY o_custkey")
def checkpoint_latest(spark, sf_dir):
    from ..sources import snapshots

    slots = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("slot"), F.col("o_orderkey").alias("sequence"), (F.col("o_orderstatus") != "F").alias("valid"))
    return snapshots.latest(slots, ["o_custkey"]).select("o_custkey", "slot", "sequence")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, 0 AS op, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS payload FROM (SELECT event_id, printf('%016x', event_id) AS h FROM events)")
def wal_roundtrip(spark, sf_dir):
    from ..sources import wal

    return wal.round_trip(events(spark, sf_dir).select("event_id"), "event_id").select("seq", "op", F.lower(F.hex("payload")).alias("payload"))


@query("WITH s AS (SELECT i, i / 100.0::DOUBLE AS t FROM range(1500) r(i)), m AS (SELECT i, exp(-0.3 * t) * sin(2 * pi() * 5 * t) + CASE WHEN t >= 3 THEN 1.5 * exp(-0.2 * (t - 3)) * sin(2 * pi() * 2 * (t - 3)) ELSE 0 END + CASE WHEN t >= 8 THEN 2 * exp(-0.1 * (t - 8)) * sin(2 * pi() * 0.3 * (t - 8)) ELSE 0 END AS x FROM s) SELECT i, CAST(trunc(x * 1000) AS INTEGER) AS v FROM m")
def mock_sensor(spark, sf_dir):
    from ..sources import sensors

    return sensors.mock(spark, 1500, "FullSequence", 1000.0, 100.0)


@query()
def simulated_event(spark, sf_dir):
    from ..sources import sensors

    return sensors.simulated(spark, 5.0, 20.0, 0.01, 100)


@query()
def tick_stream(spark, sf_dir):
    """full_tick as a stream: the signal arrives in four stretches of time, and the stream is stopped and started again between them. Also each tick's micro update."""
    from ..storage import fresh, stored
    from ..streaming import tick
    from .signal_queries import samples

    folder = fresh(spark, "tick")
    rows = stored(samples(spark, sf_dir).select(F.col("ch").cast("long").alias("ch"), F.col("i").cast("long").alias("i"), "v"), "samples")
    end = rows.agg(F.max("i")).first()[0] or 0
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/samples/*")
    for part in range(4):
        low, high = (end + 1) * part // 4, (end + 1) * (part + 1) // 4
        rows.where((F.col("i") >= low) & (F.col("i") < high)).write.parquet(f"{folder}/samples/part-{part}")
        tick.run(stream, folder).awaitTermination()
    return tick.decisions(spark, folder).select("id", "level", "kind", F.transform(F.flatten("micro"), lambda x: F.round(x, 9)).alias("micro"))


_POLLS = EV + f""", st(user_id, rn, event_id, held, w, k) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT user_id, rn, event_id, least(1024, held + n) - CASE WHEN got THEN 128 ELSE 0 END, w + got::INT, CASE WHEN got THEN w END FROM (SELECT e.user_id, e.rn, e.event_id, s.held, s.w, CASE WHEN e.event_type = 'error' THEN 0 ELSE 64 END AS n, e.event_type != 'error' AND least(1024, s.held + 64) >= 256 AS got FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1))"""


@query(f"WITH RECURSIVE {_POLLS} SELECT event_id, k, held, (k + 1) * 1280000 AS timestamp_us FROM st WHERE rn > 0")
def poll_windows(spark, sf_dir):
    """An event is a poll of its user's sensor, which reads 64 samples; an error fails."""
    polls = events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("event_type") != "error").alias("ok"), F.lit(64).alias("n"))
    found = P.polled(polls, "user_id", ["us", "event_id"], F.floor(F.col("us") / (24 * HOUR)))
    return found.select("event_id", "k", "held", P.frame_time_us(F.col("k")).alias("timestamp_us"))


@query()
def kept_index_search(spark, sf_dir):
    """The embeddings come to the index in three appends, by the remainder of their ids; then every 20th asks all of them."""
    from ..operators import graph_index
    from ..storage import fresh

    e, folder = read(spark, sf_dir, "embeddings"), fresh(spark, "graph-index")
    for part in range(3):
        graph_index.append(e.where(F.col("vec_id") % 3 == part), folder, str(part))
    return graph_index.search(e.where("vec_id % 20 = 0"), folder, 16)


@query()
def full_tick(spark, sf_dir):
    """Frames to decisions: embed, find earlier neighbours, join the last 100 frames, link all within a minute, predict, decide. A frame's id follows time, then channel; a frame is among its own neighbours and last frames, as in the reference."""
    from ..storage import fresh, stored
    from ..streaming import tick
    from .signal_queries import framed

    frames = stored(tick.identified(framed(spark, sf_dir)).select("vec_id", "ch", "k", "timestamp_us", "vector"), "frames")
    predicted = tick.predicted(frames, frames, fresh(spark, "predicted"))
    p = predicted.select((F.col("centre") % 1_000_000).alias("station"), ((F.floor(F.col("centre") / 1_000_000) + 1) * 1_280_000).alias("us"), F.col("centre").alias("id"), F.col("event_probability").alias("probability"), F.col("estimated_magnitude").alias("magnitude"))
    return L.decisions(p, L.Cooldown()).select("id", "level", "kind")
