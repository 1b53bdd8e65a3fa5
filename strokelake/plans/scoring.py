"""Queries on scored tokens, ranks, error rates and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokelake.operators import decode, reports, scoring
from strokelake.plans.quality import READS, reads
from strokelake.plans.registry import query, table
from strokelake.plans.tokens import STEPS, WALK, tokens
from strokelake.sources.scratch import written

SCORED = f"""{WALK}, bf AS (SELECT id, pos, token, coalesce(lag(token) OVER (PARTITION BY id ORDER BY pos), -1) AS before FROM tok),
pr AS (SELECT before, token, count(*) AS c FROM bf GROUP BY before, token), fr AS (SELECT before, sum(c) AS n FROM pr GROUP BY before),
sc AS (SELECT bf.id, pos, bf.token, -ln((c + 1) / (n + 10)::DOUBLE) AS nats, split_part(bf.id, '/', 2)::INT % 7 AS source FROM bf JOIN pr ON bf.before = pr.before AND bf.token = pr.token JOIN fr ON bf.before = fr.before)"""


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk's tokens, written: they are read for the counts, the costs and the roles."""
    return written(tokens(spark, sf_dir).select("id", "tokens"))


def scored(spark: SparkSession, sf_dir: str, walk: DataFrame | None = None) -> DataFrame:
    walk = walked(spark, sf_dir) if walk is None else walk
    rows = scoring.bigram_scores(walk.select("id", F.posexplode("tokens").alias("pos", "token")), 10)
    return rows.withColumn("source", F.split("id", "/")[1].cast("int") % 7)


@query(f"WITH {SCORED} SELECT id, pos, token, round(nats, 6) AS nats FROM sc")
def u02_bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "pos", "token", F.round("nats", 6).alias("nats"))


LOSS = f"{SCORED}, ls AS (SELECT source, sum(nats) / count(*) AS loss, sum(nats) / sum((token < 8)::INT) AS word_score FROM sc GROUP BY source)"


def loss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.losses(scored(spark, sf_dir), (F.col("token") < 8).cast("int"))


@query(f"WITH {LOSS} SELECT source, round(loss, 6) AS loss, round(word_score, 6) AS word_score FROM ls")
def g01_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loss_table(spark, sf_dir).select("source", F.round("loss", 6).alias("loss"), F.round("word_score", 6).alias("word_score"))


@query(f"""WITH {SCORED}, h AS (SELECT source, avg(nats) FILTER (pos % 2 = 0) AS a, avg(nats) FILTER (pos % 2 = 1) AS b FROM sc GROUP BY source) SELECT round(avg(a - b), 6) AS gap FROM h WHERE source < 5""")
def g02_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    by = lambda k: rows.where(F.col("pos") % 2 == k).groupBy("source").agg(F.avg("nats").alias("m"))
    return scoring.gap(by(0), by(1).where("source < 5"), "source", "m").select(F.round("gap", 6).alias("gap"))


COSTS = "ct AS (SELECT vec_id, label, unnest(range(10)) AS prompt, round(unnest(embedding[1:10])::DOUBLE, 5) AS cost FROM embeddings)"
RANK = f"{COSTS}, rk AS (SELECT vec_id, 1 + sum((cost < own)::INT) AS rank FROM (SELECT *, min(CASE WHEN prompt = label THEN cost END) OVER (PARTITION BY vec_id) AS own FROM ct) GROUP BY vec_id)"


def text_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("prompt", "c"))
    rows = rows.select("vec_id", "label", "prompt", F.round(F.col("c").cast("double"), 5).alias("cost"))
    return scoring.ranks(rows, "vec_id", F.col("prompt") == F.col("label"), "cost")


@query(f"WITH {RANK} SELECT vec_id, rank::BIGINT AS rank FROM rk")
def g03_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ranks(spark, sf_dir)


@query(f"WITH {RANK} SELECT count(*) AS n, round(avg(rank), 6) AS mean, round(avg((rank = 1)::INT), 6) AS first FROM rk")
def g04_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank_summary(text_ranks(spark, sf_dir)).select("n", F.round("mean", 6).alias("mean"), F.round("first", 6).alias("first"))


@query(f"""WITH {SCORED} SELECT source, round(avg(nats) FILTER (pos % 3 = 0), 6) AS alone, round(avg(nats) FILTER (pos % 3 = 1), 6) AS after_1, round(avg(nats) FILTER (pos % 3 = 2), 6) AS after_3,
round(avg(nats) FILTER (pos % 3 = 0) - avg(nats) FILTER (pos % 3 = 2), 6) AS gain FROM sc GROUP BY source""")
def g05_unseen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda k: F.avg(F.when(F.col("pos") % 3 == k, F.col("nats")))
    return scored(spark, sf_dir).groupBy("source").agg(F.round(m(0), 6).alias("alone"), F.round(m(1), 6).alias("after_1"), F.round(m(2), 6).alias("after_3"), F.round(m(0) - m(2), 6).alias("gain"))


@query(f"""WITH {READS}, c AS (SELECT item % 5 AS source, label, read FROM cand WHERE seq = 0 AND length(label) > 0)
SELECT source, count(*) AS n, round(sum(levenshtein(read, label)) / sum(length(label)), 6) AS error, round(avg((read = label)::INT), 6) AS exact FROM c GROUP BY ROLLUP (source)""")
def g06_character_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).where("seq = 0").withColumn("source", F.col("item") % 5)
    return scoring.character_error(rows, "source").select("source", "n", F.round("error", 6).alias("error"), F.round("exact", 6).alias("exact"))


@query(f"WITH {SCORED} SELECT source, token % 3 AS kind, count(*) AS n, round(avg(nats), 6) AS score FROM sc GROUP BY CUBE (source, kind)")
def g07_kind_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("kind", F.col("token") % 3)
    return rows.cube("source", "kind").agg(F.count("*").alias("n"), F.round(F.avg("nats"), 6).alias("score"))


RUNS = """mt AS (SELECT l_returnflag || l_linestatus || (l_linenumber % 3) AS run, month(l_shipdate)::INT AS step, avg(l_discount)::DOUBLE AS loss, avg(l_tax)::DOUBLE AS score FROM lineitem GROUP BY ALL),
sr AS (SELECT l_returnflag || l_linestatus AS run, 'S' || (l_suppkey % 3) AS source, round(avg(l_quantity)::DOUBLE, 6) AS score FROM lineitem GROUP BY ALL)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("run"), F.month("l_shipdate").alias("step"), "l_discount", "l_tax")
    return rows.groupBy("run", "step").agg(F.avg("l_discount").cast("double").alias("loss"), F.avg("l_tax").cast("double").alias("score"))


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run"), F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("source"))
    return rows.agg(F.round(F.avg("l_quantity").cast("double"), 6).alias("score"))


@query(f"WITH {RUNS} SELECT run, arg_min(step, struct_pack(a := round(loss, 9), b := step)) AS best, max(step) AS last, round(min(loss), 6) AS loss FROM mt GROUP BY run")
def g08_best_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir).withColumn("loss", F.round("loss", 9))
    out = reports.best_and_last(rows, "run", "loss", "step")
    return out.select("run", F.col("best.step").alias("best"), F.col("last.step").alias("last"), F.round("best.loss", 6).alias("loss"))


ABLATION = f"{RUNS}, ab AS (SELECT sr.run, avg(sr.score) AS score, avg(sr.score - b.score) AS delta, count(*) AS n FROM sr JOIN sr b ON sr.source = b.source AND b.run = 'NO' GROUP BY sr.run)"


@query(f"WITH {ABLATION} SELECT run, round(score, 6) AS score, round(delta, 6) AS delta, n FROM ab")
def g09_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.ablation(source_scores(spark, sf_dir), "run", "source", "score", "NO")
    return out.select("run", F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"), "n")


@query(f"WITH {RUNS} SELECT run, max(score) FILTER (source = 'S0') AS \"S0\", max(score) FILTER (source = 'S1') AS \"S1\", max(score) FILTER (source = 'S2') AS \"S2\" FROM sr GROUP BY run")
def g09_pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivoted(source_scores(spark, sf_dir), "run", "source", "score", ["S0", "S1", "S2"])


SPREAD = f"{RUNS}, sp AS (SELECT substr(run, 1, 2) AS grp, substr(run, 3, 1) AS seed, avg(score) AS v FROM mt GROUP BY ALL), sg AS (SELECT grp, count(v) AS n, avg(v) AS m, stddev_samp(v) AS sd, arg_min(v, seed) AS f FROM sp GROUP BY grp)"


@query(f"WITH {SPREAD} SELECT grp, CASE WHEN n < 3 THEN printf('%.3f', f) ELSE printf('%.3f', m) || ' ± ' || CASE WHEN round(sd, 3) = 0 THEN '<0.001' ELSE printf('%.3f', sd) END END AS text FROM sg")
def g10_seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir).groupBy(F.substring("run", 1, 2).alias("grp"), F.substring("run", 3, 1).alias("seed")).agg(F.avg("score").alias("v"))
    return reports.seed_spread(rows, "grp", "v", "seed", expected=3)


@query(f"WITH {RUNS}, ok AS (SELECT run FROM mt GROUP BY run HAVING max(step) >= 12), b AS (SELECT substr(run, 1, 2) AS grp, run, round(avg(score), 9) AS score FROM mt WHERE run IN (SELECT run FROM ok) GROUP BY run) "
       "SELECT grp, arg_min(run, struct_pack(a := score, b := run)) AS run, printf('%+.3f', min(score)) AS score FROM b GROUP BY grp")
def g11_best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.finished(metrics(spark, sf_dir), "run", "step", 12).groupBy("run").agg(F.round(F.avg("score"), 9).alias("score"))
    out = reports.best_configuration(rows.withColumn("grp", F.substring("run", 1, 2)), "grp", "run", "score")
    return out.select("grp", "run", reports.signed(F.col("score")).alias("score"))


ROLES = f"""{WALK}, {STEPS}, rl AS (SELECT id, pos, token, CASE WHEN token = 8 THEN 'touch down' WHEN token = 9 THEN 'lift' WHEN coalesce(down, 0) = 0 THEN 'travel' WHEN before = 8 THEN 'first move' ELSE 'rest' END AS role FROM pen)"""


@query(f"WITH {ROLES} SELECT id, pos, role FROM rl")
def g12_token_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.roles(tokens(spark, sf_dir)).select("id", "pos", "role")


@query(f"WITH {ROLES}, {SCORED[len(WALK) + 2:]}, g AS (SELECT role, sum(nats) AS nats, count(*) AS n FROM rl JOIN sc USING (id, pos) GROUP BY role) "
       "SELECT role, round(nats / n, 6) AS mean, round(nats / sum(nats) OVER (), 6) AS nats_share, round(n / sum(n) OVER (), 6) AS token_share FROM g")
def g13_nats_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = walked(spark, sf_dir)
    rows = decode.roles(walk).select("id", "pos", "role").join(scored(spark, sf_dir, walk).select("id", "pos", "nats"), ["id", "pos"])
    return scoring.by_role(rows).select("role", *[F.round(c, 6).alias(c) for c in ("mean", "nats_share", "token_share")])


PROGRESS = f"{SCORED}, pg AS (SELECT source, least(pos * 10 // count(*) OVER (PARTITION BY id), 9)::INT AS bin, nats FROM sc)"


@query(f"WITH {PROGRESS} SELECT bin, round(avg(nats), 6) AS mean, count(*) AS n FROM pg GROUP BY bin")
def g14_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_progress(scored(spark, sf_dir)).select("bin", F.round("mean", 6).alias("mean"), "n")


@query(f"WITH {PROGRESS}, t AS (SELECT bin, avg(nats) FILTER (source >= 3) - avg(nats) FILTER (source < 3) AS gain FROM pg GROUP BY bin) SELECT bin, round(gain, 6) AS gain, round(gain / sum(gain) OVER (), 4) AS share FROM t")
def g14_progress_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    out = scoring.progress_gain(scoring.by_progress(rows.where("source < 3")), scoring.by_progress(rows.where("source >= 3")))
    return out.select("bin", F.round("gain", 6).alias("gain"), F.round("share", 4).alias("share"))


@query("""WITH e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, event_type AS kind FROM events),
a AS (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY user_id ORDER BY pos))::INT, 0) AS nw FROM e), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS isl FROM a),
c AS (SELECT user_id, isl, kind, min(pos) AS pos, count(*) AS length FROM b GROUP BY user_id, isl, kind),
f AS (SELECT user_id, pos, length, CASE WHEN length < 3 AND lag(kind) OVER w = lead(kind) OVER w THEN lag(kind) OVER w ELSE kind END AS kind FROM c WINDOW w AS (PARTITION BY user_id ORDER BY isl)),
g AS (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY user_id ORDER BY pos))::INT, 0) AS nw FROM f), h AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS isl FROM g),
j AS (SELECT user_id, kind, min(pos) AS start, sum(length)::BIGINT AS length FROM h GROUP BY user_id, isl, kind)
SELECT user_id, kind, start, length FROM j WHERE length >= 3 QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY length DESC, start) = 1""")
def g15_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("pos"), F.col("event_type").alias("kind"))
    return scoring.runs(rows, "user_id", "pos", "kind")


KERNEL = {(a, b): (4.0, 2.0, 1.0)[abs(a) + abs(b)] / 16 for a in (-1, 0, 1) for b in (-1, 0, 1)}
HEAT = f"""{WALK}, ce AS (SELECT cx AS x, cy AS y, count(*) AS n FROM dn GROUP BY cx, cy), ke AS (SELECT unnest([-1, 0, 1]) AS dx), k2 AS (SELECT a.dx, b.dx AS dy, CASE abs(a.dx) + abs(b.dx) WHEN 0 THEN 0.25 WHEN 1 THEN 0.125 ELSE 0.0625 END::DOUBLE AS w FROM ke a, ke b),
ht AS (SELECT x + dx AS x, y + dy AS y, sum(n * w) AS mass FROM ce, k2 GROUP BY ALL)"""


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strokelake.plans.adapters import ink_points

    cells = ink_points(spark, sf_dir).where("pen = 1").select(F.rint(F.col("x") / 0.02).cast("int").alias("x"), F.rint(F.col("y") / 0.02).cast("int").alias("y"))
    return scoring.heat(cells, KERNEL)


@query(f"WITH {HEAT} SELECT x, y, round(mass, 6) AS mass FROM ht")
def g16_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat_map(spark, sf_dir).select("x", "y", F.round("mass", 6).alias("mass"))


@query(f"WITH {HEAT}, v AS (SELECT mass, sum(mass) AS m FROM ht GROUP BY mass), c AS (SELECT mass, sum(m) OVER (ORDER BY mass DESC) AS c, sum(m) OVER () AS t FROM v) SELECT max(mass) AS level FROM c WHERE c >= t / 2")
def g16_half_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.half_mass_level(heat_map(spark, sf_dir))


@query("""(SELECT doc_id, n_chars, 'low' AS side FROM documents ORDER BY n_chars, doc_id LIMIT 10) UNION ALL (SELECT doc_id, n_chars, 'high' FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)""")
def g17_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 10)


GAPS = "gp AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS at, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), lg AS (SELECT ln(gap) AS g FROM gp WHERE gap > 0), r0 AS (SELECT quantile_cont(g, 0.25) AS a, quantile_cont(g, 0.9) AS b FROM lg)"
ROUNDS = ", ".join(f"r{i + 1} AS (SELECT avg(g) FILTER (g <= (a + b) / 2) AS a, avg(g) FILTER (g > (a + b) / 2) AS b FROM lg, r{i})" for i in range(3))


@query(f"""WITH {GAPS}, {ROUNDS} SELECT event_id, sum((coalesce(gap > exp((a + b) / 2), false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM gp, r3""")
def g19_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    threshold = scoring.gap_threshold(events.withColumn("gap", F.col("at") - F.lag("at").over(w)), "gap", rounds=3)
    return scoring.sessions(events, "user_id", F.col("at"), ["ts", "event_id"], threshold).select("event_id", "session")


@query(f"WITH {ABLATION} SELECT '| ' || run || ' | ' || printf('%.3f', score) || ' | ' || printf('%+.3f', delta) || ' |' AS line FROM ab")
def a11_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.ablation(source_scores(spark, sf_dir), "run", "source", "score", "NO")
    return out.select(reports.markdown_line(F.col("run"), F.format_string("%.3f", F.col("score")), reports.signed(F.col("delta"))).alias("line"))


@query(f"WITH {ABLATION} SELECT run AS key, 3 AS cells FROM ab")
def a10_markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablation table as Markdown, with a header and a ruler, read again."""
    lines = a11_markdown(spark, sf_dir).select(F.lit("a.md").alias("file"), F.col("line").alias("value"))
    head = spark.range(1).select(F.lit("a.md").alias("file"), F.explode(F.array(F.lit("| Run | score | delta |"), F.lit("|---|---|---|"), F.lit("some text"))).alias("value"))
    return reports.markdown_rows(lines.unionByName(head)).select("key", F.size("cells").alias("cells"))
