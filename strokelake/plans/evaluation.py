"""Queries on hold-outs, prompts, primed scores, told vectors, probes, order changes and bends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import walk
from strokelake.functions.arrays import total
from strokelake.operators import augment, bpe, decode, quality, scoring
from strokelake.operators import sampling as s
from strokelake.operators import vectors as v
from strokelake.plans.adapters import PTS, STK, exploded, ink_events, ink_points, ink_strokes
from strokelake.plans.quality import CRC, crc
from strokelake.plans.registry import query, table
from strokelake.plans.sampling import picks, u
from strokelake.plans.scoring import SCORED, scored
from strokelake.plans.tokens import GRID, WALK, tokens
from strokelake.plans.vectors import MEANS, VEC, base, label_means, mark
from strokelake.sources.scratch import scratch, written

VOCABULARY = 10


@query(f"""WITH tab AS (SELECT {CRC} AS t), w AS (SELECT DISTINCT event_type AS source, user_id AS writer FROM events), n AS (SELECT source FROM w GROUP BY source HAVING count(*) >= 5),
h AS (SELECT source, writer FROM w, tab WHERE source IN (SELECT source FROM n) AND {crc('writer::VARCHAR')} % 5 = 0)
SELECT source, writer, event_id AS id FROM events JOIN h ON event_type = source AND user_id = writer QUALIFY row_number() OVER (PARTITION BY source ORDER BY {u('held', 'event_id')}, event_id) <= 50""")
def e03_held_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("writer"), F.col("event_id").alias("id"))
    return quality.held_out_words(rows, 5, 50).select("source", "writer", "id")


@query(f"""WITH {WALK}, ok AS (SELECT id, any_value(writer) AS writer FROM pts WHERE pen = 1 GROUP BY id HAVING count(*) >= 3),
sp AS (SELECT id, CASE WHEN pen = 1 AND lag(pen) OVER w = 1 THEN sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) END AS d FROM pts WINDOW w AS (PARTITION BY id ORDER BY seq)),
sm AS (SELECT writer, median(d) AS spacing, avg((d > 0.1)::INT) AS long_steps FROM sp JOIN ok ON sp.id = ok.id WHERE d IS NOT NULL GROUP BY writer),
tc AS (SELECT id, count(*) AS t FROM tok GROUP BY id),
ch AS (SELECT ok.writer, sum(t) / greatest(sum(length(label)), 1)::DOUBLE AS per FROM ok JOIN words ON ok.id = words.id JOIN tc ON ok.id = tc.id GROUP BY ok.writer)
SELECT ch.writer, round(spacing, 6) AS spacing, round(long_steps, 6) AS long_steps, round(per, 6) AS tokens_per_char, coalesce((long_steps > 0.05)::INT, 0) AS warnings FROM ch LEFT JOIN sm ON ch.writer = sm.writer""")
def e04_frame_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir).select("id", F.size("tokens").alias("tokens"), F.length("label").alias("chars"))
    out = quality.frame_warnings(ink_points(spark, sf_dir), words, grid=0.1)
    return out.select("writer", *[F.round(c, 6).alias(c) for c in ("spacing", "long_steps", "tokens_per_char")], F.size("warnings").alias("warnings"))


@query(f"""WITH tab AS (SELECT {CRC} AS t), f AS (SELECT doc_id, source, {crc('doc_id::VARCHAR')} % 20 = 0 AS h FROM documents, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY {u('eval', 'doc_id')}, doc_id) AS r FROM f)
SELECT doc_id, 'held' AS part FROM r WHERE h AND r <= 20 UNION ALL SELECT doc_id, 'seen' FROM r WHERE NOT h AND r <= 10
UNION ALL SELECT doc_id, 'train' FROM (SELECT doc_id FROM r WHERE NOT h ORDER BY {u('eval-train', 'doc_id')}, doc_id LIMIT 150)""")
def f02_evaluation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return s.evaluation_parts(rows, "doc_id", "source", quality.held_out(F.col("doc_id"), 20), 20, 10, 150).select("doc_id", "part")


@query(f"""WITH tab AS (SELECT {CRC} AS t), l AS (SELECT b, row_number() OVER (ORDER BY {u('prompt', 'b')}, b) AS r FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand <> '')),
h AS (SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {u('prompt-held', 'p_partkey')}, p_partkey) AS r FROM part, tab WHERE {crc('p_partkey::VARCHAR')} % 5 = 0 AND p_name <> ''),
f AS (SELECT p_name, min(struct_pack(s := p_brand, r := r)) AS first FROM h WHERE r <= 3 GROUP BY p_name)
SELECT 'label' AS kind, b AS text, r::VARCHAR AS place FROM l WHERE r <= 8 UNION ALL SELECT 'phrase', p_name, first.s || '/' || first.r FROM f""")
def f17_prompt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return s.prompt_list(rows, "p_brand", "p_name", "p_partkey", "p_brand", quality.held_out(F.col("p_partkey"), 5), n=8, most=3)


SIZED = f"{WALK}, sz AS (SELECT words.id, writer, writer % 3 AS source, strlen(label) AS b, t FROM words JOIN (SELECT id, count(*) AS t FROM tok GROUP BY id) k ON k.id = words.id)"
CONTEXTS = f"""{SIZED}, cr AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY {u('context', 'id')}, id) AS r FROM sz),
cp AS (SELECT a.id AS target, a.writer, a.t + sum(b.t) + 6 AS t, a.b + sum(b.b) + 3 AS b, list(b.id ORDER BY b.r) AS l FROM cr a JOIN
  (SELECT a.id AS target, b.id, b.r, b.t, b.b, row_number() OVER (PARTITION BY a.id ORDER BY b.r) AS place FROM cr a JOIN cr b ON a.writer = b.writer AND b.r <= 4 AND a.id <> b.id) b ON b.target = a.id AND place <= 3
  GROUP BY a.id, a.writer, a.t, a.b HAVING count(*) = 3),
ctx AS (SELECT target, writer, k, l[:k] AS context FROM cp, (SELECT unnest([0, 1, 3]) AS k) WHERE t <= 382 AND b <= 60)"""
PRIMED = """wb AS (SELECT id, before, token, count(*) AS c FROM (SELECT id, token, coalesce(lag(token) OVER (PARTITION BY id ORDER BY pos), -1) AS before FROM tok) GROUP BY ALL),
ex AS (SELECT item, unnest(context) AS id FROM tr), se AS (SELECT item, before, token, sum(c) AS k FROM ex JOIN wb ON ex.id = wb.id GROUP BY ALL), sn AS (SELECT item, before, sum(k) AS n FROM se GROUP BY ALL),
pc AS (SELECT tr.item, sum(c * -ln((coalesce(k, 0) + 1) / (coalesce(n, 0) + 10)::DOUBLE)) AS nats, sum(CASE WHEN wb.token < 8 THEN c ELSE 0 END) AS moves FROM tr JOIN wb ON tr.target = wb.id
  LEFT JOIN se ON se.item = tr.item AND se.before = wb.before AND se.token = wb.token LEFT JOIN sn ON sn.item = tr.item AND sn.before = wb.before GROUP BY tr.item)"""


def sized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, writer, source, tokens, t, b), written: they are joined with themselves."""
    rows = tokens(spark, sf_dir).select("id", "writer", (F.col("writer") % 3).alias("source"), "tokens", F.size("tokens").alias("t"), F.octet_length("label").alias("b"))
    return written(rows)


@query(f"WITH {CONTEXTS} SELECT target, k, context FROM ctx")
def f13_fitting_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.contexts(sized_words(spark, sf_dir), "writer", "id", (0, 1, 3), fits=("t", "b", 384, 60))


@query(f"""WITH {CONTEXTS}, tr AS (SELECT struct_pack(target, k) AS item, target, context FROM ctx), {PRIMED},
sc AS (SELECT split_part(item.target, '/', 2)::INT % 7 AS source, sum(nats) FILTER (item.k = 0) / sum(moves) FILTER (item.k = 0) AS s0, sum(nats) FILTER (item.k = 1) / sum(moves) FILTER (item.k = 1) AS s1,
  sum(nats) FILTER (item.k = 3) / sum(moves) FILTER (item.k = 3) AS s3 FROM pc GROUP BY ALL)
SELECT source, round(s0, 6) AS alone, round(s1, 6) AS after_1, round(s3, 6) AS after_3, round(s0 - s3, 6) AS gain FROM sc""")
def g05_context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of words alone and after one and three others of their writer."""
    words = sized_words(spark, sf_dir)
    trials = s.contexts(words, "writer", "id", (3,), fits=("t", "b", 384, 60))
    costs = scoring.primed_costs(trials, words, ["target"], VOCABULARY, firsts=(0, 1, 3))
    of = lambda k: F.sum(F.when(F.col("k") == k, F.col("nats"))) / F.sum(F.when(F.col("k") == k, F.col("moves")))
    by = costs.groupBy((F.split("target", "/")[1].cast("int") % 7).alias("source")).agg(of(0).alias("s0"), of(1).alias("s1"), of(3).alias("s3"))
    return by.select("source", F.round("s0", 6).alias("alone"), F.round("s1", 6).alias("after_1"), F.round("s3", 6).alias("after_3"), F.round(F.col("s0") - F.col("s3"), 6).alias("gain"))


TRIALS = f"""{SIZED}, rr AS (SELECT *, row_number() OVER (PARTITION BY source, writer ORDER BY {u('trial', 'id')}, id) AS r FROM sz),
pm AS (SELECT source, writer, list(id ORDER BY r) FILTER (r <= 2) AS primes, sum(t) FILTER (r <= 2) AS t, sum(b) FILTER (r <= 2) AS b, any_value(id) FILTER (r = 3) AS target, any_value(t) FILTER (r = 3) AS tt, any_value(b) FILTER (r = 3) AS tb
  FROM rr GROUP BY source, writer HAVING count(*) > 2),
rg AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {u('trial', 'writer')}, writer) - 1 AS at, count(*) OVER (PARTITION BY source) AS n FROM pm),
al AS (SELECT g.source, g.writer AS trial, i::INT AS place, h.writer AS candidate, h.primes, g.target, h.t + g.tt + 4 > 254 OR h.b + g.tb + 2 > 38 AS bad FROM rg g, range(4) t(i), rg h WHERE g.n >= 4 AND h.source = g.source AND h.at = (g.at + i) % g.n),
tl AS (SELECT * EXCLUDE (bad) FROM al QUALIFY NOT bool_or(bad) OVER (PARTITION BY source, trial))"""


def trials(words: DataFrame) -> DataFrame:
    return augment.style_trials(words, "source", "writer", "id", n=4, k=2, fits=("t", "b", 256, 38))


@query(f"WITH {TRIALS} SELECT source, trial, place, candidate, primes, target FROM tl")
def f14_fitting_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(sized_words(spark, sf_dir))


@query(f"""WITH {TRIALS}, tr AS (SELECT struct_pack(source, trial, candidate) AS item, target, primes AS context FROM tl), {PRIMED},
rk AS (SELECT item.source AS source, item.trial AS trial, 1 + sum((cost < own)::INT) AS rank FROM (SELECT *, round(nats, 9) AS cost, min(CASE WHEN item.candidate = item.trial THEN round(nats, 9) END) OVER (PARTITION BY item.source, item.trial) AS own FROM pc) GROUP BY ALL)
SELECT source, count(*) AS n, round(avg(rank), 6) AS mean, round(avg((rank = 1)::INT), 6) AS first FROM rk GROUP BY source""")
def g04_style_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the true writer among others whose words come before the target."""
    words = sized_words(spark, sf_dir)
    each = trials(words).select("source", "trial", "candidate", "target", F.col("primes").alias("context"))
    costs = scoring.primed_costs(each, words, ["source", "trial", "candidate"], VOCABULARY).withColumn("cost", F.round("nats", 9))
    ranked = scoring.ranks(costs.withColumn("t", F.struct("source", "trial")), "t", F.col("candidate") == F.col("trial"), "cost")
    rank = F.col("rank")
    return ranked.groupBy(F.col("t.source").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg(rank), 6).alias("mean"), F.round(F.avg((rank == 1).cast("int")), 6).alias("first"))


@query(f"""WITH {MEANS}, s AS (SELECT vec_id, label, prompt, list_dot_product(v, w) AS c FROM e, w), b AS (SELECT vec_id, label, arg_max(prompt, struct_pack(c, prompt)) AS best FROM s GROUP BY ALL),
g AS (SELECT d, avg(c) AS ga, avg(mc) AS gb FROM x JOIN m USING (label, d) GROUP BY d), p AS (SELECT vec_id, sum((c - ga) * (mc - gb)) / sqrt(sum((c - ga) * (c - ga)) * sum((mc - gb) * (mc - gb))) AS c FROM x JOIN m USING (label, d) JOIN g USING (d) GROUP BY vec_id)
SELECT (SELECT round(avg((best = label)::INT), 6) FROM b) AS nearest, (SELECT round(avg(c), 6) FROM p) AS centred""")
def v07_nearest_and_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(base(spark, sf_dir))
    means = label_means(spark, sf_dir)
    matched = v.matches(rows.select(F.col("vec_id").alias("item"), F.col("label").alias("own"), "v"), means.select(F.col("label").alias("prompt"), F.col("mean").alias("w")))
    near = v.nearest_own(matched).select(F.round("nearest", 6).alias("nearest"), F.lit(1).alias("o"))
    return near.join(v.centred_own(rows.join(means, "label"), "v", "mean").select(F.round("centred", 6).alias("centred"), F.lit(1).alias("o")), "o").drop("o")


@query(f"""WITH {WALK}, st2 AS (SELECT id, pos, CASE WHEN token < 8 THEN ([1, 1, 0, -1, -1, -1, 0, 1])[token + 1] ELSE 0 END AS dx, CASE WHEN token < 8 THEN ([0, 1, 1, 1, 0, -1, -1, -1])[token + 1] ELSE 0 END AS dy FROM tok WHERE pos < 62)
SELECT id, round(sum(dx) / (count(*) + 2)::DOUBLE, 6) AS x, round(sum(dy) / (count(*) + 2)::DOUBLE, 6) AS y FROM st2 GROUP BY id""")
def v09_masked_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the moves of each example's tokens, padding left out; BOS and END move nothing."""
    e = tokens(spark, sf_dir).select("id", s.make_example(F.col("tokens"), 64, bos=13, end=11, pad=10)["x"].alias("t"))
    move = lambda names: lambda t: F.coalesce(F.get(F.array(*[F.lit(float(k)) for k in names]), t), F.lit(0.0))
    vectors = F.transform("t", lambda t: F.array(move(walk.DX)(t), move(walk.DY)(t)))
    mean = v.masked_mean(vectors, F.transform("t", lambda t: t != 10))
    return e.select("id", mean.alias("m")).select("id", F.round(F.col("m")[0], 6).alias("x"), F.round(F.col("m")[1], 6).alias("y"))


@query(f"""WITH now AS (SELECT {mark("o_orderkey::VARCHAR || chr(10) || o_orderpriority")} AS b, {mark("o_orderkey::VARCHAR || chr(10) || lower(o_orderpriority)")} AS c FROM orders)
SELECT 'o_orderstatus' AS "column" FROM now UNION ALL SELECT 'o_orderpriority' FROM now WHERE b = c""")
def a08_fresh_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks recorded before one column's texts changed: it is dropped as stale."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    columns = ["o_orderstatus", "o_orderpriority"]
    recorded = written(v.column_marks(orders.withColumn("o_orderpriority", F.lower("o_orderpriority")), "o_orderkey", columns))
    return v.fresh_columns(recorded, v.column_marks(orders, "o_orderkey", columns))


RULES = [(0, 7, 10), (4, 5, 11), (0, 1, 12), (4, 3, 13)]


@query(f"""WITH {WALK}, pr AS (SELECT *, lag(token) OVER w AS b1, lead(token) OVER w AS a1, lag(token, 2) OVER w AS b2, lead(token, 2) OVER w AS a2 FROM tok WINDOW w AS (PARTITION BY id ORDER BY pos)),
sc AS (SELECT id, pos, token, (b1 = 0 AND token = 7) OR (b1 = 4 AND token = 5) OR (b1 = 0 AND token = 1) OR (b1 = 4 AND token = 3) AS second FROM pr)
SELECT id, (pos - sum(coalesce(second, false)::INT) OVER (PARTITION BY id ORDER BY pos))::INT AS owner, pos AS point, token FROM sc""")
def b19_merged_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which merged token drew each base token, under four merges."""
    merged = bpe.apply_merges(tokens(spark, sf_dir).select("id", "tokens"), RULES)
    return decode.owners(merged, bpe.expansions(RULES)).select("id", F.col("owner"), "point", "token")


@query(f"""WITH {VEC}, y AS (SELECT label, vec_id, round(v[1], 5) AS q, round(v[2] + v[1] / 2, 5) AS a, round(v[3], 5) AS b FROM e),
tab AS (SELECT {CRC} AS t), h AS (SELECT label, {crc('label::VARCHAR')} % 3 = 0 AS held FROM (SELECT DISTINCT label FROM e), tab),
d AS (SELECT label, q, lead(q) OVER w AS q2, a - lead(a) OVER w AS a, b - lead(b) OVER w AS b FROM y WINDOW w AS (PARTITION BY label ORDER BY q DESC, vec_id)),
n AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a) AS sa, sum(b) AS sb FROM d JOIN h USING (label) WHERE q > q2 AND NOT held),
k AS (SELECT (sa * bb - sb * ab) / (aa * bb - ab * ab) AS wa, (sb * aa - sa * ab) / (aa * bb - ab * ab) AS wb FROM n),
r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY round(a * wa + b * wb, 9), vec_id) AS x, row_number() OVER (PARTITION BY label ORDER BY q, vec_id) AS z FROM y JOIN h USING (label), k WHERE held)
SELECT label, count(*) AS n, round(corr(x, z), 6) AS correlation FROM r GROUP BY label""")
def e18_quality_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on better-minus-worse pairs of some labels; its rank correlation with quality on the labels held out."""
    x = F.col("v")
    rows = base(spark, sf_dir).select("label", "vec_id", F.round(x[0], 5).alias("q"), F.round(x[1] + x[0] / 2, 5).alias("a"), F.round(x[2], 5).alias("b"))
    held = quality.held_out(F.col("label"), 3)
    weights = augment.ridge_of_pairs(augment.pair_differences(rows.where(~held), "label", "vec_id", "q", ["a", "b"]), ["a", "b"], 1.0)
    score = F.round(F.col("a") * weights[0] + F.col("b") * weights[1], 9)
    out = augment.rank_correlation(rows.where(held), "label", score, F.col("q"), "vec_id")
    return out.select("label", "n", F.round("correlation", 6).alias("correlation"))


TOLD = {"image": "v", "frame": "CASE WHEN vec_id % 3 <> 0 THEN w END", "dense": "CASE WHEN vec_id % 4 <> 0 THEN list_transform(v, lambda z: z * z) END"}


@query(f"""WITH {MEANS}, t AS (SELECT vec_id, {', '.join(f'{c} AS {k}' for k, c in TOLD.items())}, CASE WHEN vec_id % 5 = 0 THEN [v, w] WHEN vec_id % 5 = 1 THEN [w, list_transform(w, lambda z: 0::DOUBLE)] END AS steps FROM e JOIN w ON label = prompt),
o AS (SELECT vec_id, steps, list_sort(list_filter([{', '.join(f"CASE WHEN {k} IS NOT NULL THEN struct_pack(u := {u('told-' + k, 'vec_id')}, k := '{k}', v := {k}) END" for k in TOLD)}], lambda z: z IS NOT NULL)) AS one FROM t),
p AS (SELECT vec_id, steps IS NOT NULL AND {u('told-pair', 'vec_id')} < 0.4 AS pair, steps, one[: CASE WHEN {u('told-two', 'vec_id')} < 0.5 THEN 2 ELSE 1 END] AS one FROM o),
q AS (SELECT vec_id, CASE WHEN pair THEN ['steps'] ELSE list_transform(one, lambda z: z.k) END AS kinds, list_filter(CASE WHEN pair THEN steps ELSE list_transform(one, lambda z: z.v) END, lambda z: list_sum(list_transform(z, lambda y: abs(y))) > 0) AS vs FROM p),
mx AS (SELECT *, CASE WHEN len(vs) > 1 THEN list_transform(list_zip(vs[1], vs[2]), lambda z: (z[1] + z[2]) / 2) ELSE vs[1] END AS h FROM q),
nx AS (SELECT *, CASE WHEN len(vs) > 1 THEN list_sum(h) / sqrt(list_sum(list_transform(h, lambda y: y * y))) ELSE list_sum(h) END AS s FROM mx)
SELECT vec_id, kinds, round(s, 6) AS s, list_transform(['image', 'frame', 'dense', 'steps'], lambda z: (list_contains(kinds, z) AND {u('told-named', 'vec_id')} < 0.7)::INT) AS flags FROM nx""")
def v04_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).join(label_means(spark, sf_dir), "label")
    k, x, w = F.col("vec_id"), F.col("v"), F.col("mean")
    steps = F.when(k % 5 == 0, F.array(x, w)).when(k % 5 == 1, F.array(w, F.transform(w, lambda y: F.lit(0.0))))
    rows = rows.select("vec_id", x.alias("image"), F.when(k % 3 != 0, w).alias("frame"), F.when(k % 4 != 0, F.transform(x, lambda y: y * y)).alias("dense"), steps.alias("steps"))
    out = v.picked(rows, "vec_id", ["image", "frame", "dense"], ["steps"], pair=0.4, two=0.5, named=0.7)
    return out.select("vec_id", "kinds", F.round(total(F.col("told")), 6).alias("s"), "flags")


DRAWN = f"""{SIZED}, wt AS (SELECT *, (split_part(id, '/', 3)::INT % 2 + 1) AS weight FROM sz), gw AS (SELECT writer, sum(weight) AS w, count(*) AS n FROM wt GROUP BY writer),
sn AS (SELECT writer, n, (sum(w) OVER (ORDER BY writer) - w) / (sum(w) OVER ())::DOUBLE AS low, sum(w) OVER (ORDER BY writer) / (sum(w) OVER ())::DOUBLE AS high FROM gw),
dr AS (SELECT o_orderkey AS draw, {u('draw', 'o_orderkey')} AS x FROM orders), ht AS (SELECT draw, writer AS grp, n, (floor({u('draw', 'draw', 1)} * least(4, n)) + 1)::INT AS lim FROM dr JOIN sn ON x >= low AND x < high),
mm AS (SELECT writer AS grp, id AS key FROM wt), {picks(4, 'ht', 'mm')}, mb AS (SELECT draw, id, t, b, place FROM chosen JOIN wt ON key = id),
cs AS (SELECT *, sum(t) OVER o + 2 * (place - 1) AS st, sum(b) OVER o + place - 1 AS sb FROM mb WINDOW o AS (PARTITION BY draw ORDER BY place)),
kp AS (SELECT draw, id, place FROM cs QUALIFY max((place > 1 AND (st > 126 OR sb > 40))::INT) OVER (PARTITION BY draw ORDER BY place) = 0),
tl AS (SELECT id, list(token ORDER BY pos) AS l FROM tok GROUP BY id),
jn AS (SELECT draw, flatten(list(CASE WHEN place > 1 THEN list_concat([12, 12], l) ELSE l END ORDER BY place)) AS l FROM kp JOIN tl ON kp.id = tl.id GROUP BY draw), hd AS (SELECT draw, l[:126] AS h, len(l) AS n FROM jn)"""


@query(f"""WITH {DRAWN} SELECT draw, list_concat([13], h, [11], list_transform(range(126 - len(h)), lambda i: 10)) AS x,
list_concat(h, [CASE WHEN n > 126 THEN -1 ELSE 11 END], list_transform(range(127 - len(h)), lambda i: -1)) AS y FROM hd""")
def k02_draw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of draw numbers, each micro-batch made into examples: words drawn, joined, padded. A draw depends on its
    number alone, so the batches' bounds change nothing."""
    words = written(sized_words(spark, sf_dir).withColumn("weight", F.split("id", "/")[2].cast("int") % 2 + 1))
    tables = s.example_tables(words, "writer", "weight", "id", "tokens", "b")
    numbers, out = scratch(spark), scratch(spark)
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw")).repartition(4, "draw").write.parquet(numbers)

    def make(batch: DataFrame, _: int) -> None:
        s.drawn_examples(words, batch, "writer", "weight", "id", "tokens", "b", most=4, block=128, limit=40, marks=walk.specials(0), tables=tables).write.mode("append").parquet(out)

    stream = spark.readStream.schema("draw bigint").option("maxFilesPerTrigger", 2).parquet(numbers)
    stream.writeStream.foreachBatch(make).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("draw bigint, x array<int>, y array<int>").parquet(out)


@query(f"""WITH {STK}, n AS (SELECT id, stroke, count(*) AS m FROM stk GROUP BY id, stroke), l AS (SELECT id, stroke, m, m + (m >= 3)::INT AS size FROM n),
w AS (SELECT *, CASE WHEN size > 3 AND {u('redraw-restart', 'id', 'stroke')} < 0.6 THEN 1 + floor({u('redraw-at', 'id', 'stroke')} * (size - 2))::INT ELSE 0 END AS fr, {u('redraw-reverse', 'id', 'stroke')} < 0.4 AS back FROM l),
p AS (SELECT id, stroke, m, size, fr, back, unnest(range(size)) AS k FROM w)
SELECT p.id, p.stroke, (CASE WHEN back THEN size - 1 - k ELSE k END)::INT AS pos, round(x, 6) AS x, round(y, 6) AS y FROM p JOIN stk ON stk.id = p.id AND stk.stroke = p.stroke AND stk.pos = (fr + k) % m""")
def b11_restart_and_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of three points and more closed by their first point, then begun elsewhere or drawn backwards."""
    closed = F.transform("strokes", lambda x: F.when(F.size(x) >= 3, F.concat(x, F.slice(x, 1, 1))).otherwise(x))
    ink = ink_strokes(spark, sf_dir).select("id", closed.alias("strokes"))
    return exploded(ink.select("id", augment.redrawn(F.col("strokes"), F.col("id"), restart=0.6, reverse=0.4).alias("strokes")))


BEND = {"grid": 0.02, "warp": 0.03, "perspective": 0.2, "rotate": 6.0, "shear": 0.2, "stretch": 0.1, "shift": 0.05}


def _around(name: str, most: float) -> str:
    return f"(2 * {u('bend-' + name, 'id')} - 1) * {most!r}::DOUBLE"


def _normal(k: int, f: str) -> str:
    return f"sqrt(-2 * ln(greatest({u('bend-push', 'id', k)}, 1e-12))) * {f}(2 * pi() * {u('bend-push-turn', 'id', k)}) * {BEND['warp'] / math.sqrt(3)!r}::DOUBLE"


_WAVES = ", ".join(f"cos(2 * pi() * {u('bend-angle', 'id', k)}) * (0.4 + 0.6 * {u('bend-length', 'id', k)}) AS wx{k}, sin(2 * pi() * {u('bend-angle', 'id', k)}) * (0.4 + 0.6 * {u('bend-length', 'id', k)}) AS wy{k}, "
                   f"2 * pi() * {u('bend-phase', 'id', k)} AS ph{k}, {_normal(k, 'cos')} AS px{k}, {_normal(k, 'sin')} AS py{k}" for k in range(3))
_PUSHED = {c: " + ".join(f"sin(2 * pi() * (cx * wx{k} + cy * wy{k}) + ph{k}) * p{c}{k}" for k in range(3)) for c in "xy"}


@query(f"""WITH {STK}, i AS (SELECT id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM stk GROUP BY id),
h AS (SELECT *, {_WAVES}, {_around('tilt-x', BEND['perspective'])} AS tx, {_around('tilt-y', BEND['perspective'])} AS ty, {_around('rotate', math.radians(BEND['rotate']))} AS ang, {_around('shear', BEND['shear'])} AS le,
  exp({_around('wide', BEND['stretch'])}) AS wd, exp({_around('high', BEND['stretch'])}) AS hg, {_around('shift-x', BEND['shift'])} + ({u('bend-nudge-x', 'id')} - 0.5) * 0.02 AS sx,
  {_around('shift-y', BEND['shift'])} + ({u('bend-nudge-y', 'id')} - 0.5) * 0.02 AS sy FROM i),
c AS (SELECT stk.id, stroke, pos, x - mx AS cx, y - my AS cy, h.* EXCLUDE (id) FROM stk JOIN h ON stk.id = h.id),
w AS (SELECT *, cx + {_PUSHED['x']} AS qx, cy + {_PUSHED['y']} AS qy FROM c), d AS (SELECT *, 1 + qx * tx + qy * ty AS dv FROM w),
f AS (SELECT id, stroke, pos, sx, sy, (qx * cos(ang) * wd + qy * (le * cos(ang) - sin(ang)) * wd) / dv AS fx, (qx * sin(ang) * hg + qy * (le * sin(ang) + cos(ang)) * hg) / dv AS fy FROM d)
SELECT id, stroke, pos, round(fx - (min(fx) OVER o + max(fx) OVER o) / 2 + sx, 6) AS x, round(fy - (min(fy) OVER o + max(fy) OVER o) / 2 + sy, 6) AS y FROM f WINDOW o AS (PARTITION BY id)""")
def b12_bend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves, perspective, turning, shear, size, shift and nudge, all drawn by hash of the id."""
    ink = ink_strokes(spark, sf_dir).where(F.size("strokes") > 0)
    how = augment.bend_parameters(F.col("id"), **BEND)
    return exploded(ink.select("id", augment.bent(F.col("strokes"), how).alias("strokes")))


@query(f"WITH {PTS} SELECT id, label, list_concat(list_transform(range(least(length(label), 15)), lambda i: ascii(label[i + 1]) + 1), [257], list_transform(range(15 - least(length(label), 15)), lambda i: 0)) AS tokens FROM words")
def u01_tokenizer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All writers' labels through the tokenizer that is named, here bytes."""
    from strokelake.operators import plugins

    return plugins.tokenized(ink_events(spark, sf_dir), "bytes", F.col("label"), 16).select("id", "label", "tokens")


@query("""WITH d AS (SELECT doc_id, lang FROM documents) SELECT doc_id, length(lang)::DOUBLE AS first, ascii(lang)::DOUBLE AS second FROM d""")
def u03_encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of texts by a user's encoder, each distinct text encoded once."""
    from strokelake.operators import plugins

    encode = lambda texts: [[float(len(t)), float(ord(t[0])) if t else 0.0] for t in texts]
    rows = plugins.encoded(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", encode)
    return rows.select("doc_id", F.col("vector")[0].alias("first"), F.col("vector")[1].alias("second"))


@query(f"""WITH {MEANS} SELECT e.vec_id, round(CASE WHEN e.vec_id % 3 = 0 THEN 0 ELSE list_sum(w) END, 6) AS vector, list_concat(list_transform(range(length(label::VARCHAR)), lambda i: ascii((label::VARCHAR)[i + 1]) + 1), [257],
list_transform(range(7 - length(label::VARCHAR)), lambda i: 0)) AS bytes FROM e JOIN w ON label = prompt""")
def u05_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is told: a vector, zeros where it is missing, and byte tokens."""
    from strokelake.operators import plugins

    rows = base(spark, sf_dir).join(label_means(spark, sf_dir), "label").withColumn("w", F.when(F.col("vec_id") % 3 != 0, F.col("mean")))
    return rows.select("vec_id", F.round(total(plugins.told_vector(F.col("w"), 64)), 6).alias("vector"), plugins.told_bytes(F.col("label").cast("string"), 8).alias("bytes"))


@query(f"""WITH tab AS (SELECT {CRC} AS t), {SCORED}, wd AS (SELECT DISTINCT id, source FROM sc), f AS (SELECT id, source, {crc('id')} % 5 = 0 AS h FROM wd, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY {u('eval', 'id')}, id) AS r FROM f), p AS (SELECT id, CASE WHEN h THEN 'held' ELSE 'seen' END AS part FROM r WHERE r <= CASE WHEN h THEN 30 ELSE 20 END),
v AS (SELECT part, sc.source, sum(nats) / sum((token < 8)::INT) AS score FROM sc JOIN p ON sc.id = p.id GROUP BY ALL)
SELECT round(avg(a.score - b.score), 6) AS gap FROM v a JOIN v b ON a.source = b.source AND a.part = 'held' AND b.part = 'seen'""")
def g02_part_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word scores of held-out words less those of seen ones, over shared sources."""
    rows = written(scored(spark, sf_dir))
    words = rows.select("id", "source").distinct()
    parts = s.evaluation_parts(words, "id", "source", quality.held_out(F.col("id"), 5), 30, 20)
    moves = (F.col("token") < 8).cast("int")
    of = lambda part: scoring.losses(rows.join(parts.where(F.col("part") == part).select("id"), "id", "left_semi"), moves)
    return scoring.gap(of("held"), of("seen"), "source", "word_score").select(F.round("gap", 6).alias("gap"))
