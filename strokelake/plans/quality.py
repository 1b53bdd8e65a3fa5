"""Queries on gates, normalisers and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.operators import quality as q
from strokelake.operators import textops
from strokelake.plans.adapters import PTS, STK, ink_events, ink_points, ink_strokes
from strokelake.plans.registry import query, table

CRC = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc(text: str) -> str:
    """SQL for CRC-32 of a text, given `tab` (a one-row table with the list t)."""
    h = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(length({h}) // 2), lambda k: ('0x' || substr({h}, (2 * k + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[xor(c & 255, b & 255) + 1])), 4294967295::BIGINT)"


@query(f"WITH tab AS (SELECT {CRC} AS t) SELECT doc_id, {crc('doc_id::VARCHAR')} % 20 = 0 AS held_out FROM documents, tab")
def e02_hash_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", q.held_out(F.col("doc_id"), 20).alias("held_out"))


@query(f"""WITH tab AS (SELECT {CRC} AS t), w AS (SELECT DISTINCT event_type AS source, user_id AS writer FROM events),
n AS (SELECT source FROM w GROUP BY source HAVING count(*) >= 20) SELECT source, writer FROM w, tab WHERE source IN (SELECT source FROM n) AND {crc('writer::VARCHAR')} % 20 = 0""")
def e03_writer_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("writer"))
    return q.held_out_writers(rows, 20)


@query("""SELECT p_partkey, strlen(p_name) <= 24 AND len(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> '')) = 1 AS kept FROM part""")
def e01_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", q.one_word(F.col("p_name"), 24).alias("kept"))


FRAME = f"""{PTS}, y AS (SELECT pts.id, pts.writer, y, length(regexp_replace(label, '[acv]', '', 'g')) <= 6 AS short FROM pts JOIN words ON pts.id = words.id WHERE pen = 1),
per AS (SELECT writer, id, short, quantile_cont(y, 0.02) AS q0, quantile_cont(y, 0.98) AS q1, quantile_cont(y, 0.05) AS r0, quantile_cont(y, 0.95) AS r1 FROM y GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT writer, CASE WHEN count(*) FILTER (short) >= 5 THEN median(q1 - q0) FILTER (short) END AS xh, CASE WHEN count(*) FILTER (short) >= 5 THEN median(q1) FILTER (short) END AS base,
  CASE WHEN count(*) >= 5 THEN median(r1 - r0) END AS ink FROM per GROUP BY writer)"""


@query(f"""WITH {FRAME} SELECT writer, round(xh, 6) AS x_height, round(base, 6) AS baseline, round(ink, 6) AS ink_height,
(CASE WHEN xh / 0.123 <= 0.6 OR xh / 0.123 >= 1.7 THEN 1 ELSE 0 END + CASE WHEN abs(base) > 0.06 THEN 1 ELSE 0 END + CASE WHEN xh IS NULL AND (ink / 0.22 <= 0.5 OR ink / 0.22 >= 2) THEN 1 ELSE 0 END)::INT AS errors FROM m""")
def e04_frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ink_events(spark, sf_dir).select("id", (F.length(F.regexp_replace("label", "[acv]", "")) <= 6).alias("short"))
    points = ink_points(spark, sf_dir).where("pen = 1").select("id", "writer", "y").join(labels, "id")
    out = q.frame_check(points)
    return out.select("writer", F.round("x_height", 6).alias("x_height"), F.round("baseline", 6).alias("baseline"), F.round("ink_height", 6).alias("ink_height"), F.size("errors").alias("errors"))


@query(f"""WITH {PTS}, h AS (SELECT writer, id, max(y) - min(y) AS height, CASE hash_kind WHEN 0 THEN 'words' WHEN 1 THEN 'letters' ELSE 'bands' END AS kind
  FROM (SELECT *, split_part(id, '/', 3)::INT % 3 AS hash_kind FROM pts WHERE pen = 1) GROUP BY writer, id, hash_kind),
m AS (SELECT writer, CASE WHEN count(*) FILTER (kind = 'words') >= 5 THEN median(height) FILTER (kind = 'words') END AS a, CASE WHEN count(*) FILTER (kind = 'letters') >= 5 THEN median(height) FILTER (kind = 'letters') END AS b,
  CASE WHEN count(*) FILTER (kind = 'bands') >= 3 THEN median(height) FILTER (kind = 'bands') END AS c FROM h GROUP BY writer)
SELECT writer, CASE WHEN a IS NOT NULL THEN 'words' WHEN b IS NOT NULL THEN 'letters' WHEN c IS NOT NULL THEN 'bands' ELSE 'none' END AS method, round(coalesce(a, b, c), 6) AS height FROM m""")
def e05_x_height_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = ink_points(spark, sf_dir).where("pen = 1").groupBy("writer", "id").agg((F.max("y") - F.min("y")).alias("height"))
    kind = F.split("id", "/")[2].cast("int") % 3
    rows = heights.select("writer", "height", F.when(kind == 0, "words").when(kind == 1, "letters").otherwise("bands").alias("kind"))
    return q.x_height_ladder(rows).select("writer", "method", F.round("height", 6).alias("height"))


@query("""WITH c AS (SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::UBIGINT AS v, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxy' AS d FROM customer)
SELECT c_custkey, concat(d[(v % 61)::INT + 1], d[(v // 61 % 61)::INT + 1], d[(v // 3721 % 61)::INT + 1], d[(v // 226981 % 61)::INT + 1], d[(v // 13845841 % 61)::INT + 1]) AS author FROM c""")
def e07_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", textops.pseudonym(F.col("c_name")).alias("author"))


@query(r"""SELECT doc_id, regexp_replace(replace(lower(text), '0', 'o'), '[^\p{L}\p{N}]', '', 'g') AS core FROM documents""")
def e08_core_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textops.core(F.col("text")).alias("core"))


@query()
def e08_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", textops.plain(F.col("text")).alias("plain"))


READS = """rd AS (SELECT p_partkey AS item, p_name AS label, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name || ' x' END AS read FROM part),
cand AS (SELECT item, v AS seq, label, CASE WHEN v = 0 THEN read ELSE label END AS read, ((item * 37 + v * 11) % 50 + 50) / 100.0::DOUBLE AS coverage, ((item * 17 + v * 7) % 20 + 80) / 100.0::DOUBLE AS precision,
  ((item * 13 + v) % 10 + 3) / 10.0::DOUBLE AS min_mark, ((item * 7 + v) % 10 + 8) / 10.0::DOUBLE AS length_ratio, ((item * 3 + v) % 10) / 20.0::DOUBLE AS retrace, ((item * 5 + v) % 10 + 11) / 10.0::DOUBLE AS max_mark_length
  FROM rd, (SELECT unnest([0, 1, 2]) AS v))"""
GATE = f"""{READS}, er AS (SELECT *, levenshtein(read, label) / greatest(length(label), 1)::DOUBLE AS read_error FROM cand),
gt AS (SELECT *, NOT (coverage >= 0.80 OR (coverage >= 0.70 AND read_error <= 0.15)) AS f1, min_mark < 0.5 AS f2, precision < 0.90 AS f3, read_error > 0.34 AS f4, length_ratio > 1.6 AS f5, retrace > 0.35 AS f6, max_mark_length > 1.95 AS f7 FROM er),
gate AS (SELECT *, f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT AS failed, NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7) AS passed FROM gt)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three trace candidates for each part name."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("label"))
    n, k = F.length("label"), F.col("item") % 4
    read = F.when(k == 0, F.col("label")).when(k == 1, F.col("label").substr(F.lit(2), n)).when(k == 2, F.col("label").substr(F.lit(1), n - 1)).otherwise(F.concat("label", F.lit(" x")))
    v, i = F.col("seq"), F.col("item")
    rows = part.withColumn("read", read).withColumn("seq", F.explode(F.array(*[F.lit(j) for j in range(3)])))
    return rows.select("item", "seq", "label", F.when(v == 0, F.col("read")).otherwise(F.col("label")).alias("read"), (((i * 37 + v * 11) % 50 + 50) / 100.0).alias("coverage"),
                       (((i * 17 + v * 7) % 20 + 80) / 100.0).alias("precision"), (((i * 13 + v) % 10 + 3) / 10.0).alias("min_mark"), (((i * 7 + v) % 10 + 8) / 10.0).alias("length_ratio"),
                       (((i * 3 + v) % 10) / 20.0).alias("retrace"), (((i * 5 + v) % 10 + 11) / 10.0).alias("max_mark_length"))


@query(f"WITH {READS} SELECT item, levenshtein(read, label)::INT AS distance FROM cand WHERE seq = 0")
def e09_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).where("seq = 0").select("item", F.levenshtein("read", "label").alias("distance"))


@query(f"WITH {READS} SELECT item, length(label) > 1 AND (read = substr(label, 1, length(label) - 1) OR read = substr(label, 2)) AS clipped FROM cand WHERE seq = 0")
def e10_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).where("seq = 0").select("item", textops.clipped(F.col("read"), F.col("label")).alias("clipped"))


@query(f"WITH {GATE} SELECT item, seq, round(read_error, 6) AS read_error, failed::INT AS failed, passed FROM gate")
def e11_trace_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.trace_gate(reads(spark, sf_dir)).select("item", "seq", F.round("read_error", 6).alias("read_error"), F.size("reasons").alias("failed"), "passed")


@query(f"WITH {GATE} SELECT item, seq, passed FROM gate QUALIFY row_number() OVER (PARTITION BY item ORDER BY passed DESC, coverage * precision DESC, seq) = 1")
def e12_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.best_candidate(q.trace_gate(reads(spark, sf_dir))).select("item", "seq", "passed")


@query(f"""WITH {GATE}, ok AS (SELECT DISTINCT item FROM gate WHERE seq = 0 AND passed) SELECT item, seq, passed FROM gate WHERE seq = 0
UNION ALL SELECT item, seq, passed FROM gate WHERE seq = 1 AND item NOT IN (SELECT item FROM ok) AND (SELECT count(*) FROM ok) < 1000000""")
def e13_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.trace_gate(reads(spark, sf_dir)).select("item", "seq", "passed")
    return q.retry(rows.where("seq = 0"), rows.where("seq = 1"), least=1_000_000)


@query(f"""WITH {GATE}, g AS (SELECT *, item % 400 AS hand FROM gate), ok AS (SELECT hand, count(DISTINCT item) FILTER (passed) AS n FROM g WHERE seq = 0 GROUP BY hand)
SELECT hand, item, seq, passed FROM g WHERE seq = 0 UNION ALL SELECT g.hand, item, seq, passed FROM g JOIN ok ON g.hand = ok.hand WHERE seq = 1 AND n < 2 AND item NOT IN (SELECT item FROM g WHERE seq = 0 AND passed)""")
def e13_retry_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second round for the hands of which fewer than two items passed, and for their failed items alone."""
    rows = q.trace_gate(reads(spark, sf_dir)).select((F.col("item") % 400).alias("hand"), "item", "seq", "passed")
    return q.retry(rows.where("seq = 0"), rows.where("seq = 1"), least=2, by="hand")


@query("""WITH w AS (SELECT doc_id, quality * 7 AS leg, string_split(text, ' ')[1] AS label FROM documents JOIN labels USING (doc_id)),
e AS (SELECT * FROM w WHERE leg >= 6 AND length(label) BETWEEN 2 AND 12 AND regexp_full_match(label, '[\\x21-\\x7e]+') AND regexp_matches(label, '[a-z]'))
SELECT label, doc_id FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY leg DESC, doc_id) <= 8""")
def e14_eligible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = graded.select("doc_id", (F.col("quality") * 7).alias("leg"), F.split("text", " ")[0].alias("label"))
    return q.capped(rows.where(q.eligible_label(F.col("label"), F.col("leg"))), "label", [F.desc("leg"), F.col("doc_id")], 8).select("label", "doc_id")


@query("""SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 20""")
def e15_document_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return q.capped(graded.where("quality = 1 AND toxic = 0"), "source", [F.desc("n_chars"), F.col("doc_id")], 20).select("source", "doc_id")


@query("""WITH c AS (SELECT source, quantile_cont(n_chars::DOUBLE, 0.5) AS a, quantile_cont(n_chars::DOUBLE, 0.98) AS b FROM documents GROUP BY source)
SELECT doc_id, d.source FROM documents d JOIN c ON d.source = c.source WHERE n_chars BETWEEN a AND b""")
def e16_class_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.within_class(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", 0.5, 0.98).select("doc_id", "source")


@query("""WITH s AS (SELECT label, vec_id, round(embedding[1]::DOUBLE, 5) AS quality FROM embeddings), l AS (SELECT 2 * min(n) AS m FROM (SELECT count(*) AS n FROM s GROUP BY label))
SELECT label, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY quality DESC, vec_id) AS rank FROM s) WHERE rank <= (SELECT m FROM l)""")
def e17_balanced_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("quality"))
    return q.balanced_best(rows, "label", F.col("quality"), "vec_id").select("label", "vec_id", "rank")


@query("""WITH s AS (SELECT label, vec_id, round(embedding[1]::DOUBLE, 5) AS quality FROM embeddings)
SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY quality DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s) WHERE r <= ceil(0.3::DOUBLE * n)""")
def e17_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("quality"))
    return q.top_share(rows, "label", F.col("quality"), "vec_id", 0.3).select("label", "vec_id")


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS caption, string_split(text, chr(10))[2] AS record FROM documents)
SELECT doc_id, len(string_split(caption, ' ')) <= 64 AS short, len(list_filter(regexp_extract_all(caption, '\\d+'), lambda x: NOT list_contains(regexp_extract_all(coalesce(record, ''), '\\d+'), x))) = 0 AS known FROM d""")
def e19_caption_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(lines, F.lit(0)).alias("caption"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("record"))
    return d.select("doc_id", (F.size(F.split("caption", " ")) <= 64).alias("short"), q.numbers_known(F.col("caption"), F.col("record")).alias("known"))


@query(f"""WITH {STK}, e AS (SELECT id, stroke, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1 FROM stk GROUP BY id, stroke),
j AS (SELECT *, round(sqrt(power(x0 - lag(x1) OVER w, 2) + power(y0 - lag(y1) OVER w, 2)), 9) AS jump FROM e WINDOW w AS (PARTITION BY id ORDER BY stroke)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jump DESC NULLS LAST, stroke) AS r FROM j)
SELECT id, stroke, (sum((r <= 2 AND jump IS NOT NULL)::INT) OVER (PARTITION BY id ORDER BY stroke))::BIGINT AS stage FROM r""")
def e20_stage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ink_strokes(spark, sf_dir).select("id", F.posexplode("strokes").alias("stroke", "s"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    return q.stage_cuts(rows.select("id", "stroke", first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1")), stages=3)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def e21_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.distinct_by(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id").select("doc_id")


@query("""WITH d AS (SELECT *, l.quality AS ql, l.toxic AS tx FROM documents LEFT JOIN labels l USING (doc_id))
SELECT 0 AS place, 'all' AS stage, count(*)::BIGINT AS n FROM d UNION ALL SELECT 1, 'english', count(*) FROM d WHERE lang = 'en' UNION ALL SELECT 2, 'long', count(*) FROM d WHERE lang = 'en' AND n_chars >= 500
UNION ALL SELECT 3, 'good', count(*) FROM d WHERE lang = 'en' AND n_chars >= 500 AND ql = 1 UNION ALL SELECT 4, 'clean', count(*) FROM d WHERE lang = 'en' AND n_chars >= 500 AND ql = 1 AND tx = 0""")
def e21_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return q.funnel(d, {"all": F.lit(True), "english": F.col("lang") == "en", "long": F.col("n_chars") >= 500, "good": F.col("quality") == 1, "clean": F.col("toxic") == 0})
