"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.llm import ann_search, conversation_repair, host_rules, html_extraction, jaccard_join, language_id, line_dedup, mixing, packing, prefix_trie, quality_classifier, sentence_pieces, warc_fixity

from strokelake.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extraction.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann_search.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, p=9, q=10)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' records against a replica in which every 97th page has its letters e turned into 3, and in every run of
    89 pages two records have changed places."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, F.translate("html", "e", "3")).otherwise(F.col("html")))
    step = F.when(F.col("page_id") % 89 == 7, 1).when(F.col("page_id") % 89 == 8, -1).otherwise(0)
    theirs = warc_fixity.records(damaged).withColumn("page_id", F.col("page_id") + step)
    out = warc_fixity.audited(warc_fixity.records(pages), theirs)
    return out.select("page_id", "file_id", "volume", "place", "offset", "length", "hash", "intact", "moved")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "n_equal",
                      F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary")).alias("kept_md5"))


def damaged(convs: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text), damaged by a hash of conversation and turn: dropped, emptied, without `.!?`, repeated, or with role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.where("k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(convs)
    found = written(conversation_repair.repair(rows), "repaired")
    hashes = conversation_repair.digests(conversation_repair.edits(rows, found)).withColumnRenamed("conv_id", "h")
    ids = convs.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("h")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns, the first h of them those of conversation c - c % 5 (h by a hash of c), from numbered turns."""
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 9
    ids = written(turns.select("conv_id").distinct(), "conv-ids")
    wanted = ids.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h("conv_id").alias("h"))
    heads = turns.where("depth <= 8").join(wanted, (F.col("conv_id") == F.col("base")) & (F.col("depth") <= F.col("h"))).select(F.col("c").alias("conv_id"), "depth", "x1", "x2", "bytes")
    heads = written(heads, "heads")
    taken = heads.groupBy(F.col("conv_id").alias("c")).agg(F.max("depth").alias("m"))
    rest = turns.where(F.col("depth") > h("conv_id")).join(taken, F.col("conv_id") == F.col("c"), "left")
    return ids, heads.union(rest.select("conv_id", F.col("depth") - h("conv_id") + F.coalesce("m", F.lit(0)), "x1", "x2", "bytes"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie.trie(*rebuilt(turns))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_pieces.encode(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_language_id, op3_ann_search, op4_best_fit_packing, op5_jaccard_join, op6_quality_classifier, op7_warc_fixity, op8_host_rules,
           op9_mixing, op10_line_dedup, op11_conversation_repair, op12_prefix_trie, op13_sentencepiece, pipeline)
    return {f.__name__: f for f in own}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, {WORDS} AS w FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
hosts AS (SELECT source AS h, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY source),
fitted AS (SELECT sum(f) / sum(n) AS m, (sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n))) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * (count(*) - 1) / sum(n) AS between_hosts FROM hosts),
prior AS (SELECT m, CASE WHEN between_hosts > 0 THEN least(greatest(m * (1 - m) / between_hosts - 1, 1), 10000) ELSE 10000 END AS weight FROM fitted),
verdicts AS (SELECT h, (f + m * weight) / (n + weight) > {host_rules.MAX_HOST_RATE} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN verdicts ON source IS NOT DISTINCT FROM h
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS ceiling FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ceiling / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
finals AS (SELECT arg_min(level, ceiling / weight) AS final FROM levels WHERE NOT level * weight > ceiling),
goals AS (SELECT source, source_size, CASE WHEN level * weight > ceiling THEN ceiling ELSE least(ceiling, final * weight) END AS target FROM levels LEFT JOIN finals ON true),
placed AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size * size + greatest(0, least(size, budget % source_size - before)))::BIGINT END AS taken FROM placed
"""

OP7 = r"""
WITH p AS (SELECT page_id, md5(coalesce(page_id::VARCHAR, '')) AS m, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, page_id // 1000 AS file_id, html, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
  substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12), '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
  'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html,
  chr(13), chr(10), chr(13), chr(10)) AS record FROM p),
h AS (SELECT page_id, file_id, sha256(record) AS hash, strlen(record)::BIGINT AS length, NOT (page_id % 97 = 13 AND contains(html, 'e')) AS intact FROM r),
n AS (SELECT file_id, count(DISTINCT (page_id, hash)) AS n FROM h GROUP BY file_id),
v AS (SELECT h.*, CASE WHEN n > 4000 THEN ('0x' || substr(hash, 9, 8))::BIGINT % ceil(n / 1000)::BIGINT ELSE 0 END::INT AS volume FROM h JOIN n USING (file_id)),
k AS (SELECT DISTINCT file_id, volume, page_id + CASE page_id % 89 WHEN 7 THEN 1 ELSE -1 END AS page_id FROM v WHERE intact AND page_id % 89 IN (7, 8))
SELECT v.page_id, v.file_id, v.volume, row_number() OVER w - 1 AS place, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, hash, intact,
  intact AND v.page_id % 89 IN (7, 8) AND k.page_id IS NOT NULL AS moved
FROM v LEFT JOIN k ON v.file_id = k.file_id AND v.volume = k.volume AND v.page_id = k.page_id WINDOW w AS (PARTITION BY v.file_id, v.volume ORDER BY v.page_id, hash)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP10 = rf"""
WITH l AS (SELECT doc_id, i, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM
  (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)),
d AS (SELECT w, min(struct_pack(d := doc_id, i := i)) AS first, len(w) AS n FROM l WHERE len(w) > 0 GROUP BY w),
h AS (SELECT *, (m - 1) // 2 AS c FROM (SELECT *, unnest([n, n - 1]) AS m FROM d WHERE n >= {line_dedup.MIN_WORDS})),
k AS (SELECT w, first, n, m, 'p' AS kind, w[:c] AS part FROM h UNION ALL SELECT w, first, n, m, 's', w[n - c + 1 :] FROM h),
pairs AS (SELECT DISTINCT a.w AS v, b.w AS w FROM k a JOIN k b ON a.m = b.m AND a.kind = b.kind AND a.part = b.part AND a.first < b.first),
sized AS (SELECT w, CASE WHEN len(v) >= len(w) THEN v ELSE w END AS x, CASE WHEN len(v) >= len(w) THEN w ELSE v END AS y FROM pairs),
near AS (SELECT DISTINCT w FROM sized WHERE len(x) - len(y) <= 1 AND CASE WHEN len(x) = len(y) THEN list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] <> y[j])::INT)) <= 1
  ELSE list_bool_or(list_transform(range(1, len(x) + 1), lambda j: list_concat(x[: j - 1], x[j + 1 :]) = y)) END),
marked AS (SELECT l.*, d.first IS NOT NULL AND d.first <> struct_pack(d := doc_id, i := l.i) AS equal, near.w IS NOT NULL AS close FROM l LEFT JOIN d ON l.w = d.w LEFT JOIN near ON l.w = near.w),
per AS (SELECT doc_id, count(*) AS n, sum((equal OR close)::INT) AS gone, sum(equal::INT) AS eq, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT (equal OR close)), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_dropped, coalesce(eq, 0)::BIGINT AS n_equal, length(coalesce(kept, ''))::BIGINT AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM documents LEFT JOIN per USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": OP5, "op10_line_dedup": OP10, "op7_warc_fixity": OP7, "op8_host_rules": OP8, "op9_mixing": OP9}
