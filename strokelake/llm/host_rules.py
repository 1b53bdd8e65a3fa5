"""Quality rules by host (DataFrame functions only).

Each document gets counts and a base verdict. Failures are summed by host, each host's failure rate is shrunk
towards a beta prior fitted to all hosts by moments, and the verdict on the host is joined back to its documents.
Here the host is the `source` column (any column can be named).

Defined cases: a null or empty text has no words and fails; null hosts form one host; repeated rows are judged one by
one; an empty table gives an empty result; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.llm.common import TRIM, let, small_or_plain, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
BROADCAST_HOSTS = 50_000


def repeated_words() -> str:
    """SQL for how many words of the bound array `w` lie in a 3-word window found twice or more, the first included.

    Windows are hashed, packed with their position into one long and sorted; neighbours with equal hashes are compared
    word by word, so a collision does not count.
    """
    mask = "(shiftleft(1L, b) - 1L)"
    at = f"int(v & {mask})"

    def same(other: str) -> str:
        there = f"int({other} & {mask})"
        return (f"(shiftright(v, b) = shiftright({other}, b) AND w[{at}] = w[{there}]"
                f" AND w[{at} + 1] = w[{there} + 1] AND w[{at} + 2] = w[{there} + 2])")

    covered = ("aggregate(transform(p, (x, k) -> CASE WHEN k + 1 < size(p) THEN least(3L, p[k + 1] - x) ELSE 3L END),"
               " 0L, (a, x) -> a + x)")
    positions = (f"sort_array(transform(filter(s, (v, k) -> (k > 0 AND {same('s[k - 1]')})"
                 f" OR (k < size(s) - 1 AND {same('s[k + 1]')})), v -> v & {mask}))")
    packed = ("sort_array(transform(sequence(0, size(w) - 3),"
              " i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | bigint(i)))")
    body = (f"transform(array(int(ceil(log2(size(w) + 1)))), b -> transform(array({packed}), s ->"
            f" transform(array({positions}), p -> {covered})[0])[0])[0]")
    return f"CASE WHEN size(w) < 3 THEN 0L ELSE {body} END"


def counts(text: str = "text") -> Column:
    """A struct (n_words, word_chars, n_repeat_words) of a text column, whose words are split once."""
    t = rf"btrim(coalesce(`{text}`, ''), ' \t\n\u000b\f\r')"
    split = rf"CASE WHEN {t} = '' THEN cast(array() AS array<string>) ELSE split({t}, '[\\x20\\x09-\\x0D]+') END"
    # `w` is bound by a transform over a one-element array: see common.let
    return F.expr(f"transform(array({split}), w -> named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))),"
                  f" 'n_repeat_words', {repeated_words()}))[0]")


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows (doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(TRIM)) != ""),
                lambda a: F.size(a) - F.size(F.array_distinct(a)))
    out = docs.select(
        "doc_id",
        F.col(host).cast("string").alias("host"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        counts().alias("counts"),
    )
    out = out.select("doc_id", "host", "counts.n_words", "counts.word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words")
    return out.withColumn("base_failed", failed())


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(base: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows (host, n, n_failed, rate, rejected): failure rates shrunk by a beta prior fitted to all hosts by moments."""
    hosts = written(base.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    t = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("n_failed").alias("f"),
                  F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n")).alias("s")).first()
    alpha, beta = beta_prior(t["hosts"], t["n"] or 0, t["f"] or 0, t["s"] or 0.0)
    rate = (F.col("n_failed") + alpha) / (F.col("n") + alpha + beta)
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def beta_prior(hosts: int, n: int, failures: int, square_sum: float) -> tuple[float, float]:
    """Moments of the hosts' rates: mean m, and variance between hosts beyond what binomial draws give.

    `square_sum` is the sum over hosts of failures squared over size. The prior's weight lies between 1 and 10,000.
    """
    if not n:
        return 0.5, 0.5
    m = failures / n
    between = (square_sum / n - m * m) - m * (1 - m) * (hosts - 1) / n
    weight = min(max(m * (1 - m) / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0
    return m * weight, (1 - m) * weight


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows (doc_id, host, counts, base_failed, host_rate, kept), one per input row."""
    base = written(base_counts(docs, host), "rules")
    verdicts = written(host_verdicts(base, max_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "rejected"), "verdicts")
    joined = base.join(small_or_plain(verdicts, BROADCAST_HOSTS), base["host"].eqNullSafe(F.col("h")), "left")
    return joined.select(*base.columns, "host_rate", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The input rows that `quality_rules` keeps, all columns as they are. Texts are judged once and not shuffled: rows that
    pass the base rules are written with their hosts, rows that fail as their hosts alone."""
    judged = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).cast("string").alias("host"), counts().alias("counts")).select("row", "host", "counts.*")
    judged = judged.withColumn("base_failed", failed()).select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", "base_failed")
    judged = written(judged, "judged")
    bad = written(host_verdicts(judged.select("host", "base_failed"), max_rate).where("rejected").select(F.col("host").alias("h")), "bad-hosts")
    kept = judged.where(~F.col("base_failed"))
    return kept.join(small_or_plain(bad, BROADCAST_HOSTS), kept["host"].eqNullSafe(F.col("h")), "left_anti").select("row.*")
