"""Word rules per document, shrunk failure rates per host, and host verdicts joined back.

DataFrame functions only. A host's failure rate is shrunk towards the rate of all documents
with a beta prior whose strength comes from the spread of the host rates (method of moments),
so that small hosts are not judged by a few documents.

Null text: no words (fails the rules). Null host: its own host. Empty table: empty result.
Repeated rows are judged and counted one by one. Columns of the same names are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import let, replace, words_of
from framelens.session import written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR = (1.0, 10_000.0)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")))

    def repeated(s: Column) -> Column:
        hits = F.filter(s, lambda x, k: x["g"].eqNullSafe(F.get(s, k - 1)["g"])
                        | x["g"].eqNullSafe(F.get(s, k + 1)["g"]))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    # the windows at starts p cover min(3, next start - p) new words each
    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        let(let(F.sort_array(windows), repeated), covered)).cast("long")


def word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.withColumn("__s", F.struct(
        let(words_of(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"),
            F.length(F.array_join(w, "")).cast("long").alias("c"))).alias("w"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("y"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    n, r = F.col("__s.w.n"), F.col("__s.w.r")
    return replace(counted, n_words=n, word_chars=F.col("__s.w.c"), n_symbols=F.col("__s.y"),
                   n_dup_lines=F.col("__s.d"), n_repeat_words=r,
                   base_failed=(n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).drop("__s")


def host_rates(stats: DataFrame, host: str = "host") -> DataFrame:
    """One row per host: documents, failures, shrunk rate."""
    hosts = stats.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    # one row: mean rate of all documents, weighted spread of the hosts around it
    rate = F.col("host_failures") / F.col("host_docs")
    spread = hosts.agg(
        (F.sum("host_failures") / F.sum("host_docs")).alias("m"),
        (F.sum(F.col("host_docs") * rate * rate) / F.sum("host_docs")).alias("q"))
    m, v = F.col("m"), F.col("q") - F.col("m") * F.col("m")
    strength = F.when(v > 1e-9, F.greatest(F.lit(PRIOR[0]), F.least(F.lit(PRIOR[1]), m * (1 - m) / v - 1))
                      ).otherwise(F.lit(PRIOR[1]))
    prior = spread.select(F.struct(m.alias("m"), strength.alias("k"))).scalar()
    return hosts.withColumn("__p", prior).select(
        "host", "host_docs", "host_failures",
        ((F.col("host_failures") + F.col("__p.m") * F.col("__p.k")) / (F.col("host_docs") + F.col("__p.k"))
         ).alias("host_rate"))


def judge(df: DataFrame, text: str = "text", host: str = "source",
          max_host_rate: float = MAX_HOST_RATE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the word counts, base_failed, the host's failed flag, and kept.

    The counts of all documents are written once; both the host rates and the join read them.
    """
    narrow = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                       F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    stats, _ = written(word_stats(narrow).drop("text"), "word-stats")
    hosts, _ = written(host_rates(stats).select("host", (F.col("host_rate") > max_host_rate).alias("host_failed")),
                       "host-rates")
    # both sides are written tables, so that Spark knows their sizes and can split a hot host
    out = stats.alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host")), "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS d FROM (
         SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY 1),
p AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS q FROM h),
k AS (SELECT m, CASE WHEN q - m * m > 1e-9
                THEN greatest(1.0, least(10000.0, m * (1 - m) / (q - m * m) - 1)) ELSE 10000.0 END AS k FROM p),
v AS (SELECT source, (f + m * k) / (n + k) > 0.5 AS host_failed FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
