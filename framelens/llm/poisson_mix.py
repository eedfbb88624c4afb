"""Mix sources to target weights by Poisson replication.

A source whose share should be ``w`` of ``total`` gets the mean repetition rate
``w * total / size``. Each document inverts the Poisson distribution of that mean at a uniform
number hashed from the seed and its id, is exploded by the count, and all copies are spread
over the partitions by a random key and sorted by it. DataFrame functions only.

Null source: a source of its own. Null or empty text: size 0; a source without any text keeps
rate 1. A source without a weight: rate 0. Rows that repeat an id draw the same number. Empty
table: empty result. Columns named copy, n_copies or shuffle_key are replaced.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import replace, unit_hash
from framelens.session import written

#: Target weight of a source: its size to this power, before the sum is made 1.
TEMPERATURE = 0.5
SEED = "mix-1"


def poisson_steps(rate: Column) -> Column:
    """Distribution function of the Poisson law at 0, 1, ...; far beyond the mean it is 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.ln(rate) - F.ln(k.cast("double"))
        p = acc["p"] + F.exp(lp)
        return F.struct(lp.alias("lp"), p.alias("p"), F.array_append(acc["all"], p).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["all"])
                  ).otherwise(F.array(F.lit(1.0)))


def source_rates(df: DataFrame, source: str = "source", text: str = "text",
                 weights: Mapping[str, float] | None = None, total: float | None = None,
                 temperature: float = TEMPERATURE) -> DataFrame:
    """One row per source: size in bytes, target weight, mean repetition rate.

    ``weights`` by source, or else size to the power ``temperature``. ``total`` is the wanted
    size in bytes (default: that of the input).
    """
    sizes = df.groupBy(F.col(f"`{source}`").alias("mix_source")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("double")).alias("mix_size"))
    if weights is None:
        raw = F.pow(F.col("mix_size"), F.lit(float(temperature)))
    else:
        raw = F.coalesce(_weight_of(weights), F.lit(0.0))
    sizes = sizes.withColumn("mix_raw", raw)
    sums = sizes.agg(F.struct(F.sum("mix_raw").alias("raws"), F.sum("mix_size").alias("all"))).scalar()
    wanted = F.col("__t.all") if total is None else F.lit(float(total))
    weight = F.when(F.col("__t.raws") > 0, F.col("mix_raw") / F.col("__t.raws")).otherwise(0.0)
    return (sizes.withColumn("__t", sums)
            .select("mix_source", "mix_size", weight.alias("mix_weight"),
                    F.when(F.col("mix_size") > 0, weight * wanted / F.col("mix_size")).otherwise(1.0).alias("mix_rate")))


def _weight_of(weights: Mapping[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.try_element_at(table, F.col("mix_source"))


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
        weights: Mapping[str, float] | None = None, total: float | None = None,
        temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """All columns of ``df`` for each drawn copy, with copy (from 0), n_copies and shuffle_key."""
    copies, order = _copies(df, source, text, key, weights, total, temperature, seed)
    out = replace(copies, copy=F.col("__c").cast("long"), n_copies=F.col("__n").cast("long"), shuffle_key=order).drop("__n", "__c")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def draw(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
         weights: Mapping[str, float] | None = None, total: float | None = None,
         temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The rows of ``mix`` with the columns of ``df`` alone, whatever their names."""
    copies, order = _copies(df, source, text, key, weights, total, temperature, seed)
    return copies.repartition(order).sortWithinPartitions(order).select(*[F.col(f"`{c}`") for c in df.columns])


def _copies(df: DataFrame, source: str, text: str, key: str, weights: Mapping[str, float] | None, total: float | None,
            temperature: float, seed: str) -> tuple[DataFrame, Column]:
    """The drawn copies with ``__n`` and ``__c``, and the key of their random order."""
    rates = source_rates(df, source, text, weights, total, temperature)
    # one small row per source, written so that Spark knows the size before it picks the join
    steps, _ = written(rates.select("mix_source", poisson_steps(F.col("mix_rate")).alias("mix_steps")), "mix-rates")
    base = df.alias("d").join(steps.alias("r"), F.col(f"d.`{source}`").eqNullSafe(F.col("r.mix_source")), "left")
    u = unit_hash(seed, F.col(f"d.`{key}`"))
    count = F.size(F.filter("r.mix_steps", lambda c: c < u))
    drawn = base.select("d.*", count.alias("__n")).where("__n > 0")
    copies = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__c"))
    return copies, F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.coalesce(
        F.col(f"`{key}`").cast("string"), F.lit("~")), F.col("__c")))


SQL = """
WITH z AS (SELECT source, sum(coalesce(strlen(text), 0)::DOUBLE) AS size FROM documents GROUP BY 1),
a AS (SELECT sum(sqrt(size)) AS raws, sum(size) AS total FROM z),
r AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) / raws * total / size ELSE 1.0 END AS rate FROM z, a),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r),
l AS (SELECT source, k, CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k::DOUBLE) END AS lp FROM k),
p AS (SELECT source, k, exp(sum(lp) OVER (PARTITION BY source ORDER BY k)) AS p FROM l),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '~')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
      FROM documents),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND cdf < u.u GROUP BY 1),
x AS (SELECT d.*, n, unnest(range(0, n)) AS i FROM documents d JOIN n USING (doc_id))
SELECT doc_id, text, lang, source, n_chars, i::BIGINT AS copy, n::BIGINT AS n_copies,
       md5('mix-1-order:' || doc_id || ':' || i) AS shuffle_key FROM x
"""
