"""Small helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def replace(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the given columns put last; columns of the same name are replaced."""
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    return df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in columns.items()])


def unit_hash(seed: str, *parts: Column) -> Column:
    """A uniform number in [0, 1) from the MD5 of seed and parts (null: ``~``)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2 ** 48))


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, keys: Sequence[str], limit: int, seed: str) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of ``keys``; all rows if there are fewer."""
    share = df.count()
    if share <= limit:
        return df
    return df.where(unit_hash(seed, *[F.col(k) for k in keys]) < F.lit(limit / share))
