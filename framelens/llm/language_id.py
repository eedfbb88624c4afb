"""Language by compression: the language whose dictionary encodes a text in the fewest bytes.

Each language gets a raw-content zstandard dictionary of passages of its texts. A text is cut
into blocks, so that its own beginning does not teach the compressor more than the dictionary
does, and encoded once per language. The words are dealt out with different strides in texts and
dictionaries: only parts of words then match, not license lines or quoted passages. The smallest total wins. Where the runner-up is hardly
larger, the text is encoded again with every quarter of the dictionaries, which adds up to a
finer measure; if that is close too, the verdict is marked as narrow.

Null text or text without a letter: ``und`` with score 0. Ties: the language with more texts.
No labelled text at all: everything is ``und``. Repeated rows get equal results.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import hashing as H
from framelens.llm.common import fold_of, unit_hash

#: Bounds of the sample that the dictionaries are made of.
PASSAGES, PASSAGE_CHARS, DICTIONARY_BYTES = 150, 1300, 192 << 10
BLOCK_CHARS = 3000
LEVEL = 6
#: Verdicts are narrow if the runner-up needs less than this share more.
NARROW = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def _plain(text: str, stride: int) -> str:
    """Letters in lower case; the words in ``stride`` rounds, each taking every ``stride``-th word."""
    words = _OTHER.sub(" ", text.lower()).split(" ")
    return " ".join(w for k in range(stride) for w in words[k::stride])


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          passages: int = PASSAGES, seed: str = "lang-1") -> dict[str, bytes]:
    """One dictionary per language, from about ``passages`` hash-chosen passages of each."""
    t, name = F.col(f"`{text}`"), F.col(f"`{lang}`")
    known = df.where(name.isNotNull() & (F.length(t) > 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy(name.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, passages / n))])
    k = F.col(f"`{key}`")
    start = 1 + F.floor(unit_hash(seed + "-at", k) * F.greatest(F.length(t) - PASSAGE_CHARS, F.lit(0)))
    taken = (known.where(unit_hash(seed, k) < F.element_at(share, name))
             .select(name.alias("lang"), F.substring(t, start.cast("int"), F.lit(PASSAGE_CHARS)).alias("t"), unit_hash(seed, k).alias("u")))
    parts: dict[str, list[str]] = {c: [] for c in counts}
    for row in sorted(taken.collect(), key=lambda r: (r["u"], r["t"])):
        parts[row["lang"]].append(_plain(row["t"], 5))
    order = sorted(counts, key=lambda c: (-counts[c], c))
    return {c: " ".join(parts[c]).encode()[-DICTIONARY_BYTES:] for c in order if parts[c]}


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id",
            narrow: float = NARROW) -> DataFrame:
    """``key``, lang_pred, score, narrow: score 0 is a tie, 1 a certain verdict."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: languages x DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd
        names = list(shared.value)
        whole = [[_loaded(zstd, shared.value[n])] for n in names]
        parts = [[_loaded(zstd, q) for q in _quarters(shared.value[n])] for n in names]
        for batch in H.slices(batches):
            pred, score, close = [], [], []
            for t in batch.column(1).to_pylist():
                if t is None or not names or not _LETTER.search(t):
                    pred.append(UNKNOWN), score.append(0.0), close.append(True)
                    continue
                plain = _plain(t, 7)
                blocks = [plain[i:i + BLOCK_CHARS].encode() for i in range(0, len(plain), BLOCK_CHARS)]
                best, margin = _smallest(whole, blocks)
                if margin < narrow:
                    best, margin = _smallest(parts, blocks)
                pred.append(names[best]), score.append(1 - math.exp(-20 * margin)), close.append(margin < narrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                names=["key", "lang_pred", "score", "narrow"])

    narrowed = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = narrowed.schema["key"].dataType.simpleString()
    return narrowed.mapInArrow(run, f"key {kind}, lang_pred string, score double, narrow boolean").withColumnRenamed("key", key)


def _loaded(zstd, data: bytes):
    made = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=made)


def _quarters(data: bytes) -> list[bytes]:
    step = max(8, -(-len(data) // 4))
    return [data[i:i + step] for i in range(0, len(data), step)]


def _smallest(coders: list[list], blocks: list[bytes]) -> tuple[int, float]:
    """Index of the language with the least bytes; how much more the next one needs, relatively."""
    sizes = [sum(len(c.compress(b)) for c in own for b in blocks) / len(own) for own in coders]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
    return best, (rest - sizes[best]) / sizes[best]


def held_out_languages(df: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the rows outside one fold; predict all rows."""
    out = fold_of(F.col("doc_id"), folds) == fold
    dictionaries = train(df.where(~out))
    return predict(df, dictionaries).select("doc_id", out.alias("held_out"), "lang_pred", "score", "narrow")
