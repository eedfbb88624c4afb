"""Decoding of logged raw model outputs: class scores, text steps, keypoints, priors, faces."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions.geometry import bind

# fixed values: face priors and box variances
PRIOR_STEPS = (8, 16, 32)
PRIOR_SIZES = ((16, 32), (64, 128), (256, 512))
VAR_CENTRE, VAR_SIZE = 0.1, 0.2


def argmax(values: Column) -> Column:
    """First index of the maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax_at_max(values: Column) -> Column:
    """Probability of the best class, computed stably."""
    return bind(F.array_max(values), lambda m: F.lit(1.0) / F.aggregate(
        values, F.lit(0.0), lambda a, v: a + F.exp((v - m).cast("double"))))


def looks_like_probabilities(values: Column) -> Column:
    return F.abs(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) - 1.0) < 0.05


def top1(values: Column, is_prob: Column | bool | None = None) -> Column:
    """Struct (cls, score). Without ``is_prob`` the sum decides whether values are probabilities."""
    prob = looks_like_probabilities(values) if is_prob is None else (
        F.lit(is_prob) if isinstance(is_prob, bool) else is_prob)
    score = F.when(prob, F.array_max(values).cast("double")).otherwise(softmax_at_max(values))
    return F.when(F.size(values) > 0, F.struct(argmax(values).alias("cls"), score.alias("score")))


def text_layout(flat: Column, dim0: int, dim1: int, dict_size: int) -> Column:
    """Flat logits to one array per time step; class-first input is turned.

    The class dimension is the one within two of the dictionary size.
    """
    def fits(v: int) -> bool:
        return dict_size <= v <= dict_size + 2
    if dict_size > 0 and not fits(dim1) and fits(dim0):
        return F.transform(F.sequence(F.lit(0), F.lit(dim1 - 1)), lambda t: F.transform(
            F.sequence(F.lit(0), F.lit(dim0 - 1)), lambda c: F.get(flat, c * dim1 + t)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim0 - 1)), lambda t: F.slice(flat, t * dim1 + 1, dim1))


def ctc_decode(steps: Column, alphabet: Sequence[str], blank: int = 0, is_prob: bool = False) -> Column:
    """Greedy text of per-step scores: drop blanks and repeats, average the kept probabilities.

    Index 1..D is the alphabet; anything else is a space.
    """
    letters = F.array(*[F.lit(c) for c in alphabet])
    seen = F.transform(steps, lambda row: F.struct(
        argmax(row).alias("c"), (F.array_max(row).cast("double") if is_prob else softmax_at_max(row)).alias("p")))
    kept = bind(seen, lambda all_: F.filter(
        F.transform(all_, lambda s, i: s.withField("fresh", ~F.coalesce(F.get(all_, i - 1)["c"] == s["c"], F.lit(False)))),
        lambda s: s["fresh"] & (s["c"] != blank)))

    def letter(s: Column) -> Column:
        return F.when(s["c"].between(1, len(alphabet)), F.get(letters, s["c"] - 1)).otherwise(" ")
    return bind(kept, lambda k: F.struct(
        F.array_join(F.transform(k, letter), "").alias("text"),
        F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, s: a + s["p"]) / F.size(k)).otherwise(0.0).alias("score")))


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def simcc_decode(x: Column, y: Column, crop: Column, threshold: float = 0.0, product: bool = True) -> Column:
    """Keypoint from two axis-wise score arrays at half-pixel bins, mapped back by the crop struct."""
    vx, vy = F.array_max(x), F.array_max(y)
    score = sigmoid(vx) * sigmoid(vy) if product else sigmoid((vx + vy) / 2)
    px, py = argmax(x) / 2.0, argmax(y) / 2.0
    return F.struct((crop["ix"] * px + crop["itx"]).alias("x"), (crop["iy"] * py + crop["ity"]).alias("y"),
                    F.when(score < threshold, 0.0).otherwise(score).alias("score"))


def expected_bin(logits: Column) -> Column:
    """Softmax-weighted mean of the bin index (distribution focal box side)."""
    e = F.transform(logits, lambda v: F.exp(v.cast("double")))
    return bind(e, lambda w: F.aggregate(F.transform(w, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
                / F.aggregate(w, F.lit(0.0), lambda a, v: a + v))


def box_sides(logits: Column, bins: int = 16) -> Column:
    """Four expected sides from ``4 * bins`` logits."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: expected_bin(F.slice(logits, s * bins + 1, bins)))


def dequantise(q: Column, zero: int, scale: float) -> Column:
    return (q - zero) * F.lit(scale)


def quantise(v: Column, zero: int, scale: float) -> Column:
    """To int8 range, truncating toward zero."""
    return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), v / scale + zero)).cast("int")


def face_priors(spark: SparkSession, size: int = 320) -> DataFrame:
    """Anchor table ``anchor, cx, cy, pw`` in relative units: three strides, two sizes per cell."""
    layers = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(size // s).alias("grid"), F.lit(i).alias("layer"))
                       for i, s in enumerate(PRIOR_STEPS)])
    sizes = F.array(*[F.array(*[F.lit(v) for v in pair]) for pair in PRIOR_SIZES])
    starts = F.array(*[F.lit(sum(2 * (size // s) ** 2 for s in PRIOR_STEPS[:i])) for i in range(len(PRIOR_STEPS))])
    cells = spark.range(1).select(F.inline(layers))
    for name in ("row", "col"):
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    cells = cells.select("*", F.posexplode(F.get(sizes, F.col("layer"))).alias("m", "pw"))
    number = F.get(starts, F.col("layer")) + (F.col("row") * F.col("grid") + F.col("col")) * 2 + F.col("m")
    return cells.select(number.alias("anchor"), ((F.col("col") + 0.5) * F.col("step") / size).alias("cx"),
                        ((F.col("row") + 0.5) * F.col("step") / size).alias("cy"), (F.col("pw") / size).alias("pw"))


def decode_faces(heads: DataFrame, priors: DataFrame, size: int = 320) -> DataFrame:
    """Raw rows ``frame, anchor, loc, score, landm`` to pixel boxes and five landmarks."""
    j = heads.join(priors, "anchor")
    loc = F.col("loc")
    cx, cy = F.col("cx") + F.col("pw") * loc[0] * VAR_CENTRE, F.col("cy") + F.col("pw") * loc[1] * VAR_CENTRE
    w, h = F.col("pw") * F.exp(loc[2] * VAR_SIZE), F.col("pw") * F.exp(loc[3] * VAR_SIZE)
    marks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(
        ((F.col("cx") + F.col("pw") * F.get("landm", k * 2) * VAR_CENTRE) * size).alias("x"),
        ((F.col("cy") + F.col("pw") * F.get("landm", k * 2 + 1) * VAR_CENTRE) * size).alias("y")))
    return j.select("frame", F.col("anchor").alias("det_idx"), "score", ((cx - w / 2) * size).alias("left"),
                    ((cy - h / 2) * size).alias("top"), ((cx + w / 2) * size).alias("right"),
                    ((cy + h / 2) * size).alias("bottom"), marks.alias("landmarks"))


def rle_encode(mask: Column) -> Column:
    """Row-major run lengths of a flat 0/1 mask; the first run counts zeros."""
    bits = F.transform(mask, lambda v: (v > 0).cast("int"))
    n = F.size(mask)
    starts = bind(bits, lambda b: F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(b, i) != F.get(b, i - 1)))
    edges = F.concat(F.when(F.get(mask, F.lit(0)) > 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))),
                     F.when(n > 1, starts).otherwise(F.array().cast("array<int>")), F.array(n))
    return F.when(n > 0, bind(edges, lambda e: F.zip_with(
        F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, F.size(e) - 1), lambda a, b: a - b)))
