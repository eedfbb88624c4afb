"""Personal data by fixed patterns, extended by a skip-chain conditional random field.

1. Patterns find e-mail addresses, IP addresses, card and phone numbers. These base spans stay as they are.
2. The words of a text that hold a digit or ``@`` are the nodes of its field, with the labels none, email, ip,
   card, phone. Chain edges join nodes that are neighbouring words. Skip edges join a node to the last
   one before it with the same letters and digits, or with the same last SUFFIX digits or the same name
   before its ``@``, however far away: repeated and similar words share a potential.
3. Weights of shapes, neighbours and edges are learnt by pseudo-likelihood from the base spans of a
   bounded sample of texts (SAMPLE_TEXTS texts, of each WINDOW nodes in a row from a hashed place on).
4. In every text, nodes under base spans are fixed and ROUNDS rounds of loopy message passing spread
   their labels along chain and skip edges. Nodes with a label of probability SURE or more that no
   base span touches become added spans; neighbouring words with one label become one span.

The edges of a text grow with its nodes, as each node looks back to one earlier node per key. A text
is one row in one task, whatever its length. Null and empty texts: no spans. Null ids and
repeated rows are kept, each row on its own; rows without id teach nothing. Empty table: no rows. Columns named spans are
replaced; all others stay. A sample without base spans: nothing is added.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import hashing as H
from framelens.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
#: Bound of the sample: texts, and nodes in a row of each.
SAMPLE_TEXTS, WINDOW = 20_000, 64
WIDTH = 1 << 12
ROUNDS, DAMPING, SURE = 12, 0.3, 0.9
#: Last digits that make two numbers similar; least letters and digits of a word with skip edges.
SUFFIX, LEAST = 7, 5
CHAIN, SAME, SIMILAR = range(3)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The name before an @ is as long as it can be; it starts anew after the last address."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, ascending; kinds count from 0 as in KINDS."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _KEY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_SHAPE = [(re.compile(r"[a-z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\x00-\x7f]+"), "u")]


def _shape(word: str) -> str:
    """Digits as 9 (up to four in a row), letters as one a or A; signs stay."""
    for pattern, to in _SHAPE:
        word = pattern.sub(to, word)
    return re.sub(r"9{5,}", "99999", re.sub(r"[0-9]", "9", word))[:40]


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode()) % WIDTH


class Field:
    """Nodes and edges of one text: word places, features, base labels (0: not under a base span)."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.start, self.end, self.word = _key_words(text)
        n = len(self.start)
        self.label = np.zeros(n, dtype=np.int64)
        for a, kind, b in reversed(base):
            lo, hi = np.searchsorted(self.end, a, side="right"), np.searchsorted(self.start, b, side="left")
            self.label[lo:hi] = kind + 1
        cores = [text[a:b] for a, b in zip(self.start, self.end)]
        shapes = [_shape(c) for c in cores]
        near = np.diff(self.word) == 1
        self.features = [self._features(text, i, cores, shapes, near) for i in range(n)]
        self.edges = [(i, i + 1, CHAIN) for i in np.flatnonzero(near).tolist()]
        last: dict[tuple, int] = {}
        for i, core in enumerate(cores):
            joined = set()
            for kind, key in _keys(core):
                j = last.get((kind, key))
                if j is not None and j not in joined:
                    self.edges.append((j, i, kind))
                    joined.add(j)
                last[kind, key] = i

    def _features(self, text, i, cores, shapes, near) -> np.ndarray:
        core, shape = cores[i], shapes[i]
        before = shapes[i - 1] if i and near[i - 1] else ""
        after = shapes[i + 1] if i < len(near) and near[i] else ""
        digits = sum(c.isdigit() for c in core) if len(core) < 100 else 100
        head = text[max(0, self.start[i] - 24):self.start[i]].split()
        names = ["1", "s=" + shape, "d=%d" % min(digits, 20), "b=" + before, "f=" + after, "bs=" + before + "|" + shape,
                 "sf=" + shape + "|" + after, "w=" + (head[-1].lower()[-12:] if head else ""), "@" if "@" in core else "no@",
                 "+" if core[:1] == "+" else "no+"]
        if shape.count(".") == 3 and _IP.fullmatch(core):
            names.append("ip%d" % all(len(p) < 4 and int(p) <= 255 for p in core.split(".")))
        if 14 <= digits <= 19:
            names.append("luhn%d" % luhn(_NOT_DIGIT.sub("", core)))
        return np.array([_bucket(x) for x in names], dtype=np.int32)


def _key_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number) of the words with a digit or @, without the signs around them."""
    if not _KEY.search(text):
        return (np.zeros(0, dtype=np.int64),) * 3
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    space = np.concatenate([[True], (code == 32) | (code - np.uint32(9) <= 4), [True]])
    edge = np.diff(space.view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    seen = np.concatenate([[0], np.cumsum((code - np.uint32(48) <= 9) | (code == 64))])
    number = np.flatnonzero(seen[end] > seen[start])
    start, end = start[number], end[number]
    inner = code - np.uint32(48) <= 9
    inner |= (code | 32) - np.uint32(97) <= 25
    inner |= (code > 127) | (code == 64)
    head = np.flatnonzero(inner | (code == 43))  # + may lead
    tail = np.flatnonzero(inner)
    return head[np.searchsorted(head, start)], tail[np.searchsorted(tail, end) - 1] + 1, number


def _keys(core: str) -> Iterator[tuple[int, str]]:
    plain = "".join(c for c in core.lower() if c.isalnum())
    if len(plain) >= LEAST:
        yield SAME, plain
    digits = _NOT_DIGIT.sub("", core)
    if len(digits) >= SUFFIX:
        yield SIMILAR, digits[-SUFFIX:]
    name, at, _ = core.lower().partition("@")
    if at and len(name) >= LEAST:
        yield SIMILAR, name


def empty_model() -> dict[str, np.ndarray]:
    """Every node has no label."""
    unary = np.zeros((WIDTH, LABELS))
    unary[_bucket("1"), 0] = 8
    return {"unary": unary, "edge": np.zeros((3, LABELS, LABELS))}


def fit(rows: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.15,
        decay: float = 2e-5) -> dict[str, np.ndarray]:
    """Weights that maximise the pseudo-likelihood; ``rows``: features, labels and (n, 3) edges of each window."""
    model = empty_model()
    if not any(len(y) and y.any() for _, y, _ in rows):
        return model
    sizes = np.array([len(y) for _, y, _ in rows])
    base = np.cumsum(sizes) - sizes
    y = np.concatenate([y for _, y, _ in rows])
    feats = [f for fs, _, _ in rows for f in fs]
    of = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    feat = np.concatenate(feats).astype(np.int64)
    edges = np.concatenate([e + [b, b, 0] for (_, _, e), b in zip(rows, base) if len(e)] or [np.zeros((0, 3), np.int64)])
    by_kind = [edges[edges[:, 2] == k] for k in range(3)]
    hot = np.eye(LABELS)[y]
    model["unary"][_bucket("1"), 0] = 1
    params = [model["unary"], model["edge"]]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        score = np.stack([np.bincount(of, params[0][feat, k], len(y)) for k in range(LABELS)], axis=1)
        for k, e in enumerate(by_kind):
            np.add.at(score, e[:, 0], params[1][k].T[y[e[:, 1]]])
            np.add.at(score, e[:, 1], params[1][k][y[e[:, 0]]])
        p = np.exp(score - score.max(1, keepdims=True))
        miss = hot - p / p.sum(1, keepdims=True)
        slope = [np.stack([np.bincount(feat, miss[of, k], WIDTH) for k in range(LABELS)], axis=1), np.zeros_like(params[1])]
        for k, e in enumerate(by_kind):
            slope[1][k] = miss[e[:, 0]].T @ hot[e[:, 1]] + hot[e[:, 0]].T @ miss[e[:, 1]]
            if k != CHAIN:
                slope[1][k] = (slope[1][k] + slope[1][k].T) / 2
        for i, q in enumerate(params):
            g = slope[i] / len(y) - decay * q
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            q += rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.99 ** t)) + 1e-6)
    return model


def marginals(model: dict[str, np.ndarray], features: list[np.ndarray], known: np.ndarray, edges: np.ndarray,
              rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the labels of each node after loopy message passing; ``known``: fixed labels, 0 for free nodes."""
    n = len(features)
    of = np.repeat(np.arange(n), [len(f) for f in features])
    feat = np.concatenate(features) if n else np.zeros(0, dtype=np.int64)
    unary = np.stack([np.bincount(of, model["unary"][feat, k], n) for k in range(LABELS)], axis=1)
    fixed = np.flatnonzero(known)
    unary[fixed] = -60
    unary[fixed, known[fixed]] = 0
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    both = np.concatenate([model["edge"][edges[:, 2]], model["edge"][edges[:, 2]].transpose(0, 2, 1)])
    message = np.zeros((len(source), LABELS))

    def belief() -> np.ndarray:
        return unary + np.stack([np.bincount(target, message[:, k], n) for k in range(LABELS)], axis=1)

    for _ in range(rounds if len(edges) else 0):
        out = (belief()[source] - message[back])[:, :, None] + both
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    b = belief()
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(field: Field, base: list[tuple[int, int, int]], chance: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the words that the field labels beyond the base spans."""
    best = chance.argmax(1)
    sure = (best > 0) & (chance[np.arange(len(best)), best] >= SURE) & (field.label == 0)
    out: list[tuple[int, int, int]] = []
    last = None
    for i in np.flatnonzero(sure).tolist():
        kind = int(best[i]) - 1
        if last is not None and last == i - 1 and field.word[i] == field.word[last] + 1 and out[-1][1] == kind:
            out[-1] = (out[-1][0], kind, int(field.end[i]))
        else:
            out.append((int(field.start[i]), kind, int(field.end[i])))
        last = i
    return out


def spans_of(texts: list[str], model: dict[str, np.ndarray]) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of each text, by start, then kind."""
    found = [base_spans(t) for t in texts]
    fields = [Field(t, b) for t, b in zip(texts, found)]
    sizes = [len(f.label) for f in fields]
    out = [[(*s, True) for s in b] for b in found]
    if not any(sizes):
        return out
    base = np.cumsum(sizes) - sizes
    edges = [np.array(f.edges, dtype=np.int64).reshape(-1, 3) + [b, b, 0] for f, b in zip(fields, base)]
    chance = marginals(model, [x for f in fields for x in f.features], np.concatenate([f.label for f in fields]), np.concatenate(edges))
    for k, (field, at, n) in enumerate(zip(fields, base, sizes)):
        out[k] = sorted(out[k] + [(*s, False) for s in added_spans(field, found[k], chance[at:at + n])])
    return out


def train(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE_TEXTS) -> dict[str, np.ndarray]:
    """Fit on a sample of about ``limit`` texts; the executors make features, labels and edges."""
    texts = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                field = Field(t or "", base_spans(t or ""))
                if n := len(field.label):
                    lo = zlib.crc32(name.encode()) % max(1, n - WINDOW + 1)
                    own = field.features[lo:lo + WINDOW]
                    edges = np.array([(i - lo, j - lo, k) for i, j, k in field.edges if i >= lo and j < lo + WINDOW],
                                     dtype=np.int32).reshape(-1, 3)
                    for c, v in zip(cols, (name, np.concatenate(own), np.array([len(f) for f in own], dtype=np.int32),
                                           field.label[lo:lo + WINDOW].astype(np.int32), edges)):
                        c.append(v if c is cols[0] else v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                             names=["id", "f", "n", "y", "e"])

    # bounded by limit x WINDOW nodes, whatever the texts
    found = bounded_sample(texts, ["id"], limit, "crf-1").mapInArrow(run, "id string, f binary, n binary, y binary, e binary").collect()
    found.sort(key=lambda r: (r["id"], r["f"], r["e"]))
    read = lambda b: np.frombuffer(b, dtype=np.int32)
    return fit([(np.split(read(r["f"]), np.cumsum(read(r["n"]))[:-1]), read(r["y"]).astype(np.int64),
                 read(r["e"]).reshape(-1, 3).astype(np.int64)) for r in found])


def personal_data(df: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``spans``: kind, start and end in code points, base (found by a pattern) or added."""
    kept = df.drop("spans")
    at = kept.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            found = spans_of([t or "" for t in batch.column(at).to_pylist()], shared.value)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(_SPAN))], names=[*batch.schema.names, "spans"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *T.StructType.fromDDL(
        "spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>").fields]))


def span_digest(df: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans as text."""
    found = personal_data(df.select("doc_id", "text"), train(df))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
