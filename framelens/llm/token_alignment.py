"""Align the tokens of two tokenizers over the same bytes, and count which ids end together.

1. Both token sequences of a text become arrays of byte offsets at which tokens end. Diagonal run
   skipping walks them: at the current index shift, stretches of doubling length are compared
   whole, and jumped while they agree (one token against one); a stretch that disagrees is
   walked to its first unequal end. The irregular group there is settled
   locally, end by end, and leaves a new shift. Offsets where both end cut the tokens into groups.
2. A link is a pair of tokens that end together, the last ones of a group. Texts are taken in
   blocks of bounded size; a block writes each id pair once with its number of links, so that the
   pair counts of the corpus and their way back shuffle one row per block and pair, never one
   per link, and no frequent pair is a hot key.
3. The counts meet the texts again block by block.

Token bytes: A is byte-level; B writes a space as U+2581 and single bytes as <0xHH>, and puts a
space before the text, so A reads a space and the text. Texts that are null or empty, or whose token bytes do
not give a space and the text, have no tokens: zeros and ''. Plain texts take A's rank file, and B codes them in
stretches that end before a space; both give the same ids as the tokenizer files on the whole text. Null ids and repeated
rows are kept, each row on its own. Empty table: no rows. Very long texts: a block of their own, memory linear in the text.
Only key and text are read; other columns of any name are not looked at.
"""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from operator import ne
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import hashing as H
from framelens.llm.pattern_packing import _PLAIN
from framelens.session import written

#: Bytes of texts, and rows, of a block.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4_096
#: Characters of a stretch that B codes at once, about.
STRETCH = 4_096
#: Ends compared at once behind an irregular group; the number doubles while they agree.
FIRST_STEP = 16
_MARK = "▁"
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Coded(NamedTuple):
    """Ids of a text's tokens, and the byte offsets at which they end."""

    ids: np.ndarray
    ends: np.ndarray


class _Coder:
    """Codes whole texts."""

    bytes: list[bytes]

    def __init__(self) -> None:
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def coded(self, ids: list[int], want: bytes) -> Coded | None:
        """None if the tokens' bytes are not ``want``."""
        if b"".join([self.bytes[i] for i in ids]) != want:
            return None
        ids = np.array(ids, dtype=np.int64)
        return Coded(ids, np.cumsum(self.sizes[ids]))


class ByteCoder(_Coder):
    """Tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import base64
        import os

        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        letters = _byte_letters()
        tokens = [self.exact.id_to_token(i) for i in range(self.exact.get_vocab_size())]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        super().__init__()
        self.ranks = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> Coded | None:
        if self.ranks is None or not _PLAIN.fullmatch(text):
            return self.coded(self.exact.encode(text, add_special_tokens=False).ids, text.encode())
        return self.coded(self.ranks.encode_ordinary(text), text.encode())


class PieceCoder(_Coder):
    """Tokens of a sentence piece model, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece
        self.exact = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.exact.id_to_piece(i) for i in range(self.exact.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(n)) else n.replace(_MARK, " ").encode() for n in names]
        super().__init__()
        # no piece goes on behind a space: a text can then be cut before spaces
        self.apart = not any(re.search(f"[^{_MARK}]{_MARK}", n) for n in names)
        self.stretches = re.compile(f"(?s).{{1,{STRETCH}}}[^ ](?= |\\Z)|.+?[^ ](?= |\\Z)")

    def encode(self, text: str) -> Coded | None:
        if len(text) <= STRETCH or not self.apart or text[-1] == " " or not _PLAIN.fullmatch(text):
            return self.coded(self.exact.encode(text), (" " + text).encode())
        parts = self.exact.encode([p[1:] for p in self.stretches.findall(" " + text)], num_threads=1)
        return self.coded(list(chain.from_iterable(parts)), (" " + text).encode())


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _coders(a: str, b: str) -> tuple[ByteCoder, PieceCoder]:
    return ByteCoder(a), PieceCoder(b)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both have; both ascend and have the same last one."""
    # ends of one that the other has not; all others pair up in order
    only_a: list[int] = []
    only_b: list[int] = []
    i, j, n, step = 0, 0, len(a), FIRST_STEP
    while i < n:
        # jump along the diagonal
        run_a, run_b = a[i:i + step], b[j:j + step]
        if run_a == run_b:
            i, j, step = i + step, j + step, 2 * step
            continue
        agree = list(map(ne, run_a, run_b)).index(True)
        i, j, step = i + agree, j + agree, FIRST_STEP
        # an irregular group, and a new shift behind it
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                only_a.append(i)
                i += 1
                x = a[i]
            else:
                only_b.append(j)
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
    return np.delete(np.arange(n), only_a), np.delete(np.arange(len(b)), only_b)


@functools.lru_cache(maxsize=2)
def _signed(n: int) -> pa.Array:
    """``id,`` of the ids below ``n``, then ``id|``, then ``id;``."""
    return pa.array([f"{i}{sign}" for sign in ",|;" for i in range(n)], pa.large_string())


def group_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_ids: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids (below ``n_ids``) of every group, which end at the given places."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)  # behind the groups before
    at_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[at_a], ids[at_b] = a, b
    ids[at_a[last_a]] += n_ids
    ids[at_b[last_b]] += 2 * n_ids
    _, ends, text = _signed(n_ids).take(pa.array(ids)).buffers()
    return text.to_pybytes()[:np.frombuffer(ends, dtype=np.int64)[len(ids)] - 1]


def aligned_text(text: str | None, coders: tuple[ByteCoder, PieceCoder]):
    """(A's tokens, B's tokens, last places in A and in B of each group) of a text; None if it has no tokens."""
    if not text:
        return None
    a, b = coders[0].encode(" " + text), coders[1].encode(text)
    if a is None or b is None:
        return None
    return a, b, *common_ends(a.ends.tolist(), b.ends.tolist())


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(key, groups) of each row: the ids of A and B in each group, and the byte offset at its end."""
    paths = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(*paths)
        for batch in H.slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                found, own = aligned_text(t, coders), []
                if found:
                    (a, ends), (b, _), last_a, last_b = found
                    own = [{"a": x, "b": y, "end": e} for x, y, e in zip(
                        np.split(a, last_a[:-1] + 1), np.split(b, last_b[:-1] + 1), ends[last_a].tolist())]
                out.append(own)
            ids = pa.list_(pa.int32())
            kind = pa.list_(pa.struct([("a", ids), ("b", ids), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[key, "groups"])

    taken = df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return taken.mapInArrow(run, T.StructType([taken.schema[0], *T.StructType.fromDDL(
        "groups array<struct<a: array<int>, b: array<int>, end: bigint>>").fields]))


def block_links(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """One row per text: key, figures, digest of its groups, its block, and its id pairs by their place in the
    block with their times. One row of each block also holds the block's pairs and times. To be written before use.
    """
    paths = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, block = _coders(*paths), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in H.slices(batches):
            for i, t in enumerate(batch.column(1).to_pylist()):
                held.append((batch.column(0)[i], *_figures(t, coders)))
                size += len(t or "")
                if size >= BLOCK_BYTES or len(held) >= BLOCK_ROWS:
                    yield _block(held, block, names, kind)
                    held, size, block = [], 0, block + 1
        if held:
            yield _block(held, block, names, kind)

    taken = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fields = [taken.schema["doc_id"], *T.StructType.fromDDL(
        ", ".join(f"{c} bigint" for c in _FIGURES) + ", groups_sha256 string, block bigint, place array<int>, "
        "times array<int>, pairs array<bigint>, totals array<bigint>").fields]
    names = [f.name for f in fields]
    kind = _arrow_type(taken.schema["doc_id"].dataType)
    return taken.mapInArrow(run, T.StructType(fields))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _figures(text: str | None, coders) -> tuple[tuple[int, ...], str, np.ndarray, np.ndarray]:
    found = aligned_text(text, coders)
    if found is None:
        return (0,) * len(_FIGURES), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, last_a, last_b = found
    pairs, times = np.unique(a.ids[last_a] << 32 | b.ids[last_b], return_counts=True)
    digest = hashlib.sha256(group_text(a.ids, b.ids, last_a, last_b, max(len(c.bytes) for c in coders))).hexdigest()
    return (len(a.ids), len(b.ids), len(last_a), len(last_a)), digest, pairs, times


def _block(held: list, block: int, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    sizes = [len(h[3]) for h in held]
    pairs, place = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
    times = np.concatenate([h[4] for h in held])
    totals = np.bincount(place.ravel(), times, minlength=len(pairs)).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    first = [pa.array([x.tolist()] + [None] * (len(held) - 1), pa.list_(pa.int64())) for x in (pairs, totals)]
    return pa.RecordBatch.from_arrays(
        [pa.array([h[0].as_py() for h in held], kind), *(pa.array([h[1][k] for h in held], pa.int64()) for k in range(len(_FIGURES))),
         pa.array([h[2] for h in held], pa.string()), pa.array([block] * len(held), pa.int64()),
         pa.ListArray.from_arrays(offsets, pa.array(place.ravel().astype(np.int32))),
         pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))), *first], names=names)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of a written table of ``block_links``: links of each id pair in the corpus; best: no
    other id of A ends with that id of B more often."""
    blocks = links.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "totals")).alias("p"))
    counts = blocks.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("n"))
    # an id of B has no more pairs than A has ids
    top = F.max("n").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit(2 ** 32 - 1))))
    return counts.select("pair", "n", (F.col("n") == top).alias("best"))


def id_links(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(id_a, id_b, n, best): how often two ids end together, a dictionary between the vocabularies."""
    links, _ = written(block_links(df, key, text, tokenizers), "links")
    return pair_counts(links).select(F.shiftright("pair", 32).cast("int").alias("id_a"), F.col("pair").bitwiseAND(
        F.lit(2 ** 32 - 1)).cast("int").alias("id_b"), "n", "best")


def align_digest(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    links, _ = written(block_links(df, key, text, tokenizers), "links")
    counts, _ = written(pair_counts(links), "pair-counts")
    blocks = links.where("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    known = blocks.join(counts, "pair").select("of", "at", "n", "best")
    texts = links.drop("pairs", "totals")
    out = T.StructType([links.schema["doc_id"], *T.StructType.fromDDL(
        ", ".join(f"{c} bigint" for c in (*_FIGURES, "n_best", "count_sum")) + ", groups_sha256 string").fields])

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["at"].to_numpy())
        n, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order]
        good, total = [], []
        for place, times in zip(rows["place"], rows["times"]):
            at = np.asarray(place.values.to_numpy(), dtype=np.int64)
            k = np.asarray(times.values.to_numpy(), dtype=np.int64)
            good.append(int(k[best[at].astype(bool)].sum()) if len(at) else 0)
            total.append(int((k * n[at]).sum()) if len(at) else 0)
        return pa.table([rows["doc_id"], *(rows[c] for c in _FIGURES), pa.array(good, pa.int64()), pa.array(total, pa.int64()),
                         rows["groups_sha256"]], names=out.names)

    # a group is one block, of bounded size
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, out)
