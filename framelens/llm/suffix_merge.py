"""Remove long repeated byte strings: merged Burrows-Wheeler transforms of candidate passages.

A byte goes if a string of ``span`` bytes that covers it starts anywhere else as well; or, with
``keep_first``, if such a string starts earlier as well, in order of ids, then of places.

1. Every text marks some of its ``gram``-byte grams: the least hash of each run of ``near``
   grams. Equal strings hold equal runs with equal marks, so a string with a run whose mark
   occurs once in the corpus is unique. Marks are counted over all texts.
2. Every string of ``span`` bytes without such a run belongs to the least gram among all its
   grams. Consecutive strings with equal anchors form a passage (mostly less than ``2 * span``
   bytes, longer in periodic texts). Equal strings have equal anchors, so passages are dealt out by anchor. Each string lies in one
   passage only. Passages leave the texts in chunks, cut where the hash of an anchor says so;
   equal chunks, then equal passages, are counted and kept once.
3. A task cuts its passages into shards and builds the transform of each over blocks of ``block``
   bytes. The transforms are merged by refining their interleave: each round deals the rows out
   by the block before them, which orders the rows by one more block, and notes where neighbours
   begin to differ. After ``span / block`` rounds, rows not yet told apart share ``span`` bytes.
   No suffix is sorted again. Blocks with equal hashes are compared byte by byte.
4. An anchor with more than ``WIDE`` different passages, or more than ``WIDE_BYTES`` bytes of them
   (long runs of periodic texts), would not fit one task; its strings are
   counted one by one instead, by 128-bit hashes, which splits any group.
5. The repeated intervals go back to the chunks, then to all their places, and are united per
   document. With ``keep_first`` a passage or chunk is whole repeated at all its places but the
   first; there only the strings go that some other passage holds earlier.

Null text counts as empty. Rows with equal id and text repeat each other; with ``keep_first`` they are one
place and keep the same bytes. Texts shorter than ``span`` bytes stay whole. Null ids are kept. Empty table: no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm import hashing as H
from framelens.session import drop_path, written


@dataclass(frozen=True)
class Lengths:
    """Bytes of a string, a gram and a block, and grams of a run; ``block`` divides ``span``."""

    span: int = 400
    gram: int = 64
    near: int = 200
    block: int = 50


DEFAULT = Lengths()
#: For passages of 50 words and more: the shortest of them have some 200 bytes.
WORDS_50 = Lengths(200, 32, 100, 25)
#: Bytes of passages merged together in a task, and the shards they are cut into.
BATCH_BYTES, SHARDS = 700_000, 4
#: Different passages of one anchor that are merged in one task.
WIDE = 2_000
#: Bytes of different passages of an anchor up to which they are merged in one task.
WIDE_BYTES = 4 << 20
#: Passages in a chunk, on average.
CHUNK = 8
_PLACE = np.uint64((1 << 28) - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width`` keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


class Grams:
    """Gram hashes of several texts, with marks and anchors; ``texts`` all have ``span`` bytes or more."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: Lengths = DEFAULT):
        self.data, self.starts, self.ends, self.lengths = data, starts[:-1], starts[1:] - 1, lengths
        self.hash = H.Rolling(data).windows(lengths.gram)
        place = np.arange(len(self.hash), dtype=np.uint64)
        self.keys = (self.hash & ~_PLACE) | place

    def _inside(self, values: np.ndarray, width: int) -> np.ndarray:
        """Mask of the runs of ``width`` grams that lie in one text."""
        edge = np.zeros(len(values) + 1, dtype=np.int8)
        edge[self.starts] += 1
        np.add.at(edge, np.minimum(self.ends - self.lengths.gram - width + 2, len(values)), -1)
        return np.cumsum(edge[:-1]).astype(bool)

    def marks(self) -> np.ndarray:
        """Places of the marked grams, ascending."""
        near = self.lengths.near
        least = _least(self.keys, near)
        chosen = (least & _PLACE).astype(np.int64)[self._inside(least, near)]
        return chosen[np.concatenate([[True], np.diff(chosen) != 0])] if len(chosen) else chosen

    def passages(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first string, last string, anchor hash, more than one anchor) of each passage.

        ``unique``: places of unique marks.
        """
        width = self.lengths.span - self.lengths.gram + 1
        least = _least(self.keys, width)
        anchor = (least & _PLACE).astype(np.int64)
        lone = np.zeros(len(self.hash), dtype=bool)
        lone[unique] = True
        near = _least(self.keys, self.lengths.near)
        count = np.concatenate([[0], np.cumsum(lone[(near & _PLACE).astype(np.int64)])])
        inner = width - self.lengths.near + 1  # runs of grams in a string: none of them may mark a unique gram
        fine = self._inside(least, width) & (count[inner:] == count[:-inner])[:len(least)]
        # a periodic text has one equal anchor after the other: its strings stay together
        of = self.hash[anchor]
        cut = np.concatenate([[True], (fine[1:] != fine[:-1]) | (of[1:] != of[:-1])]) if len(fine) else fine
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(fine)]]) - 1
        keep = fine[first] if len(first) else first.astype(bool)
        first, last = first[keep], last[keep]
        return first, last, of[first], anchor[first] != anchor[last]


def _grams(texts: list[bytes], lengths: Lengths) -> Iterator[tuple[np.ndarray, Grams]]:
    """Runs of texts of at least ``span`` bytes: their numbers and grams."""
    number = np.array([i for i, t in enumerate(texts) if len(t) >= lengths.span], dtype=np.int64)
    for first, end, data, starts in H.pieces([texts[i] for i in number]):
        yield number[first:end], Grams(data, starts, lengths)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _lists(owner: np.ndarray, count: int, values: np.ndarray) -> pa.Array:
    """One list per row; ``owner`` ascending."""
    offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def text_marks(rows: DataFrame, lengths: Lengths = DEFAULT) -> DataFrame:
    """(did, rid, h, p): hashes and places of the marks of each row of (did, rid, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            for number, grams in _grams(_bytes(batch.column(2)), lengths):
                at = grams.marks()
                of = H.owner(grams.starts, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(number)), batch.column(1).take(pa.array(number)),
                     _lists(of, len(number), grams.hash[at].view(np.int64)),
                     _lists(of, len(number), (at - grams.starts[of]).astype(np.int32))], names=["did", "rid", "h", "p"])

    return rows.mapInArrow(run, "did long, rid long, h array<long>, p array<int>")


def text_chunks(rows: DataFrame, lengths: Lengths = DEFAULT) -> DataFrame:
    """(did, rid, start, chunk) of rows (did, rid, text, seen); seen: places of repeated marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            texts, seen = _bytes(batch.column(2)), batch.column(3)
            for number, grams in _grams(texts, lengths):
                known = [np.asarray(seen[int(i)].values.to_numpy(), dtype=np.int64) + s
                         for i, s in zip(number, grams.starts)]
                unique = np.setdiff1d(grams.marks(), np.concatenate(known), assume_unique=True)
                first, last, anchor, _ = grams.passages(unique)
                cut = np.flatnonzero(np.concatenate([[True], (first[1:] != last[:-1] + 1)
                                                     | ((anchor[1:] >> np.uint64(40)) % np.uint64(CHUNK) == 0)])[:len(first)])
                first, last = first[cut], last[np.append(cut[1:], len(last)) - 1] if len(cut) else last
                of = H.owner(grams.starts, first)
                row, start = number[of], first - grams.starts[of]
                stop = last + lengths.span - grams.starts[of]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start),
                     pa.array([texts[r][a:b] for r, a, b in zip(row, start, stop)], pa.binary())],
                    names=["did", "rid", "start", "chunk"])

    return rows.mapInArrow(run, "did long, rid long, start long, chunk binary")


def chunk_passages(chunks: DataFrame, lengths: Lengths = DEFAULT) -> DataFrame:
    """(cid, n, start, anchor, many, passage) of rows (cid, n, chunk); many: it may repeat itself.

    A column ``first`` of the chunks comes along.
    """
    more = chunks.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            texts = _bytes(batch.column(2))
            for number, grams in _grams(texts, lengths):
                first, last, anchor, many = grams.passages(np.zeros(0, dtype=np.int64))
                of = H.owner(grams.starts, first)
                row, start = number[of], first - grams.starts[of]
                stop = last + lengths.span - grams.starts[of]
                own = lambda k: batch.column(k).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [own(0), own(1), pa.array(start), pa.array(anchor.view(np.int64)), pa.array(many),
                     pa.array([texts[r][a:b] for r, a, b in zip(row, start, stop)], pa.binary()), *(own(3 + k) for k in range(len(more)))],
                    names=["cid", "n", "start", "anchor", "many", "passage", *more])

    kinds = "".join(f", {c} {chunks.schema[c].dataType.simpleString()}" for c in more)
    return chunks.mapInArrow(run, "cid binary, n long, start long, anchor long, many boolean, passage binary" + kinds)


class Rows:
    """Suffixes of the passages over blocks: a row per place that has a whole block, and one per string end.

    The places of one remainder modulo ``block`` in a passage are one string. Block numbers begin at 1.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, block: int):
        ends = starts + size
        place = np.arange(len(data) - block + 1)
        of = np.searchsorted(starts, place, side="right") - 1
        self.place = place[place + block <= ends[of]]
        self.of = of[self.place]
        self.symbol = _symbols(data, self.place, block)
        n = len(self.place)
        row = np.full(len(data) + block + 1, -1, dtype=np.int64)
        row[self.place] = np.arange(n)
        after = row[self.place + block]
        same = (after >= 0) & (self.place + 2 * block <= ends[self.of])
        final = np.flatnonzero(~same)  # the last block of each string
        self.next = np.where(same, after, 0)
        self.next[final] = n + np.arange(len(final))
        self.final, self.rows = final, n
        self.string_of = np.concatenate([self.of, self.of[final]])


def _symbols(data: np.ndarray, place: np.ndarray, block: int) -> np.ndarray:
    """Numbers from 1 of the blocks at the places; equal numbers mean equal bytes."""
    used, first, number = np.unique(H.Rolling(data).windows(block)[place], return_index=True, return_inverse=True)
    for at in [*range(0, block - 7, 8), block - 8]:
        words = np.lib.stride_tricks.as_strided(data[at:].view(np.uint8), (len(data) - at - 7, 8), (1, 1))
        own = np.ascontiguousarray(words[place]).view(np.uint64).ravel()
        if (own != own[first][number]).any():  # unequal blocks with one hash: number the bytes themselves
            blocks = np.lib.stride_tricks.as_strided(data, (len(data) - block + 1, block), (1, 1))[place]
            return np.unique(np.ascontiguousarray(blocks).view(f"V{block}").ravel(), return_inverse=True)[1].ravel() + 1
    return number + 1


def shard_order(rows: Rows, chosen: np.ndarray, ends: np.ndarray, longest: int, block: int) -> np.ndarray:
    """Sorted order of one shard's rows (end rows first), by doubling the compared length."""
    total = rows.rows + len(rows.final)
    local = np.concatenate([ends, chosen])
    rank = np.zeros(total + 1, dtype=np.int64)
    rank[ends] = np.arange(len(ends))
    rank[chosen] = len(ends) + rows.symbol[chosen]
    step = np.concatenate([rows.next, np.full(len(rows.final) + 1, total)])
    rank[total] = -1
    span, width = 1, len(local) + int(rows.symbol.max(initial=0)) + 3
    while span * block < longest:
        key = (rank[local] + 1) * width + rank[step[local]] + 1
        rank[local] = np.unique(key, return_inverse=True)[1].ravel()
        step = step[step]
        span *= 2
    return local[np.argsort(rank[local], kind="stable")]


def repeated_strings(data: np.ndarray, starts: np.ndarray, size: np.ndarray, count: np.ndarray,
                     shards: int = SHARDS, lengths: Lengths = DEFAULT, order: np.ndarray | None = None) -> np.ndarray:
    """Mask over ``data`` of the places whose ``span`` bytes occur twice or more in the passages.

    ``starts`` and ``size``: the passages in ``data``; ``count``: how often the corpus has each.
    ``order``: numbers of the passages by their first place; then the mask leaves out the first place of each string.
    """
    span, block = lengths.span, lengths.block
    rows = Rows(data, starts, size, block)
    n = rows.rows
    before = np.zeros(n + len(rows.final), dtype=np.int64)
    before[rows.next] = rows.symbol
    shard = rows.string_of * shards // max(len(starts), 1)
    orders, transforms = [], []
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        orders.append(shard_order(rows, own[own < n], own[own >= n], int(size.max()), block))
        transforms.append(before[orders[-1]])
    # interleave of the sorted shards: string ends first, all else not yet told apart
    ends = [int((o >= n).sum()) for o in orders]
    head = np.repeat(np.arange(shards, dtype=np.int8), ends)
    z = np.concatenate([head, np.repeat(np.arange(shards, dtype=np.int8), [len(o) - e for o, e in zip(orders, ends)])])
    group = np.zeros(len(z), dtype=np.int64)
    lcp = np.full(len(z), -1, dtype=np.int16)
    for depth in range(span // block):
        symbol = np.empty(len(z), dtype=np.int64)
        for s in range(shards):
            symbol[z == s] = transforms[s]
        moved = np.flatnonzero(symbol > 0)
        moved = moved[np.argsort(symbol[moved], kind="stable")]
        z = np.concatenate([head, z[moved]])
        new = np.ones(len(z), dtype=bool)
        at, key, old = len(head), symbol[moved], group[moved]
        new[at + 1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        lcp[new & (lcp < 0)] = depth  # common blocks with the row above
        group = np.cumsum(new)
    place = np.full(len(z), -1, dtype=np.int64)
    for s in range(shards):
        place[z == s] = orders[s]
    real = place < n
    place, group = place[real], group[real]
    whole = rows.place[place] + span <= (starts + size)[rows.of[place]]
    place, group = place[whole], group[whole]
    times = np.bincount(group, count[rows.of[place]], minlength=int(group.max(initial=0)) + 1)
    mask = np.zeros(len(data), dtype=bool)
    mask[rows.place[place[times[group] > 1]]] = True
    if order is not None and len(place):
        by_first = np.lexsort([rows.place[place], order[rows.of[place]], group])
        lead = by_first[np.concatenate([[True], np.diff(group[by_first]) != 0])]
        mask[rows.place[place[lead]]] = False
    return mask


def cover(mask: np.ndarray, span: int) -> np.ndarray:
    """Mask of the bytes that lie in a string starting at a marked place."""
    edge = np.zeros(len(mask) + span + 1, dtype=np.int32)
    at = np.flatnonzero(mask)
    edge[at] += 1
    edge[at + span] -= 1
    return np.cumsum(edge)[:len(mask)] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _merged(batches: Iterator[pa.RecordBatch], lengths: Lengths = DEFAULT, keep_first: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, sid, n, passage, turn) by anchor and turn → (anchor, sid, spans); no anchor is divided between merges."""
    def emit(held):
        data, sizes = b"".join(h[3] for h in held), np.array([len(h[3]) for h in held], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        # equal strings have one anchor, so the order within an anchor is enough
        order = np.arange(len(held)) if keep_first else None
        mask = repeated_strings(np.frombuffer(data, np.uint8), starts, sizes, np.array([h[2] for h in held]),
                                lengths=lengths, order=order)
        out = [[], [], []]
        for h, s, k in zip(held, starts, sizes):
            if (keep_first or h[2] == 1) and mask[s:s + k].any():  # else repeated as a whole
                first, end = runs(cover(mask[s:s + k], lengths.span))
                out[0].append(h[0]), out[1].append(h[1])
                out[2].append([{"a": int(a), "b": int(b)} for a, b in zip(first, end)])
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
             pa.array(out[2], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["anchor", "sid", "spans"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:4])):
            if size >= BATCH_BYTES and row[0] != held[-1][0]:
                yield emit(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield emit(held)


def _strings(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, sid, n, passage) → (anchor, sid, n, w1, w2, at) for each string of ``span`` bytes."""
    for batch in H.slices(batches):
        for row in range(batch.num_rows):
            passage = batch.column(3)[row].as_py()
            digests = [hashlib.blake2b(passage[i:i + span], digest_size=16).digest() for i in range(len(passage) - span + 1)]
            w = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            one = lambda c: c.take(pa.array(np.full(len(w), row)))
            yield pa.RecordBatch.from_arrays(
                [one(batch.column(0)), one(batch.column(1)), one(batch.column(2)), pa.array(np.ascontiguousarray(w[:, 0])),
                 pa.array(np.ascontiguousarray(w[:, 1])), pa.array(np.arange(len(w)))],
                names=["anchor", "sid", "n", "w1", "w2", "at"])


def repeated_spans(rows: DataFrame, lengths: Lengths = DEFAULT, keep_first: bool = False) -> DataFrame:
    """(did, rid, spans), written, of the rows (did, rid, text) that hold repeated strings; spans not united.

    With ``keep_first`` the rows also hold ``turn``, and of equal strings the one with the least turn,
    then the least place, is not in the spans.
    """
    spark, paths = rows.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        paths.append(path)
        return table

    turn = ["turn"] if keep_first else []
    marks = kept(text_marks(rows.select("did", "rid", "text"), lengths), "marks")
    repeated = kept(marks.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("h"), "repeated-marks")
    places = marks.select("did", "rid", F.explode(F.arrays_zip("h", "p")).alias("m")).select("did", "rid", "m.h", "m.p")
    seen = kept(places.join(repeated, "h").groupBy("did", "rid").agg(F.collect_set("p").alias("seen")), "seen-marks")
    found = kept(text_chunks(rows.join(seen, ["did", "rid"]).select("did", "rid", "text", "seen"), lengths)
                 .withColumn("cid", F.unhex(F.md5("chunk"))), "chunks")
    of_row = found if not keep_first else found.join(
        rows.select("did", "rid", "turn").groupBy("did", "rid").agg(F.min("turn").alias("turn")), ["did", "rid"])
    where = F.struct(*turn, "did", "rid", "start")  # places in order; only compared with each other
    chunks = kept(of_row.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.first("chunk").alias("chunk"),
                                            *([F.min(where).alias("first")] if keep_first else [])), "different-chunks")
    inner = kept(chunk_passages(chunks.select("cid", "n", "chunk", *(["first"] if keep_first else [])), lengths)
                 .withColumn("sid", F.unhex(F.md5("passage"))), "passages")
    # the first place of a passage is in the first place of some chunk
    lead = F.min(F.struct(F.col("first").withField("start", F.col("first.start") + F.col("start")).alias("here"), "cid", "start")
                 ) if keep_first else F.lit(None).cast("int")
    different = kept(inner.groupBy("anchor", "sid").agg(
        F.sum("n").alias("n"), F.max("many").alias("many"), lead.alias("turn"), F.first("passage").alias("passage")),
        "different-passages")
    kinds = kept(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("many").alias("many"),
                                                 F.sum(F.length("passage")).alias("bytes"))
                 .where("kinds > 1 or many")
                 .select("anchor", ((F.col("kinds") > WIDE) | (F.col("bytes") > WIDE_BYTES)).alias("hot")), "anchors")
    shared = different.join(kinds, "anchor").select("anchor", "sid", "n", "passage", "turn", "hot")
    narrow = shared.where(~F.col("hot")).drop("hot")
    merged = (narrow.repartition("anchor").sortWithinPartitions("anchor", *turn).drop("turn")
              .mapInArrow(lambda batches: _merged(batches, lengths, keep_first),
                          "anchor long, sid binary, spans array<struct<a: long, b: long>>"))
    strings = kept(shared.where("hot").select("anchor", "sid", "n", "passage").mapInArrow(
        lambda batches: _strings(batches, lengths.span), "anchor long, sid binary, n long, w1 long, w2 long, at long"), "strings")
    if keep_first:
        turns = strings.join(shared.where("hot").select("anchor", "sid", "turn"), ["anchor", "sid"])
        lead = kept(turns.groupBy("w1", "w2").agg(F.min(F.struct("turn", "at")).alias("lead")), "leads")
        often = turns.join(lead, ["w1", "w2"]).where(F.struct("turn", "at") != F.col("lead"))
    else:
        twice = kept(strings.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "often")
        often = strings.where("n = 1").join(twice, ["w1", "w2"])
    wide = often.groupBy("anchor", "sid").agg(F.collect_list(F.struct(
        F.col("at").alias("a"), (F.col("at") + lengths.span).alias("b"))).alias("spans"))
    if keep_first:
        spans = kept(merged.union(wide), "spans")
        firsts = different.select("anchor", "sid", "turn.cid", "turn.start").join(spans, ["anchor", "sid"], "left").groupBy("cid").agg(
            F.collect_list(F.struct("start", F.coalesce("spans", F.array().cast("array<struct<a: bigint, b: bigint>>")).alias("spans")))
            .alias("firsts"))
        every = inner.groupBy("cid").agg(F.collect_list(F.struct("start", F.length("passage").alias("size"))).alias("every"))
        # at its first place a passage loses its own spans, at every other one all of it
        known = F.coalesce(F.col("firsts"), F.array().cast(firsts.schema["firsts"].dataType))
        shift = lambda start, s: F.struct((s["a"] + start).alias("a"), (s["b"] + start).alias("b"))
        own = F.flatten(F.transform(known, lambda f: F.transform(f["spans"], lambda s: shift(f["start"], s))))
        others = F.filter("every", lambda p: ~F.array_contains(F.transform(known, lambda f: f["start"]), p["start"]))
        whole = F.transform(others, lambda p: F.struct(p["start"].alias("a"), (p["start"] + p["size"]).alias("b")))
        lone = every.join(firsts, "cid", "left").select("cid", F.concat(own, whole).alias("spans"))
        of_chunk = kept(chunks.select("cid", "first", F.length("chunk").alias("size")).join(lone, "cid", "left"), "chunk-spans")
        met = of_row.select("did", "rid", "start", "cid", where.alias("here")).join(of_chunk, "cid")
        out = _moved(met.withColumn("spans", F.when(F.col("here") != F.col("first"), _whole(F.col("size")))
                                    .otherwise(F.col("spans"))).where("spans is not null"), "did", "rid")
    else:
        whole = different.where("n > 1").select("anchor", "sid", _all_of("passage").alias("spans"))
        spans = kept(whole.union(merged).union(wide), "spans")
        # a chunk that occurs twice is repeated as a whole
        lone = _moved(inner.where("n = 1").select("cid", "start", "anchor", "sid").join(spans, ["anchor", "sid"]), "cid")
        of_chunk = kept(chunks.where("n > 1").select("cid", _all_of("chunk").alias("spans")).union(lone), "chunk-spans")
        out = _moved(found.select("did", "rid", "start", "cid").join(of_chunk, "cid"), "did", "rid")
    out, _ = written(out, "text-spans")
    for path in paths:
        drop_path(spark, path)
    return out


def _whole(size):
    return F.array(F.struct(F.lit(0).cast("long").alias("a"), size.cast("long").alias("b")))


def _all_of(column: str):
    return _whole(F.length(column))


def _moved(places: DataFrame, *keys: str) -> DataFrame:
    """The spans of all rows of a key, each moved by the row's start."""
    moved = places.select(*keys, F.transform("spans", lambda s: F.struct(
        (s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"))).alias("spans"))
    return moved.groupBy(*keys).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, did, rid, text, turn): two rows share did and rid only if id and text are equal; turn: the id."""
    did = F.coalesce(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(0).cast("long"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text], F.col(f"`{text}`").isNull().alias("__null"))
                     .alias("row"), did.alias("did"),
                     F.xxhash64(t, F.col(f"`{key}`").cast("string")).alias("rid"), t.cast("binary").alias("text"),
                     F.col(f"`{key}`").alias("turn"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", decode: bool = False,
                 lengths: Lengths = DEFAULT, keep_first: bool = False) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): the other columns of each row, and its remaining bytes.

    ``decode``: kept as a string, without characters that were cut in two.
    """
    keyed = _keyed(df, key, text)
    spans = repeated_spans(keyed.drop("row"), lengths, keep_first)
    joined = keyed.join(spans, ["did", "rid"], "left").select("row", "text", "spans")
    kind, out = joined.schema["row"].dataType.simpleString(), "string" if decode else "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            kept, size, gone, number = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                for s in found or ():
                    edge[s["a"]] += 1
                    edge[s["b"]] -= 1
                first, end = runs(np.cumsum(edge[:-1]) > 0) if found else ((), ())
                stays = [text[a:b] for a, b in zip([0, *end], [*first, len(text)])]
                kept.append("".join(s.decode("utf-8", "ignore") for s in stays) if decode else b"".join(stays))
                size.append(len(text)), gone.append(sum(b - a for a, b in zip(first, end))), number.append(len(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string() if decode else pa.binary()),
                 *(pa.array(x, pa.int64()) for x in (size, gone, number))],
                names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, f"row {kind}, kept {out}, n_bytes long, n_removed long, n_spans long")


def removal_digest(df: DataFrame) -> DataFrame:
    return deduplicated(df.select("doc_id", "text")).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def strip_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars",
                  lengths: Lengths = WORDS_50) -> DataFrame:
    """``df`` with repeated strings cut out of its texts but for their first places; ``chars`` follows
    where a text changed. A row goes if all its words were cut out; texts without any word stay as they are."""
    out = deduplicated(df, key, text, decode=True, lengths=lengths, keep_first=True)
    emptied = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")

    def column(name: str):
        if name == text:
            # untouched nulls stay null
            return F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("own")).alias(name)
        own = F.col(f"row.`{name}`")
        if name == chars:
            own = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(own).cast(df.schema[name].dataType)
        return own.alias(name)

    return out.where(~emptied).withColumn("own", F.when(F.col("row.__null"), None).otherwise(F.col("kept"))).select(
        *[column(c) for c in df.columns])
