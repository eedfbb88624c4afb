"""Token alignment against plain walks over byte offsets, and coders against whole texts."""
import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from framelens.llm import token_alignment as A


@pytest.fixture(scope="module")
def coders():
    return A._coders(*A.default_tokenizers())


def plain_groups(a, b):
    """Cut at offsets that both have."""
    shared = sorted(set(a) & set(b))
    out, i, j = [], 0, 0
    for e in shared:
        i2, j2 = a.index(e) + 1, b.index(e) + 1
        out.append((i, i2, j, j2))
        i, j = i2, j2
    return out


def walked(a, b):
    x, y = A.common_ends(a, b)
    return list(zip([0, *(k + 1 for k in x)], [k + 1 for k in x], [0, *(k + 1 for k in y)], [k + 1 for k in y]))


def test_diagonal_walk_equals_shared_offsets():
    r = random.Random(2)
    for n in (1, 2, 5, 40, 300):
        for share in (0.1, 0.5, 0.9, 1.0):
            for _ in range(20):
                cut = lambda: sorted({n, *(x for x in range(1, n) if r.random() < share)})
                a = cut()
                b = a if share == 1.0 else sorted(set(cut()) | {x for x in a if r.random() < share})
                assert walked(a, b) == plain_groups(a, b)


TEXTS = [None, "", " ", "a", " lead", "tail ", "two  spaces", "\n\n x\t", "▁mark", "Ünï ﬁ é ß", "日本 𝔘nicode", "<s> <unk> <0x41> </s>",
         "<|endoftext|> a<|endoftext|>", " nbsp", "a­b", "12 345,678.90 can't we'll", "x" * 3000, "é" * 700, "the " * 500]


def test_cached_coders_equal_whole_texts(spark, coders):
    r = random.Random(5)
    alphabet = "ab cd  'sT.,!?0129\n\tÄéßø€–…<|>[]{}§¡¿ſ"
    texts = [t for t in TEXTS if t] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 80))) for _ in range(1500)]
    texts += [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if x["text"]]
    a, b = coders
    assert b.apart
    for t in texts:
        got, want = a.encode(" " + t), a.exact.encode(" " + t, add_special_tokens=False).ids
        assert got.ids.tolist() == want and got.ends.tolist() == list(accumulate(len(a.bytes[i]) for i in want))
        got, want = b.encode(t), b.exact.encode(t)
        whole = b"".join(b.bytes[i] for i in want) == (" " + t).encode()
        assert got.ids.tolist() == want and got.ends[-1] == len((" " + t).encode()) if whole else got is None


def expected(rows, coders):
    a, b = coders
    found, counts = [], Counter()
    for key, t in rows:
        ids_a = a.exact.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.exact.encode(t) if t else []
        byte_a, byte_b = [a.bytes[i] for i in ids_a], [b.bytes[i] for i in ids_b]
        if not t or b"".join(byte_a) != (" " + t).encode() or b"".join(byte_b) != (" " + t).encode():
            found.append((key, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[:k + 1])) for k in range(len(parts))]
        g = plain_groups(ends(byte_a), ends(byte_b)) if len(t) < 1500 else walked(ends(byte_a), ends(byte_b))
        found.append((key, ids_a, ids_b, g))
        counts.update((ids_a[i2 - 1], ids_b[j2 - 1]) for _, i2, _, j2 in g)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for key, x, y, g in found:
        pairs = [(x[i2 - 1], y[j2 - 1]) for _, i2, _, j2 in g]
        text = ";".join(",".join(map(str, x[i:i2])) + "|" + ",".join(map(str, y[j:j2])) for i, i2, j, j2 in g)
        out.append((key, len(x), len(y), len(g), len(g), sum(counts[p] == top[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out, counts, top


def test_query_against_plain_counts(spark, coders, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "a b c"), (None, None)] + [(100 + r[0], r[1][:1200]) for r in docs]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, n_a int").repartition(3)
    want, counts, top = expected(rows, coders)
    order = lambda x: sorted(x, key=str)
    got = order(tuple(x) for x in A.align_digest(df).collect())
    assert got == order(want) and A.align_digest(df.limit(0)).count() == 0
    assert A.align_digest(df).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    table = {(x["id_a"], x["id_b"]): (x["n"], x["best"]) for x in A.id_links(df).collect()}
    assert table == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_small_blocks_give_the_same_rows(spark, coders, monkeypatch):
    """Blocks of one row each: counts still meet over the whole corpus."""
    rows = [(i, "the cat sat. " * (i % 5) + "unbelievable") for i in range(30)] + [(40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = [(i, *A._figures(t, coders)) for i, t in rows]
    import pyarrow as pa
    one = A._block([(pa.scalar(h[0]), *h[1:]) for h in held], 7, [f"c{i}" for i in range(11)], pa.int64())
    assert one.num_rows == 31 and one.column(9)[0].as_py() == sorted(set().union(*(h[3].tolist() for h in held)))
    assert sorted(map(tuple, A.align_digest(df).collect())) == sorted(expected(rows, coders)[0])
    assert sorted(map(tuple, A.align_digest(df.repartition(31)).collect())) == sorted(expected(rows, coders)[0])


def test_groups_cover_the_text(spark, coders):
    df = spark.createDataFrame([(1, "Antidisestablishmentarianism, naïve café 42"), (2, None)], "id int, body string")
    rows = {r["id"]: r["groups"] for r in A.groups(df, "id", "body").collect()}
    a, b = coders
    assert rows[2] == []
    assert b"".join(a.bytes[i] for g in rows[1] for i in g["a"]) == " Antidisestablishmentarianism, naïve café 42".encode()
    at = 0
    for g in rows[1]:
        text = b"".join(a.bytes[i] for i in g["a"])
        assert text == b"".join(b.bytes[i] for i in g["b"])
        at += len(text)
        assert g["end"] == at


def test_texts_are_coded_in_few_calls(coders, monkeypatch):
    """A plain text takes one call of A's coder and one of B's, however many words it has."""
    calls = Counter()

    class Counted:
        def __init__(self, name, inner):
            self.name, self.inner = name, inner

        def __getattr__(self, method):
            def call(*args, **kwargs):
                calls[self.name] += 1
                return getattr(self.inner, method)(*args, **kwargs)
            return call

    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(n)) for n in (3, 200, 3000)]
    monkeypatch.setattr(coders[0], "ranks", Counted("a", coders[0].ranks))
    monkeypatch.setattr(coders[1], "exact", Counted("b", coders[1].exact))
    for t in texts:
        assert A.aligned_text(t, coders) is not None
    assert calls == {"a": len(texts), "b": len(texts)}


def test_stretches_equal_whole_texts(coders, monkeypatch):
    """Texts of several stretches: runs of spaces, words longer than a stretch, line ends at the cuts."""
    b, r = coders[1], random.Random(9)
    parts = ["a", "word", " ", "  ", "\n", "\t\n ", "x" * 50, "Zürich", "1,234", "." * 30, " " * 40]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    texts += ["x" * 300, " " * 300, "x " * 150, " x" * 150, "x" * 200 + " y" + " " * 100 + "z"]
    import re
    monkeypatch.setattr(b, "stretches", re.compile(b.stretches.pattern.replace(str(A.STRETCH), "12")))
    monkeypatch.setattr(A, "STRETCH", 12)
    for t in texts:
        want = b.exact.encode(t)
        got = b.encode(t)
        if b"".join(b.bytes[i] for i in want) == (" " + t).encode():
            assert got.ids.tolist() == want
        else:
            assert got is None


def test_group_text_is_written_with_all_widths():
    import numpy as np
    a, b = np.array([0, 9, 10, 50256]), np.array([99999, 7, 100])
    assert A.group_text(a, b, np.array([0, 3]), np.array([1, 2]), 100_000) == b"0|99999,7;9,10,50256|100"
    assert A.group_text(a[:1], b[:1], np.array([0]), np.array([0]), 100_000) == b"0|99999"
