"""Periodic runs against a plain search of all stretches."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from framelens.llm import periodic_runs as P


def plain_runs(w):
    """Every stretch with a period, by comparing all words at all lags."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i:i + length]
                if not any(all(s[k] == s[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_equal_plain_search(letters):
    r = random.Random(letters)
    for _ in range(150):
        w = []
        while len(w) < r.randrange(1, 90):
            unit = [str(r.randrange(letters)).encode() for _ in range(r.randint(1, 7))]
            w += unit * r.choice([1, 1, 2, 4, 5, 9]) + unit[:r.randrange(len(unit) + 1)]
            if r.random() < 0.3:
                w.append(b"rare%d" % r.randrange(10 ** 6))
        assert P.runs_of([w]) == [plain_runs(w)]


def test_texts_are_kept_apart():
    one, two = [b"a", b"b"] * 3, [b"a", b"b"] * 3
    assert P.runs_of([one, two, [], one + two]) == [[], [], [], [(0, 12, 2)]]


def test_splitting_recurses():
    """Each split makes the next word rare in its part; nothing is left but the run."""
    words = np.array([0, 1, 9, 0, 1, 0, 1, 8, 0, 2, 2, 2, 2, 2, 2, 1, 2], dtype=np.int64)
    assert P.frequent_segments(words, np.array([0])) == [(9, 15)]
    assert P.frequent_segments(words[:0], np.zeros(0, np.int64)) == []


def test_long_texts_are_not_quadratic():
    assert P.runs_of([[b"x"] * 60_000]) == [[(0, 60_000, 1)]]
    unit = [b"%d" % i for i in range(7_000)]
    assert P.runs_of([unit * 5]) == [[(0, 35_000, 7_000)]]
    r = random.Random(0)
    noise = [r.choice([b"a", b"b"]) for _ in range(20_000)]
    assert all(n >= max(6, 4 * q) for _, n, q in P.runs_of([noise])[0])


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_plain_search(spark):
    r = random.Random(4)
    texts = [None, "", " \t\n\x0b ", "a " * 6, "a " * 5, "ab ab\tab\nab ab ab", "Ünï é " * 20, "x y " * 8, "a a a a a a b a a a a a a"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(1, 60))) for _ in range(60)]
    texts += [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(1, 200))) for _ in range(60)]
    rows = [(i, t, "mine", 5) for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "a b " * 9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, length int").repartition(3)
    got = sorted((tuple(x) for x in P.run_digest(df).collect()), key=str)
    assert got == sorted(((d, *expected(d, t)) for d, t, *_ in rows), key=str)
    assert any(x[0] is not None and x[1] for x in got) and P.run_digest(df.limit(0)).count() == 0


def test_operator_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "go on go on go on go on end", "mine", 7), (2, None, None, None)],
                               "id int, body string, collapsed string, n int")
    out = P.periodic_runs(df, "body")
    assert out.columns == ["id", "body", "n", "runs", "collapsed"]
    first, second = out.orderBy("id").collect()
    assert first["runs"] == [(0, 8, 2)] and first["collapsed"] == "go on end" and first["n"] == 7
    assert second["runs"] == [] and second["collapsed"] == ""
