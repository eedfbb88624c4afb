"""Patterns against a plain use of their regular expressions; message passing against enumeration."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from framelens.llm import skip_chain_pii as S
from framelens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(2 * c, 10)) if k % 2 else c for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [None, "", "@", "a@b", "a@b.c_d@e.f", "x@y.zz.", "é.a@b-c.de", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111",
         "4111-1111-1111-1112", "+1 (523) 555-1055", "+1234567890 12.13.14.15", "+1 2 3", "++1234567890", "a@@b.c", "p%+q@b.co@d.ef",
         "1" * 5000, "a" * 5000 + "@b.c", "@" * 200, "+1" * 200, ("mail a.b@c.de now " * 300)]


def test_patterns_equal_plain_regex():
    r = random.Random(3)
    texts = [t for t in TEXTS if t]
    texts += ["".join(r.choice(c) for _ in range(r.randrange(1, 60))) for c in ("a1@.-_ ", "12. 5+", "0123456789 -", "+1() .-45", "é1@a.b") for _ in range(400)]
    for t in texts:
        assert S.base_spans(t) == plain_base(t), t


def test_cards_of_every_length_pass_luhn():
    for n in range(12, 22):
        body = "7" * (n - 1)
        for c in "0123456789":
            assert S.base_spans(body + c) == plain_base(body + c)


def exact(unary, edges, model, known):
    n = len(unary)
    p = np.zeros((n, S.LABELS))
    for y in itertools.product(range(S.LABELS), repeat=n):
        if any(k and k != v for k, v in zip(known, y)):
            continue
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(model["edge"][k][y[i], y[j]] for i, j, k in edges))
        for i in range(n):
            p[i, y[i]] += w
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("loop", [False, True])
def test_message_passing_equals_enumeration(loop):
    """Exact on trees; close to it on a loop closed by a skip edge."""
    r = np.random.default_rng(1)
    model = S.empty_model()
    model["unary"] = r.normal(size=model["unary"].shape)
    model["edge"] = r.normal(size=model["edge"].shape) * (0.3 if loop else 1)
    features = [np.array([i, 50 + i], dtype=np.int32) for i in range(5)]
    edges = [(0, 1, S.CHAIN), (1, 2, S.CHAIN), (1, 4, S.SAME), (2, 3, S.SIMILAR)] + ([(0, 3, S.SAME)] if loop else [])
    known = np.array([0, 0, 0, 2, 0])
    unary = np.array([model["unary"][f].sum(0) for f in features])
    got = S.marginals(model, features, known, np.array(edges), rounds=60)
    assert np.abs(got - exact(unary, edges, model, known)).max() < (0.02 if loop else 1e-6)
    assert got[3, 2] > 0.999


def test_skip_edges_join_distant_words():
    f = S.Field("call 555-1055 or x. " + "word " * 200 + "again 5551055 and tel 1-555-1055, x1y x1y", [])
    kinds = {(f.start[i], f.start[j], k) for i, j, k in f.edges}
    at = [f.start[i] for i in range(3)]
    assert (at[0], at[1], S.SAME) in kinds and (at[1], at[2], S.SIMILAR) in kinds
    assert not any(k != S.CHAIN for i, j, k in f.edges if i >= 3)  # short words have no skip edges
    many = S.Field("id 1234567 " * 500, [])
    assert len(many.edges) == 499


@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_labels_spread_along_skip_edges(model):
    """A number without its + and country, far from the whole one, is found; plain numbers are not."""
    noise = " ".join(["the level was low and"] * 30)
    text = f"Tel +1 (523) 555-1055 is right. {noise} so 523 555-1055 again, {noise} in 1984 we had 12 of 300 and v2.0 b4"
    base = S.base_spans(text)
    spans = S.spans_of([text, noise + " 1984 and 12 of 300, v2.0"], model)
    extra = [text[a:b] for a, k, b, own in spans[0] if not own]
    assert [s[:3] for s in spans[0] if s[3]] == base
    assert any("555-1055" in x for x in extra) and all("555-1055" in x for x in extra)
    assert spans[1] == []


def test_hidden_spans_are_recovered(spark, model):
    """Base spans hidden from the field: recall by the learnt weights alone; texts without any stay clean."""
    found = hidden = wrong = clean = 0
    for r in spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet").collect():
        base = S.base_spans(r["text"] or "")
        field = S.Field(r["text"] or "", [])
        if not len(field.label):
            continue
        got = S.added_spans(field, [], S.marginals(model, field.features, field.label, np.array(field.edges, dtype=np.int64).reshape(-1, 3)))
        hidden += len(base)
        found += sum(any(g[1] == k and g[0] < b and g[2] > a for g in got) for a, k, b in base)
        clean += not base
        wrong += bool(got and not base)
    assert hidden > 30 and found >= 0.9 * hidden and wrong <= 0.02 * clean


def digest(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_base_columns(spark):
    rows = [(i, t, "mine", 1) for i, t in enumerate(TEXTS)] + [(5, "x@y.zz.", None, None), (None, "+1 (523) 555-1055", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int").repartition(3)
    got = S.span_digest(df).collect()
    want = []
    for d, t, *_ in rows:
        b = plain_base(t or "")
        want.append((d, *(sum(s[1] == k for s in b) for k in range(4)), hashlib.sha256(digest(b).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        t = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        assert set(digest(plain_base(t)).split(",")) <= set(r["spans"].split(","))
    assert S.span_digest(df.limit(0)).count() == 0
    out = S.personal_data(df, S.empty_model())
    assert out.columns == ["doc_id", "text", "n_email", "spans"] and out.count() == len(rows)


def test_whole_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_skip_chain_pii"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs:
        b = plain_base(t or "")
        assert got[d]["base_sha256"] == hashlib.sha256(digest(b).encode()).hexdigest()
        assert got[d]["n_phone"] == sum(s[1] == 3 for s in b)
