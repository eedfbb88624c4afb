"""Corpus operators against brute force on small tables, and their edge cases."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framelens.llm import (components, language_id, multi_index, pattern_packing, poisson_mix, quality_fm,
                           quality_rules, simhash_gray, suffix_merge, toxicity, virtual_slots)
from framelens.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, `length` int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty, long and repeated texts, repeated rows, clashing extra columns."""
    base = words(1, 300)
    texts = [None, "", "   \n\t ", base, base, base + " tail", words(2, 40), "Ünï " * 30, "x", words(3, 9000),
             words(4, 100) + base[200:900] + words(5, 80), "ab " * 700, base[50:800], "<|endoftext|> a", "a\nb\na\nb\n\n"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, i, "mine", 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s1", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(15)] + [(3, None, None), (None, 1, 1), (4, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == ""


def test_rules_on_edge_cases(docs, empty):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count() and quality_rules.judge(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["n_words"], by[0]["base_failed"], by[0]["kept"]) == (0, True, False)
    assert by[14]["n_dup_lines"] == 2 and by[13]["n_symbols"] == 4  # <||>
    assert by[11]["n_words"] == 700 and by[11]["n_repeat_words"] == 700 and by[11]["base_failed"]
    assert by[3]["n_repeat_words"] == 0 and by[3]["word_chars"] == len(words(1, 300).replace(" ", ""))


def test_mixing_counts(docs, empty, spark):
    out = poisson_mix.mix(docs, weights={"s0": 3.0, "s1": 1.0}, total=1e6)
    assert poisson_mix.mix(empty).count() == 0
    assert set(docs.columns) < set(out.columns)
    got = out.groupBy("source").count().collect()
    assert {r["source"] for r in got} <= {"s0", "s1"}
    many = spark.range(20000).selectExpr("id as doc_id", "'abcd' as text", "if(id % 2 = 0, 'a', 'b') as source")
    n = {r["source"]: r["count"] for r in poisson_mix.mix(many, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 15000) < 500 and abs(n["b"] - 5000) < 300


def test_slots_are_even_and_gapless(docs, empty, spark):
    assert virtual_slots.shard_digest(empty).count() == 0
    for df in (docs, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        rows = virtual_slots.shard_digest(df).collect()
        assert len(rows) == df.count()
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.05 * sum(load.values()) / 8


def test_slot_map_versions(spark, tmp_path):
    table = virtual_slots.uniform_map(spark, 64, 4)
    used = spark.range(64).selectExpr("cast(id as int) virtual_slot", "cast(if(id < 16, 100, 10) as long) bytes")
    virtual_slots.save_map(table, str(tmp_path / "map"))
    virtual_slots.save_map(virtual_slots.rebalance(table, used, 5), str(tmp_path / "map"))
    new = virtual_slots.load_map(spark, str(tmp_path / "map"))
    assert new.first()["version"] == 2 and virtual_slots.load_map(spark, str(tmp_path / "map"), 1).count() == 64
    size = {r["shard"]: r["b"] for r in new.join(used, "virtual_slot").groupBy("shard").agg({"bytes": "sum"}).toDF("shard", "b").collect()}
    assert len(size) == 5 and max(size.values()) - min(size.values()) <= 100


def test_language(docs, empty):
    assert language_id.held_out_languages(empty).count() == 0
    by = {r["doc_id"]: r for r in language_id.held_out_languages(docs).collect()}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und"
    assert by[6]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in by.values())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = QUERIES["op3_language_id"](spark, sf).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() / lang.count() > 0.97
    quality = QUERIES["op5_quality_fm"](spark, sf).join(lab, "doc_id").where("held_out")
    assert quality.where("predicted = quality").count() / quality.count() > 0.95
    toxic = QUERIES["op8_toxicity"](spark, sf).join(lab, "doc_id").where("held_out").toPandas()
    assert toxic[toxic.toxic == 1].score.mean() > toxic[toxic.toxic == 0].score.mean()


def test_classifiers_on_edge_cases(docs, empty, labels):
    none = labels.limit(0)
    for fn in (quality_fm.quality_scores, toxicity.toxicity_scores):
        assert fn(empty, labels).count() == 0
        for lab in (labels, none):
            rows = fn(docs, lab).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_fm.score(docs, quality_fm.fit([])).columns[-1] == "score"


def test_rare_toxic_words_count():
    """A toxic word of under 1 % of the sample raises the score of a text with it."""
    rng = np.random.default_rng(3)
    common = lambda: np.sort(rng.choice(50, 20, replace=False)).astype(np.int32)
    rows = []
    for i in range(1000):
        f = common() if i >= 8 else np.append(common(), np.int32(77))
        rows.append((f, np.ones(len(f), np.uint16), int(i < 100)))
    model = toxicity.fit(rows)
    assert model["weight"][77] > 0 and model["value"][77] > 0


def test_sample_is_pruned_before_the_driver(spark):
    bag = lambda *f: bytearray(np.array(f, np.int32).tobytes())
    ones = lambda n: bytearray(np.ones(n, np.uint16).tobytes())
    found = spark.createDataFrame([("a", 1, bag(1, 5), ones(2)), ("b", 0, bag(1, 6), ones(2)), ("c", 0, bag(1, 5, 7), ones(3)),
                                   ("d", 1, bag(5), ones(1)), ("e", 1, bag(8), ones(1))], "id string, label int, f binary, x binary")
    got = [(f.tolist(), len(x), label) for f, x, label in toxicity.sample_bags(found)]
    assert got == [([5], 1, 1), ([1, 5], 2, 0), ([1], 1, 0), ([1, 5], 2, 1)]
    assert toxicity.SAMPLE_ROWS >= 6_000


def test_sum_of_squares_identity():
    model = quality_fm.fit([])
    rng = np.random.default_rng(0)
    model["v"] = rng.normal(size=model["v"].shape)
    feats, x = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0])
    v = model["v"][feats]
    want = sum(v[i] @ v[j] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(quality_fm.margins(model, np.array([0]), feats, x)[0][0], want)


def roots_of(n, pairs):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(100, 140)]
    links = spark.createDataFrame([*pairs, (None, 4), (5, 5)], "a long, b long")
    want = roots_of(200, pairs)
    got = {x["node"]: x["root"] for x in components.components(links).collect()}
    assert all(want[i] == got.get(i, i) for i in range(200))
    assert components.components(links.limit(0)).count() == 0


def test_fingerprint_by_hand():
    import xxhash
    text = "The quick  brown\tFOX jumps over Ärger\x0bthe dog"
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash_gray.fingerprint(text.encode()) == want
    assert simhash_gray.fingerprint(b" \n") == 0
    assert simhash_gray.fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)


@pytest.mark.parametrize("large", [6, 1500])
def test_gray_index_finds_every_link(spark, monkeypatch, large):
    """Dense and sparse fingerprints; small limit: buckets are routed on by a third block."""
    monkeypatch.setattr(simhash_gray, "LARGE_BUCKET", large)
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(9))) & (1 << 64) - 1 for c in centres for _ in range(25)}
    prints = sorted(prints | {r.getrandbits(64) for _ in range(100)} | {0})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame(list(zip(signed, range(len(prints)))), "f long, id long")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots_of(len(prints), pairs)
    got = {x["node"]: x["root"] for x in components.components(simhash_gray.print_links(classes)).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == want


def test_gray_tree_in_a_large_bucket():
    r = np.random.default_rng(1)
    prints = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFFFFF))
    label = simhash_gray.bucket_stars(np.zeros(len(prints), np.int64), prints)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    assert list(label) == roots_of(len(prints), pairs)


def test_near_documents_edge_cases(docs, empty):
    assert simhash_gray.fingerprint_components(empty).count() == 0
    rows = simhash_gray.fingerprint_components(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[1]["component_id"] == 0
    assert by[4]["component_id"] == 3
    kept = simhash_gray.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 4)").count() == 0


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 8))
    x = [*(base + 0.02 * r.normal(size=base.shape)), *base, *base[:5], *base[:5]]
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, None] + [0.0] * 6, [1.0, 2.0]]
    rows += [(1000 + i, b, None) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = np.array([e for e in x], dtype=np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots_of(len(x), list(zip(*np.nonzero(near))))
    got = {q["vec_id"]: q for q in multi_index.near_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x))) and found >= 0.99 * near.sum()
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(x))]) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(1000, 1007))
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_rare_links_beside_a_hot_group(spark):
    """The pairs of a group with a third of the rows must not decide how far the others are searched."""
    r = np.random.default_rng(6)
    one = r.normal(size=(700, 64))
    hot = r.normal(size=64) + 0.05 * r.normal(size=(700, 64))
    x = np.concatenate([one, one + 0.46 * r.normal(size=one.shape), hot]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots_of(len(x), list(zip(*np.nonzero(near))))
    assert 300 < near[:700].sum() < 700
    got = {q["vec_id"]: q for q in multi_index.near_vectors(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == [want[i] for i in range(len(x))]


def test_cell_bounds_hold():
    r = np.random.default_rng(7)
    for size in (2, 6, 33):
        x = multi_index.unit(np.repeat(r.normal(size=(40, size)), 10, axis=0) + 0.3 * r.normal(size=(400, size)))
        grid = multi_index.Grid(x, 9)
        for d, book in zip(grid._both(x), grid.books):
            part = x[:, :grid.half] if book is grid.books[0] else x[:, grid.half:]
            code, far = d.argmin(1), np.sqrt(np.maximum(d.min(1), 0))
            low = np.array([far[code == k].min(initial=9) for k in range(len(book))])
            high = np.array([far[code == k].max(initial=0) for k in range(len(book))])
            gaps = np.sqrt(np.maximum(multi_index.distances(book, book), 0))
            bound = multi_index.least_squares(d, gaps, low, high)[:, code]
            assert (bound <= multi_index.distances(part, part) + 1e-6).all()


def test_multi_sequence_order():
    r = np.random.default_rng(4)
    grid = multi_index.Grid(r.normal(size=(300, 6)), 7)
    x = r.normal(size=(20, 6))
    a, b = grid._both(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    walk = grid.visits(x, 10)
    assert (walk[:, 0] == grid.cell(x)).all()
    assert np.allclose(np.take_along_axis(total, walk, 1), np.sort(total, axis=1)[:, :10])


def removed(texts):
    seen = Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                mark[i:i + 400] = 1
        mark = mark[:len(t)]
        out.append((len(t), int(mark.sum()), int((np.diff(np.r_[0, mark]) == 1).sum()),
                    hashlib.sha256(np.frombuffer(t, np.uint8)[mark == 0].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [0, 2000])
def test_repeats_against_brute_force(spark, docs, empty, monkeypatch, wide):
    """``wide`` 0: every shared anchor takes the way of the hot ones."""
    monkeypatch.setattr(suffix_merge, "WIDE", wide)
    assert suffix_merge.removal_digest(empty).count() == 0
    common = words(9, 150)
    more = [(100 + i, words(20 + i, 60) + common[i:i + 700] + words(50 + i, 60), None, None, 1, "", 1) for i in range(12)]
    more += [(200, "abcabd" * 300, None, None, 1, "", 1), (201, "é" * 500, None, None, 1, "", 1)]
    df = docs.union(spark.createDataFrame(more, DOCS))
    rows = df.select("doc_id", "text").collect()
    want = removed([(r["text"] or "").encode() for r in rows])
    got = suffix_merge.removal_digest(df).collect()
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r["doc_id"], *w) for r, w in zip(rows, want)), key=key)


def test_long_runs_of_one_anchor_are_not_merged_whole(spark, monkeypatch):
    """Few but long different passages: the way of the hot anchors, by bytes."""
    def merged(batches, *args, real=suffix_merge._merged):
        def bounded():
            sizes = Counter()
            for batch in batches:
                for anchor, passage in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                    sizes[anchor] += len(passage)
                assert max(sizes.values(), default=0) <= 10_000
                yield batch
        yield from real(bounded(), *args)
    monkeypatch.setattr(suffix_merge, "_merged", merged)
    monkeypatch.setattr(suffix_merge, "WIDE_BYTES", 10_000, raising=False)
    texts = [words(70 + i, 80) + "-" * (3000 + 500 * i) + words(90 + i, 80) for i in range(6)]
    got = suffix_merge.removal_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, *w) for i, w in enumerate(removed([t.encode() for t in texts]))]


def first_kept(rows, span=200):
    """Texts by id without the bytes under a string that starts at an earlier place too."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        t = text.encode()
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - span + 1):
            if t[i:i + span] in seen:
                mark[i:i + span] = 1
            seen.add(t[i:i + span])
        out[key] = "".join(t[a:b].decode("utf-8", "ignore") for a, b in zip(*stays(mark[:-1])))
    return out


def stays(mark):
    edge = np.diff(np.r_[0, 1 - mark, 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@pytest.mark.parametrize("wide", [0, 2000])
def test_first_copies_stay(spark, monkeypatch, wide):
    """``wide`` 0: the way of the hot anchors."""
    monkeypatch.setattr(suffix_merge, "WIDE", wide)
    common, r = words(9, 150), random.Random(1)
    rows = [(i, words(20 + i, 40) + common[i * 7:i * 7 + 330] + words(50 + i, 60)) for i in range(12)]
    rows += [(50, "abcabd" * 300), (51, "é" * 500), (52, common), (53, words(20, 40) + "x" + common), (54, common[100:500] * 3)]
    rows += [(60 + i, " ".join(r.choice([words(k, 45) for k in range(90, 96)]) for _ in range(4))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_merge.deduplicated(df, decode=True, lengths=suffix_merge.WORDS_50, keep_first=True)
    assert {x["doc_id"]: x["kept"] for x in got.select("row.doc_id", "kept").collect()} == first_kept(rows)


def test_passages_over_50_words_stay_once(spark):
    """A passage of 51 short words in ten documents stays in the first one only."""
    passage = words(77, 51)[:205] + " end"
    rows = [(i, words(100 + i, 70) + " " + passage + " " + words(200 + i, 70)) for i in range(10)]
    out = {r["doc_id"]: r["text"] for r in suffix_merge.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1] and len(out) == 10
    # neighbours of the passage may be equal by chance
    assert all(passage not in out[i] and len(out[i]) >= len(rows[i][1]) - len(passage) - 10 for i in range(1, 10))


def test_stripped_texts_keep_columns(docs):
    out = suffix_merge.strip_repeats(docs)
    rows = out.collect()
    assert out.columns == docs.columns
    by = {r["doc_id"]: r for r in rows}
    # the copy without an id comes first; the others lose all their words and go
    assert by[None]["text"] in (None, words(1, 300)) and not {3, 4} & set(by) and by[6]["text"] == words(2, 40)
    assert by[0]["text"] is None and by[1]["text"] == "" and by[2]["text"] == "   \n\t "
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["doc_id"] in (5, 10, 12))


def test_merge_equals_one_sort():
    r = random.Random(8)
    parts = [words(k, 130).encode()[:700] for k in range(6)]
    parts += [parts[0][100:650], parts[1][:300] + parts[2][:420]]
    size = np.array([len(p) for p in parts])
    starts = np.cumsum(size) - size
    mask = suffix_merge.repeated_strings(np.frombuffer(b"".join(parts), np.uint8), starts, size, np.ones(len(parts), int), r.choice([2, 3]))
    seen = Counter(p[i:i + 400] for p in parts for i in range(len(p) - 399))
    want = [i + s for p, s in zip(parts, starts) for i in range(len(p) - 399) if seen[p[i:i + 400]] > 1]
    assert list(np.flatnonzero(mask)) == want


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(pattern_packing.default_tokenizer())
    assert pattern_packing.pack_documents(empty).count() == 0
    rows = pattern_packing.pack_documents(docs, ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    for d, t in texts.items():
        own = {r["piece"]: r for r in rows if r["doc_id"] == d}
        ids = [i for k in sorted(own) for i in own[k]["ids"]]
        assert ids == exact.encode(t or "", add_special_tokens=False).ids + [0]
        for r in own.values():
            assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048


def test_plan_holds_every_piece():
    r = random.Random(1)
    histogram = Counter(r.choice([r.randint(1, 2048), r.randint(200, 700), 1, 2048]) for _ in range(5000))
    groups = pattern_packing.plan(histogram)
    placed = Counter()
    for many, pieces in groups:
        assert sum(n * k for n, k in pieces) <= 2048
        for n, k in pieces:
            placed[n] += many * k
    assert placed == histogram
    bound = sum(n * c for n, c in histogram.items()) / 2048
    assert sum(m for m, _ in groups) <= 1.02 * bound + 1


def test_nnls():
    r = np.random.default_rng(0)
    a, x = r.random((12, 30)), np.zeros(30)
    x[[2, 7, 11]] = 1, 2, 3
    got = pattern_packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_one_row_of_each_group_stays(spark):
    """Repeated ids: a text that is nobody's copy stays, and equal rows are one document."""
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (1, a, "x"), (3, c, "u"), (3, c, "u"), (3, c, "u"), (None, a, "n"), (4, None, "e"), (5, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash_gray.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (None, a), (4, None)], key=str)
    assert simhash_gray.keep_one(df.limit(0)).count() == 0 and simhash_gray.keep_one(df).columns == df.columns


def test_own_columns_stay(spark, labels):
    rows = [(i, words(i, 80), "s", "mine", "c", "k", 5) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string, copy string, shuffle_key string, n_copies int")
    for out in (quality_fm.keep_good(df, labels, -1.0), poisson_mix.draw(df, weights={"s": 1.0}, total=1e5)):
        assert out.schema.simpleString() == df.schema.simpleString() and out.count() > 0
        assert set(map(tuple, out.collect())) <= set(rows)


def test_vectors_of_other_lengths(spark):
    r = np.random.default_rng(3)
    wide, many = r.normal(size=(5, 4)), r.normal(size=(90, 6))
    x = [*wide, *wide, *many, *many[:80], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    want = np.zeros((len(x), len(x)), bool)
    for i in range(len(x)):
        for j in range(len(x)):
            if i != j and len(x[i]) == len(x[j]):
                want[i, j] = np.dot(x[i], x[j]) >= 0.9 * np.linalg.norm(x[i]) * np.linalg.norm(x[j])
    got = {q["vec_id"]: q for q in multi_index.near_vectors(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == want.sum(1).tolist()
    roots = roots_of(len(x), list(zip(*np.nonzero(want))))
    assert [got[i]["component_id"] for i in range(len(x))] == roots and want[-3:].sum() == 6


def test_patterns_never_cost_a_sequence():
    """Never more sequences than best fit alone, and the best possible where patterns decide."""
    r = random.Random(2)
    for draw in (lambda: r.randint(1, 2048), lambda: min(2048, max(1, int(r.gauss(700, 120)))), lambda: r.choice([600, 700, 748, 1024, 5])):
        histogram = Counter(draw() for _ in range(4000))
        taken = sum(m for m, _ in pattern_packing.plan(histogram))
        alone = sum(m for m, _ in pattern_packing._filled(dict(histogram), [], np.zeros(0), 2048, 16))
        assert taken <= alone + histogram[2048]
    assert sum(m for m, _ in pattern_packing.plan({600: 50, 700: 50, 748: 50})) == 50


def test_fast_coder_gives_the_same_ids(spark):
    from tokenizers import Tokenizer
    exact, coder = Tokenizer.from_file(pattern_packing.default_tokenizer()), pattern_packing._coder(pattern_packing.default_tokenizer())
    r = random.Random(6)
    texts = ["".join(r.choice("ab cd  'sT.,!?0129\n\tÄéßø€–…<|>[]{}§¡¿ſ") for _ in range(r.randrange(80))) for _ in range(1500)]
    texts += [x["text"] for x in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect() if x["text"]]
    assert all(coder(t).tolist() == exact.encode(t, add_special_tokens=False).ids for t in texts)


def test_pipeline_on_edge_cases(spark, docs, empty):
    import corpus_pipeline
    for table in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, FOLDER)
            if name != "packing":
                assert out.schema.simpleString() == table.schema.simpleString(), name
            assert (out.count() > 0) == (table is docs), name
            assert name == "packing" or {r["score"] for r in out.collect()} <= {"mine", None}


def test_pipeline_runs_and_chains(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        docs = docs.cache()
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2]
    rows = corpus_pipeline.run(spark, FOLDER)
    want = pattern_packing.pack_documents(docs)
    assert rows.select("doc_id", "length").exceptAll(want.select("doc_id", "length")).count() == 0
