"""Exact deduplication, whitening and ranked search against brute force, on small hostile tables."""

import random
from collections import Counter
from fractions import Fraction
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import exactdup, lexical, whiten

DOCS = "doc_id long, text string, lang string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 11


def horner(data, point, prime):
    h = 0
    for c in reversed(data):
        h = (h * point + c) % prime
    return h


def hashes(poly, parts, offset=None):
    data = np.frombuffer(b"".join(parts), np.uint8)
    return poly.many(data, np.cumsum([0] + [len(p) for p in parts]), None if offset is None else np.array(offset)).astype(object)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=8), st.sampled_from([exactdup.PRIME, 3, 101]))
def test_polynomials(parts, prime):
    poly = exactdup.Polynomial(prime)
    got = hashes(poly, parts)
    assert got.tolist() == [[horner(p, b, prime) for b in poly.points] for p in parts]


def test_fingerprints_compose():
    """However a text is cut, its parts' shifted hashes add up to its own, over more than one window."""
    r, poly = random.Random(3), exactdup.Polynomial()
    text = r.randbytes(3 * exactdup.WINDOW + 17)
    cuts = sorted({0, len(text), *(r.randrange(len(text)) for _ in range(9)), exactdup.WINDOW, 2 * exactdup.WINDOW + 1})
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    whole = hashes(poly, [b"abc", text, b""])[1]
    assert (hashes(poly, parts, cuts[:-1]).sum(0) % exactdup.PRIME).tolist() == whole.tolist()
    x, y = hashes(poly, [text[:1000], text[1000:]])
    assert [(int(a) + pow(b, 1000, exactdup.PRIME) * int(c)) % exactdup.PRIME for a, b, c in zip(x, poly.points, y)] == whole.tolist()


def copies():
    r = random.Random(8)
    base = " ".join(f"w{r.randrange(50)}" for _ in range(300))
    rows = [(i, base, "x") for i in range(40)]  # a hot text
    rows += [(100, None, "a"), (101, "", "b"), (102, " ", None), (103, base + " ", "c"), (104, base[:-1] + "~", "d"), (None, base, "e"), (None, "alone", "f"), (None, "alone", "g")]
    rows += [(105, "é", "h"), (106, "é", "i"), (107, "long " * 60_000, "j"), (108, "long " * 60_000, "k"), (109, "long " * 59_999 + "lonG ", "l"), (5, base, "x"), (5, base, "x")]
    return rows


def kept_by_hand(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((-1 if i is None else i for i in ids)) for t, ids in groups.items()}
    return sorted(((i, None if best[t or ""] < 0 else best[t or ""], len(groups[t or ""])) for i, t, _ in rows), key=repr), {t: None if b < 0 else b for t, b in best.items()}


@pytest.mark.parametrize("prime,huge", [(exactdup.PRIME, exactdup.HUGE), (2, exactdup.HUGE), (exactdup.PRIME, 500), (3, 4)])
def test_exact_dedup(spark, prime, huge):
    """Also with a field so small that most fingerprints of one length collide, and with all texts dealt in chunks."""
    rows = copies()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"rid": F.lit("clash"), "row": F.lit(1), "same_as": F.lit(2), "kept": F.lit("other")})
    made = exactdup.classes(docs, prime, huge)
    assert made.columns == ["doc_id", "lang", "rid", "row", "same_as", "keep_id", "group_size", "kept"]
    want, best = kept_by_hand(rows)
    assert rows_of(made.select("doc_id", "keep_id", "group_size")) == want
    assert Counter(r["keep_id"] for r in made.filter("kept").collect()) == Counter(best.values())
    assert made.filter("kept AND NOT doc_id <=> keep_id").count() == 0


def test_keep_last(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, DOCS)
    got = exactdup.keep_last(docs)
    assert got.columns == docs.columns
    _, best = kept_by_hand(rows)
    assert sorted(((r["text"], r["doc_id"]) for r in got.collect()), key=repr) == sorted(best.items(), key=repr)


def test_exact_dedup_of_nothing(spark):
    assert exactdup.classes(spark.createDataFrame([], DOCS)).collect() == []


# -- 12


def components_by_hand(rows, most=4):
    """Exact covariance over fractions, then eigh, for each length."""
    good = [(i, [min(max(floor(Fraction(c) * 256), -(1 << 63)), (1 << 63) - 1) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in good} - {0}:
        fit = sorted({tuple(x) for _, x in good if len(x) == dim})
        n, total = len(fit), [sum(x[j] for x in fit) for j in range(dim)]
        v = [[Fraction(n * sum(x[i] * x[j] for x in fit) - total[i] * total[j], n * n) for j in range(dim)] for i in range(dim)]
        e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
        order = np.argsort(-e)[:most]
        trace = float(sum(v[i][i] for i in range(dim)))
        for i, x in good:
            if len(x) == dim:
                y = [n * a - s for a, s in zip(x, total)]
                out.setdefault(i, []).append((n, sum(a * a for a in y), np.array([float(Fraction(a, n)) for a in y]) @ u[:, order], e[order], trace))
    return out


def compare_components(spark, rows, real=4, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, schema).withColumns({"x": F.lit("clash"), "dim": F.lit(1), "id": F.lit(2), "n": F.lit(3)})
    want = components_by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = whiten.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({i: sum(min(4, len(w[2])) for w in ws) for i, ws in want.items()})
    signs = {}
    for r in got:
        n, far, flat, e, trace = want[r["vec_id"]][0]
        k = r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, far)
        if k >= real:
            assert r["whitened"] is None
            continue
        assert r["explained"] == pytest.approx(e[k] / trace, rel=1e-9)
        value = flat[k] / np.sqrt(e[k])
        assert abs(r["whitened"]) == pytest.approx(abs(value), abs=1e-7, rel=1e-7)
        if abs(value) > 1e-3:
            assert signs.setdefault((len(flat), k), np.sign(r["whitened"] * value)) == np.sign(r["whitened"] * value)
    return got


def test_whitening(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.normal(0, [0.5, 0.3, 0.2, 0.1, 0.05, 0.02])]) for i in range(200)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 0.0, -0.0, 1.0]) for i in range(90)]  # a hot vector
    rows += [(1, rows[7][1]), (None, rows[8][1]), (300, None), (301, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (302, [float("nan")] * 6), (303, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (304, [])]
    rows += [(1, rows[1][1])]  # a row twice
    df_rows = [x for x in rows if x[0] not in (1,)] + [(2000, rows[7][1])]
    got = compare_components(spark, df_rows)
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    repeated = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("vec_id = 1").collect()
    assert len(repeated) == 4 * 3


def test_whitening_of_each_length(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.normal(0, 1 + np.arange(d))]) for i, d in enumerate([2, 3, 5] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = components_by_hand(rows)
    for row in whiten.whiten(df).collect():
        n, far, flat, e, _ = want[row["vec_id"]][0]
        assert (row["n"], int(row["deviation"])) == (20, far) and abs(row["whitened"]) == pytest.approx(abs(flat[row["component"] - 1]) / np.sqrt(e[row["component"] - 1]), rel=1e-7, abs=1e-7)


def test_whitening_without_variance(spark):
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    line = whiten.whiten(spark.createDataFrame([(i, [i / 4, -i / 4, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and all(r["explained"] == pytest.approx(float(r["component"] == 1)) for r in line)
    assert whiten.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_whitening_of_large_entries(spark):
    """Beyond what doubles and 64-bit products hold; entries beyond a long stay at its bounds."""
    r = np.random.default_rng(6)
    rows = [(i, [float(c) for c in r.normal(0, [1e12, 3e13, 5e12])]) for i in range(30)]
    compare_components(spark, rows, schema="vec_id long, embedding array<double>")
    got = whiten.quantized(spark.createDataFrame([(1, [1e30, -1e30])], "vec_id long, embedding array<double>")).first()
    assert list(got["x"]) == [(1 << 63) - 1, -(1 << 63)]


@given(st.lists(st.integers(-(10**30), 10**30), max_size=5))
def test_limbs(values):
    assert [sum(v << (whiten.LIMB * i) for i, v in enumerate(whiten.limbs_of(x))) for x in values] == values


@pytest.mark.parametrize("most", [10, 1 << 24, 1 << 40])
def test_scatter_is_exact(most):
    x = np.random.default_rng(7).integers(-most, most, (70, 3))
    shift = x[0]
    sums, cross = whiten.scatter_of(x, shift)
    y = x.astype(object) - shift.astype(object)
    assert sums == list(y.sum(0)) and cross == [int((y[:, i] * y[:, j]).sum()) for i in range(3) for j in range(i, 3)]


# -- 13


def terms(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out, now = [*out, now] if now else out, ""
        else:
            now += c.lower() if c.isascii() else c
    return out


def ranked_by_hand(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, b in bags:
            size = sum(b.values())
            m = 50 + (50 * size * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def corpus():
    r = random.Random(9)
    topics = [[f"t{k}x{i}" for i in range(40)] for k in range(6)]
    docs = [(i, " ".join(r.choice(topics[i % 6]) if r.random() < 0.8 else f"c{r.randrange(30)}" for _ in range(r.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # a hot text: ties by id
    docs += [(500, None), (501, ""), (502, " .,;\n"), (503, "Ünïcode É é İ ß 日本"), (504, "É"), (505, "A_b-c`d~e"), (506, "word " * 30_000 + "t1x1"), (None, docs[3][1]), (None, "t0x1 t0x2"), (7, docs[7][1])]
    items = [(1, docs[3][1]), (2, "T1X1, t2x2! c5"), (3, "absent"), (4, None), (5, ""), (6, "日本 é A b"), (None, "t0x1"), (2, "t3x3"), (8, "c1 c1 c1 " + " ".join(topics[4])), (9, "word")]
    return docs, items


@pytest.mark.parametrize("shard_docs,k", [(4096, 50), (70, 5), (1, 3)])
def test_search(spark, shard_docs, k):
    docs, items = corpus()
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"shard": F.lit("clash"), "n": F.lit(1), "terms": F.lit(0)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("clash"), "w": F.lit(1)})
    assert rows_of(lexical.search(a, b, k, shard_docs)) == ranked_by_hand(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = corpus()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(a.limit(0), b).collect() == [] and lexical.search(a, b.limit(0)).collect() == []


def test_bisection_gathers_topics():
    """A permutation whose leaves are small, and hold fewer different topics than the order before."""
    r = np.random.default_rng(1)
    n, topic = 512, np.random.default_rng(2).integers(0, 8, 512)
    doc = np.repeat(np.arange(n), 20)
    term = topic[doc] * 50 + r.integers(0, 50, len(doc))
    pairs = np.unique(np.stack([doc, term]), axis=1)
    order, bounds = lexical.bisect(*pairs, n)
    assert sorted(order.tolist()) == list(range(n)) and np.diff(bounds).max() <= lexical.CLUSTER
    mixed = lambda o: np.mean([len(set(topic[o[a:b]])) for a, b in zip(bounds, bounds[1:])])
    assert mixed(np.arange(n)) == 8 and mixed(order) < 3


def test_search_stops_early():
    """Clusters whose bound is below the k-th score are not scored, and the result is that of all documents."""
    r = random.Random(2)
    texts = [[f"t{i % 8}x{r.randrange(50)}".encode() for _ in range(20)] for i in range(1024)]
    count = [Counter(t) for t in texts]
    row = lexical.shard_row(0, list(range(1024)), [20] * 1024, [list(c) for c in count], [list(c.values()) for c in count], 1024, 20 * 1024)
    shard = lexical.Shard(row, True)
    query = {f"t3x{i}".encode(): 100 + i for i in range(5)}
    found, visited = shard.top(list(query), list(query.values()), 10, 0)
    score = lambda c: sum(w * int(lexical.contribution(np.array([c[t]]), np.array([20]), 1024, 20 * 1024)[0]) for t, w in query.items() if t in c)
    assert found and visited < shard.clusters
    assert sorted(((-s, i) for s, i in found))[:10] == sorted((-score(c), i) for i, c in enumerate(count))[:10]
