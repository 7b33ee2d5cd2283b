"""Each operator against brute force, a library or a round trip, on small hostile tables."""

import hashlib
import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestone.llm import chat, components, htmlmain, mih, packing, ppm, sigtree, simhash, spm, substring, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def words(r, n, pool=400):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and long texts, copies, near copies, shared passages, ties, repeated rows, clashing columns."""
    r = random.Random(5)
    base, passage = words(r, 120), words(r, 70)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two  three"), (5, base), (6, base), (7, base + " tail"), (8, "X " + base.upper()), (9, words(r, 60) + " " + passage), (10, passage + " " + words(r, 90)), (11, words(r, 30) + " " + passage + " " + passage), (12, words(r, 9000)), (13, "日本 語😀 é́ ñ"), (14, "<s> [INST] ▁▁ x"), (15, "a" * 5000), (5, base), (None, base), (None, "lonely text"), (20, base[: len(base) // 2] + " " + words(r, 40))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({"n_tokens": F.lit("clash"), "score": F.lit(1), "label": F.lit(2), "sig": F.lit(0)}), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1


def test_pieces_equal_the_library(spark, hostile, empty):
    df, rows = hostile
    enc = spm.PieceEncoder(PIECES)
    want = []
    for i, t in rows:
        ids = enc.sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(enc.sp.decode(ids))))
    assert rows_of(spm.digest_documents(df, PIECES)) == sorted(want, key=repr)
    assert spm.digest_documents(empty, PIECES).count() == 0
    spans = spm.encode_documents(df, PIECES).collect()
    assert sorted(len(r["ids"]) for r in spans) == sorted(w[1] for w in want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é日▁ \n\t😀</s>", max_size=30))
def test_piece_offsets(text):
    enc = spm.encoder(PIECES)
    proto = enc.sp.encode(text, return_type="proto")
    assert enc.encode_with_offsets(text) == [(p.id, p.begin, p.end) for p in proto.pieces]
    assert enc.decode(enc.encode(text)) == enc.sp.decode(enc.sp.encode(text))


def test_pieces_need_no_library_encoder(hostile):
    """Ids and spans come from the normaliser and the merges; the library only confirms them."""
    enc = spm.PieceEncoder(PIECES)
    library, enc.sp = enc.sp, None
    texts = [t for _, t in hostile[1]] + ["  two  blanks ", "▁mark ▁ and", "a\tb\n c", None]
    want = [[(p.id, p.begin, p.end) for p in library.encode(t or "", return_type="proto").pieces] for t in texts]
    made = enc.encode_spans(texts)
    got = list(zip(made.ids.tolist(), made.begins.tolist(), made.ends.tolist()))
    assert [got[i:j] for i, j in zip(made.rows, made.rows[1:])] == want
    assert made.joined() == [",".join(str(i) for i, _, _ in w) for w in want]
    # The array form of the normaliser is the call for each text.
    normal, align, place = enc.normalizer.many([t or "" for t in texts])
    for t, i, j in zip(texts, place, place[1:]):
        assert (normal[i : j - 1].tobytes(), align[i:j].tolist()) == enc.normalizer(t or "")


def trie(keys):
    """A double array of byte keys with values, as in precompiled maps."""
    units, taken = [0] * 4096, {0}

    def place(node, items, depth):
        labels = sorted({k[depth] if depth < len(k) else 0 for k, _ in items})
        for base in range(1, 2048):
            spots = [base ^ c for c in labels]
            if not any(s in taken for s in spots) and (node ^ base) < 1 << 21:
                break
        taken.update(spots)
        units[node] |= (node ^ base) << 10
        for c in labels:
            own = [(k, v) for k, v in items if (k[depth] if depth < len(k) else 0) == c]
            if c == 0:
                units[base] = own[0][1] | 1 << 31
                units[node] |= 1 << 8
            else:
                units[base ^ c] = c
                place(base ^ c, own, depth + 1)

    place(0, keys, 0)
    return units


def test_longest_prefix_normalisation():
    import struct

    strings = b"fi\0AE\0x\0"
    units = trie([("ﬁ".encode(), 0), (b"ab", 3), (b"abc", 6)])
    charsmap = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings
    n = spm.Normalizer(charsmap, dummy_prefix=False, escape=False)
    out, align = n("ﬁab abcd")
    assert out == b"fiAE xd" and align == [0, 0, 3, 3, 5, 6, 9, 10]
    out, align = spm.Normalizer(remove_extra=True)("  a   b ")
    assert out.decode() == "▁a▁b" and align[3] == 2 and align[-1] == 8


# -- 2


def test_noisy_or(spark, hostile, empty):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        sentences = [words(r, 6, 50) for _ in range(5)]
        if bad:
            sentences[2] += " vile"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels + [(0, 1, 0), (1, None, 0)], "doc_id long, toxic int, quality int"), max_docs=1000)
    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    found = toxicity.locate_sentences(docs, model).collect()
    assert len(found) == 80 and all("vile" in rows[x["doc_id"]][1][x["begin"] : x["end"]] for x in found)
    text = rows[5][1]
    assert abs(model.score(text) - (1 - np.prod([1 - 1 / (1 + np.exp(-z)) for _, _, z in model.sentences(text)]))) < 1e-9
    scores = toxicity.score_documents(hostile[0], model).collect()
    assert len(scores) == len(hostile[1]) and all(0 <= s["score"] < 0.5 for s in scores)
    kept = toxicity.drop_toxic(hostile[0], model)
    assert kept.columns == hostile[0].columns and kept.count() == len(hostile[1])
    blank = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert blank.score("x") < 0.5 and toxicity.score_documents(empty, blank).count() == 0


# -- 3


def test_simhash(spark, hostile, empty):
    df, rows = hostile
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        want.append((i, n, sha(t[: n - n // 3] + after[: n // 3])))
    for buckets in (1, 7):
        got = simhash.fingerprint_documents(df, buckets)
        assert rows_of(got.select("doc_id", "n_chars", "edited_sha256")) == sorted(want, key=repr)
    prints = {}
    for r in got.collect():
        assert 0 <= r["near_edited"] <= 1 and len(r["fingerprint"]) == 32
    pairs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(got.select("doc_id", "fingerprint"), "doc_id").select("text", "fingerprint")
    for r in pairs.filter("doc_id NOT IN (5)" if "doc_id" in pairs.columns else "true").collect():
        prints.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert simhash.fingerprint_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert simhash.fingerprint_documents(one).first()["edited_sha256"] == sha("abcdab")


def test_simhash_votes(spark):
    """Packed lanes give the signs of plain counting, over several parts."""
    text = " ".join(f"t{i % 977}" for i in range(70_000))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    got = simhash.fingerprint_texts(df, ["k"], ["text"]).first()
    hashes = df.select(F.explode(simhash.term_hashes(F.col("text"))).alias("a")).select("a", F.xxhash64("a").alias("b")).toPandas()
    for c, name in (("a", "text_hi"), ("b", "text_lo")):
        h = hashes[c].to_numpy().view(np.uint64)
        bits = [int(2 * int(((h >> np.uint64(j)) & np.uint64(1)).sum()) > len(h)) for j in range(64)]
        assert got[name] & ((1 << 64) - 1) == sum(b << j for j, b in enumerate(bits))


def test_near_fingerprints(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(60)]
    near = [b ^ sum(1 << k for k in r.sample(range(63), r.randrange(6))) for b in base]
    every = base + near
    df = spark.createDataFrame([(x,) for x in every + every[:3]], "fp long")
    got = {(x["query"], x["found"]): x["distance"] for x in simhash.near_fingerprints(df, df, radius=3, blocks=5).collect()}
    assert got == {(a, b): (a ^ b).bit_count() for a in every for b in every if (a ^ b).bit_count() <= 3}


def test_near_fingerprints_of_documents(spark):
    """The operator's own 128 bits: pairs that differ in either half, or in both."""
    r = random.Random(6)
    docs = spark.createDataFrame([(i, words(r, 30)) for i in range(12)], "doc_id long, text string")
    prints = [int(x["fingerprint"], 16) for x in simhash.fingerprint_documents(docs).collect()]
    every = [*prints, *(p ^ sum(1 << k for k in r.sample(range(128), r.randrange(7))) for p in prints * 3), *(p ^ (1 << 127) for p in prints)]
    df = spark.createDataFrame([(f"{p:032x}",) for p in every + every[:3]] + [(None,)], "fingerprint string")
    got = {(int(x["query"], 16), int(x["found"], 16)): x["distance"] for x in simhash.near_fingerprints(df, df, radius=3, blocks=6).collect()}
    assert got == {(a, b): (a ^ b).bit_count() for a in every for b in every if (a ^ b).bit_count() <= 3}
    counts = {(int(x["fingerprint"], 16), x["n_near"]) for x in simhash.with_near(df.dropna()).collect()}
    assert counts == {(a, sum(0 < (a ^ b).bit_count() <= 3 for b in set(every))) for a in every}
    assert simhash.near_fingerprints(df.limit(0), df).count() == 0 and simhash.with_near(df.filter("fingerprint IS NULL")).first()["n_near"] == 0


def test_likeness_equals_plain_simhash(spark, hostile):
    """near_edited and near_next of every row, the votes counted one by one in Python."""
    import re

    import xxhash

    def plain(text):
        w = [x.encode() for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower())]
        votes = [0] * 128
        for a, b in zip(w, [*w[1:], None]):
            h = xxhash.xxh64_intdigest(a, 42)
            h = h if b is None else xxhash.xxh64_intdigest(b, h)
            h = h << 64 | xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
            for k in range(128):
                votes[k] += 1 if h >> k & 1 else -1
        return sum(1 << k for k, v in enumerate(votes) if v > 0)

    df, rows = hostile
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    texts, want = [t or "" for _, t in order], []
    for k, (i, _) in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        n = len(t)
        own, edited, next_ = plain(t), plain(t[: n - n // 3] + after[: n // 3]), plain(after)
        want.append((i, f"{own:032x}", f"{edited:032x}", 1 - (own ^ edited).bit_count() / 128, 1 - (own ^ next_).bit_count() / 128))
    got = simhash.fingerprint_documents(df, 5).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("radius, hot", [(3, 8), (3, 40), (3, 10_000), (2, 8), (1, 8)])
def test_near_counts_of_families(spark, radius, hot):
    """Families of many near fingerprints, counted by pairs and by points, with pairs that meet in one table only."""
    r = random.Random(8)
    off = lambda x, bits, most: x ^ sum(1 << k for k in r.sample(bits, r.randrange(most + 1)))
    one, two, three = (r.getrandbits(128) for _ in range(3))
    every = {off(one, range(128), 3) for _ in range(120)} | {off(two, range(40, 60), 6) for _ in range(200)} | {off(three, [0, 1, 126, 127], 4) for _ in range(60)}
    every |= {off(x, range(128), 4) for x in r.sample(sorted(every), 60)} | {r.getrandbits(128) for _ in range(60)}
    df = spark.createDataFrame([(f"{p:032x}",) for p in [*every, *list(every)[:9]]] + [(None,)], "fingerprint string")
    got = {int(x["fingerprint"], 16): x["n_near"] for x in simhash.near_counts(df, radius, hot=hot).collect()}
    want = {a: sum(0 < (a ^ b).bit_count() <= radius for b in every) for a in every}
    assert got == {a: n for a, n in want.items() if n}


def test_successors_in_fine_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CUTS", 3)
    r = random.Random(8)
    rows = [(i, f"t{i} " * 3) for i in r.sample(range(-(10**12), 10**12), 60)] + [(None, "none")]
    got = {x["doc_id"]: x["edited_sha256"] for x in simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()}
    order = sorted(rows, key=lambda x: -(x[0] if x[0] is not None else -(1 << 63)))
    for k, (i, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(t)
        assert got[i] == sha(t[: n - n // 3] + after[: n // 3])


# -- 4


def test_top_k(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 64))
    v[50:120] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist()), (900, None), (901, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mih.top_k(df, df.filter("vec_id % 20 = 0"), 7).collect()
    b = v > 0
    for q in range(0, 300, 20):
        want = sorted(((int((b[q] != b[n]).sum()), n) for n in range(300) if n != q))[:7]
        assert sorted((x["distance"], x["neighbor_id"]) for x in got if x["query_id"] == q) == want
    assert {x["query_id"] for x in got} == set(range(0, 300, 20))
    assert mih.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_top_k_of_mixed_lengths(spark, monkeypatch):
    """Codes of 3 to 100 bits, NaN, nulls, rows without ids, clashing columns, several shards; only equal lengths meet."""
    monkeypatch.setattr(mih, "SHARD_CODES", 40)
    r = np.random.default_rng(1)
    dims = [3, 24, 64, 100]
    rows = [(i, r.normal(size=dims[i % 4]).tolist()) for i in range(240)] + [(None, [1.0] * 24), (400, [float("nan"), None, 1.0]), (420, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"code": F.lit(1), "bits": F.lit("x"), "rank": F.lit(0)})
    got = {}
    for x in mih.top_k(df, df.filter("vec_id % 20 = 0"), 5).collect():
        got.setdefault(x["query_id"], []).append((x["distance"], x["neighbor_id"]))
    bits = {i: [x is not None and x > 0 for x in v] for i, v in rows if i is not None}
    want = {q: sorted((sum(a != b for a, b in zip(bits[q], bits[n])), n) for n in bits if n != q and len(bits[n]) == len(bits[q]))[:5] for q in bits if q % 20 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want


# -- 5


def plain_ppm(texts, data):
    """Bits of ``data`` by contexts of up to three bytes, with escapes and exclusion, in plain Python."""
    counts = {}
    for t in texts:
        for i in range(len(t)):
            for n in range(min(3, i) + 1):
                own = counts.setdefault(t[i - n : i], {})
                own[t[i]] = own.get(t[i], 0) + 1

    def spread(context):
        lower = spread(context[1:]) if context else {x: 1 / 256 for x in range(256)}
        own = counts.get(context)
        if not own:
            return lower
        total, rest = sum(own.values()), sum(p for x, p in lower.items() if x not in own)
        return {x: own[x] / (total + len(own)) if x in own else len(own) / (total + len(own)) * lower[x] / rest for x in lower}

    return -sum(np.log2(spread(data[max(0, i - 3) : i])[data[i]]) for i in range(len(data)))


def test_ppm(spark, hostile, empty):
    r = random.Random(2)
    make = {"aa": lambda: "".join(r.choice("abcde ") for _ in range(200)), "bb": lambda: "".join(r.choice("cdefgh ") for _ in range(200)), "cc": lambda: "".join(r.choice("éèüa ") for _ in range(200))}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    docs = spark.createDataFrame(rows + [(999, None, "aa"), (998, "x", None)], "doc_id long, text string, lang string")
    model = ppm.train(docs.filter("doc_id % 2 = 0 OR doc_id > 900"))
    got = {x["doc_id"]: x for x in ppm.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang in rows)
    assert got[999]["lang_pred"] == "und"
    # The costs are those of the trees, byte by byte, and each context's probabilities sum to 1.
    code, width, lookup, costs = model._build()
    p = 2.0 ** -costs.reshape(-1, width, len(model.languages)).astype(float)
    p[:, width - 1] *= 256 - (width - 1)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    text = "abé cd\n😀"
    data = [width - 1] * 3 + [int(code[x]) for x in text.encode()]
    want = sum(costs[lookup[(data[i - 3] * width + data[i - 2]) * width + data[i - 1]] * width + data[i]].astype(float) for i in range(3, len(data)))
    assert np.allclose(model.code_lengths(["q", text, ""])[1], want)
    out = ppm.identify(hostile[0], model).collect()
    assert len(out) == len(hostile[1]) and all(x["lang_pred"] == "und" for x in out if x["doc_id"] in (0, 1, 2))
    # Every code length is that of plain prediction by partial matching over the training texts.
    seen = [(t, lang) for i, t, lang in rows if i % 2 == 0]
    texts = ["abcde", "ghé", "zzz 12", rows[3][1][:25], "😀a"]
    got = model.code_lengths(texts)
    for k, lang in enumerate(model.languages):
        assert np.allclose(got[:, k], [plain_ppm([t.encode() for t, x in seen if x == lang], t.encode()) for t in texts], rtol=1e-4)
    # A text with letters goes when no language's trees know it; those of the languages stay.
    more = spark.createDataFrame([(1, "zxqvw kjy mnop " * 9), (2, rows[0][1]), (3, rows[1][1]), (4, "12 34"), (5, None)], "doc_id long, text string")
    kept = ppm.keep_identified(more, model)
    assert kept.columns == more.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert ppm.keep_identified(hostile[0], model).columns == hostile[0].columns and ppm.keep_identified(empty, model).count() == 0
    assert ppm.own_bits(b"aab") == pytest.approx(-np.log2(0.5 / 128 * 1.5 / 129 * 0.5 / 130))
    none = ppm.train(empty)
    assert none.predict(["abc"]) == (["und"], [0.0]) and ppm.identify(empty, none).count() == 0


# -- 6

SPECIAL = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/s>", "INST]", "a", "\n", "<<"]), max_size=8).map("".join)


def _language(r, letters, n):
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(300)]
    return [" ".join(r.choice(pool) for _ in range(r.randrange(8, 60))) for _ in range(n)]


def test_a_language_of_one_huge_text_is_learned(spark):
    """Its text is far beyond the share that is drawn; rows without an id are drawn one by one."""
    r = random.Random(3)
    one, two = _language(r, "aeinorstl", 60), " ".join(_language(r, "ukmzvyph", 900))
    rows = [(i, t, "aa") for i, t in enumerate(one)] + [(77, two * 8, "bb")] + [(None, t, "cc") for t in _language(r, "wxqjgdf", 60)]
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), target_bytes=60_000)
    assert model.languages == ["aa", "bb", "cc"]
    total = [int(model.counts[x][1][1].sum()) for x in model.languages]
    assert 30_000 < total[1] < 120_000 and total[2] > 5_000
    assert model.predict([one[0], two[:300], rows[-1][1]])[0] == ["aa", "bb", "cc"]


def test_language_stage_rejects_junk_only(spark):
    """Random letters and a language that was not learned go; learned text stays, in capitals too, and no word of it goes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = ppm.train(docs)
    r = random.Random(4)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (60, 400, 4000)] + ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."]
    clean = [x["text"] for x in docs.select("text").collect()]
    rows = [(i, t) for i, t in enumerate(junk)] + [(100 + i, t) for i, t in enumerate(clean)] + [(9000 + i, t.upper()) for i, t in enumerate(clean[:40])] + [(9999, None), (9998, "12 34")]
    kept = {x["doc_id"] for x in ppm.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model).select("doc_id").collect()}
    assert kept == {i for i, _ in rows} - {0, 1, 2, 3, 4, 9998, 9999}



@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x\ny", "a\\n"]), SPECIAL), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 5.0), (1, 4, 2, "user", "d", 9.0), (2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0), (3, 5, 99, "user", None, 0.0)]
    rows += [(4, i, i - 1 if i else None, "user", f"t{i}", 0.0) for i in range(37)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").fillna("")
    got = {(r["tree"], r["rank"]): [t for _, t in chat.parse_turns(r["formatted"])] for r in chat.format_paths(chat.choose_paths(df, top=2)).collect()}
    assert got == {(1, 1): ["a", "b", "d"], (1, 2): ["a", "c"], (3, 1): [""], (4, 1): [f"t{i}" for i in range(37)]}


def test_reply_forests_equal_enumeration(spark):
    """Random forests with scores: the best paths of each tree are those of plain enumeration."""
    r = random.Random(12)
    rows, want = [], []
    for tree in range(25):
        n = r.randrange(1, 30)
        parent = {k: (r.randrange(k) if k and r.random() < 0.9 else None) for k in range(n)}
        score = {k: r.choice([0.0, 0.25, 0.5, 1.0]) for k in range(n)}
        rows += [(tree, k, parent[k], r.choice(["user", "assistant"]), f"t{tree}-{k}", score[k]) for k in range(n)]
        paths = []
        for leaf in set(range(n)) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(score[k] for k in path) / len(path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want += [(tree, leaf, rank, pos, f"t{tree}-{k}") for pos, k in enumerate(path)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert rows_of(chat.choose_paths(df, top=3).select("tree", "leaf", "rank", "pos", "text")) == sorted(want, key=repr)


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", "two"), (2, 5, None, "</s>\\"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest_formatted(chat.format_paths(chat.choose_paths(chat.linear_messages(df)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == sha("two") and got[1]["turns_sha256"] == sha("user\nq\nassistant\n\nassistant\ntwo\n")
    assert got[2]["turns_sha256"] == sha("user\n</s>\\\n") and got[None]["n_turns"] == 1
    assert chat.choose_paths(chat.linear_messages(df.limit(0))).count() == 0


# -- 7


def test_packing(spark, hostile, empty):
    from tokenizers import Tokenizer

    df, rows = hostile
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(df, WORDS).toPandas()
    by_text = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        by_text.setdefault(-1 if i is None else i, []).append(ids)
    want = sorted((k, len(x)) for k, v in by_text.items() for x in v)
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, got[got["start"] == 0][["doc_id", "doc_tokens"]].to_numpy().tolist())) == want
    for r in got.itertuples():
        options = [x for x in by_text[r.doc_id] if len(x) == r.doc_tokens]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in options)
    assert got["length"].sum() == sum(n for _, n in want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        end = (g["offset"] + g["length"]).to_numpy()
        assert g["offset"].iloc[0] == 0 and (end[:-1] == g["offset"].to_numpy()[1:]).all() and end[-1] <= 2048 and end[-1] & (end[-1] - 1) == 0
    assert packing.pack_documents(empty, WORDS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ'.,!éÉİΣſ<|endoftx> \n\t ́ñ1²_😀"), st.characters(max_codepoint=0x24F, exclude_categories=["Cs"])), max_size=40))
def test_word_cache_is_exact(text):
    tokens = packing.cached(("words", WORDS), lambda: packing.WordTokenizer(WORDS))
    for t in (text, text + " <|endoftext|>", "abc " + text):
        assert np.frombuffer(tokens([t])[0], "<u4").tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids


# -- 8


def brute_repeats(rows):
    key = lambda i: i if i is not None else 1 << 63
    split = [(key(i), (t or "").encode().split()) for i, t in rows]
    first = {}
    for d, w in sorted(split, key=lambda x: x[0]):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    out = []
    for (i, _), (d, w) in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), sha(b" ".join(kept))))
    return sorted(out, key=repr)


def test_substrings(spark, hostile, empty):
    df, rows = hostile
    assert rows_of(substring.digest_documents(df)) == brute_repeats(rows)
    r = random.Random(9)
    blocks = [words(r, n, 60) for n in (49, 50, 51, 75, 120)]
    more = [(i, " ".join(r.choice(blocks + [words(r, r.randrange(1, 40), 60)]) for _ in range(r.randrange(0, 6)))) for i in range(60)]
    more += [(100 + i, " ".join(["line that comes again and again"] * 20)) for i in range(3)]
    assert rows_of(substring.digest_documents(spark.createDataFrame(more, "doc_id long, text string"))) == brute_repeats(more)
    assert substring.digest_documents(empty).count() == 0
    cut = substring.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert all(x["n_chars"] == len(x["text"] or "") for x in cut.collect())


# -- 9


def test_html(spark):
    model = packing.cached(("html-test",), lambda: htmlmain.train(300))
    right = 0
    for i in range(60):
        page = htmlmain.compose(77_000_000 + i)
        nodes, x = htmlmain.features(htmlmain.parse(page), model.odds)
        want = htmlmain.text_of(nodes, htmlmain._labels(nodes).astype(bool).tolist())
        right += htmlmain.extract([page], model) == [want]
    assert right >= 54
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><article><h1>A &amp; B</h1><p>One <b>t</b>wo&nbsp;\n three.<br>Four<script>x('</p>')</script></p><p>Last &lt;p&gt; one, with words enough.</article><div class='comments'><p>First!</p></div><footer>&copy; x</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<<>< <p")], "page_id long, url string, html string")
    got = rows_of(htmlmain.extract_pages(rows, model))
    assert got.count((1, "u", "A & B One two three. Four Last <p> one, with words enough.", 58)) == 2
    assert (2, None, "", 0) in got and (3, "u", "", 0) in got and len(got) == 5


def test_decoding_is_hierarchical():
    root = htmlmain.parse("<div><p>a</p><p>b</p></div><p>c</p>")
    nodes = htmlmain.nodes_of(root)
    kept = htmlmain.decode(nodes, np.array([9.0, -8.0, 1.0, 1.0, 1.0]))
    assert kept == [True, False, False, False, True]
    assert htmlmain.decode(nodes, np.array([9.0, -1.0, 1.0, 1.0, -1.0])) == [True, True, True, True, False]


# -- 10


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                parent[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min([d for d in v if d is not None], default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[find(i)]) for i in range(len(rows))), key=repr)


def test_jaccard(spark, hostile, empty, monkeypatch):
    df, rows = hostile
    assert rows_of(sigtree.jaccard_components(df)) == brute_components(rows)
    r = random.Random(4)
    base = [words(r, 60, 90).split() for _ in range(4)]
    more = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"z{r.randrange(5)}"
        more.append((i, " ".join(w[r.randrange(3) :])))
    want = brute_components(more)
    frame = spark.createDataFrame(more, "doc_id long, text string")
    assert rows_of(sigtree.jaccard_components(frame)) == want
    monkeypatch.setattr(sigtree, "BLOCK", 4)  # groups are dealt out as block pairs
    assert rows_of(sigtree.jaccard_components(frame)) == want
    assert sigtree.jaccard_components(empty).count() == 0
    kept = sigtree.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15, 20, None, None], key=repr)


def test_jaccard_of_rows_without_ids(spark):
    """Classes whose rows all lack an id are checked as the others are."""
    r = random.Random(8)
    base = words(r, 80)
    rows = [(1, base), (None, base + " tail"), (None, base + " tail"), (None, "head " + base), (None, words(r, 50)), (2, words(r, 50))]
    got = rows_of(sigtree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_components(rows) and sum(c == 1 for _, _, c in got) == 4


def test_tree_pairs():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, r.integers(20, 80), dtype=np.int64)).astype(np.uint64) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], r.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64)])) for s in sets for k in (1, 6)]
    order = sigtree.Order(np.zeros(sigtree.SKETCH, np.uint8))
    n = np.array([len(s) for s in sets])
    at = np.argsort(n, kind="stable")
    level = sigtree._level(n[at], [sigtree._bitmap(order.prefix(sets[i], 75)) for i in at], np.arange(len(at)), 75)
    i, j = sigtree.tree_pairs(level, None, 75)
    got = {tuple(sorted((int(at[x]), int(at[y])))) for x, y in zip(i, j)}
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - k)}
    assert links <= got and len(got) < 3 * len(links) + 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("reach", [1, 4])
def test_components_of_long_chains(spark, reach):
    """Chains of thousands in random order of labels, as of successive revisions of one text."""
    r = random.Random(reach)
    names = [r.getrandbits(63) - (1 << 62) for _ in range(3000)]
    edges = [(names[i], names[i + k]) for i in range(3000) for k in range(1, reach + 1) if i + k < 3000 and i // 2500 == (i + k) // 2500]
    r.shuffle(edges)
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(names[:2500] if i < 2500 else names[2500:]) for i, n in enumerate(names)}


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    docs_in = docs
    for name, stage in C.STAGES:
        out = C.scratch(stage(spark, docs, sf), name)
        if name == "toxicity":
            gone = {r["doc_id"] for r in docs.join(out, "doc_id", "left_anti").collect()}
            clean = set(labels[labels["toxic"] == 0]["doc_id"])
            assert gone and len(gone & clean) <= 0.05 * len(clean)
        if name == "language":
            model = C.ppm.train(spark.read.parquet(f"{sf}/documents.parquet"))
            rows = docs.select("doc_id", "text").collect()
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r, x in zip(rows, model.savings([r["text"] for r in rows])) if x >= -1}
            assert out.count() >= 0.98 * docs.filter("text IS NOT NULL").count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert {r["doc_id"] for r in out.collect()} == {d for d, n, c in brute_components(rows) if d == c or n == 0}
        if name == "repeats":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            want = {d: n - k for d, n, k, _ in brute_repeats(rows)}
            assert {r["doc_id"]: len((r["text"] or "").encode().split()) for r in out.collect()} == want
        if name != "packing":
            assert out.columns == docs_in.columns
        docs = out
    assert docs.columns[:3] == ["doc_id", "start", "length"] and docs.count()
