"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import ann, jaccard, licenses, lm, media, mixing, packing, quality, shared, spans, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"shared{i} word{i}." if i % 5 == 4 else f"shared{i} word{i}" for i in range(40))


def body(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}{seed}." if i % 9 == 8 else f"{w}{seed}" for i, w in enumerate(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"], n)))


ROWS = [
    (1, body(1), "en", "a", 1), (2, body(2) + " " + PASSAGE, "en", "a", 1), (3, "x" + body(3) + "\n" + PASSAGE, None, "b", None), (4, None, "en", None, 0), (5, "", "en", "b", 0),
    (6, body(1), "en", "a", 1), (6, body(1), "en", "a", 1), (7, "one", "en", "c", 3), (8, "one two", "en", "c", 7), (9, " \n\t ", "en", "c", 4), (None, body(9), "en", "a", 1),
    (10, "word " * 30000, "en", "d", 150000), (11, body(1) + " extra", "en", "a", 1), (12, "<|endoftext|>   \U0001f600 naïve Ünïcode", "en", "a", 30), (13, "a" * 50000, "en", "d", 50000),
]
LABELS = [(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None), (5, 1, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).withColumns({"score": F.lit(1.5), "size": F.lit("s"), "part": F.lit(2), "n": F.lit(1)}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").cache()


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_media(spark, docs):
    got = media.media_features(media.with_media(docs)).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(i), hashlib.sha256(raw + bytes(-len(raw) % 64 or (0 if raw else 64))).hexdigest(), len(raw)) for i, t, *_ in ROWS for raw in [(t or "").encode()])
    assert sorted((str(r.doc_id), r.payload_sha256, r.n_bytes) for r in got) == want
    for r in got:
        if r.n_bytes <= 64:
            assert r.payload_bytes == 64
    assert media.media_features(media.with_media(empty(spark))).count() == 0
    assert media.media_features(spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")).first().feature is None


def test_jpeg_round_trip_and_thumbnail():
    rng = np.random.default_rng(0)
    payloads = [bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 2, 70, 9000)] + [bytes(64), bytes([128] * 640), bytes(rng.choice([128] * 20 + [3], 6400).astype(np.uint8))]
    heads, blocks = media.coefficients(media.encode(payloads))
    assert [media.payload_of(h, b) for h, b in zip(heads, blocks, strict=True)] == payloads
    for h, b, p in zip(heads, blocks, payloads, strict=True):
        pixels = media.thumbnail(h, b).ravel()[: len(p) // 64]
        assert pixels.tolist() == list(p[::64])  # quantiser 8 makes a block's mean its first coefficient
    with pytest.raises(ValueError):
        media.parse(b"no image")


def test_jpeg_without_restart_intervals_chains_dc():
    import struct

    dc, ac = media.DC_TABLE, media.AC_TABLE
    bits, last = "", 0
    values = [5, -3, -3, 90]
    for v in values:
        d = v - last
        last = v
        s = abs(d).bit_length()
        bits += format(int(dc.code[s]), f"0{int(dc.size[s])}b") + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
        bits += format(int(ac.code[0]), f"0{int(ac.size[0])}b")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    tables = b"".join(bytes([k << 4]) + t.counts.tobytes() + t.symbols.tobytes() for k, t in ((0, dc), (1, ac)))
    seg = media._segment
    image = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 1) + bytes([1, 0x11, 0])) + seg(0xC4, tables) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (head,), (blocks,) = media.coefficients([image])
    assert blocks[:, 0].tolist() == values and not blocks[:, 1:].any() and (head["width"], head["height"]) == (16, 16)


def test_licenses(spark, docs):
    noted = docs.unionByName(spark.createDataFrame([(20, body(4) + " Released under the MIT license. " + body(5), "en", "a", 1), (21, "licensed under the apache license, version 2.0.", "en", "a", 1)], COLUMNS), allowMissingColumns=True)
    got = licenses.scan(noted)
    rows = {(r.doc_id, r.license): r for r in got.collect()}
    assert set(rows) == {(20, "MIT"), (21, "Apache-2.0")} and rows[20, "MIT"].first_word == 60 and rows[20, "MIT"].containment == 1.0
    assert plain(got.collect()) == plain(licenses.scan(noted, retrieve=False).collect())
    assert licenses.scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"big": "w " * (licenses.MOST_WORDS + 1)})


def test_license_bands_find_what_brute_force_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = licenses.scan(docs).collect()
    assert got and plain(got) == plain(licenses.scan(docs, retrieve=False).collect())


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(201, None), (202, [0.0] * 4), (203, [float("nan")] * 4), (204, [1.0, None, 0.0, 0.0]), (205, [1.0, 2.0]), (None, [1.0] * 4), (206, [float("inf"), 0.0, 0.0, 0.0]), (5, [9.0, 9.0, 9.0, 9.0]), (207, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("rank", F.lit("x"))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[:100]] + [(5, np.full(4, 9.0))]
    got = {}
    for r in ann.nearest(df, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (i for i, _ in rows[:100] if i % 20 == 0):
        best = {}
        for qv in (v for i, v in good if i == q):
            for i, v in good:
                if i != q:
                    best[i] = max(best.get(i, -1e9), float((v * qv).sum()))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want]
        assert [s for *_, s in sorted(got[q])] == pytest.approx([s for _, s in want])
    assert ann.nearest(df.where("vec_id > 200 and vec_id <> 205")).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r["rank"], len(few)) for r in few] == [(0, 1, 2), (0, 2, 2)]


@pytest.mark.parametrize("times", [2, 5])
def test_nearest_counts_ids_not_rows(spark, times):
    """Every row repeated, and one id that holds a third of all rows with vectors of its own."""
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 6)).tolist()) for _ in range(times)]
    rows += [(7, v) for v in (3 * rng.normal(size=(150 * times, 6))).tolist()]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        score = m @ rows[times * q][1]
        want = sorted(((score[ids == i].max(), i) for i in range(300) if i != q), key=lambda x: (-x[0], x[1]))[:20]
        assert [(n, i) for n, i, _ in sorted(found)] == [(n, i) for n, (_, i) in enumerate(want, 1)]
        assert [s for *_, s in sorted(found)] == pytest.approx([s for s, _ in want])


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = df.orderBy("vec_id").toPandas()
    m = np.stack(x["embedding"]).astype(float)
    found, hits = {}, 0
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, got in found.items():
        s = m @ m[q]
        s[q] = -9
        hits += len(set(np.lexsort((x["vec_id"], -s))[:20].tolist()) & got)
    assert len(found) == 100 and hits / 2000 >= 0.9


def test_packing(spark, docs):
    enc = packing.encoder(None).slow
    ids = {}
    for i, t, *_ in ROWS:
        ids.setdefault(i, np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got = packing.pack(docs).collect()
    tokens = {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(v) * sum(x[0] == i for x in ROWS) for i, v in ids.items()}
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(empty(spark)).count() == 0


def test_packing_plan_is_balanced():
    lengths = np.random.default_rng(0).integers(1, 3000, 400)
    p = packing.plan(lengths)
    assert p[:, 2].sum() == lengths.sum()
    sizes = np.bincount(p[:, 3], p[:, 2])
    assert (sizes[:-10] == 1024).all()


def test_fast_and_slow_tokenizers_agree():
    from hypothesis import given, settings, strategies as st

    e = packing.encoder(None)
    known = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), 0x2013, 0x2014, *range(0x2018, 0x201E), 0x2026]]
    slow = lambda t: e.slow.encode(t, add_special_tokens=False).ids
    for c in known:
        for t in (f"a{c}b", f" {c} {c}{c}", f"{c}1", f"\n{c}\n"):
            assert e.encode(t).tolist() == slow(t)

    @settings(max_examples=200, deadline=None)
    @given(st.text(st.sampled_from(known)) | st.text())
    def same(t):
        t = t.encode("utf-8", "ignore").decode()
        assert e.encode(t).tolist() == slow(t)

    same()
    long = (body(3) + "\n") * 3000
    assert len(long) > packing.LONG_CHARS and e.encode(long).tolist() == slow(long)


def test_quality_and_toxicity(spark, docs, labels):
    for f in (quality.quality, toxicity.toxicity):
        got = f(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out in (True, False) for r in got)
        assert len({r.score for r in got if r.doc_id == 6}) == 1
        assert f(empty(spark), labels).count() == 0
        assert f(docs, labels.limit(0)).count() == len(ROWS)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (5 if f is quality.quality else 3) == (0 if f is quality.quality else 1)) for r in got if r.doc_id is not None)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    q = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in q) / len(q) > 0.97
    x = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    rank = np.array([r.score for r in x])
    y = np.array([r.toxic for r in x])
    auc = (rank[y == 1][:, None] > rank[y == 0][None]).mean()
    assert auc > 0.9 and np.mean([r.predicted for r in x if not r.toxic]) < 0.05


def test_misspelt_words_share_subwords():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    neutral = [f"{a}{b}" for a in ("ton", "mer", "lis", "vak", "dor") for b in ("an", "el", "ir", "os", "um")]
    texts = [" ".join([*rng.choice(neutral, 30), *(["wretchedness"] if i % 2 else [])]) for i in range(200)]
    bags = [(b, c) for _, b, c in toxicity._bags(pa.record_batch({"text": texts}))]
    add, bias = toxicity.train(bags, np.arange(200) % 2)
    for text, least, most in (("ton an wretchednezs mer el", 0.5, 1), ("tonan merel lisir vakos", 0, 0.5)):
        ((_, b, c),) = toxicity._bags(pa.record_batch({"text": [text]}))
        p = 1 / (1 + np.exp(-(add[b] @ c / (c.sum() + toxicity.SHRINK) + bias)))
        assert least <= p <= most


def brute_mix(rows):
    size = {k: len(re.findall(mixing.WORD, t or "")) for k, t in ((n, r[1]) for n, r in enumerate(rows))}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = sum(size.values())
    held = {s: sum(size[n] for n, r in enumerate(rows) if r[3] == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * held[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * held[s]
            left -= target[s]
        free -= over
    return size, held, target


def test_mixing(spark, docs):
    got = mixing.mix_counts(docs).collect()
    size, held, target = brute_mix(ROWS)
    assert len(got) == len(ROWS)
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 4)) for r in got) == sorted((str(r[0]), size[n], held[r[3]], round(target[r[3]], 4)) for n, r in enumerate(ROWS))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by[r.source_size, round(r.target, 4)] = by.get((r.source_size, round(r.target, 4)), 0) + r.taken
    assert all(abs(taken - t) <= 1 for (_, t), taken in by.items())
    assert plain(got) == plain(mixing.mix_counts(docs.repartition(5)).collect())
    assert mixing.mix_counts(empty(spark)).count() == 0
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    rows = copies.collect()
    assert sum(len(re.findall(mixing.WORD, r.text)) for r in rows) == sum(r.taken for r in got)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_language_model(spark, docs):
    got = lm.score(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    tokens = lambda t: [*re.findall(mixing.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    train = [w for i, t, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t)]
    known = set(train)
    texts = {i: t for i, t, *_ in ROWS}
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in known for x in w), len(train)) and np.isfinite(r.score) and r.score < 0
    none = lm.score(docs.where("doc_id is null")).collect()
    assert none[0].train_tokens == 0 and np.isfinite(none[0].score)
    assert lm.score(empty(spark)).count() == 0


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a", "c c a b", "a", "d a b"])], "doc_id long, text string")
    model = lm.fit(docs)
    s = lm.Scorer(model)
    ids = np.arange(-1, model.size)
    for before in range(-1, model.size + 1):
        p = s.pairs(np.full(len(ids), before), ids, s.words(ids))
        assert abs(p.sum() - 1) < 1e-9


def test_jaccard(spark, docs):
    got = jaccard.similar_documents(docs, 3, 90).collect()
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(ROWS)
    assert rows[1][1] == rows[6][1] == rows[11][1] == 1
    assert all(rows[i] == (0, i) for i in (4, 5, 9)) and rows[7] == (1, 7) and rows[8] == (1, 8) and rows[10] == (1, 10) and rows[None][1] is None
    assert jaccard.similar_documents(empty(spark)).count() == 0
    kept = jaccard.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {r[0] for r in ROWS} - {6, 11})


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_against_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    texts = []
    for _ in range(25):
        base = rng.integers(0, 60, int(rng.integers(0, 50)))
        for _ in range(int(rng.integers(1, 8))):
            t = base.copy()
            if len(t):
                t[rng.integers(0, len(t), int(rng.integers(0, 4)))] = rng.integers(0, 60)
            texts.append(" ".join(f"w{x}" for x in t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, k, percent).collect()}
    assert got == {i: (len(s), group[i]) for i, s in enumerate(sets)}


def test_jaccard_gives_the_rows_of_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
        want = sorted(con.sql(f"select doc_id, n_shingles, component_id from ({jaccard.ORACLE})").fetchall())
        got = jaccard.similar_documents(spark.read.parquet(f"{folder}/documents.parquet"), k=3, percent=90)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_shuffle_files_go_once_rows_are_stored(spark):
    before = spark.conf.get(shared._FREE)
    kept = shared.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and kept.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(shared._FREE) == before


def test_spans(spark, docs):
    out = spans.without_repeats(docs, counts=True)
    rows = out.collect()
    assert len(rows) == len(ROWS) and out.columns == [*docs.columns, "n_sentences", "n_removed"]
    by = {r.doc_id: r for r in rows}
    assert by[4].text is None and by[5].text == "" and by[7].text == "one" and by[9].text == " \n\t "
    assert by[2].text == ROWS[1][1] and "shared20" not in by[3].text and by[3].text.startswith("x")
    assert by[1].text == body(1) and len(by[6].text) < 40 and by[13].text == "a" * 50000
    assert by[3].n_chars == len(by[3].text)
    assert spans.without_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        spans.repeated_runs(docs, words=5000)


def test_spans_leave_clean_documents_and_find_passages(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) + ("." if rng.uniform() < 0.1 else "") for _ in range(n))
    passage = fresh(55)
    rows = [(i, fresh(80) + ". " + passage + ". " + fresh(30) if i % 3 == 0 else fresh(150)) for i in range(30)]
    got = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 3 or i == 0:
            assert got[i] == text
        else:
            assert len(set(passage.split()) & set(got[i].split())) <= 8


def test_spans_find_every_passage_that_brute_force_finds(spark):
    """Passages of 51 words without punctuation, mid-sentence, of few words, and broken into other lines."""
    rng = np.random.default_rng(11)
    fresh = lambda n, dot=0.0: [("".join(rng.choice(list("abcdefgh"), 7)) + ("." if rng.uniform() < dot else "")) for _ in range(n)]
    lines = lambda words: "".join(w + ("\n" if rng.uniform() < 0.2 else " ") for w in words)
    rows = []
    for i in range(1600):
        few = fresh(21)
        passage = [fresh(51), fresh(51, 0.1), rng.choice(few, 51).tolist(), fresh(51)][i % 4]
        for _ in range(2):
            words = fresh(int(rng.integers(5, 30)), 0.1) + fresh(3) + passage + fresh(3) + fresh(int(rng.integers(5, 30)), 0.1)
            rows.append((len(rows), lines(words) if i % 4 == 3 else " ".join(words)))
    seen, want = set(), set()
    for i, text in rows:
        words = text.split()
        grams = {" ".join(words[a : a + 51]) for a in range(len(words) - 50)}
        want |= {i} if grams & seen else set()
        seen |= grams
    got = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shorter = {i for i, text in rows if got[i] != text}
    assert len(want) == 1600 and not want - shorter and all(i % 2 for i in shorter)
    for i in want:  # what stays of a passage is at its ends, and what stood around it stays
        kept, words = got[i].split(), rows[i][1].split()
        assert len(words) - 51 <= len(kept) <= len(words) - 51 + 30


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert sorted(out.columns) == sorted(rows.columns), name
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mix", "packing"]
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
