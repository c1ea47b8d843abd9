"""Operators and stages against plain versions that look at everything, on small tables; and texts longer than any step's chunk."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import components, jaccard, labelled, licenses, lm, media, mixing, packing, quality, spans, textkit, toxicity

VOCABULARY = [a + b for a in ("ton", "mer", "lis", "vak", "dor", "fen") for b in ("an", "el", "ir", "os", "um", "ay")]


def prose(rng, n, stop=0.12):
    return " ".join(w + ("." if rng.uniform() < stop else "") for w in rng.choice(VOCABULARY, n))


def tokens(text):
    return [*re.findall(mixing.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_language_model_against_plain_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, int(rng.integers(0, 40)))) for i in range(60)] + [(100, "never seen words"), (101, None), (102, "TONAN tonan")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    single = Counter(w for t in train for w in t)
    total, size = sum(single.values()), len(single)
    pairs = Counter((a, b) for t in train for a, b in zip(["<s>", *t[:-1]], t, strict=True))
    ahead = Counter(b for _, b in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
        return [0.0, *(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))]

    d2, d1 = discounts(pairs.values()), discounts(ahead.values())
    seen, kinds = Counter(), defaultdict(Counter)
    for (a, _), c in pairs.items():
        seen[a] += c
        kinds[a][min(c, 3)] += 1
    even = sum(d1[min(c, 3)] for c in ahead.values()) / sum(ahead.values()) / (size + 1)
    alone = lambda w: (ahead[w] - d1[min(ahead[w], 3)]) / sum(ahead.values()) + even

    def after(a, w):
        if not seen[a]:
            return alone(w)
        c = pairs[a, w]
        return (c - d2[min(c, 3)]) / seen[a] + sum(d2[k] * n for k, n in kinds[a].items()) / seen[a] * alone(w)

    for i, text in rows:
        w = tokens(text)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(single[x] > 0 for x in w), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((single[x] + 1) / (total + size + 1)) for x in w))
        assert got[i].score == pytest.approx(sum(math.log10(after(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)))


def test_wide_counts_are_kept(tmp_path):
    for counts in ([1, 2, 3], [1, 1 << 40, 3]):
        store = lm.Store(f"file://{tmp_path}/{len(str(counts))}")
        store.write("count-0", lm._narrow(np.array(counts)))
        assert lm._counts(store.folder, "count-0", 3).tolist() == counts


def test_ftrl_against_one_number_at_a_time():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(30, 6, replace=False)).astype(np.uint32), rng.integers(1, 4, 6).astype(np.uint32)) for _ in range(40)]
    y = rng.integers(0, 2, 40)
    weights, bias = quality.train(rows, y)
    z, n, b, bn = defaultdict(float), defaultdict(float), 0.0, 0.0
    share = {c: 0.5 / np.mean(y == c) for c in (0, 1)}
    order = np.random.default_rng(5)

    def weight(s):
        if abs(z[s]) <= quality.L1:
            return 0.0
        return -(z[s] - math.copysign(quality.L1, z[s])) / ((quality.BETA + math.sqrt(n[s])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for i in order.permutation(40):
            slots, counts = rows[i]
            values = [quality.SCALE * int(c) / int(counts.sum()) for c in counts]
            w = [weight(int(s)) for s in slots]
            p = 1 / (1 + math.exp(-sum(a * v for a, v in zip(w, values, strict=True)) - b))
            slope = (p - y[i]) * share[int(y[i])]
            for s, v, a in zip(slots.tolist(), values, w, strict=True):
                g = slope * v
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / quality.ALPHA * a
                n[s] += g * g
            bn += slope * slope
            b -= slope * 0.3 / math.sqrt(1 + bn)
    assert bias == pytest.approx(b) and all(weights[s] == pytest.approx(weight(s), abs=1e-5) for s in range(30))


def test_embeddings_against_dense_gradients():
    rng = np.random.default_rng(3)
    n, k = 30, 12
    dense = rng.integers(0, 3, (n, k)) * (rng.uniform(size=(n, k)) < 0.5)
    y = np.arange(n) % 2
    dense[y == 1, 0] += 2
    bags = [(np.flatnonzero(r).astype(np.uint32), r[r > 0].astype(np.uint32)) for r in dense]
    add, bias = toxicity.train(bags, y)
    many = np.stack([(dense[y == c] > 0).sum(0) for c in (0, 1)])
    known = np.flatnonzero((many.sum(0) >= toxicity.LEAST_DOCS) & ~(many > toxicity.MOST_SHARE * np.bincount(y)[:, None]).all(0))
    s = (dense / (dense.sum(1, keepdims=True) + toxicity.SHRINK))[:, known]
    r = np.random.default_rng(7)
    emb = r.uniform(-1, 1, (toxicity.DIM, len(known))).T / toxicity.DIM
    out, b = r.uniform(-0.1, 0.1, (2, toxicity.DIM)), np.zeros(2)
    ge, go, gb = np.full(emb.shape, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    order = r.permutation(n)
    for step in range(toxicity.STEPS):
        at = order.take(np.arange(step * toxicity.BATCH, step * toxicity.BATCH + min(toxicity.BATCH, n)), mode="wrap")
        mean = s[at] @ emb
        p = np.exp(mean @ out.T + b)
        p /= p.sum(1, keepdims=True)
        p -= np.eye(2)[y[at]]
        p /= len(at)  # both classes are even here
        de, do, db = s[at].T @ (p @ out), p.T @ mean, p.sum(0)
        rate = toxicity.RATE * (1 - step / toxicity.STEPS)
        for x, g, d in ((emb, ge, de), (out, go, do), (b, gb, db)):
            g += d**2
            x -= rate * d / np.sqrt(g)
    assert np.allclose(add[known], emb @ (out[1] - out[0]), atol=2e-2, rtol=2e-2) and bias == pytest.approx(b[1] - b[0], abs=2e-2)


def plain_spans(rows):
    """Texts without covered sentences; sentences end in a full stop and have at most ORDINARY words."""
    split = {i: re.findall(r"[^.]+\.?\s*", t) for i, t in rows}
    runs = defaultdict(list)
    for i, parts in split.items():
        n = [len(p.split()) for p in parts]
        assert max(n) <= spans.ORDINARY
        for u in range(len(parts)):
            for ends in ([v for v in range(u + 3, len(parts) + 1) if sum(n[u:v]) >= 20][:1]):
                runs[" ".join(" ".join(parts[u:ends]).split()).lower()].append((i, u, ends))
        for v in range(len(parts), 2, -1):
            for u in ([u for u in range(v - 3, -1, -1) if sum(n[u:v]) >= 20][:1]):
                runs[" ".join(" ".join(parts[u:v]).split()).lower()].append((i, u, v))
    gone = defaultdict(set)
    for places in runs.values():
        for i, u, v in set(places) - {min(places)}:
            gone[i] |= set(range(u, v))
    return {i: "".join(p for k, p in enumerate(parts) if k not in gone[i]) for i, parts in split.items()}


def sentences(rng, n):
    return " ".join(" ".join(rng.choice(VOCABULARY, int(rng.integers(2, spans.ORDINARY + 1)))) + "." for _ in range(n))


def test_spans_against_every_run(spark):
    rng = np.random.default_rng(4)
    shared = [sentences(rng, 5) for _ in range(6)]
    rows = [(i, " ".join([sentences(rng, int(rng.integers(1, 6))), *rng.choice(shared, int(rng.integers(0, 4))), sentences(rng, int(rng.integers(1, 4)))])) for i in range(80)]
    want = plain_spans(rows)
    got = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(len(want[i]) < len(t) for i, t in rows) > 20


def test_ordinary_sentences_are_not_cut():
    rng = np.random.default_rng(5)
    text = " ".join(" ".join(rng.choice(VOCABULARY, 6)) + "." for _ in range(3000))
    data, offsets = textkit.utf8(pa.array([text]))
    words = textkit.Words(data, offsets)
    assert len(spans.Sentences(words, words.hashes()).edges) - 1 == 3000


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    rng = np.random.default_rng(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, 1), (1, b, 2), (1, a, 1), (2, a + " ton", 3), (3, c, 4), (None, a, 5), (None, a, 5)]
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect())
    assert got == sorted([("1", a, 1), ("1", b, 2), ("3", c, 4), ("None", a, 5), ("None", a, 5)])


def test_components_by_rounds_and_by_one_task(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(1000, 1020)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    rows = [sorted(map(tuple, components.components(df, one_task=n).collect())) for n in (components.ONE_TASK, 60, 0)]
    assert rows[0] == rows[1] == rows[2] and (1020, 1000) in rows[0]


def test_mixing_keeps_the_values_of_clashing_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i if i % 3 else None, prose(rng, 5 + i % 7), "ab"[i % 2], f"s{i}", i, 2.0 * i, f"t{i}", f"p{i}", i + 7, f"w{i}", f"c{i}", f"f{i}") for i in range(60)]
    names = ["doc_id", "text", "source", "size", "target", "taken", "_part", "_before", "_copy", "words", "copy", "finish"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target long, taken double, _part string, _before string, _copy long, words string, copy string, finish string").repartition(3)
    out = mixing.mix(docs)
    assert out.columns == names and out.dtypes == docs.dtypes
    whole = {r[3:]: r for r in rows}
    for r in out.collect():
        origin = whole[tuple(r)[3:]]
        assert (r.doc_id, r.source) == (origin[0], origin[2]) and origin[1].startswith(r.text)
    counts = mixing.mix_counts(docs).collect()
    assert len(counts) == 60 and sum(r.taken for r in counts) == sum(len(r.text.split()) for r in out.collect())


def test_mixing_order_is_that_of_finish_times(spark):
    """Every prefix of the mix holds sources near their shares of the targets."""
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, 20), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.targets(docs.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    got = [(r.source, len(r.text.split())) for r in mixing.mix(docs).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()]
    taken, done = Counter(), 0
    for source, n in got:
        taken[source] += n
        done += n
        assert all(abs(taken[s] - t * done / sum(target.values())) <= 45 for s, t in target.items())


def test_samples_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 5, 0, 10).collect()
    assert len(got) == 20 and len({r.doc_id for r in got}) == 20 and all(r.doc_id < 50 for r in got)


def test_packing_fills_and_balances():
    lengths = np.random.default_rng(9).integers(1, 1024, 600)
    p = packing.plan(lengths)
    cost = np.bincount(p[:, 3], packing.LINEAR * p[:, 2] + packing.QUADRATIC * p[:, 2] ** 2.0)
    size = np.bincount(p[:, 3], p[:, 2]).astype(int)
    whole = cost[size == 1024]
    assert whole.std() / whole.mean() < 0.05 and (size & (size - 1) == 0).all()


@pytest.mark.parametrize("change", [lambda t: t, lambda t: t.rstrip(".") + ",", lambda t: "(" + t.rstrip(".") + ")", lambda t: t.rstrip(".")])
def test_notices_with_other_ends(spark, change):
    rng = np.random.default_rng(10)
    rows = [(i, f"{prose(rng, 30)} {change(t)} {prose(rng, 30)}") for i, t in enumerate(licenses.NOTICES.values())]
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert all(name in got[i] for i, name in enumerate(licenses.NOTICES))


def test_foreign_images_do_not_stop_the_job(spark):
    own = media.encode([bytes(range(64))])[0]
    rows = [(1, own), (2, b"no image"), (3, None), (4, own.replace(b"blocks=1", b"strange!")), (5, own[:40])]
    got = {r.doc_id: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, media binary"), keep=("doc_id",)).collect()}
    assert got[1].payload_bytes == 64 and got[4].payload_bytes is None and got[4].feature == got[1].feature
    assert got[2].feature is None and got[2].media_bytes == 8 and got[3].media_bytes is None and got[5].feature is None


def test_texts_longer_than_any_chunk(spark):
    rng = np.random.default_rng(11)
    n = 260_000
    words = [f"{w}{k}" for w, k in zip(rng.choice(VOCABULARY, n), rng.integers(0, 900, n), strict=True)]
    text = " ".join(words) + " Released under the MIT License."
    assert len(text) > max(textkit.CHUNK_BYTES, textkit.SEGMENT_BYTES)
    docs = spark.createDataFrame([(1, text), (2, prose(rng, 50)), (9, text)], "doc_id long, text string").withColumn("source", F.lit("a")).cache()
    raw = text.encode()
    for r in media.media_features(media.with_media(docs)).where("doc_id <> 2").collect():
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()
    assert [(r.license, r.first_word) for r in licenses.scan(docs.where("doc_id = 1")).collect()] == [("MIT", n)]
    assert {r.doc_id: r.n_tokens for r in lm.score(docs).collect()}[1] == n + 6
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, 3, 90).collect()}
    every = [*words, "released", "under", "the", "mit", "license."]
    assert got[1] == got[9] == (len(set(zip(every, every[1:], every[2:], strict=False))), 1)
    left = {r.doc_id: r.text for r in spans.without_repeats(docs.select("doc_id", "text")).collect()}
    assert left[1] == text and len(left[9]) < 400
    assert sum(r.size for r in mixing.mix_counts(docs).collect()) == 2 * (n + 5) + 50


def test_stages_against_plain_versions(spark, tmp_path):
    rng = np.random.default_rng(12)
    base = [sentences(rng, 8) for _ in range(30)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i] + " ton.", "en", "a", 1) for i in range(6)] + [(200 + i, sentences(rng, 3) + " " + base[i + 10] + " " + sentences(rng, 9), "en", "b", 1) for i in range(6)]
    rows += [(300 + i, " ".join(["vileness"] * 30) + f" x{i}.", "en", "c", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    spark.createDataFrame([(i, int(i >= 300)) for i, *_ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = lambda n, df: corpus_pipeline.STAGES[n][1](spark, df, str(tmp_path))
    # 1: the model's weights over each text's subwords, one by one
    add, bias = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    bags = {rows[i][0]: (b, c) for i, b, c in toxicity._bags(pa.record_batch({"text": [r[1] for r in rows]}))}
    score = {i: 1 / (1 + math.exp(-(sum(float(add[x]) * int(y) for x, y in zip(b, c, strict=True)) / (int(c.sum()) + toxicity.SHRINK) + bias))) for i, (b, c) in bags.items()}
    kept = run(0, docs).collect()
    assert {r.doc_id for r in kept} == {i for i, s in score.items() if s < 0.7} and not any(r.doc_id >= 300 for r in kept)
    # 2: all pairs
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(len(w) - 4)} for r in kept}
    gone = {max(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    second = run(1, spark.createDataFrame(kept, docs.schema)).collect()
    assert {r.doc_id for r in second} == set(sets) - gone and gone == {100 + i for i in range(6)}
    # 3: all runs of sentences
    third = run(2, spark.createDataFrame(second, docs.schema)).collect()
    assert {r.doc_id: r.text for r in third} == plain_spans([(r.doc_id, r.text) for r in second])
    assert all(r.n_chars == len(r.text) for r in third if r.doc_id >= 200)
    # 4: each source's words of the mix
    mixed = run(3, spark.createDataFrame(third, docs.schema)).collect()
    held = Counter()
    for r in third:
        held[r.source] += len(r.text.split())
    level = sum(held.values()) / 6
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    due = {s: min(3 * held[s], level * (1 + i)) for i, s in enumerate("abc")}
    if all(level * (1 + i) <= 3 * held[s] for i, s in enumerate("abc")):
        assert all(abs(taken[s] - due[s]) <= 1 for s in "abc")
    # 5: every token in one place
    whole = run(4, spark.createDataFrame(mixed, docs.schema)).collect()
    slow = packing.encoder(None).slow
    assert sum(r.length for r in whole) == sum(len(slow.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    sizes = Counter()
    for r in whole:
        sizes[r.sequence_id] += r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes.values())
