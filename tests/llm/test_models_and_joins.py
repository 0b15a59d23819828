"""Classifier, language model, near-duplicates, embeddings, pages and the pipeline, with brute-force versions."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cinnabar.llm import embed_join, host_rules, html_wrapper, lbl, minhash, quality_fm, secret_ledger
from cinnabar.llm.common import connected_components, salted_join, shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200, 300)] + [(0, i) for i in range(1, 60)] + [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(120)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [0, 20_000])
def test_salted_join(spark, how, most):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(None, 1), ("cold", 2)], "k string, x int")
    right = spark.createDataFrame([("hot", 9), ("other", 8)], "k string, y int")
    want = left.join(right, ["k"], how)
    got = salted_join(left, right, ["k"], how, most=most)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


# classifier


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        text = " ".join(r.choice(vocabulary) + ("" if good else r.choice(["%%%", "***", "&&&"])) for _ in range(r.randrange(5, 80)))
        rows.append((i, text, f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None, None), (1001, "", "src0", 0), (None, "w1 w2", "src1", 5), (1, rows[1][1], "src1", 3)]
    labels += [(5, None, 0), (None, 1, 0), (6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_documents(corpus):
    docs, labels = corpus
    out = quality_fm.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count()
    right = total = 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        i = r["doc_id"]
        if i is not None:
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if i is not None and i < 600 and r["held_out"]:
            total += 1
            right += r["predicted"] == int(i % 4 > 0)
    assert total > 80 and right / total > 0.97


def test_kept_documents_are_the_predicted_ones(corpus):
    docs, labels = corpus
    machine = quality_fm.learn(docs, labels)
    want = Counter(r["doc_id"] for r in quality_fm.score(docs, machine).where("predicted = 1").collect())
    named = docs.selectExpr("*", "'d' as doc", "'x' as `a.b`", "'r' as rank")
    out = quality_fm.kept(named, machine)
    assert out.columns == named.columns and Counter(r["doc_id"] for r in out.collect()) == want
    assert {(r["doc"], r["a.b"], r["rank"]) for r in out.collect()} == {("d", "x", "r")}
    assert quality_fm.kept(named.where("false"), machine).count() == 0


def test_the_sample_is_the_same_on_every_run_and_bounded(corpus):
    docs, labels = corpus
    s = quality_fm.Settings(sample=150, features=4000, epochs=1)
    a, b = quality_fm.learn(docs, labels, s), quality_fm.learn(docs.repartition(7), labels.repartition(3), s)
    assert a.bias == b.bias and (a.weight == b.weight).all() and (a.factor == b.factor).all()


def test_training_follows_the_gradient_of_the_logistic_loss():
    """A step on one batch against differences of the loss written as a double sum over pairs of features."""
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(60, 5, replace=False)), rng.normal(size=5).astype(np.float32), float(k % 2)) for k in range(6)]
    s = quality_fm.Settings(epochs=1, batch=6, decay=0.0, factors=3)
    before = quality_fm.fit([], s)
    mean = 0.5
    before.bias = math.log(mean / (1 - mean))
    after = quality_fm.fit(rows, s)

    def loss(w, v, bias):
        total = 0.0
        for index, value, y in rows:
            x = bias + sum(w[i] * a for i, a in zip(index, value, strict=True))
            x += sum(v[i] @ v[j] * a * b for k, (i, a) in enumerate(zip(index, value, strict=True)) for j, b in list(zip(index, value, strict=True))[:k])
            total += math.log1p(math.exp(-x)) + (1 - y) * x
        return total / len(rows)

    w, v = before.weight.astype(float), before.factor.astype(float)
    used = sorted({int(i) for r in rows for i in r[0]})
    for i in used[:8]:
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        g = (loss(up, v, before.bias) - loss(down, v, before.bias)) / 2e-5
        assert after.weight[i] - before.weight[i] == pytest.approx(-s.rate * g / math.sqrt(1e-4 + g * g), rel=2e-2, abs=1e-5)
        for f in range(3):
            up, down = v.copy(), v.copy()
            up[i, f] += 1e-5
            down[i, f] -= 1e-5
            g = (loss(w, up, before.bias) - loss(w, down, before.bias)) / 2e-5
            assert after.factor[i, f] - before.factor[i, f] == pytest.approx(-0.2 * s.rate * g / math.sqrt(1e-4 + g * g), rel=5e-2, abs=2e-5)
    unused = np.setdiff1d(np.arange(quality_fm.SIZE), used)
    assert (after.weight[unused] == 0).all() and (after.factor[unused] == before.factor[unused]).all()


def test_pairs_in_linear_time_equal_the_double_sum():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE).astype(np.float32), rng.normal(size=(quality_fm.SIZE, 4)).astype(np.float32))
    index, value = np.array([1, 40, 900, 4000]), np.array([1, 0.5, 2, 1], np.float32)
    want = 0.3 + m.weight[index] @ value + sum(m.factor[a] @ m.factor[b] * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[:i])  # noqa: B905
    assert m.margin(index, value) == pytest.approx(float(want), rel=1e-5)


def test_without_labels_the_score_is_one_half(corpus):
    docs, labels = corpus
    out = quality_fm.classify(docs, labels.where("false"))
    assert all(abs(r["score"] - 0.5) < 0.05 for r in out.collect())
    assert quality_fm.classify(docs.where("false"), labels).count() == 0


# language model


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        text = " ".join(x for _ in range(r.randrange(1, 30)) for x in (r.choice(["the", "a"]), r.choice(["cat", "dog", f"Rare{r.randrange(300)}"]), r.choice(["sat", "ran."])))
        rows.append((i, text))
    long = "x" * 100
    rows += [(1000, None), (1001, ""), (1002, f"unseen words é {long}z"), (None, "the cat"), (3, rows[3][1])] + [(2000 + i, f"{long} cat {long}y") for i in range(8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(6)
    s = lbl.Settings(frequent=50, least_count=4, vocabulary=30, endings=8, classes=6, steps=200, shard=2500, buffer=900, batch=64, block=16, tile=100)
    return rows, lbl.score(df, s).collect(), s, df


def words_(t):
    return [w.encode() for w in words(t)]


def test_words_are_split_at_the_six_spaces_only():
    texts = ["", " \t\n", "A b\x0bC\x0cd\re", " x\xa0y\u2003z\x85w\x1cv\x1f ÉÀ İ ", "one", "\x00 b  c ", "Tail "]
    found, whose = lbl.split(pa.array(texts))
    got = [found.dictionary[i].as_py() for i in found.indices.to_pylist()]
    assert [[w for w, k in zip(got, whose, strict=True) if k == i] for i in range(len(texts))] == [words_(t) for t in texts]


def test_base_scores(scored):
    rows, got, *_ = scored
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for t in train for x in [*words(t), " "])
    n, v = c.total(), len(c)
    want = Counter()
    for i, t in rows:
        tokens = [*words(t), " "]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)
        want[i, i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(c[x] > 0 for x in tokens), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_the_model_beats_the_base_on_held_out_documents(scored):
    _, got, *_ = scored
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_the_score_is_the_sum_of_normalised_token_probabilities(scored):
    rows, got, s, df = scored
    m, y, *_ = lbl.fit(df, s)
    train = Counter(x for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for x in [*words_(t), lbl.END])
    own = {w for w, k in y.number.items() if y.own[k]}
    assert len(own) > 20 and all(train[w] >= s.least_count or w == lbl.END for w in map(bytes, own) if len(w) <= 16)
    by_ending = {}  # the symbol of each ending
    for e in range(s.endings):
        by_ending[e] = int(y.symbol[~e])
    size = Counter(lbl.short(w) for w in train)
    mass = Counter()
    for w in size:
        if w not in own:
            mass[lbl.ending(w, s)] += train[w] + 1 if w in train else next(c for x, c in train.items() if lbl.short(x) == w) + 1

    def symbol(w):
        return int(y.symbol[y.number[w]]) if w in own else by_ending[lbl.ending(w, s)]

    def probability(near, far, at):
        h = m.context[near].astype(float) * m.mix[0] + m.context[far].astype(float) * m.mix[1]
        group = next(k for k in range(len(y.cut) - 1) if y.cut[k] <= at < y.cut[k + 1])
        first = [math.exp(h @ m.classes[k] + m.class_bias[k]) for k in range(len(y.cut) - 1)]
        second = {k: math.exp(h @ m.target[k] + m.bias[k]) for k in range(y.cut[group], y.cut[group + 1])}
        return first[group] / sum(first) * second[at] / sum(second.values())

    end = symbol(lbl.END)
    n = len(y.size)
    assert sum(probability(end, 3, k) for k in range(n)) == pytest.approx(1)
    for r, (_, t) in ((r, x) for r in got for x in dict.fromkeys(rows[::7] + rows[-14:]) if x[0] == r["doc_id"]):
        total, before = 0.0, [end, end]
        for x in [*words_(t), lbl.END]:
            w = lbl.short(x)
            total += math.log10(probability(before[1], before[0], symbol(w)))
            if w not in own:
                total += math.log10((train[x] + 1) / (mass[lbl.ending(w, s)] + 1))
            before = [before[1], symbol(w)]
        assert r["score"] == pytest.approx(total, rel=1e-4, abs=0.01)


def _symbols(size, cut):
    n = len(size)
    return lbl.Symbols({}, np.array(size), np.arange(n), np.array(size), np.array(cut), np.zeros(n), np.ones(n, bool))


def test_every_token_trains_and_is_counted():
    s = lbl.Settings(batch=16, steps=1)
    y = _symbols([50, 40, 3, 2, 1], [0, 1, 2, 5])
    row, at = lbl.contexts(np.array([2, 1, 1, 4, 1, 3]), np.array([0, 0, 0, 1, 3, 3]), 4, 0)
    assert row[at].tolist() == [2, 1, 1, 0, 4, 0, 0, 1, 3, 0] and row[at - 1].tolist() == [0, 2, 1, 1, 0, 4, 0, 0, 1, 3] and row[at - 2].tolist() == [0, 0, 2, 1, 0, 0, 0, 0, 0, 1]
    trainer = lbl.Trainer(lbl.start(y, s), y, s, 1)
    trainer.learn(row, at)
    trainer.learn(row, at)
    assert trainer.met.tolist() == [8, 6, 2, 2, 2]
    before = lbl.start(y, s)
    assert (trainer.m.target[2:] != before.target[2:]).any(1).all() and (trainer.m.context[:4] != before.context[:4]).any(1).all()
    assert (trainer.m.target[:2] == before.target[:2]).all()  # alone in their classes


def test_a_step_is_adagrad_on_the_noise_contrastive_loss():
    s = lbl.Settings(factors=3, class_noise=4, word_noise=2)
    y = _symbols([50, 40, 30, 9, 5, 4, 2, 1], [0, 1, 3, 8])
    rng = np.random.default_rng(4)
    model = lbl.Model(*(rng.normal(size=x.shape).astype(np.float32) for x in lbl.start(y, s).parts()))
    near, far, w = rng.integers(8, size=(3, 20))
    w.sort()
    trainer = lbl.Trainer(model, y, s, 1)
    trainer.rng, draws = np.random.default_rng(9), np.random.default_rng(9)
    sums = [np.full(x.shape, s.calm) for x in model.parts()]
    want = [x.astype(float) for x in model.parts()]
    for _ in range(2):
        trainer.step(near.astype(np.int32), far.astype(np.int32), w.astype(np.int32))
        noise = np.searchsorted(np.cumsum(trainer.group), draws.random(s.class_noise), "right")
        at = draws.random((len(w), s.word_noise))
        context, target, bias, classes, class_bias, mix = want
        grad = [np.zeros(x.shape) for x in want]
        for i, (a, b, x) in enumerate(zip(near, far, w, strict=True)):
            h, own, dh = context[a] * mix[0] + context[b] * mix[1], y.class_of[x], np.zeros(s.factors)
            lo, hi = trainer.total[y.cut[own]], trainer.total[y.cut[own + 1]]
            words = [x, *(int(np.searchsorted(trainer.total, lo + u * (hi - lo), "right")) - 1 for u in at[i])]
            for q, c, share, kept, each in ((3, 4, s.class_noise * trainer.group, True, [own, *noise]), (1, 2, s.word_noise * trainer.word, y.cut[own + 1] - y.cut[own] > 1, words)):
                for j, k in enumerate(each):
                    e = (1 / (1 + math.exp(-(h @ want[q][k] + want[c][k] - math.log(share[k])))) - (j == 0)) * kept
                    dh += e * want[q][k]
                    grad[q][k] += e * h
                    grad[c][k] += e
            grad[0][a] += dh * mix[0]
            grad[0][b] += dh * mix[1]
            grad[5] += dh * context[a], dh * context[b]
        for x, q, g in zip(want, sums, grad, strict=True):
            q += g * g
            x -= s.rate * g / np.sqrt(q)
    for got, x in zip(trainer.m.parts(), want, strict=True):
        assert np.allclose(got, x, atol=1e-4)


def test_probabilities_of_extreme_scores_are_normalised():
    x = np.array([[100, 99, 0], [-90, -91, -92], [0, 1, 2], [80, -80, 0]], np.float32)
    for rows in (x, x[1:3], x[2:3]):
        every = np.stack([lbl._log_softmax(rows.copy(), np.full(len(rows), k)) for k in range(3)], 1)
        want = rows - rows.max(1, keepdims=True).astype(float)
        assert np.allclose(every, want - np.log(np.exp(want).sum(1, keepdims=True)), atol=1e-5)


def test_a_symbol_is_averaged_over_the_shards_that_met_it():
    s = lbl.Settings(block=2, factors=3)
    y = _symbols([9, 8, 7, 6, 5], [0, 2, 5])
    rng = np.random.default_rng(2)
    models = [lbl.Model(*(rng.normal(size=x.shape).astype(np.float32) for x in lbl.start(y, s).parts())) for _ in range(2)]
    met = [np.array([1, 0, 4, 0, 0]), np.array([3, 0, 0, 2, 0])]
    rows = [(b, k, w, p * w[:, None]) for k in range(2) for b, w, p in lbl._pack(models[k], met[k], y, s)]
    level = list(lbl._sums([lbl._rows(rows[:3]), lbl._rows(rows[3:])]))
    before = lbl.start(y, s)
    got = lbl._merge(level[0].to_pylist(), before, s)
    a, b = models
    assert np.allclose(got.target[0], (a.target[0] + 3 * b.target[0]) / 4, atol=1e-6)
    assert np.allclose(got.context[2], a.context[2]) and np.allclose(got.bias[3], b.bias[3])
    assert (got.target[[1, 4]] == before.target[[1, 4]]).all()
    assert np.allclose(got.classes[1], (4 * a.classes[1] + 2 * b.classes[1]) / 6, atol=1e-6) and np.allclose(got.mix, (a.mix + b.mix) / 2, atol=1e-6)


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lbl.score(df).count() == 0


# near-duplicate documents


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b):
    return bool(a) and 100 * len(a & b) >= 85 * len(a | b)


@pytest.fixture(scope="module")
def copies(spark):
    r = random.Random(7)
    word = lambda: f"v{r.randrange(4000)}"
    rows = []
    base = [[word() for _ in range(r.randrange(3, 200))] for _ in range(60)]
    for i in range(400):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 8])):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    chain = [word() for _ in range(120)]
    for i in range(400, 440):  # each is near the next, the ends are far apart
        chain[(3 * i) % 120] = word()
        rows.append((i, " ".join(chain)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one two"), (504, "ONE\tTWO"), (505, "one"), (None, rows[0][1]), (3, rows[3][1]), (9, rows[3][1])]
    return rows, spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, node string, comp int")


def test_near_duplicates(copies):
    rows, df = copies
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingle_set(t))
    known = [i for i in sets if i is not None]
    edges = [(a, b) for k, a in enumerate(known) for b in known[:k] if any(linked(x, y) for x in sets[a] for y in sets[b])]
    comp = components(known, edges)
    got = minhash.near_duplicates(df).collect()
    want = Counter((i, len(shingle_set(t)), comp.get(i), i is None or comp[i] == i) for i, t in rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_small_units_give_the_same_links(copies):
    _, df = copies
    key = lambda out: sorted(map(repr, out.collect()))
    assert key(minhash.near_duplicates(df, minhash.Settings(chunk=3, set_chunk=2, hot=2))) == key(minhash.near_duplicates(df))


def test_one_of_each(copies):
    rows, df = copies
    kept = {r["doc_id"] for r in minhash.near_duplicates(df).where("kept").collect()}
    named = df.selectExpr("doc_id", "text", "node", "comp", "'keepme' as _id", "'s' as _salt", "'dot' as `a.b`", "'doc' as doc", "'id' as id", "map('k', 1) as m")
    for s in (minhash.Settings(), minhash.Settings(broadcast_ids=0)):
        out = minhash.one_of_each(named, s)
        assert out.columns == named.columns
        got = out.collect()
        assert Counter(r["doc_id"] for r in got) == Counter({i: 1 for i in kept})
        assert {(r["_id"], r["_salt"], r["a.b"], r["doc"], r["id"], r["m"]["k"]) for r in got} == {("keepme", "s", "dot", "doc", "id", 1)}
        assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    assert minhash.one_of_each(named.where("false")).count() == 0


def test_a_bucket_with_one_large_group_deals_it_out_once(spark):
    """A group's copies number as the chunks of the others in its bucket, and every pair across meets once."""
    members = spark.createDataFrame([(7, i, 0) for i in range(100)] + [(7, 1000 + i, i % 3 + 1) for i in range(8)] + [(8, 1, 0)], "bh long, node long, comp long")
    s = minhash.Settings()
    both = minhash.hot_join(members, minhash.facts(members), minhash.F.col("n_main") > 50)
    units = {}
    for r in minhash.units(both, 10, "node", "comp").collect():
        units.setdefault(r[:3], []).append(r)
    assert all(len(u) <= 40 for u in units.values()) and s.chunk
    met = Counter()
    for (_, lo, hi), u in units.items():
        left = u if lo == hi else [r for r in u if r[3]]
        right = u if lo == hi else [r for r in u if not r[3]]
        met.update({frozenset((x[4], y[4])) for x in left for y in right if x[5] != y[5]})
    nodes = [(i, 0) for i in range(100)] + [(1000 + i, i % 3 + 1) for i in range(8)]
    assert met == Counter(frozenset((a, b)) for a, p in nodes for b, q in nodes if a < b and p != q)
    assert sum(r[4] < 100 for u in units.values() for r in u) == 100
    assert not any(r[0] == 8 for u in units.values() for r in u)


def test_short_sets_are_dealt_in_larger_chunks_and_long_ones_are_not(spark):
    """600 members of one group and 600 others make 3 chunks each of 256, one of 1747."""
    s, rows = minhash.Settings(), {}
    for longest in (150, 20_000):
        members = spark.createDataFrame([(7, i, 0, longest) for i in range(600)] + [(7, 1000 + i, i + 1, 150) for i in range(600)], "bh long, node long, comp long, longest long")
        both = members.drop("longest").join(minhash.facts(members, "longest"), "bh")
        rows[longest] = minhash.units(both, minhash.by_set(s), "node", "comp").count()
    assert rows == {150: 1200, 20_000: 600 * 6 + 600 * 3}
    small = spark.createDataFrame([(7, i, i % 3, 150) for i in range(200)], "bh long, node long, comp long, longest long")
    assert minhash.units(small.drop("longest").join(minhash.facts(small, "longest"), "bh"), minhash.by_set(s), "node", "comp").count() == 200
    n = spark.createDataFrame([(k,) for k in (1, 4096, 8000, 100_000)], "n long")
    assert [r[0] for r in n.select(minhash.by_sketch(s)(minhash.F.col("n"))).collect()] == [1024, 2048, 4000, 8192]


def test_shared_shingles_of_many_and_few(spark):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(80)]
    rows = [(*range(9), x.tobytes()) for x in sets]
    for shared in (minhash.Shared(rows), minhash.Shared(rows, most=10)):
        for k in range(80):
            for others in ([*range(80)], [*range(k, 80, 7)]):
                assert shared(rows[k], [rows[i] for i in others]).tolist() == [len(np.intersect1d(sets[k], sets[i])) for i in others]


def test_tables_that_nothing_reads_again_are_removed(spark):
    at = Path(shared_dir(spark).removeprefix("file:"))
    before = set(at.glob("*")) if at.exists() else set()
    got = minhash.near_duplicates(spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r {'s' * (i % 2)}") for i in range(6)], "doc_id long, text string"))
    left = {p.name.rpartition("-")[0] for p in set(at.glob("*")) - before}
    assert left and not left & {"fingerprints", "nodes", "members", "texts", "labelled", "sketches", "sets"}
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == [0] * 6


def test_long_texts_and_hot_buckets_give_the_same_links(spark):
    r = random.Random(8)
    base = [f"v{r.randrange(10**6)}" for _ in range(30_000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "more"])), (2, " ".join(base[:20_000]))]
    short = [f"u{i}" for i in range(60)]
    rows += [(10 + i, " ".join([*short, f"e{i}"])) for i in range(60)]  # all in the same buckets
    rows += [(200 + i, " ".join([*short[:50], *(f"f{i}{k}" for k in range(12))])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    for s in (minhash.Settings(), minhash.Settings(hot=3, chunk=4, set_chunk=4)):
        assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df, s).collect()} == want


def test_signatures_estimate_the_similarity():
    r = random.Random(9)
    a = [f"x{r.randrange(10**6)}".encode() for _ in range(500)]
    b = a[:400] + [f"y{i}".encode() for i in range(100)]
    x, y = minhash.shingles(a, 5), minhash.shingles(b, 5)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert (minhash.signature(x, 4096) == minhash.signature(y, 4096)).mean() == pytest.approx(true, abs=0.04)


# embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.3, 1.0])]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, [2 * x for x in rows[5][1]]), (2001, None), (2002, []), (2003, [0.0] * 24), (2004, [float("nan")] * 24), (2005, [None] * 24), (2006, [float("inf")] + [1.0] * 23), (2007, [1.0, 2.0]), (2008, [2.0, 4.0]), (2009, [1.0]), (2010, [3.0]), (7, rows[7][1])]
    rows += [(2011, [x * 1e-250 for x in rows[5][1]]), (2012, [x * 1e250 for x in rows[5][1]]), (2013, [5e-324, 0.0]), (2014, [1.0, 0.0])]
    fit = lambda v: np.array(v) / max(abs(x) for x in v)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = {k: fit(v) for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links, edges = Counter(), []
    for a, x in fine.items():
        for b, y in fine.items():
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    place = components(range(len(rows)), edges)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[place[k]] = min(least.get(place[k], i), i)
    want = Counter((i, links[k], least[place[k]], least[place[k]] == i) for k, (i, _) in enumerate(rows))
    for s in (embed_join.Settings(), embed_join.Settings(chunk=16, tile=8, blocks=6, axes=2)):
        got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_join.near_duplicates(df, s).collect())
        assert got == want
    assert embed_join.near_duplicates(df.where("false")).count() == 0


def test_a_pair_of_cells_within_reach_meets_once():
    rng = np.random.default_rng(1)
    y, radius = rng.normal(size=(400, 3)), 0.4
    homes, probes = {}, {}
    for k, (rows, cells) in enumerate(embed_join.reached(y, radius)):
        for i, c in zip(rows.tolist(), map(tuple, cells.tolist()), strict=True):
            (probes if k else homes).setdefault(c, []).append(i)
    met = Counter()
    for c, own in homes.items():
        met.update(frozenset((a, b)) for k, a in enumerate(own) for b in own[:k])
        met.update(frozenset((a, b)) for a in own for b in probes.get(c, ()))
    near = {frozenset((a, b)) for a in range(400) for b in range(a) if np.square(y[a] - y[b]).sum() <= radius**2}
    assert near <= set(met) and max(met.values()) == 1


# pages


def page(title, blocks, extra=""):
    nav = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a < b) document.write('</p>');</script><style>p{{}}</style></head><body><header><h1>Site</h1></header>{nav}<div class='cookie-notice'>We use cookies</div><div class=content>{''.join(blocks)}</div>{extra}<div><p>All rights reserved by the owners of this site.</p></div><footer>&copy; us</footer></body></html>"


def test_pages(spark):
    body = [f"<p>Paragraph {i} &amp; <b>more</b>\n  text &lt;{i}&gt;&nbsp;here<br>and on" for i in range(5)]
    rows = [(i, f"http://Host.example/{i}", page(f"T{i}", [f"<h2>Title {i}</h2>", *body[: 1 + i % 5], f"<p>Unique {i}</p>"], "<section id=comments><p>first!</p></section><aside>ads</aside><form><p>Name</p><input></form>")) for i in range(8)]
    article = "<body><nav><a href=x>x</a></nav><p>outside</p><article><h1>A &amp; B</h1><p>one<p>two <i>three</i><div class='ad'>buy</div><header>in</header><ul><li>l1<li>l2</ul><footer>by</footer></article><p>after"
    rows += [(100, "https://single.example/x?y#z", article), (101, None, "<p>no host"), (102, "not a url", None), (103, "http://e.example/", ""), (104, "http://e.example/", "plain &eacute; text"), (100, "https://single.example/x?y#z", article), (None, "http://e.example/", "<div hidden>no</div><table><tr><td>c1<td>c2</table><!-- <p>no -->"), (105, "http://d.example/", "<div>" * 3000 + "deep"), (106, "http://f.example/", "<div class=site-header>top</div><article data-hidden=1 title='a hidden id=ad'><div class='post-header'><h1>T</h1></div><p style='display: none'>no<p>yes</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_wrapper.extract(df).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    for i in range(8):
        want = [f"Title {i}", *(f"Paragraph {k} & more text <{k}> here and on" for k in range(1 + i % 5)), f"Unique {i}"]
        assert got[i] == "\n".join(want)
    assert got[100] == "A & B\none\ntwo three\nin\nl1\nl2"
    assert (got[101], got[102], got[103], got[104], got[None]) == ("no host", "", "", "plain é text", "c1\nc2")
    assert got[105] == "deep" and got[106] == "T\nyes"
    assert html_wrapper.extract(df.where("false")).count() == 0


def test_copies_take_one_place_of_a_sample():
    rows = [("h", 1, "copy")] * 20 + [("h", 2 + i, f"page {i}") for i in range(20)] + [("h", 1, "copy")] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "hash", "html"])
    got = [k for out in html_wrapper._smallest(html_wrapper.Settings())([batch]) for k in out.column(1).to_pylist()]
    assert sorted(got) == list(range(1, 9))


def test_deep_pages_take_the_same_path(spark):
    deep = "<title>T</title><nav><a href=x>menu</a></nav><script>var x = 1</script>" + "<div>" * 20_000
    df = spark.createDataFrame([(i, "http://h.example/", f"{deep}<p>main text {i}<footer>foot</footer><p>more{i}") for i in range(3)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_wrapper.extract(df).collect()} == {i: f"main text {i}\nmore{i}" for i in range(3)}


def test_all_pages_make_the_wrapper(spark):
    rows = [(f"h{i % 3}.example", f"<body><div class=k{'abcdefghijklmnopqrstuvwxyz'[i % 26]}><p>Text {i}</div>{'<ul><li>x</ul>' * (i % 2)}") for i in range(130)]
    df = spark.createDataFrame(rows, "host string, html string")
    got = {r["host"]: json.loads(r["wrapper"]) for r in html_wrapper.wrappers(df, html_wrapper.Settings()).collect()}
    again = html_wrapper.wrappers(df.repartition(7, "html"), html_wrapper.Settings()).collect()
    assert {r["host"]: json.loads(r["wrapper"]) for r in again} == got and len(again) == 3
    for host, source in rows:
        slots = html_wrapper.align(html_wrapper.page(source)[0], html_wrapper.unpack(got[host]), False)
        assert all(x.key is not None for x in slots)


def test_hidden_on_one_page_only(spark):
    rows = [(i, "http://h.example/", f"<body><div{' hidden' * (i % 5 == 2)}><p>Text {i}</div><div class=y><p>More {i}</div>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"More {i}" if i % 5 == 2 else f"Text {i}\nMore {i}" for i in range(20)}


def texts_of(source):
    return [b[2] for b in html_wrapper.page(source)[1]]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p title=it's>hello one</p><p>two</p><p>don't three</p><p>four</p>", ["hello one", "two", "don't three", "four"]),
        ("<p a='x>y' b=\"<q>\">in</p>", ["in"]),
        ("<p c='never closed>in<p>more", ["in", "more"]),
        ("1 < 2 <3 </ x><p>a<!-- <p>b --><p>c<!d><?e?>", ["1 < 2 <3", "a", "c"]),
        ("<p>kept<p>also<a href=", ["kept", "also"]),
        ("<title>t</title><script>if (a < b) x('<p>')</script><p>in<script>open", ["in"]),
    ],
)
def test_tags_are_read_as_browsers_read_them(source, want):
    assert texts_of(source) == want


@pytest.mark.parametrize("source", ["<a" * 500_000, "<p>x</p><h2>y</h2>" * 60_000, "<a b='\"" * 200_000, "<noscript>" * 100_000, "<!--" * 250_000, "<blockquote>" * 30_000 + "</x>" * 60_000 + "<li></li>" * 30_000, "<" * 1_000_000])
def test_a_page_of_a_megabyte_takes_seconds(source):
    began = time.monotonic()
    html_wrapper.page(source)
    assert time.monotonic() - began < 10


def test_a_long_page_of_unlike_siblings_takes_seconds():
    r = random.Random(1)
    pages = ["".join(f"<div class={'abcdefg'[r.randrange(7)]}><p>{i}</p></div>" for i in range(6000)) for _ in range(2)]
    began = time.monotonic()
    root = html_wrapper.induce(pages)
    assert time.monotonic() - began < 30 and len(root.children) > 100


def random_tree(r, depth=3):
    return html_wrapper.Tree(r.choice("ab"), False, [random_tree(r, depth - 1) for _ in range(r.randrange(4))] if depth else [])


def as_slot(x):
    return html_wrapper.Slot(x.label, False, [as_slot(c) for c in x.children])


def most_shared(x, y):
    """The definition of simple tree matching, without sharing any work."""
    if x.label != y.label:
        return 0

    def best(a, b):
        if not a or not b:
            return 0
        return max(best(a[1:], b), best(a, b[1:]), best(a[1:], b[1:]) + most_shared(a[0], b[0]))

    return 1 + best(x.children, y.children)


@pytest.mark.parametrize("seed", range(40))
def test_matching_shares_the_most_nodes(seed):
    r = random.Random(seed)
    x, y = random_tree(r), random_tree(r)
    y.label = x.label
    slot, known = as_slot(y), {}

    def shared(a, b):
        pairs = html_wrapper.match(a, b, known)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert all(a.children[i].label == b.children[j].label for i, j in pairs)
        return 1 + sum(shared(a.children[i], b.children[j]) for i, j in pairs)

    assert shared(x, slot) == most_shared(x, y)


def test_matching_within_the_band(monkeypatch):
    monkeypatch.setattr(html_wrapper, "BAND", 4)
    for seed in range(60):
        r = random.Random(seed)
        a = [html_wrapper.Tree(r.choice("abc"), False, []) for _ in range(r.randrange(5, 30))]
        b = [html_wrapper.Slot(r.choice("abc"), False) for _ in range(r.randrange(5, 30))]
        pairs = html_wrapper.match(html_wrapper.Tree("x", False, a), html_wrapper.Slot("x", False, b), {})
        rows = html_wrapper.band(len(a), len(b))
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                fits = i and j and j - 1 in rows[i - 1] and a[i - 1].label == b[j - 1].label
                best[i, j] = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0), best.get((i - 1, j - 1), 0) + 1 if fits else 0)
        assert len(pairs) == best[len(a), len(b)] and all(j in rows[i] and a[i].label == b[j].label for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_siblings_that_repeat_in_turn_count_once():
    leaf = lambda c: html_wrapper.Tree(c, False, [])
    for text, want in [("aaaa", "a"), ("ababab", "ab"), ("abcabcabd", "abcabd"), ("aabaab", "ab"), ("abcd", "abcd"), ("", "")]:
        kept, at = html_wrapper.once([leaf(c) for c in text])
        assert "".join(x.label for x in kept) == want and "".join(kept[k].label for k in at) == text


def test_a_text_on_some_pages_is_template(spark):
    notice = lambda i: "<div class=x><p>Get the paper</div>" if i % 10 == 0 else ""
    rows = [(i, "http://h.example/", f"<body>{notice(i)}<div><p>Text {i}</div>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}" for i in range(60)}


def test_what_near_copies_share_is_their_own(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    copy = lambda i: f"<h1>Common title</h1><p>{text(0)} edit{i}<p>{text(1)}"
    rows = [(i, "http://h.example/", f"<body><nav>Menu</nav><div class=x>Get the paper</div><article>{copy(i) if i < 20 else f'<h1>T{i}</h1><p>{text(i)}'}</article>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Common title\n{text(0)} edit{i}\n{text(1)}" if i < 20 else f"T{i}\n{text(i)}" for i in range(60)}


def test_template_inside_an_article(spark):
    rows = [(i, "http://h.example/", f"<body><article><p>Text {i}<div class=x>Get the paper</div><p>More {i}</article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}\nMore {i}" for i in range(12)}


# pipeline


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(500)}"
    good = [" ".join(word() for _ in range(r.randrange(30, 120))) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, t + " end", "en", "s1", len(t) + 4) for i, t in enumerate(good[:10])]
    rows += [(300 + i, " ".join(f"{word()}%%%" for _ in range(40)), "en", "s2", 1) for i in range(20)]
    rows += [(400, "too short", "en", "s0", 9), (401, good[50] + " token = abcdef123456", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality rules":
            assert set(after) == {r["doc_id"] for r in host_rules.judge(spark.read.parquet(str(tmp_path / "documents.parquet"))).where("kept").collect()}
            assert set(range(120)) <= set(after) and not set(range(300, 401)) & set(after)
        elif name == "quality classifier":
            assert set(range(120)) <= set(after)
        elif name == "near duplicates":
            sets = {i: shingle_set(t) for i, t in before.items()}
            comp = components(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
            assert set(after) == set(comp.values())
        else:
            assert set(after) == set(before) and all("abcdef123456" not in t for t in after.values())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(after)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    r = random.Random(13)
    text = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(40))
    long = " ".join(f"w{i * i % 399991}" for i in range(60_000))
    same = text()
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(60)]
    rows += [(60, None, None, None), (61, "", "en", "s1"), (None, text(), "en", "s0"), (None, same, None, None), (62, long, "de", "s2"), (7, rows[7][1], "en", "s1"), (7, rows[7][1], "en", "s1"), (63, same, "en", "s0"), (64, same + " token = abcdef9876", "en", "s0")]
    schema = "doc_id long, text string, lang string, source string"
    extra = ["_id", "_sha", "_spans", "_new", "_salt", "doc", "host", "rank", "a.b"]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as bigint) as n_chars", *(f"'{c}!' as `{c}`" for c in extra))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / "some" / f"{name}.parquet"))
        df.where("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    at = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = at
        at = f(spark, at, str(tmp_path / "some"))
        assert at.columns == docs.columns
        at = minhash.stage(at, "pipeline-test")
        got = at.collect()
        assert all(x[c] == f"{c}!" for x in got for c in extra), name
        ids = Counter(x["doc_id"] for x in got)
        if name == "quality rules":
            assert not {60, 61} & set(ids) and ids[7] == 3 and ids[None] == 2 and ids[62] == 1
        elif name == "near duplicates":
            assert ids[7] == 1 and ids[None] == 2 and ids[63] == 1 and not ids[64]
        else:
            assert len(got) == before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, "").groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {x["doc_id"] for x in pieces} == set(ids)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_the_entry_registers_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    assert secret_ledger.BASE and set(entry.oracle_sql()) <= set(names)
