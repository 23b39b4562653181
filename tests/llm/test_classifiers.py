import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import quality, toxicity
from lodeframe.llm import words as W
from lodeframe.llm.registry import fold, op7_toxicity, op8_quality

RUDE = [f"rude{i}" for i in range(6)]
BOTH = {"toxicity": toxicity, "quality": quality}


def rows(n=700, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.randrange(5, 80))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE).upper() + rng.choice(["", "!", ","]))
        if not good:
            w = [x + rng.choice(["###", "$$$", "%%"]) for x in w]
        docs.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = rows()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", BOTH)
def test_held_out_rows(labelled, name):
    docs, labels = labelled
    module, label = BOTH[name], "toxic" if name == "toxicity" else "quality"
    model = module.fit(docs, labels, learn=fold("id", 4) != 2)
    got = module.score(docs, model).join(labels, "doc_id").filter(fold("doc_id", 4) == 2).collect()
    assert len(got) > 100
    assert sum(r.predicted == r[label] for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = module.score(docs, module.fit(docs.repartition(5), labels.repartition(3), learn=fold("id", 4) != 2))
    assert {r.doc_id: r.score for r in again.collect() if r.doc_id % 9 == 0} == pytest.approx({r.doc_id: r.score for r in module.score(docs, model).collect() if r.doc_id % 9 == 0})


@pytest.mark.parametrize("name", BOTH)
def test_a_bounded_sample_is_enough(labelled, name):
    docs, labels = labelled
    module, label = BOTH[name], "toxic" if name == "toxicity" else "quality"
    got = module.score(docs, module.fit(docs, labels, most=90)).join(labels, "doc_id").collect()
    assert sum(r.predicted == r[label] for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("name", BOTH)
def test_any_rows(spark, docs, empty, clashing, labelled, corpus, name):
    module = BOTH[name]
    model = module.fit(*labelled)
    plain = module.score(docs, model)
    assert plain.columns == [*docs.columns, "score", "predicted"] and plain.count() == len(corpus)
    assert sorted(map(repr, plain.drop("score", "predicted").collect())) == sorted(map(repr, docs.collect()))
    got = module.score(clashing, model)
    assert got.columns == [*(c for c in clashing.columns if c not in ("score", "predicted")), "score", "predicted"]
    by = {r.doc_id: r.score for r in plain.collect() if r.doc_id is not None}
    assert {r.doc_id: r.score for r in got.collect() if r.doc_id is not None} == by
    no_text = [r.score for r in plain.collect() if not (r.text or "").strip()]
    assert len(set(no_text)) == 1 and 0 <= no_text[0] <= 1
    assert module.score(empty, model).collect() == []
    none = module.fit(empty, labelled[1])
    assert {r.score for r in module.score(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.score(docs, module.fit(docs, odd)).collect())


def test_features():
    raw, offsets = W.column_bytes(pa.array(["You, FOOL you", "", "you fool"]))
    doc, f = toxicity.features(raw, offsets)
    one, two = set(f[doc == 0].tolist()), set(f[doc == 2].tolist())
    assert len(f[doc == 0]) == 3 + 2 + 1 and not (doc == 1).any() and two < one


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(2)
    x = [np.unique(np.append(rng.integers(10, 1 << 12, 30), [3] if i % 4 == 0 else [])).astype(np.int64) for i in range(800)]
    y = np.array([float(i % 4 == 0) for i in range(800)])
    m = toxicity.ftrl(x, y, np.ones(800), bits=12)
    assert m.index[np.argmax(m.weight)] == 3 and len(m.index) < 200


def plain_ftrl(x, y, c, epochs, alpha, beta, l1, l2):
    """One coordinate at a time, in dictionaries."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(f):
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for row, label, w in zip(x, y, c, strict=True):
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = w * (1 / (1 + math.exp(-(bias + sum(weight(f) for f in row)))) - label)
            old = {f: weight(f) for f in row}
            for f in row:
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + g - sigma * old[f]
                n[f] = n.get(f, 0.0) + g * g
            sigma = (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha
            bz += g - sigma * bias
            bn += g * g
    return {f: weight(f) for f in z if weight(f)}, -bz / ((beta + math.sqrt(bn)) / alpha)


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(3)
    x = [np.unique(rng.integers(0, 60, 8)) for _ in range(300)]
    y, c = np.array([float(3 in r) for r in x]), rng.uniform(1, 3, 300)
    got = toxicity.ftrl(x, y, c, bits=6, epochs=3, alpha=0.7, beta=1.2, l1=2.0, l2=0.5)
    weights, bias = plain_ftrl([r.tolist() for r in x], y, c, 3, 0.7, 1.2, 2.0, 0.5)
    assert 0 < len(weights) < 60 and dict(zip(got.index.tolist(), got.weight.tolist(), strict=True)) == pytest.approx(weights)
    assert got.bias == pytest.approx(bias)


def test_scores_equal_a_plain_version(labelled):
    """A query's scores are the sigmoid of the bias and the weights of a text's words, pairs and skip pairs, each once."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    for r in toxicity.score(docs, model).limit(60).collect():
        raw, offsets = W.column_bytes(pa.array([r.text]))
        found = {int(f) for f in toxicity.features(raw, offsets)[1]}
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in found)))))


#: by toxic word another whose hash has the same leading 22 bits
CELL_MATES = {"rude0": "v1303763", "rude1": "v2762193", "rude2": "v1393688", "rude3": "v3223286", "rude4": "v682633", "rude5": "v10428904"}


def test_a_clean_text_isnt_marked_for_the_cells_of_its_words(spark, labelled):
    for pair in CELL_MATES.items():
        raw, offsets = W.column_bytes(pa.array([" ".join(pair)]))
        starts, ends, _ = W.spans(raw, offsets)
        one, two = W.word_hashes(raw, starts, ends)
        assert one >> np.uint64(42) == two >> np.uint64(42) and one != two
    docs, labels = labelled
    texts = [" ".join(f"w{j}" for j in range(i, i + 20)) for i in range(6)]
    clean = [(10_000 + i, " ".join([t, *CELL_MATES.values()])) for i, t in enumerate(texts)]
    toxic = [(20_000 + i, " ".join([t, *CELL_MATES])) for i, t in enumerate(texts)]
    seen = spark.createDataFrame([(1_000, "w1 w2 " + CELL_MATES["rude0"])], "doc_id long, text string")  # learnt from, too
    model = toxicity.fit(docs.select("doc_id", "text").union(seen), labels.union(spark.createDataFrame([(1_000, 1, 0)], labels.schema)))
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(clean + toxic, "doc_id long, text string"), model).collect()}
    without = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    assert {i: got[i].score for i, _ in clean} == pytest.approx(without)
    assert not any(got[i].predicted for i, _ in clean) and all(got[i].predicted for i, _ in toxic)


def test_clean_texts_stay_when_the_sample_holds_few_of_them(spark):
    """Of 40,000 labels 10 % are toxic; the sample has 1,500 of each."""
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(40_000):
        toxic = rng.random() < 0.1
        w = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.randrange(5, 60))]
        docs.append((i, " ".join([*w, *([f"rude{rng.randrange(150)}"] if toxic else [])])))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, most=1_500)).join(labels, "doc_id").collect()
    assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(got)
    assert sum(r.predicted for r in got if r.toxic) >= 0.95 * sum(r.toxic for r in got)


def test_the_sample_is_bounded_in_bytes(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, most_bytes=30_000)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)


def plain_boost(x, y, c, bins, rounds, rate, leaves=3, l2=1.0, least=2.0):
    """Cyclic boosting of each measure's lookup table, row by row and cut by cut."""
    share = (c * y).sum() / c.sum()
    base = math.log(share / (1 - share))
    cuts = [sorted({sorted(col)[int(math.floor((len(col) - 1) * i / bins))] for i in range(1, bins)}) for col in x.T.tolist()]
    tables = [[0.0] * (len(cut) + 1) for cut in cuts]
    bins_of = [[sum(v >= t for t in cut) for v in col] for cut, col in zip(cuts, x.T.tolist(), strict=True)]
    out = [base] * len(y)
    for _ in range(rounds):
        for f, table in enumerate(tables):
            p = [1 / (1 + math.exp(-o)) for o in out]
            g, h = [0.0] * len(table), [0.0] * len(table)
            for b, yy, cc, pp in zip(bins_of[f], y, c, p, strict=True):
                g[b] += cc * (yy - pp)
                h[b] += cc * pp * (1 - pp)
            parts = [(0, len(table))]
            while len(parts) < leaves:
                best = None
                for a, b in parts:
                    for k in range(a + 1, b):
                        if sum(h[a:k]) >= least and sum(h[k:b]) >= least:
                            gain = sum(g[a:k]) ** 2 / (sum(h[a:k]) + l2) + sum(g[k:b]) ** 2 / (sum(h[k:b]) + l2) - sum(g[a:b]) ** 2 / (sum(h[a:b]) + l2)
                            if gain > 0 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, a, k, b)
                if best is None:
                    break
                parts = [q for q in parts if q != (best[1], best[3])] + [(best[1], best[2]), (best[2], best[3])]
            for a, b in parts:
                for k in range(a, b):
                    table[k] += rate * sum(g[a:b]) / (sum(h[a:b]) + l2)
            step = {k: rate * sum(g[a:b]) / (sum(h[a:b]) + l2) for a, b in parts for k in range(a, b)}
            out = [o + step[b] for o, b in zip(out, bins_of[f], strict=True)]
    return out


def test_boosting_equals_a_plain_version():
    rng = np.random.default_rng(6)
    x = rng.random((240, 3)).round(2)
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0.4) + 0.2 * rng.random(240) > 0.8).astype(float)
    c = rng.uniform(1, 2, 240)
    m = quality.boost(x, y, c, bins=8, rounds=6, rate=0.3, pairs=0)
    assert m.raw_scores(x) == pytest.approx(plain_boost(x, y, c, 8, 6, 0.3))


def test_pair_tables_are_added():
    m = quality.Model(0.5, [np.array([1.0]), np.array([2.0])], [np.array([0.1, 0.2]), np.array([-0.1, 0.4])], [np.array([1.0]), np.array([2.0])], [(1, 0, np.array([[1.0, 2.0], [3.0, 4.0]]))])
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0], [9.0, 9.0]])
    assert m.raw_scores(x) == pytest.approx([0.5 + 0.1 - 0.1 + 1, 0.5 + 0.2 - 0.1 + 2, 0.5 + 0.1 + 0.4 + 3, 0.5 + 0.2 + 0.4 + 4])


@pytest.mark.parametrize("name", BOTH)
def test_very_long_texts(spark, labelled, name):
    module = BOTH[name]
    long = "word other " * 200_000
    docs = spark.createDataFrame([(1, long), (2, long + "rude1 " * 3), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = module.score(docs, module.fit(*labelled)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got) and got[0].text == long


def test_trees():
    g, h = np.array([-4.0, -4, 3, 3, 9, 9]), np.ones(6) * 4
    t = quality.shallow(g, h)
    assert len(set(t)) == 3 and t[0] == t[1] and t[2] == t[3] and t[4] == t[5]
    assert (quality.shallow(np.zeros(4), h[:4]) == 0).all()
    gain, v = quality.shallow_pair(np.array([[5.0, -5], [-5, 5]]), np.ones((2, 2)) * 4)
    assert gain > 0 and v[0, 0] > 0 > v[0, 1] and v[1, 1] > 0


def test_pairs_learn_what_measures_alone_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.boost(x, y, np.ones(3000))
    assert m.pairs and ((m.scores(x) > 0.5) == y).mean() > 0.9
    assert ((quality.boost(x, y, np.ones(3000), pairs=0).scores(x) > 0.5) == y).mean() < 0.7


def test_measures():
    texts = ["The cat sat.\nThe cat sat.", "", "### $$$", None, "aa aa aa 12"]
    raw, offsets = W.column_bytes(pa.array(texts))
    m = {n: c for n, c in zip(quality.NAMES, quality.measures(raw, offsets).T, strict=True)}
    assert np.expm1(m["log_words"]).round().tolist() == [6, 0, 2, 0, 4]
    assert m["distinct_lines"].tolist() == [0.5, 0, 1, 0, 1] and m["symbols"][2] == 1 and m["wordless"].tolist() == [0, 0, 1, 0, 0.25]
    assert m["same_as_last"].tolist() == [0, 0, 0, 0, 0.5] and m["distinct"].tolist() == [0.5, 0, 1, 0, 0.5]
    assert np.isfinite(quality.measures(raw, offsets)).all()


@pytest.mark.parametrize("query, n, out, label", [(op7_toxicity, 4, 2, "toxic"), (op8_quality, 5, 0, "quality")])
def test_queries(spark, query, n, out, label):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.dtypes[1:] == [("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows_ = got.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == out) for r in rows_)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows_ if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.85 * len(held)
