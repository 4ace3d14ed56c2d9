import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import language_model, quality, toxicity
from tests.llm.conftest import prose


VILE = [f"{a}vile{b}" for a in "bcdfg" for b in "klmn"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        bad, low = i % 5 == 0, i % 4 == 1
        words = prose(rng, rng.randint(30, 120)).split() + [f"w{rng.randint(0, 400)}" for _ in range(20)]
        if bad:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(VILE))
        text = " ".join(w + "!!" if low else w for w in words)
        docs.append((i, text))
        labels.append((i, int(not low), int(bad)))
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 0), (0, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(df, labels, column):
    truth = labels.where("doc_id < 400").groupBy("doc_id").agg(F.max(column).alias("y"))
    rows = df.where("held_out").join(truth, "doc_id").select("predicted", "y").collect()
    return sum(r["predicted"] == r["y"] for r in rows) / len(rows)


def test_toxicity_on_held_out_rows(labelled, stored):
    docs, labels = labelled
    assert accuracy(toxicity.score_documents(docs, labels), labels, "toxic") > 0.9
    edge = toxicity.score_documents(stored, labels).collect()
    assert len(edge) == stored.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs.limit(5), labels.limit(0)).count() == 5
    assert toxicity.clean(stored, labels).columns == stored.columns


def test_common_evidence_counts(spark):
    """A third of the rows are copies of one toxic text, and another third shares its words one by one: still told."""
    rng = random.Random(21)
    vile = prose(rng, 40) + " " + " ".join(VILE)
    docs = [(i, vile if i % 3 == 0 else prose(rng, 60) + " " + (" ".join(rng.sample(VILE, 4)) if i % 3 == 1 else "")) for i in range(600)]
    labels = [(i, 1, int(i % 3 < 2)) for i in range(600)]
    found = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [r for r in found.collect() if r["held_out"]]
    assert all(r["evidence"] for r in rows if r["doc_id"] % 3 < 2)
    assert sum(r["predicted"] == (r["doc_id"] % 3 < 2) for r in rows) >= 0.95 * len(rows)


def test_rare_kinds_of_toxicity(spark):
    """Forty kinds of toxic text, each with words of its own in fewer than 1 % of the examples."""
    rng = random.Random(22)
    docs = [(i, prose(rng, 60) + (f" {chr(97 + i % 20)}{chr(97 + i % 40 // 20)}ish" * 2 if i < 400 else "")) for i in range(1600)]
    labels = [(i, 1, int(i < 400)) for i in range(1600)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.score_documents(docs, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] for r in rows if r["doc_id"] < 400) >= 0.9 * len([r for r in rows if r["doc_id"] < 400])
    assert sum(r["predicted"] for r in rows if r["doc_id"] >= 400) <= 0.02 * len(rows)


def test_neighbours_are_exact(labelled):
    docs, labels = labelled
    index = toxicity.fit(docs, toxicity.training_labels(labels))
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", None, "unknown"]
    n, v = len(index.labels), len(index.vocabulary)
    dense = np.zeros((n, v))
    for t in range(v):
        dense[index.example[index.first[t] : index.first[t + 1]], t] = index.weight[index.first[t] : index.first[t + 1]]
    v = toxicity.vectors(texts, index.vocabulary, index.idf)
    text, who, cosine = index.neighbours(v, 7)
    for i in range(len(texts)):
        at, w = v.row(i)
        want = dense[:, at] @ w if len(at) else np.zeros(n)
        best = sorted(((-c, e) for e, c in enumerate(want) if c > 1e-12))[:7]
        assert np.allclose(cosine[text == i], [-c for c, _ in best]) and np.allclose(want[who[text == i]], cosine[text == i])


def test_toxicity_scores_by_brute_force(labelled, monkeypatch):
    """Weights, neighbours, votes, curve and scores written out plainly, over all examples at once; a smaller index storage changes nothing."""
    docs, labels = labelled
    allowed = {}
    for r in toxicity.training_labels(labels).collect():
        if r["doc_id"] is not None and r["label"] is not None:
            allowed[r["doc_id"]] = min(r["label"], allowed.get(r["doc_id"], 1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stems = lambda t: Counter(x for w in re.findall(r"[a-z]+", t.lower()) for x in [w, *((w[:s], s) for s in toxicity.STEMS if len(w) > s)])
    bags = {d: stems(t) for d, t in texts.items()}
    examples = sorted(d for d in allowed if d in texts)
    y = np.array([allowed[d] for d in examples])
    df = Counter(t for b in bags.values() for t in b)
    inside = Counter(t for d in examples for t in bags[d])
    toxic = Counter(t for d in examples if allowed[d] for t in bags[d])
    n, k = len(examples), int(y.sum())

    def weight(t):
        spread = inside[t] * (n - inside[t]) * k * (n - k)
        chi = (toxic[t] * n - inside[t] * k) ** 2 * n / spread if spread else 0.0
        return math.log((len(texts) + 1) / (df[t] + 0.5)) * (chi + 1) / (chi + toxicity.HALF)

    def unit(bag):
        v = {t: weight(t) * (1 + math.log(c)) for t, c in bag.items() if t in inside}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    units = {d: unit(bags[d]) for d in texts}

    def odds(d, leave=None):
        cosines = sorted(((sum(x * units[e].get(t, 0.0) for t, x in units[d].items()), allowed[e]) for e in examples if e != leave), reverse=True)[: toxicity.NEIGHBOURS]
        yes, no = (sum(c * c for c, label in cosines if label == z and c > 0) for z in (1, 0))
        smooth = 0.05 * (yes + no) + 1e-4
        return math.log((yes + smooth) / (no + smooth))

    slope, level = toxicity._logistic(np.array([odds(d, d) for d in examples]), y, np.ones(n))
    want = {d: 1 / (1 + math.exp(-(slope * odds(d) + level))) for d in texts}
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    assert max(abs(got[d] - want[d]) for d in want) < 1e-6
    monkeypatch.setattr(toxicity, "WHOLE", 3)
    monkeypatch.setattr(toxicity, "STEP", 7)
    few = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    assert max(abs(got[d] - few[d]) for d in want) < 1e-9


def test_a_sample_smaller_than_the_labels(labelled):
    """More labelled rows than the bound: the sample is the first of each label by hash order, and still tells."""
    docs, labels = labelled
    index = toxicity.fit(docs, toxicity.training_labels(labels), per_label=20)
    assert np.bincount(index.labels).tolist() == [20, 20]
    score = toxicity.scored(docs, index)["score"]
    rows = docs.select("doc_id", (score >= 0.5).cast("int").alias("predicted"), F.lit(True).alias("held_out"))
    assert accuracy(rows, labels, "toxic") > 0.85


def test_quality_on_held_out_rows(labelled, stored):
    docs, labels = labelled
    assert accuracy(quality.score_documents(docs, labels), labels, "quality") > 0.95
    edge = quality.score_documents(stored, labels).collect()
    assert len(edge) == stored.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert all(r["score"] > 0.999 for r in quality.score_documents(docs.limit(5), labels.limit(0)).collect())
    assert quality.clean(stored, labels).columns == stored.columns


def test_quality_by_brute_force(labelled):
    """Weights that plain gradient descent finds for the same pairs, the quantile's threshold, and the scores."""
    docs, labels = labelled
    allowed = {}
    for r in quality.training_labels(labels).collect():
        if r["doc_id"] is not None and r["label"] is not None:
            allowed[r["doc_id"]] = min(r["label"], allowed.get(r["doc_id"], 1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(d for d in allowed if d in texts)
    y = np.array([allowed[d] for d in ids])
    x = np.stack([quality.features(texts[d]) for d in ids])
    centre, scale = x.mean(0), x.std(0) + 1e-6
    wide = lambda v: np.concatenate([z := np.clip((v - centre) / scale, -6, 6), z**2], -1)
    good, bad = wide(x[y == 1]), wide(x[y == 0])
    picks = np.random.default_rng(0).integers(len(good), size=min(quality.PAIRS, len(good)) * len(bad))
    d = good[picks] - bad[np.arange(len(picks)) % len(bad)]
    model = quality.fit(docs, quality.training_labels(labels))
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 0.5e-2 * (w @ w)
    slope = lambda w: -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) + 1e-2 * w
    w = np.zeros(d.shape[1])
    for _ in range(20_000):
        w -= 0.05 * slope(w)
    assert np.abs(slope(model.weights)).max() < 1e-5 and abs(loss(w) - loss(model.weights)) < 1e-4
    s = np.sort(wide(x) @ model.weights)
    low = int((y == 0).sum())  # so many texts stay below the threshold
    threshold = (s[low - 1] + s[low]) / 2
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    for i, t in texts.items():
        strength = float(wide(quality.features(t)) @ model.weights)
        want = 1 / (1 + math.exp(-min(30, max(-30, model.slope * (strength - threshold) + math.log(quality.CUT / (1 - quality.CUT))))))
        assert math.isclose(got[i], want, rel_tol=1e-6, abs_tol=1e-9)


def test_quality_learns_from_all_labelled_rows(spark):
    """Thousands of rows of each label: centre, scale, weights and threshold are of all of them, however they are dealt out."""
    rng = random.Random(23)
    docs = [(i, prose(rng, rng.randint(1, 12)) + "!" * (rng.randint(0, 3) if i % 2 else rng.randint(2, 6))) for i in range(6000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, label int")
    x = np.stack([quality.features(t) for _, t in docs])
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), labels)
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6)
    wide = model.wide(x)
    good, bad = wide[1::2], wide[::2]
    draws = np.arange(quality.PAIRS * len(bad))
    picks = np.concatenate([np.random.default_rng(k).integers(len(good), size=quality.DRAWS) for k in range(draws[-1] // quality.DRAWS + 1)])[draws]
    left = np.setdiff1d(np.arange(len(good)), picks)
    d = np.concatenate([good[picks] - bad[draws % len(bad)], good[left] - bad[left % len(bad)]])
    slope = -(d / (1 + np.exp(d @ model.weights))[:, None]).mean(0) + 1e-2 * model.weights
    assert len(draws) > quality.DRAWS and np.abs(slope).max() < 1e-6
    s, y = wide @ model.weights, np.arange(6000) % 2
    threshold = (math.log(quality.CUT / (1 - quality.CUT)) - model.level) / model.slope
    assert math.isclose(threshold, np.sort(s)[2999:3001].mean(), abs_tol=1e-9)
    assert math.isclose(model.slope, toxicity._logistic(s, y, np.ones(6000))[0], rel_tol=1e-6)


def test_every_labelled_row_is_in_a_pair(spark):
    rng = random.Random(24)
    rows = [(i, np.array([float(i)] * len(quality.NAMES)).tobytes()) for i in range(300)]
    for lower in (1, 4, 299):
        pairs = quality._pairs(spark.createDataFrame(rows, "slot long, x binary"), lower, 300 - lower).collect()
        low, high = ({int(np.frombuffer(r[c])[0]) for r in pairs} for c in ("low", "high"))
        assert low == set(range(lower)) and high == set(range(lower, 300))
    values = [rng.choice([0.0, -1.5, 1e-300, 7.25, rng.random()]) for _ in range(500)]
    strengths = spark.createDataFrame([(v,) for v in values], "strength double")
    for rank in (0, 100, 250, 498):
        assert quality._at_rank(strengths, rank) == tuple(sorted(values)[rank : rank + 2])


def test_language_model_equals_brute_force(stored, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            words = split(t)
            one.update(words)
            two.update(zip([0, *words], words))
    n, v, ends = sum(one.values()), len(one), one[None]
    cells = np.zeros((language_model.BUCKETS, language_model.BINS, language_model.BINS), np.int64)
    for d, t in rows:
        if not held(d):
            words = split(t)
            for h, w in zip([0, *words], words):
                c = (ends if h == 0 else one[h]) - 1
                p2, p1 = np.array([(two[h, w] - 1) / c if c else 0.0]), np.array([(one[w] - 1) / (n - 1)])
                cells[language_model._bucket(np.array([float(c)]))[0], language_model._bin(p2)[0], language_model._bin(p1)[0]] += 1
    weights = language_model.learn(cells, n, v)
    assert np.allclose(weights.sum(1), 1)
    want = Counter()
    for d, t in rows:
        words = split(t)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        own = 0.0
        for h, w in zip([0, *words], words):
            c = float(ends if h == 0 else one[h])
            own += math.log10(language_model.probabilities(np.array([float(one[w])]), np.array([float(two[h, w])]), np.array([c]), weights, n, v)[0])
        want[d, held(d), len(words), sum(one[w] > 0 for w in words), n, round(base, 5), round(own, 5)] += 1
    got = language_model.score(stored, partitions=3).collect()
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got)
    assert language_model.score(stored.limit(0), partitions=2).count() == 0


def test_packed_arrays_come_back():
    for kind in ("u8", "u4", "i8", "u1"):
        x = np.random.default_rng(1).integers(0, 200, 77).astype(kind)
        assert (language_model._unpack(language_model._pack(x), kind) == x).all()
    assert len(language_model._unpack(language_model._pack(np.empty(0, "u8")), "u8")) == 0


def test_language_model_over_several_batches_of_a_task(stored, monkeypatch):
    """Small batches, one partition or many, and an input that comes out in another order each time: the same rows."""
    keys = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    rows = lambda df: Counter((*(r[k] for k in keys), round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())
    want = rows(language_model.score(stored))
    monkeypatch.setattr(language_model, "BATCH", 3000)
    assert rows(language_model.score(stored, partitions=11)) == want
    assert rows(language_model.score(stored.coalesce(1).orderBy(F.rand()), partitions=1)) == want


def test_words_do_not_depend_on_the_slice(monkeypatch, rows):
    from pointloom.llm import words

    texts = [t for _, t in rows]
    want = [words.plain_words(texts), words.alnum_words(texts), words.letter_terms(texts, (4, 5))]
    monkeypatch.setattr(words, "SLICE", 7)
    got = [words.plain_words(texts), words.alnum_words(texts), words.letter_terms(texts, (4, 5))]
    assert all((x == y).all() for a, b in zip(want, got) for x, y in zip(a, b))
