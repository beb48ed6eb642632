"""Operators that learn: held-out accuracy, and defined results for odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leakloom.llm import langid, toxicity

SYLLABLES = {
    "aa": ["ka", "ro", "mi", "ten", "sol", "pa"],
    "bb": ["sch", "ung", "ver", "ein", "keit", "zu"],
    "cc": ["eau", "que", "oi", "ment", "lle", "ére"],
}


def text_in(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        lang = r.choice(list(SYLLABLES))
        words, toxic = text_in(r, lang, r.randint(5, 60)).split(), int(r.random() < 0.25)
        if toxic:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(["idiot", "scum"] if lang == "aa" else [f"grumpf{r.choice('abcde')}"]))
        docs.append((i, " ".join(words), lang))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled, odd, empty):
    docs, labels = labelled
    model = toxicity.train(docs, labels, lambda c: ~toxicity.held_out(c))
    out = toxicity.scores(docs, model).filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    right = out.filter((F.col("toxicity_score") >= 0.3) == (F.col("toxic") == 1)).count()
    assert right >= 0.97 * out.count() and out.count() > 100
    rows = toxicity.scores(odd, model)
    assert rows.columns == ["toxicity_score", *odd.columns] and rows.count() == odd.count()
    assert all(0 <= r.toxicity_score <= 1 for r in rows.collect())
    assert toxicity.scores(empty, model).count() == 0
    # Labels with nulls, repeats and no partner change nothing but what they say.
    more = labels.unionByName(labels.limit(20)).unionByName(labels.limit(5).withColumn("toxic", F.lit(None).cast("int"))).unionByName(labels.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    assert toxicity.train(docs, more, lambda c: ~toxicity.held_out(c)).places == model.places
    bare = toxicity.train(docs, labels.limit(0), lambda c: ~toxicity.held_out(c))
    assert bare.score("you are an idiot and a moron") > 0.5 > bare.score("a kind word") and 0 <= bare.score(None) <= 1


def test_label_model_finds_good_voters():
    r = np.random.default_rng(3)
    y = r.random(3000) < 0.2
    fires = np.zeros((3000, len(toxicity.VOTERS)))
    fires[:, 0] = np.where(y, r.random(3000) < 0.9, r.random(3000) < 0.02)
    fires[:, 1] = fires[:, 0]  # repeats the first
    fires[:, 2] = np.where(y, r.random(3000) < 0.8, r.random(3000) < 0.05)
    fires[:, 13] = r.random(3000) < 0.3  # says nothing
    fires[:, 14] = 1 - fires[:, :3].max(1)
    post = toxicity.label_model(fires, np.full(3000, -1), np.ones(3000), 0.2)
    assert ((post > 0.5) == y).mean() > 0.93  # the best any rule can reach here is 0.964


def test_label_model_against_enumeration(monkeypatch):
    import itertools

    r = np.random.default_rng(6)
    true = toxicity.LabelModel(r.normal(-1, 0.5, 4), np.array([2.0, 1.5, 2.5, 0.0]), [(1, 0), (3, 2)], np.array([2.5, -1.0]), 0.3)
    p = {}
    for y, *v in itertools.product((0, 1), repeat=5):
        p[y, *v] = np.exp(true.bias() * y + sum((true.rate[j] + true.accuracy[j] * y) * v[j] for j in range(4)) + 2.5 * v[1] * v[0] - v[3] * v[2])
    total, joint = sum(p.values()), true.joint()
    for (y, *v), w in p.items():
        assert np.isclose(joint[y, sum(x << j for j, x in enumerate(v))], w / total)
        votes = np.array([v], float)
        assert np.isclose(true.posterior(votes)[0], p[1, *v] / (p[0, *v] + p[1, *v]))
    assert np.isclose(joint[1].sum(), 0.3)
    # Votes drawn from it give back its expectations and, nearly, its posterior: a voter that repeats another is not counted twice.
    state = r.choice(32, 40_000, p=joint.reshape(-1))
    fires, y = true.states[state % 16], state // 16
    gold = np.where(r.random(40_000) < 0.05, y, -1)
    got = toxicity.fit_label_model(fires, gold, np.ones(40_000), 0.3)
    assert (1, 0) in got.edges and got.correlation[got.edges.index((1, 0))] > 1
    assert np.allclose(got.joint().sum(0) @ got.states, fires.mean(0), atol=0.02)
    wrong = lambda m: joint.sum(0) @ np.abs(m.posterior(true.states) - true.posterior(true.states))
    monkeypatch.setattr(toxicity, "dependencies", lambda *_: [])
    apart = toxicity.fit_label_model(fires, gold, np.ones(40_000), 0.3)
    assert wrong(got) < 0.75 * wrong(apart) and wrong(got) < 0.08
    assert (got.accuracy[:2] < 2.2).all() and (apart.accuracy[:2] > 3).all()


def test_toxicity_rows_that_repeat_an_id_are_learned_once(spark, labelled):
    docs, labels = labelled
    rows, _, _ = toxicity.training_rows(docs.unionByName(docs.limit(50)), labels, lambda c: ~toxicity.held_out(c))
    assert rows.count() == rows.select("doc_id").distinct().count()
    named = docs.limit(3).withColumn("toxicity_score", F.lit("own"))
    assert toxicity.scores(named, toxicity.Model()).columns == ["toxicity_score", "doc_id", "text", "lang"]
    assert toxicity.without_toxic(named, toxicity.Model(bias=-5.0), 0.3).collect() == named.collect()


def test_toxicity_is_learned_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """Every labelled row that is not held out is learned from, however many there are and however large their ids."""
    rows = [(i + (1 << 40) * (i % 2), f"word{i % 50} {'you grumpf' if i % 20 == 0 else 'a fine day'}", int(i % 20 == 0)) for i in range(17_000)]
    docs, labels = (spark.createDataFrame([(x[0], x[k]) for x in rows], f"doc_id long, {c}") for k, c in ((1, "text string"), (2, "toxic int")))
    mine = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    toxic = sum(x[2] for x in mine)
    assert len(mine) - toxic > 12_000
    learned, n_pos, n_neg = toxicity.training_rows(docs, labels, lambda c: ~toxicity.held_out(c))
    assert (learned.count(), n_pos, n_neg) == (len(mine), toxic, len(mine) - toxic)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen, posteriors, fit = [], toxicity.posteriors, toxicity.fit_linear
    monkeypatch.setattr(toxicity, "posteriors", lambda h, share: seen.append((h.count(), share)) or posteriors(h, share))
    monkeypatch.setattr(toxicity, "fit_linear", lambda h, *more: seen.append((h.count(), toxic / len(mine))) or fit(h, *more))
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert seen == [(len(mine), toxic / len(mine))] * 2
    assert sorted(x.doc_id for x in left) == sorted(i for i, _, bad in rows if not bad)


def test_linear_classifier_is_at_its_optimum(spark):
    """The gradient of the penalised mean loss on soft labels vanishes; equal rows and rows without features count too."""
    r = np.random.default_rng(8)
    n, k = 400, 6
    votes, found = r.integers(0, 8, n), [sorted(np.flatnonzero(r.random(k) < 0.4).tolist()) for _ in range(n)]
    post = {int(v): float(p) for v, p in zip(range(8), r.uniform(0.1, 0.9, 8), strict=True)}
    hits = spark.createDataFrame([(int(v), -1, 0, f) for v, f in zip(votes, found, strict=True)], toxicity.HITS)
    w, v, b = toxicity.fit_linear(hits, post, k)
    x = np.array([[i in f for i in range(k)] for f in found], float)
    fires = ((votes[:, None] >> np.arange(len(toxicity.VOTERS))) & 1).astype(float)
    off = (1 / (1 + np.exp(-(x @ w + fires @ v + b))) - np.array([post[int(i)] for i in votes])) / n
    slopes = np.concatenate([x.T @ off + toxicity.PENALTY * w, fires.T @ off + toxicity.PENALTY * v, [off.sum()]])
    assert len(w) == k and len(v) == len(toxicity.VOTERS) and np.abs(slopes).max() < 1e-3 and np.abs(v[:3]).max() > 0.1


def test_language_on_held_out_rows(spark, labelled, odd, empty):
    docs, _ = labelled
    field = langid.train(docs, lambda c: ~langid.held_out(c))
    assert field.languages == ["aa", "bb", "cc"]
    out = langid.predict(docs, field).join(docs, "doc_id").filter(langid.held_out(F.col("doc_id")))
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count() and out.count() > 80
    assert (np.diag(field.transitions) > 0).all()
    r = random.Random(1)
    parts = [(lang, text_in(r, lang, 12).split()) for lang in ("aa", "cc", "bb")]
    row = langid.predict(spark.createDataFrame([(1, " ".join(w for _, p in parts for w in p))], "doc_id long, text string"), field, words_too=True).first()
    assert sum(a == b for a, b in zip(row.langs, [x for x, p in parts for _ in p], strict=True)) >= 32
    rows = {r.doc_id: r for r in langid.predict(odd, field).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[6].lang_pred == "und" and rows[3].score == 0
    assert len(langid.predict(odd, field).collect()) == odd.count()
    assert langid.predict(spark.createDataFrame([(1, "12 ² ½ !?")], "doc_id long, text string"), field).first().lang_pred == "und"
    assert langid.predict(empty, field).count() == 0
    nothing = langid.train(empty, lambda c: ~langid.held_out(c))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "IN_ALL", 300, raising=False)  # fewer documents of each
    monkeypatch.setattr(langid, "CELLS", 1 << 15, raising=False)
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{i:02}": ["".join(r.choice(letters) for _ in range(4)) for _ in range(6)] for i in range(70)}
    rows = [(lang, " ".join("".join(r.choice(s) for _ in range(2)) for _ in range(30))) for lang, s in stems.items() for _ in range(8)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    field = langid.train(docs, lambda c: ~langid.held_out(c))
    assert field.languages == sorted(stems)
    out = langid.predict(docs, field).join(docs, "doc_id").filter(langid.held_out(F.col("doc_id")))
    assert out.filter("lang_pred = lang").count() >= 0.95 * out.count() and out.select("lang").distinct().count() >= 50


def test_texts_are_one_sequence_whatever_their_length():
    r = np.random.default_rng(3)
    for k in (2, 3, 11):  # as matrices, and block by block
        moves, counts = r.normal(scale=2, size=(k, k)), [1, 700, 0, 64, 65, 130, 3]
        scores = r.normal(size=(sum(counts), k)).astype(np.float32)
        field = langid.Field([str(i) for i in range(k)], np.zeros((langid.WEIGHTS, k), np.float32), moves, {})
        field.emissions = lambda words, scores=scores: scores
        got, at = field.marginals([""] * sum(counts), counts), 0
        for n in counts:
            if n:
                want = langid.forward_backward(scores[None, at : at + n], np.ones((1, n), bool), moves)[0][0]
                assert np.allclose(got[at : at + n], want, atol=1e-6)
            at += n


def test_language_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda pieces: seen.append(pieces))
    rows = [(None, "the same text again and again", "xx")] * 300 + [(None, f"ein text {i}", "yy") for i in range(50)] + [(1, "12", "zz"), (2, "wort", "zz")]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lambda c: ~langid.held_out(c))
    by = [lang for lang, _ in seen[0]]
    assert by.count("xx") == 5 and by.count("yy") == 5 and by.count("zz") == 1


def test_forward_backward_against_enumeration():
    import itertools

    r = np.random.default_rng(0)
    scores, moves = r.normal(size=(1, 5, 3)), r.normal(size=(3, 3))
    real = np.array([[True] * 4 + [False]])
    weights = {}
    for path in itertools.product(range(3), repeat=4):
        weights[path] = np.exp(sum(scores[0, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
    total = sum(weights.values())
    got, moved, log_total = langid.forward_backward(scores, real, moves)
    for i in range(4):
        for y in range(3):
            assert np.isclose(got[0, i, y], sum(w for p, w in weights.items() if p[i] == y) / total)
    want = np.zeros((3, 3))
    for p, w in weights.items():
        for a, b in itertools.pairwise(p):
            want[a, b] += w / total
    assert np.allclose(moved, want) and np.isclose(log_total, np.log(total))
