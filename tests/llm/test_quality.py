from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from driftwell.llm.common import table
from driftwell.llm import quality
from driftwell.llm.quality import CoTrained, Exchange, fit, metadata_features, score_documents, text_features

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep int"


def co_train(labelled, y, pool, rounds=2):
    model = CoTrained().learn(labelled, y)
    for _ in range(rounds):
        sums = Exchange(model.views, model.gives)
        sums.add(pool, np.arange(len(pool[0])))
        model.learn(labelled, y, sums.sums)
    return model


def test_views_teach_each_other_and_are_weighed():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 8000)
    a, b = rng.standard_normal((8000, 30)) + 2 * y[:, None] * (np.arange(30) < 3), rng.standard_normal((8000, 30))
    b[:, 0] += 1.5 * y
    alone = CoTrained().learn([a[:64], b[:64]], y[:64])
    model = co_train([a[:64], b[:64]], y[:64], [a[64:4000], b[64:4000]])
    assert min(model.exchanged) > 500
    right = lambda m: [((p > 0.5) == y[4000:]).mean() for p in m.score([a[4000:], b[4000:]])]
    assert right(model)[2] > right(alone)[2] + 0.02  # the weaker view gains by what the other one gave
    assert right(model)[0] > 0.9
    noise = CoTrained().learn([a[:2000], rng.standard_normal((2000, 3))], y[:2000])
    assert not any(noise.gives[1])  # what tells nothing gives no labels
    assert ((noise.score([a[2000:], rng.standard_normal((6000, 3))])[0] > 0.5) == y[2000:]).mean() > 0.94


def test_the_exchange_sums_all_documents_as_by_brute_force(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    sample = quality._labelled_features(docs, labels, 60)
    model = quality._fitted(sample, None, CoTrained())
    got = {(r.view, r.label, r.bucket): (r.n, np.frombuffer(r.total)) for r in quality._summed(docs.repartition(7), sample, model, 0.8).collect()}
    known = {r._id for r in sample.collect()}
    rest = [r for r in docs.collect() if r.doc_id not in known and r.text is not None]
    assert len(known) == 60 and rest
    slow = {}
    for r in rest:
        x = [text_features(r.text).astype(np.float32), metadata_features(r.lang, r.source, r.n_chars).astype(np.float32)]
        for v in (0, 1):
            p = 1 / (1 + np.exp(-(x[v].astype(float) @ model.views[v][:-1] + model.views[v][-1])))
            for label in (0, 1):
                if model.gives[v][label] and (p if label else 1 - p) >= 0.8:
                    n, total = slow.get(k := (1 - v, label, zlib.crc32(str(r.doc_id).encode()) % 8), (0, 0))
                    slow[k] = (n + 1, total + x[1 - v])
    assert sum(n for n, _ in got.values()) > 20 or not any(map(any, model.gives))
    assert abs(sum(n for n, _ in got.values()) - sum(n for n, _ in slow.values())) <= 1  # a row may lie on the bound
    assert sum(got[k][0] == slow[k][0] and np.allclose(got[k][1], slow[k][1], rtol=1e-4, atol=1e-3) for k in slow) >= len(slow) - 1


def test_scores_as_by_brute_force(spark):
    """The query's scores, one document at a time, from the model's weights."""
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = fit(docs, labels)
    logit = lambda x, w: float(np.dot(x.astype(float), w[:-1]) + w[-1])
    for r in score_documents(docs, model).collect():
        x = [text_features(r.text), metadata_features(r.lang, r.source, r.n_chars)]
        z = [logit(np.array([logit(m, w)]), s) for m, w, s in zip(x, model.views, model.scales, strict=True)]
        slow = [1 / (1 + np.exp(-v)) for v in (logit(np.array(z), model.joint), *z)]
        assert np.allclose([r.score, r.text_score, r.metadata_score], slow, atol=1e-4) and r.keep == (r.score >= 0.5)


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = fit(docs, labels.filter("doc_id % 3 <> 0"))
    got = score_documents(docs, model).join(labels.filter("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").collect()
    bad, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1]
    assert sum(r.keep for r in good) / len(good) >= 0.97
    assert sum(not r.keep for r in bad) / len(bad) >= 0.7


def test_odd_rows(spark):
    rows = [(i, "good words that differ %d here" % i if i % 3 else "bad bad bad ### %%% bad", "en" if i % 2 else None, None, i) for i in range(60)]
    rows += [(100, None, "en", "s", 1), (101, " \n\t", None, None, None), (102, "", "en", "s", 0), (None, "good words that differ 7 here", "en", None, -5), (103, "word " * 200_000, "en", "s", 10**6), (1, rows[1][1], "en", None, 1)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)] + [(51, None, 0), (None, 1, 0), (52, 7, 0), (3, 0, 1), (100, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, fit(docs, labels))
    assert set(got.columns) == set(docs.columns) | {"text_score", "metadata_score"}
    kept = {r.doc_id: (r.keep, r.score) for r in got.collect()}
    assert got.count() == len(rows) and all(0 <= s <= 1 for _, s in kept.values())
    assert [kept[i] for i in (100, 101, 102)] == [(False, 0.0)] * 3
    assert all(kept[i][0] == bool(i % 3) for i in range(60)) and kept[None][0]
    nothing = fit(docs, labels.filter("quality = 1"))
    assert not nothing.views and score_documents(docs, nothing).filter("doc_id = 0").first().score == 1.0
    empty = docs.filter(F.lit(False))
    assert score_documents(empty, fit(empty, labels)).count() == 0
