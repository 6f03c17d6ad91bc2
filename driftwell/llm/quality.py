"""Quality classifier by co-training of a text-content view and a page-metadata view.

1. The text view sees the content: hashed byte pairs and triples, how words repeat, and the lines. The metadata view
   sees language, source and the stated length, and nothing that is read off the text.
2. A logistic regression is fitted for each view on labelled rows. In each of ROUNDS rounds every document outside
   the labelled sample is scored by both views. Those that a view is surest of (SURE and beyond) get its pseudo-label,
   and the other view learns from them, unless on the rows kept out a view's sure answers of that label are hardly
   more often right than any answer of it would be (``gives``). They are taken in as the means of their features in BUCKETS buckets for each
   label (sums over all documents, made in each task first), which together weigh at most as much as the labelled
   rows of that label. So the whole table takes part, while a fit reads a bounded number of rows.
3. A quarter of the labelled rows is kept out of all fits. On one half of it each view's scores are calibrated
   (Platt), on the other half the calibrated views are combined by a logistic regression, so a view that tells
   little gets little weight.
4. Every document is scored; ``keep`` says whether its probability of good quality is THRESHOLD or more.

The one bounded sample is of labelled rows: LABELLED of them, those with the smallest draws of a hash of their ids.
Fits run in one executor task on that sample's features and the means; the driver gets the weights. Whole texts are
read, in fitting and in scoring.

Defined results: null texts and texts of white space alone score 0 and aren't kept; null lang, source or n_chars
are values of their own; labels other than 0 and 1 are ignored, and of several labels of a document the greatest
counts; without labelled rows of both classes every other document scores 1; null ids are scored and exchanged like
any other and never in the sample; of repeated ids in the sample the smallest row by its fields teaches; repeated
rows are scored each; columns ``keep``, ``score``, ``text_score`` and ``metadata_score`` are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .common import digest_int, materialise, ship, text_batches

LABELLED = 6000
ROUNDS = 2
SURE = 0.9
BUCKETS = 8
THRESHOLD = 0.5
HASHES = 512
FIELDS = ["text", "lang", "source", "n_chars"]


def text_features(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    parts = []
    for n in (2, 3):
        if len(data) >= n:
            code = data[: len(data) - n + 1].copy()
            for i in range(1, n):
                code = code * np.uint32(257) + data[i : len(data) - n + 1 + i]
            counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 9), minlength=HASHES)
            parts.append(np.sqrt(counts / len(code)))
        else:
            parts.append(np.zeros(HASHES))
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    counts = Counter(words)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, words))
    parts.append(np.array([len(counts) / n, max(counts.values(), default=0) / n, runs / n, upper / n, min(len(text) / n, 40) / 40]))
    parts.append(np.array([np.log1p(len(lines)) / 5, np.log1p(len(text) / len(lines)) / 8, np.log1p(max(map(len, lines))) / 8, len(set(lines)) / len(lines)]))
    return np.concatenate(parts)


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(2 * 64 + 2)
    for i, value in enumerate((lang, source)):
        out[64 * i + (0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "replace")) % 63)] = 1
    known = n_chars is not None and not pd.isna(n_chars) and n_chars >= 0
    out[128:] = [np.log1p(n_chars) / 10 if known else 0, not known]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, start: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 250, rate: float = 0.2) -> np.ndarray:
    """Weights, the intercept last, by Adam on all rows."""
    n = x.shape[1]
    w = np.zeros(n + 1) if start is None else start
    share = (np.ones(len(x)) if weight is None else weight) / (len(x) if weight is None else weight.sum())
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        off = ((sigmoid(margin(x, w)) - y) * share).astype(x.dtype)
        g = np.append(off @ x, off.sum()) + ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1].astype(x.dtype)).astype(float) + w[-1]


class Exchange:
    """Sums of the features that the views give each other, by (taking view, label, bucket): (rows, sum)."""

    def __init__(self, views: list[np.ndarray], gives: list[list[bool]] | None = None, sure: float = SURE, buckets: int = BUCKETS) -> None:
        self.views, self.sure, self.buckets = views, sure, buckets
        self.gives = gives or [[True, True], [True, True]]
        self.sums: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}

    def add(self, x: list[np.ndarray], bucket: np.ndarray) -> None:
        """Rows of both views' features; ``bucket`` is any number of each row's own."""
        for v in (0, 1):
            p = sigmoid(margin(x[v], self.views[v]))
            for label, certainty in ((1, p), (0, 1 - p)):
                for b in range(self.buckets if self.gives[v][label] else 0):
                    some = (certainty >= self.sure) & (bucket % self.buckets == b)
                    if some.any():
                        key = (1 - v, label, b)
                        n, total = self.sums.get(key, (0, 0))
                        self.sums[key] = (n + int(some.sum()), total + x[1 - v][some].sum(axis=0, dtype=np.float64))


class CoTrained:
    """Two views, calibrated and combined. ``views`` is empty if nothing could be learned."""

    def __init__(self) -> None:
        self.views: list[np.ndarray] = []
        self.scales: list[np.ndarray] = []
        self.joint = np.zeros(3)
        self.exchanged = [0, 0]
        self.gives = [[False, False], [False, False]]

    def learn(self, labelled: list[np.ndarray], y: np.ndarray, given: dict[tuple[int, int, int], tuple[int, np.ndarray]] | None = None) -> CoTrained:
        """Fit to labelled rows (a matrix of each view's features; y is 0 or 1) and to what an Exchange has summed.

        A model that was fitted before goes on from its weights.
        """
        turn = np.arange(len(y)) % 8
        held = turn % 4 == 3
        if any((y[some] == c).sum() == 0 for some in (~held, held) for c in (0, 1)):
            return self
        given = given or {}
        views = []
        for v in (0, 1):
            x, label, weight = [labelled[v]], [y], [np.where(held, 0.0, 1.0)]  # held rows weigh nothing here
            for c in (0, 1):
                means = [(n, total / n) for (view, kind, _), (n, total) in sorted(given.items()) if (view, kind) == (v, c)]
                if means:
                    n = np.array([m[0] for m in means], float)
                    x.append(np.stack([m[1] for m in means]).astype(labelled[v].dtype))
                    label.append(np.full(len(n), c))
                    weight.append(n * min(1.0, (y[~held] == c).sum() / n.sum()))
            start = self.views[v] if self.views else None
            views.append(logistic(np.vstack(x), np.concatenate(label), np.concatenate(weight), start, steps=250 if start is None else 100))
        self.exchanged = [sum(n for (view, _, _), (n, _) in given.items() if view == v) for v in (0, 1)]
        self.views, told = views, y[held]
        for v in (0, 1):
            p = sigmoid(margin(labelled[v][held], views[v]))
            for label, certainty in ((0, 1 - p), (1, p)):
                share, sure = (told == label).mean(), told[certainty >= SURE] == label
                self.gives[v][label] = bool(len(sure) and sure.mean() >= (1 + share) / 2)
        one, other = (turn == 3, turn == 7) if all((y[turn == t] == c).any() for t in (3, 7) for c in (0, 1)) else (held, held)
        raw = [margin(m, w)[:, None] for m, w in zip(labelled, views, strict=True)]
        self.scales = [logistic(r[one], y[one], steps=400) for r in raw]
        calibrated = np.stack([margin(r[other], s) for r, s in zip(raw, self.scales, strict=True)], axis=1)
        self.joint = logistic(calibrated, y[other], steps=400)
        return self

    def score(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by both views together, by the text and by the metadata."""
        if not self.views:
            return (np.ones(len(x[0])),) * 3
        z = [margin(margin(m, w)[:, None], s) for m, w, s in zip(x, self.views, self.scales, strict=True)]
        return sigmoid(margin(np.stack(z, axis=1), self.joint)), sigmoid(z[0]), sigmoid(z[1])


def both_views(rows: pd.DataFrame) -> list[np.ndarray]:
    text = np.stack([text_features(t) for t in rows["text"]])
    meta = np.stack([metadata_features(*r) for r in rows[FIELDS[1:]].itertuples(index=False, name=None)])
    return [text.astype(np.float32), meta.astype(np.float32)]


def _fields(docs: DataFrame) -> list[Column]:
    kinds = {"n_chars": "double"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FIELDS]


def _pack(*arrays: np.ndarray) -> bytes:
    return np.concatenate([np.ravel(a) for a in arrays]).astype("<f8").tobytes()


def _labelled_features(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """(_id, _y, _draw, text, meta) of the labelled rows with the smallest draws, at most ``labelled``; written."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("_y"))
    known = known.withColumn("_draw", digest_int(F.concat(F.lit("quality:"), F.col("_id").cast("string"))))
    # Most rows are cut off by a bound on the draw before they're sorted.
    bound = int(min(1.0, 1.5 * labelled / max(known.count(), 1) + 1e-9) * (1 << 52))
    picked = known.filter(F.col("_draw") <= bound).orderBy("_draw", "_id").limit(labelled)
    own = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("_doc"), *_fields(docs))
    rows = own.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_y", "_draw", *FIELDS)
    rows = rows.groupBy("_id", "_y", "_draw").agg(F.min(F.struct(*FIELDS)).alias("_d")).select("_id", "_y", "_draw", "_d.*")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = both_views(batch) if len(batch) else [np.zeros((0, 1))] * 2
            yield pd.DataFrame({"_id": batch["_id"], "_y": batch["_y"], "_draw": batch["_draw"], "text": [r.tobytes() for r in x[0]], "meta": [r.tobytes() for r in x[1]]})

    return materialise(rows.mapInPandas(features, "_id long, _y int, _draw long, text binary, meta binary"))


def _summed(docs: DataFrame, sample: DataFrame, model: CoTrained, sure: float) -> DataFrame:
    """(view, label, bucket, n, total) over all documents outside the sample: what the views give each other."""
    held = ship(docs.sparkSession, (model.views, model.gives))
    rest = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("_doc"), *_fields(docs))
    ids = F.broadcast(sample.select("_id"))  # as many as the sample has rows
    rest = rest.join(ids, F.col("_doc") == F.col("_id"), "left_anti").select(F.crc32(F.encode(F.coalesce(F.col("_doc").cast("string"), F.lit("")), "UTF-8")).alias("_bucket"), *FIELDS)

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Exchange(*held(), sure)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                sums.add(both_views(some), some["_bucket"].to_numpy())
        yield pd.DataFrame([(v, c, b, n, _pack(total)) for (v, c, b), (n, total) in sums.sums.items()], columns=["view", "label", "bucket", "n", "total"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(t, "<f8") for t in rows["total"]], axis=0)
        return pd.DataFrame({**{c: rows[c].iloc[:1] for c in ("view", "label", "bucket")}, "n": [rows["n"].sum()], "total": [_pack(total)]})

    schema, key = "view int, label int, bucket int, n long, total binary", ["view", "label", "bucket"]
    parts = rest.mapInPandas(give, schema).withColumn("_part", F.spark_partition_id() % 64)
    parts = parts.groupBy(*key, "_part").applyInPandas(add, schema)  # so that no task meets the sums of all tasks
    return parts.groupBy(*key).applyInPandas(add, schema)


def _fitted(sample: DataFrame, given: DataFrame | None, model: CoTrained) -> CoTrained:
    """``model`` fitted in one task to the bounded sample and the bounded number of means; its weights come back."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts)
        parts.clear()
        told = rows[rows["_y"] >= 0].sort_values(["_draw", "_id"])
        if len(told):
            means = {(int(v), int(-1 - y), int(b)): (int(n), np.frombuffer(t, "<f8")) for v, y, b, n, t in rows.loc[rows["_y"] < 0, ["view", "_y", "bucket", "n", "text"]].itertuples(index=False, name=None)}
            del rows
            x = [np.frombuffer(b"".join(told.pop(c)), np.float32).reshape(len(told), -1) for c in ("text", "meta")]
            model.learn(x, told["_y"].to_numpy(), means)
        yield pd.DataFrame({"model": [cloudpickle.dumps((model.views, model.scales, model.joint, model.exchanged, model.gives))]})

    rows = sample.select("_id", "_y", "_draw", "text", "meta", *[F.lit(None).cast("long").alias(c) for c in ("view", "bucket", "n")])
    if given is not None:
        no = F.lit(None)
        rows = rows.unionAll(given.select(no, -1 - F.col("label"), no, "total", no, "view", "bucket", "n"))
    found = rows.repartition(1).mapInPandas(train, "model binary").collect()
    if found:
        model.views, model.scales, model.joint, model.exchanged, model.gives = pickle.loads(found[0][0])
    return model


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Co-train on docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality)."""
    text_batches(docs.sparkSession)
    sample = _labelled_features(docs, labels, labelled)
    model = _fitted(sample, None, CoTrained())
    for _ in range(rounds if model.views else 0):
        model = _fitted(sample, _summed(docs, sample, model, sure), model)
    return model


def score_documents(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, text_score, metadata_score and keep."""
    held = ship(docs.sparkSession, model)
    text_batches(docs.sparkSession)

    @F.pandas_udf("score double, text_score double, metadata_score double")
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held()
        for batch in batches:
            out = np.zeros((len(batch), 3))
            there = np.array([t is not None and bool(t.strip()) for t in batch["text"]], bool)
            for at in range(0, len(batch), 512):
                some = np.flatnonzero(there[at : at + 512]) + at
                if len(some):
                    out[some] = np.stack(own.score(both_views(batch.iloc[some])), axis=1)
            yield pd.DataFrame(out, columns=["score", "text_score", "metadata_score"])

    judged = docs.withColumn("_judged", judge(F.struct(*_fields(docs))))
    new = ("score", "text_score", "metadata_score", "keep")
    return judged.select(*[c for c in docs.columns if c not in new], "_judged.*", (F.col("_judged.score") >= threshold).alias("keep"))
