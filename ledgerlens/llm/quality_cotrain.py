"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees hashed byte pairs of the text; the metadata view sees language, source, length and the layout profile
(kinds of characters, lines). Both are logistic regressions. They start from labelled rows; in each of ROUNDS rounds each view
scores every unlabelled row and hands all of which it is SURE to the other view, which keeps a label once given. On a held-out
fold their logits are then calibrated and combined into one probability, and all documents are scored in one pass.

Only the labelled rows are a bounded sample: at most MAX_LABELLED, chosen by a hash of the id, whose vectors reach the driver.
The unlabelled rows stay in Spark as vectors; each Newton step sums their gradient and Hessian, of fixed width, over all of them.
As good and bad ones are found in other shares than among labelled rows, the pseudo-labels of a class are weighted: together
those of both classes weigh at most as much as the labelled rows, in the labelled rows' shares, and none more than 1.

Defined cases: a null text counts as empty, a null language or source as a value of its own; label rows without a quality
are ignored, and of several labels for an id the smallest counts; with fewer than MIN_CLASS rows of either class every
document gets the share of good labels (1 without labels) and is kept; repeated rows are scored each; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small, stored, table

TEXT_FEATURES = 256
HASHED_FEATURES = 32
MAX_LABELLED = 6_000
MIN_CLASS = 10
ROUNDS = 4
SURE = 0.95
HELD_OUT = 0.25
#: Only what is probably bad is rejected.
KEEP_FROM = 0.25
RIDGE = 1.0
STEPS = 12

_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)).astype(np.int64) % TEXT_FEATURES
_b = np.arange(256)
#: Kinds of bytes: capitals, small letters, digits, spaces, line ends, brackets-and-bars-and-symbols, other punctuation, beyond ASCII.
_KIND = np.select([(_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122), (_b >= 48) & (_b <= 57), _b == 32, _b == 10, np.isin(_b, np.frombuffer(b"#*$%&|<>{}[]\\^~=+_@", np.uint8)), _b < 128], range(7), 7)
META_FEATURES = 8 + 5 + HASHED_FEATURES
META_COLUMNS = ("lang", "source")


def text_view(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs: a unit vector."""
    if len(data) < 2:
        return np.zeros(TEXT_FEATURES, np.float32)
    b = np.frombuffer(data, np.uint8).astype(np.uint16)
    counts = np.bincount(_PAIR[(b[:-1] << np.uint16(8)) | b[1:]], minlength=TEXT_FEATURES)
    return np.sqrt(counts / (len(b) - 1)).astype(np.float32)


def meta_view(data: bytes, values: tuple) -> np.ndarray:
    n = max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8) if data else np.zeros(8)
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    mean = sum(map(len, full)) / max(1, len(full))
    out = np.zeros(META_FEATURES, np.float32)
    out[:8] = np.sqrt(kinds / n)
    out[8:13] = np.log1p(n) / 10, np.log1p(len(full)) / 5, np.log1p(mean) / 7, 1 - len(full) / len(lines), 1 - len(set(full)) / max(1, len(full))
    for name, value in zip(META_COLUMNS, values, strict=True):
        out[13 + zlib.crc32(f"{name}={value}".encode()) % HASHED_FEATURES] += 1
    return out


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Gradient and Hessian of the likelihood at w."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return a.T @ (p - y), (a * (p * (1 - p) + 1e-6)[:, None]).T @ a


def _step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> np.ndarray:
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    return np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights and bias by Newton steps on the ridge-penalised likelihood."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        step = _step(w, *_sums(x, y, w), ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _split(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]]


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f4").reshape(-1, TEXT_FEATURES + META_FEATURES)


def pseudo_labels(views: list[np.ndarray], teachers: list[list[np.ndarray]]) -> list[np.ndarray]:
    """What each view is taught by the other one: 1, 0, or -1 for nothing. teachers has both views' weights of every round so
    far; the first round in which the teacher is sure of a row decides."""
    out = []
    for v in (0, 1):
        given = np.full(len(views[0]), -1, np.int8)
        for weights in teachers:
            p = 1 / (1 + np.exp(-np.clip(_logits(views[1 - v], weights[1 - v]), -30, 30)))
            given = np.where(given >= 0, given, np.where(p >= SURE, 1, np.where(1 - p >= SURE, 0, -1))).astype(np.int8)
        out.append(given)
    return out


def _summed(pool: DataFrame, parts: int, make) -> np.ndarray:
    """The sum of make(both views of a batch) over all rows of pool: by partition, by groups of partitions, at the driver."""
    groups = max(1, math.isqrt(parts))

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = make(_split(_matrix(batch.column(0).to_pylist())))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["g", "sums"])

    def merged(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(b, "<f8") for b in own["sums"]], axis=0).tobytes()]})

    rows = pool.select("x").mapInArrow(partial, "g int, sums binary").groupBy("g").applyInPandas(merged, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"], "<f8") for r in rows], axis=0) if rows else np.zeros(1)


def _refit(views, y, pool, parts, teachers, start):
    """Both views' weights from the labelled rows and all pseudo-labels that the teachers give, by Newton steps over Spark."""

    def counts(both):
        return np.array([np.sum(g == label) for g in pseudo_labels(both, teachers) for label in (0, 1)], float)

    found = _summed(pool, parts, counts).reshape(2, 2)  # view, label
    share = np.array([1 - y.mean(), y.mean()])
    weight = np.minimum(1.0, share * len(y) / np.maximum(found, 1))
    weights, open_ = list(start), [bool(found[v].any()) for v in (0, 1)]
    for _ in range(STEPS):
        if not any(open_):
            break
        now, moving = list(weights), list(open_)

        def sums(both, now=now, moving=moving):
            out = []
            for v, given in enumerate(pseudo_labels(both, teachers)):
                if moving[v]:
                    for label in (0, 1):
                        x = both[v][given == label]
                        gradient, hessian = _sums(x, np.full(len(x), float(label)), now[v])
                        out += [weight[v, label] * gradient, weight[v, label] * hessian[np.triu_indices(len(gradient))]]
            return np.concatenate([np.concatenate(out[i : i + 2]) + np.concatenate(out[i + 2 : i + 4]) for i in range(0, len(out), 4)])

        total, at = _summed(pool, parts, sums), 0
        for v in (0, 1):
            if moving[v]:
                n = len(weights[v])
                gradient, hessian = _sums(views[v], y, weights[v])
                more = np.zeros((n, n))
                more[np.triu_indices(n)] = total[at + n : at + n + n * (n + 1) // 2]
                step = _step(weights[v], gradient + total[at : at + n], hessian + more + np.triu(more, 1).T, RIDGE)
                at += n + n * (n + 1) // 2
                weights[v] = weights[v] - step
                open_[v] = bool(np.abs(step).max() >= 1e-3)
    return weights


def co_train(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, held: np.ndarray):
    """Weights of both views and of the combiner of their logits. pool has the vectors x of all unlabelled rows; held marks the
    labelled rows of the calibration fold."""
    own, parts, teachers = [views[v][~held] for v in (0, 1)], pool.rdd.getNumPartitions(), []
    weights = [fit_logistic(own[v], y[~held]) for v in (0, 1)]
    for _ in range(ROUNDS):
        teachers = [*teachers, weights]
        weights = _refit(own, y[~held], pool, parts, teachers, weights)
    logits = np.stack([np.clip(_logits(views[v][held], weights[v]), -15, 15) for v in (0, 1)], 1)
    return weights, fit_logistic(logits, y[held], ridge=0.01)


def fit(docs: DataFrame, labels: DataFrame):
    """A model for score(): weights of both views and the combiner, or a constant share."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("string").alias(c) for c in META_COLUMNS])

    def vectors(batches):
        for batch in batches:
            rows = batch.to_pylist()
            data = [(r["text"] or "").encode() for r in rows]
            x = [np.concatenate([text_view(d), meta_view(d, tuple(r[c] for c in META_COLUMNS))]).astype("<f4").tobytes() for d, r in zip(data, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    labelled = base.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # MAX_LABELLED rows of two numbers
    quality = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    found = labelled.select(base.columns).mapInArrow(vectors, "doc_id long, x binary").toPandas().sort_values("doc_id")
    x = _matrix(list(found["x"]))
    y = (found["doc_id"].map(quality).to_numpy(float) > 0).astype(float)
    if min(y.sum(), len(y) - y.sum()) < MIN_CLASS:
        return float(y.mean()) if len(y) else 1.0
    turn = np.zeros(len(y), int)
    for label in (0.0, 1.0):  # every fourth row of either class is held out
        own = np.flatnonzero(y == label)
        turn[own] = np.arange(len(own))
    ids = known.select("doc_id")
    pool = stored(base.mapInArrow(vectors, "doc_id long, x binary").join(small(ids, ids.count()), "doc_id", "left_anti").select("x"))
    return co_train(_split(x), y, pool, turn % round(1 / HELD_OUT) == 0)


def _scores(model, texts, metas):
    if isinstance(model, float):
        n = len(texts)
        return [model] * n, [model] * n, [model] * n
    (wt, wm), combiner = model
    data = [(t or "").encode() for t in texts]
    a = np.clip(_logits(np.stack([text_view(d) for d in data]), wt), -15, 15)
    b = np.clip(_logits(np.stack([meta_view(d, m) for d, m in zip(data, metas, strict=True)]), wm), -15, 15)
    both = np.clip(combiner[0] * a + combiner[1] * b + combiner[2], -30, 30)
    return [(1 / (1 + np.exp(-v))).tolist() for v in (a, b, both)]


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t, m, s = _scores(model, batch.column(1).to_pylist(), list(zip(*[batch.column(2 + i).to_pylist() for i in range(len(META_COLUMNS))], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.float64()) for v in (t, m, s)], pa.array([v >= KEEP_FROM for v in s], pa.bool_())], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("string").alias(c) for c in META_COLUMNS])
    return chosen.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, model) -> DataFrame:
    """The rows of docs that the model keeps, unchanged."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
                s = _scores(model, column("text"), list(zip(*[column(c) for c in META_COLUMNS], strict=True)))[2]
                yield batch.filter(pa.array([v >= KEEP_FROM for v in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_cotrained_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
