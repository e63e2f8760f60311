"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass measures every whole text (shares are taken as log(share + 0.001), sizes as logarithms). Class means and
covariances come from sums of products over all labelled documents outside the held-out fold, added up in the
tasks and by Spark; two small matrices reach the driver. Each class covariance is shrunk towards the pooled one and
towards a sphere, its Cholesky factor is computed once, and the score is the logistic of the log-density
difference, two Mahalanobis terms by the cached inverses of the factors.

Labels of 1 and 0 count, others and nulls do not; a document labelled twice with both has none. Null and empty texts have all
shares zero and a score like any other. With a class missing, the score is the share of the other one (0.5 without
labels). Ids, languages and sources are never measured; repeated rows give repeated rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import materialise
from .common import NOT_SPACE, STEP, Words, mix, pieces

FEATURES = ["words", "word_bytes", "upper", "symbols", "digits", "marks", "wide", "short", "single", "distinct", "twice", "top", "line_words", "grams"]
#: Weight of the pooled covariance in a class's own, and of a sphere of the same trace.
TO_POOLED, TO_SPHERE = 0.1, 0.02
FLOOR = 1e-3


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT, SYMBOL, MARK = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("#*$%&|<>{}[]\\^~@=_+"), _table(".,;:!?'\"()-/")


def per_text(words: Words, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[words.first[1:]] - total[words.first[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    w = Words(column, NOT_SPACE, True)
    n, size = w.counts.astype(float), w.end - w.start
    chars = w.per_text(w.is_word)
    owner = np.repeat(np.arange(w.n), w.counts)
    key = mix(w.hash ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(fresh)
    repeats = np.diff(np.append(starts, len(key)))
    distinct = np.bincount(owner[order[starts]], minlength=w.n)
    top = np.zeros(w.n)
    np.maximum.at(top, owner[order[starts]], repeats)
    twice = np.zeros(len(key), bool)
    twice[1:] = key[1:] == key[:-1]
    grams, ok = w.grams(3)
    at = np.flatnonzero(ok)
    three = mix(grams[at] ^ (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
    by = np.argsort(three)
    seen = np.zeros(len(at), bool)
    seen[by[1:]] = three[by[1:]] == three[by[:-1]]
    again, repeated = np.bincount(owner[at], minlength=w.n), np.bincount(owner[at], seen, minlength=w.n)
    lines = w.per_text(w.data == 10) + 1

    def share(part, whole):
        return np.log(np.divide(part, whole, out=np.zeros(len(n)), where=whole > 0) + FLOOR)

    columns = [np.log1p(n), np.log1p(np.divide(chars, n, out=np.zeros(len(n)), where=n > 0)),
               *[share(w.per_text(t[w.data]), chars) for t in (UPPER, SYMBOL, DIGIT, MARK)], share(w.per_text(w.data >= 128), chars),
               share(per_text(w, size <= 3), n), share(per_text(w, size == 1), n),
               np.log1p(n) - np.log1p(distinct), share(per_text(w, twice), n), share(top, n), np.log1p(n / lines), share(repeated, again)]
    return np.column_stack(columns)


def feature_rows(batches):
    for batch in pieces(batches):
        x = features(batch.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel(), pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])


def sum_rows(batches):
    """Per class and task: count, sums and sums of products."""
    d = len(FEATURES)
    sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
    for batch in batches:
        label = np.asarray(batch.column("label"))
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = np.column_stack([np.ones(len(x)), x])
        for k, total in sums.items():
            total += x[label == k].T @ x[label == k]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], (d + 1) ** 2), pa.int32()), pa.array(np.tile(np.arange((d + 1) ** 2), 2), pa.int32()),
                                      pa.array(np.concatenate([sums[0].ravel(), sums[1].ravel()]), pa.float64())], ["label", "cell", "v"])


class Discriminant:
    """Means, Cholesky factors and offsets of both classes."""

    def __init__(self, sums: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE):
        n = {k: s[0, 0] for k, s in sums.items()}
        self.prior = (n[1] / (n[0] + n[1])) if n[0] + n[1] else 0.5
        self.parts = None
        if min(n.values()) < 2:
            return
        mean = {k: s[0, 1:] / n[k] for k, s in sums.items()}
        scatter = {k: s[1:, 1:] - n[k] * np.outer(mean[k], mean[k]) for k, s in sums.items()}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.scale = scale
        self.parts = []
        for k in (0, 1):
            own = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
            own = own / np.outer(scale, scale)
            own = (1 - to_sphere) * own + to_sphere * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.parts.append((mean[k] / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n[k])))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        logs = [log_n - half_det - 0.5 * (((x / self.scale - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, half_det, log_n in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(feature_rows, "doc_id long, x array<double>"), "features")


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    known = (labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"), F.max("quality").alias("high"))
             .where("label = high").where(~held_out(F.col("doc_id"))).select("doc_id", "label"))
    cells = (rows.join(known, "doc_id").select(F.col("label").cast("int").alias("label"), "x").mapInArrow(sum_rows, "label int, cell int, v double")
             .groupBy("label", "cell").agg(F.sum("v").alias("v")).collect())
    d = len(FEATURES) + 1
    sums = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in cells:
        sums[r["label"]][r["cell"]] = r["v"]
    return Discriminant({k: s.reshape(d, d) for k, s in sums.items()})


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row."""
    rows = measured(docs)
    model = fit(rows, labels)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    out = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
