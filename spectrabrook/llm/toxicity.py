"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; everything else, labelled or not,
is unlabelled text that holds toxic documents at the class prior's rate. A
linear model on the distinct words of a text and their first characters,
hashed, is trained in numpy on the risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l; where the second part falls below zero its gradient
is reversed, which stops the model from fitting the unlabelled examples by
heart. The samples are bounded (``positives``, ``unlabelled``) and picked by a
hash of doc_id; the prior is counted over all labels that may be learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrabrook.llm.common import fold, small_batches

DIMS = 1 << 20
PREFIXES = (4, 5, 6, 8)
EDGE = b".,;:!?\"'()[]{}*#$%&|-_"


def word_features(word: bytes, dims: int = DIMS) -> list[int]:
    """Hashed features of a lower-cased word: itself and its beginnings, without marks at its ends."""
    w = word.strip(EDGE)
    if not w:
        return []
    return [zlib.crc32(b"w" + w) % dims, *(zlib.crc32(b"%d" % k + w[:k]) % dims for k in PREFIXES if len(w) >= k)]


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").lower().split())


def text_features(text: str | None, dims: int = DIMS) -> np.ndarray:
    return np.unique(np.array([f for w in words(text) for f in word_features(w, dims)], np.int32))


#: Features that are weighed at once in training; what a step needs besides the rows is bounded by it.
BLOCK = 1 << 18


class Rows:
    """Sparse 0/1 rows: feature ids one after another, and where each row ends.

    The driver holds the ids once, in four bytes each. Sums go through them in
    blocks of whole rows and add in the order of the rows, so that the blocks'
    size changes no bit of a result.
    """

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.flat = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.zeros(0, np.int32)
        self.ends = np.cumsum([len(r) for r in rows], dtype=np.int64)

    def __len__(self) -> int:
        return self.n

    def blocks(self, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, each row's number of features, their ids) of runs of rows: `most` features each, or one longer row."""
        row, start = 0, 0
        while row < self.n:
            to = max(row + 1, int(np.searchsorted(self.ends, start + (most or BLOCK), "right")))
            ends = self.ends[row:to]
            yield row, np.diff(ends, prepend=start), self.flat[start : ends[-1]]
            row, start = to, int(ends[-1])

    def seen(self, dims: int) -> np.ndarray:
        """The number of rows with each feature."""
        out = np.zeros(dims, np.int64)
        for _, _, ids in self.blocks():
            out += np.bincount(ids, minlength=dims)
        return out

    def keep(self, where: np.ndarray) -> Rows:
        """The same rows with features numbered as `where` says; those at -1 go."""
        out = Rows([])
        out.n, out.ends = self.n, np.zeros(self.n, np.int64)
        out.flat, at = np.empty(sum(int((where[ids] >= 0).sum()) for _, _, ids in self.blocks()), np.int32), 0
        for row, counts, ids in self.blocks():
            new = where[ids]
            ok = new >= 0
            upto = at + np.concatenate([[0], np.cumsum(ok)])
            out.ends[row : row + len(counts)] = upto[np.cumsum(counts)]
            out.flat[at : upto[-1]] = new[ok]
            at = int(upto[-1])
        return out

    def dot(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for row, counts, ids in self.blocks():
            out[row : row + len(counts)] = np.bincount(np.repeat(np.arange(len(counts)), counts), weight[ids], len(counts))
        return out

    def spread(self, value: np.ndarray, dims: int) -> np.ndarray:
        """For each feature the sum of the values of the rows that have it."""
        out = np.zeros(dims)
        for row, counts, ids in self.blocks():
            np.add.at(out, ids, np.repeat(value[row : row + len(counts)], counts))
        return out


def nnpu_gradient(p: Rows, u: Rows, w: np.ndarray, prior: float) -> tuple[tuple[float, float], np.ndarray]:
    """Both parts of the risk at weights w, the bias last, and the direction to step against.

    While the second part is not negative that is the risk's gradient; below zero
    it is minus the second part's.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    gp, gu = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
    parts = float(prior * np.logaddexp(0, -gp).mean()), float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
    # Derivatives of the parts with respect to the margins.
    pos = -prior * sigmoid(-gp) / p.n
    neg_u, neg_p = sigmoid(gu) / u.n, -prior * sigmoid(gp) / p.n
    dp, du = (pos + neg_p, neg_u) if parts[1] >= 0 else (-neg_p, -neg_u)
    grad = np.empty_like(w)
    grad[:-1] = p.spread(dp, len(w) - 1) + u.spread(du, len(w) - 1)
    grad[-1] = dp.sum() + du.sum()
    return parts, grad


def fit_nnpu(positive: Rows | list[np.ndarray], unlabelled: Rows | list[np.ndarray], prior: float, dims: int = DIMS, least_rows: int = 3, steps: int = 120, rate: float = 0.1, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on the non-negative risk; features in fewer than least_rows examples get none.

    Weights are kept at zero or above, with an L1 penalty: a word can speak for
    toxicity, and no amount of ordinary text outweighs one that does.

    Without positives every weight is zero and the bias is the prior's log odds.
    """
    prior = min(max(prior, 1e-4), 0.9999)
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(dims, np.float32), base
    p, u = (x if isinstance(x, Rows) else Rows(x) for x in (positive, unlabelled))
    del positive, unlabelled  # the rows as they came go when those with the used features are there
    seen = p.seen(dims) + u.seen(dims)
    used, where = np.flatnonzero(seen >= least_rows), np.full(dims, -1, np.int32)
    where[used] = np.arange(len(used))
    p, u = p.keep(where), u.keep(where)
    del seen, where
    w = np.zeros(len(used) + 1)
    w[-1] = base
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = nnpu_gradient(p, u, w, prior)[1]
        grad[:-1] += l1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    out = np.zeros(dims, np.float32)
    out[used] = w[:-1]
    return out, float(w[-1])


def _sampled(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> Rows:
    """Features of the documents named in ids, a bounded table, by id and features.

    They come as Arrow buffers and are copied once, so that the driver holds them neither as objects nor pickled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "found"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    got = rows.mapInArrow(run, "id long, found binary").toArrow()
    order = pc.sort_indices(got, [("id", "ascending"), ("found", "ascending")]).to_pylist()
    found = got["found"]
    return Rows([np.frombuffer(found[i].as_buffer(), np.int32) for i in order])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", positives: int = 1500, unlabelled: int = 6000, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit on at most `positives` confirmed and `unlabelled` other documents for which may_learn, a column of doc_id, holds."""
    small_batches(docs.sparkSession)
    order = F.xxhash64(F.lit(seed), F.col(doc_id))
    usable = labels.filter(may_learn & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    prior = usable.agg(F.avg(F.col(toxic).cast("double"))).first()[0]
    bounded = lambda df, n: df.select(F.col(doc_id).cast("long").alias("id"), order.alias("o")).distinct().orderBy("o", "id").limit(n).select("id")
    p = bounded(usable.filter(F.col(toxic) == 1), positives)
    u = bounded(docs.filter(may_learn & F.col(doc_id).isNotNull()), unlabelled)
    return fit_nnpu(_sampled(docs, p, text, doc_id), _sampled(docs, u, text, doc_id), prior if prior is not None else 0.0)


def score_column(spark: SparkSession, model: tuple[np.ndarray, float], text: Column, cache: int = 400_000) -> Column:
    """The score of a text as a column: rows stay where they are, and only texts go to Python."""
    used = np.flatnonzero(model[0])
    sparse, bias = (used.astype(np.int32), model[0][used]), model[1]
    shared = spark.sparkContext.broadcast(sparse)
    small_batches(spark)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = np.zeros(DIMS, np.float32)
        weight[shared.value[0]] = shared.value[1]
        heavy = bytearray((weight != 0).tobytes())
        seen: set[bytes] = set()
        hits: dict[bytes, tuple[int, ...]] = {}  # words with features that weigh; most have none
        telling: set[bytes] = set()
        for b in batches:
            texts = [words(t) for t in b.to_pylist()]
            new = set().union(*texts).difference(seen)
            if len(seen) + len(new) > cache:
                seen, new = set(), set().union(*texts)
                hits, telling = {}, set()
            seen |= new
            for w in new:
                if found := tuple(f for f in word_features(w) if heavy[f]):
                    hits[w] = found
                    telling.add(w)
            scores = []
            for t in texts:
                hit = {f for w in t & telling for f in hits[w]}  # each feature counts once
                z = bias + float(weight[sorted(hit)].sum()) if hit else bias
                scores.append(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
            yield pa.array(scores, pa.float64())

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **how) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels count only for documents whose crc32 of doc_id modulo folds is not
    zero. Null and empty texts have no words and get the bias's score; very long
    texts are read whole, one to a batch. Rows repeat as in docs, with equal
    scores for equal texts; a null doc_id is scored and never learnt from. With
    no positive label all scores are the prior. An empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    model = train(docs, labels, fold(F.col("doc_id"), folds) != 0, **how)
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score_column(docs.sparkSession, model, docs["text"]).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns; each is judged where it lies, without an exchange."""
    model = train(docs, labels, fold(F.col(doc_id), folds) != 0, text, doc_id, **how)
    return docs.filter(score_column(docs.sparkSession, model, docs[text]) < 0.5)
