"""Nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking.

Coarse cells split the index; a query visits the cells whose centres score
best, as many as find ``recall`` of the true neighbours within the sample, where
neighbours lie further apart than in the whole table, and more where those hold
too few rows for k neighbours. Within a cell each
vector is sixteen-way quantised per pair of dimensions. Codebooks and codes
minimise the anisotropic loss |r|^2 + (eta - 1) <r, x/|x|>^2, which penalises
the part of the residual parallel to the vector, the part that changes large
inner products. A scan adds table entries, two codes to a byte; the best
``rerank`` candidates of each cell are scored on the original vectors, and with
them every other one whose scanned score lies within ``margin`` root mean square
errors of the k-th best of those: where neighbours lie too close together for
the codes to tell them apart, all of them are.
Centres and codebooks are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrabrook.llm.common import stage


@dataclass
class Index:
    """Cell centres (cells x dims) and codebooks (pairs x 16 x 2), for vectors padded to pairs."""

    dims: int
    centres: np.ndarray
    books: np.ndarray
    eta: float

    @property
    def padded(self) -> int:
        return 4 * ((self.dims + 3) // 4)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - self.dims)))

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        return _nearest(x, self.centres)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Codes of rows given their cells, two to a byte."""
        code = assign(self.pad(x - self.centres[cell]), self.pad(_unit(x)), self.books, self.eta)
        return (code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: the inner product with what each byte stands for."""
        part = np.einsum("qjd,jkd->qjk", self.pad(q).reshape(len(q), -1, 2), self.books)
        low, high = part[:, 0::2, None, :], part[:, 1::2, :, None]
        return (low + high).reshape(len(q), -1, 256).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, 1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def assign(r: np.ndarray, u: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes that lower the anisotropic loss of residuals r with directions u, one pair of dimensions at a time."""
    n, pairs = len(r), len(books)
    rj, uj = r.reshape(n, pairs, 2), u.reshape(n, pairs, 2)
    plain = [((rj[:, j, None, :] - books[j]) ** 2).sum(2) for j in range(pairs)]
    code = np.stack([p.argmin(1) for p in plain], 1) if n else np.zeros((0, pairs), np.int64)
    along = [(rj[:, j, None, :] - books[j]) @ uj[:, j, :, None] for j in range(pairs)]
    along = [a[:, :, 0] for a in along]
    at = np.arange(n)
    total = sum(a[at, code[:, j]] for j, a in enumerate(along)) if n else np.zeros(0)
    for _ in range(rounds):
        for j in range(pairs):
            rest = total - along[j][at, code[:, j]]
            code[:, j] = (plain[j] + (eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
            total = rest + along[j][at, code[:, j]]
    return code


def fit(sample: np.ndarray, cells: int, seed: int = 0, threshold: float = 0.2, rounds: int = 6) -> Index:
    """Centres by k-means and codebooks by alternating assignment and weighted least squares."""
    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    centres = sample[rng.choice(n, min(cells, n), replace=False)].copy()
    for _ in range(10):
        near = _nearest(sample, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    index = Index(dims, centres, np.zeros((0, 16, 2)), eta)
    near = _nearest(sample, centres)
    r, u = index.pad(sample - centres[near]), index.pad(_unit(sample))
    pairs = index.padded // 2
    rj, uj = r.reshape(n, pairs, 2), u.reshape(n, pairs, 2)
    books = np.stack([rj[rng.choice(n, 16, replace=n < 16), j] for j in range(pairs)])
    for _ in range(rounds):
        code = assign(r, u, books, eta, 1)
        got = np.stack([books[j][code[:, j]] for j in range(pairs)], 1)
        along = ((rj - got) * uj).sum(2)
        total = along.sum(1)
        for j in range(pairs):
            rest = total - along[:, j]
            w = np.eye(2) + (eta - 1) * uj[:, j, :, None] * uj[:, j, None, :]
            b = np.einsum("nab,nb->na", w, rj[:, j]) + (eta - 1) * rest[:, None] * uj[:, j]
            left, right = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(left, code[:, j], w)
            np.add.at(right, code[:, j], b)
            ok = np.bincount(code[:, j], minlength=16) > 0
            books[j][ok] = np.linalg.solve(left[ok], right[ok][:, :, None])[:, :, 0]
    index.books = books
    return index


def probes_for(index: Index, sample: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Cells to visit so that `recall` of the sample's k nearest rows lie in them."""
    q = sample[:queries]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(index.centres)
    near = index.cell(sample)[np.argpartition(-score, k - 1, axis=1)[:, :k]]
    place = np.argsort(np.argsort(-(q @ index.centres.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, near, axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(recall * len(ranks)))]) + 1


def usable(v: Column) -> Column:
    """True for vectors without null or non-finite components, and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64, copy=False)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, each row's sum in the same order wherever the row lies."""
    return (x * q).sum(axis=1)


def best_of(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, of equal ones the first."""
    if len(score) <= n:
        return np.arange(len(score))
    least = np.partition(score, -n)[-n]
    above = np.flatnonzero(score > least)
    return np.r_[above, np.flatnonzero(score == least)[: n - len(above)]]


def visited(score: np.ndarray, rows: np.ndarray, probes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) of the cells each query visits, given its scores of all centres and the cells' rows.

    Centres in order of score, until `probes` cells are visited and they hold
    `least` rows or all there are. Cells without rows are no visit.
    """
    full = np.flatnonzero(rows > 0)
    order = np.argsort(-score[:, full], axis=1, kind="stable")
    held = np.cumsum(rows[full][order], axis=1)
    before = np.c_[np.zeros(len(score), np.int64), held[:, :-1]]
    who, place = np.nonzero((np.arange(len(full)) < probes) | (before < least))
    return who, full[order[who, place]]


def one_vector(good: DataFrame) -> DataFrame:
    """Rows with one vector for each vec_id: of several the greatest, component by component.

    Only ids are exchanged to find those that repeat; vectors are where some do.
    """
    again = stage(good.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "ann-repeats")
    if again.isEmpty():
        return good
    once = good.join(again, "vec_id", "left_anti")
    return once.unionByName(good.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.max("vec").alias("vec"), F.max("asks").alias("asks")).select(*good.columns))


def search(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 20_000, recall: float = 0.98, rerank: int = 40, margin: float = 1.5, cell_rows: int = 8192, query_rows: int = 16_384, most_cells: int = 16_384, fit_bytes: int = 64 << 20, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    Every query gets k rows, or all candidates if there are fewer: cells are
    visited until they hold that many. is_query is a condition on rows. Vectors
    that are null, zero, or hold null or non-finite components take no part,
    nor do rows without vec_id or with another number of dimensions than most
    have. A query's own vec_id is no candidate; ties go to the smaller vec_id;
    of rows that repeat a vec_id the one with the greatest vector stands for
    all, and asks if any does. An empty table gives an empty result; other
    columns, whatever their names, are not read. The sample and the centres are
    bounded by rows and by fit_bytes; long vectors mean fewer of both.
    """
    spark = rows.sparkSession
    ids, v = rows[vec_id], rows[embedding]
    good = rows.filter(ids.isNotNull() & usable(v)).select(ids.cast("long").alias("vec_id"), v.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    found = good.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = int(found["dims"]), int(found["count"])
    good = one_vector(good.filter(F.size("vec") == dims))
    most_rows = max(1, fit_bytes // (8 * dims))
    cells = int(min(most_cells, most_rows, max(1, round(n**0.5 / 8))))
    picked = good.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(min(sample, most_rows)).select("vec").toPandas()
    train = np.stack(picked["vec"].to_numpy()).astype(np.float64)
    index = fit(train, cells, seed)
    probes = probes_for(index, train, k, recall)
    shared = spark.sparkContext.broadcast(index)  # fit_bytes at most
    kind = good.schema["vec"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            x = _matrix(b.column(1), dims)
            cell = at.cell(x)
            codes = at.encode(x, cell)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], names=["cell", "vec_id", "vec", "code", "asks"])

    coded = stage(good.mapInArrow(encode, f"cell int, vec_id long, vec {kind}, code binary, asks boolean"), "ann-index")
    # One row per cell, most_cells at most.
    held = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                who, cell = visited(_matrix(part.column(1), dims) @ at.centres.T, held, probes, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0).take(pa.array(who))], names=["cell", "query_id"])

    asking = coded.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("ask"))
    visits = stage(asking.mapInArrow(probe, "cell int, query_id long"), "ann-visits")  # ids only
    # A cell's queries are dealt to pieces and its rows to chunks; every piece meets every chunk.
    load = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    shape = F.broadcast(spark.createDataFrame([(c, -(-int(held[c]) // cell_rows), -(-m // query_rows)) for c, m in load.items()], "cell int, chunks int, pieces int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = visits.join(shape, "cell").withColumn("piece", F.pmod(F.xxhash64("query_id"), F.col("pieces")).cast("int")).join(asking, "query_id")
    queries = asked.withColumn("chunk", each("chunks")).select("cell", "chunk", "piece", "query_id", "ask")
    dealt = coded.join(shape, "cell").withColumn("piece", each("pieces")).select("cell", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "piece", "vec_id", "vec", "code")

    def scan(ask: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(ask) or not len(data):
            return empty
        at = shared.value
        data = data.sort_values("vec_id", kind="stable")
        ids, x = data["vec_id"].to_numpy(), np.stack(data["vec"].to_numpy()).astype(np.float64, copy=False)
        code = np.frombuffer(b"".join(data["code"]), np.uint8).reshape(len(data), -1)
        names, q = ask["query_id"].to_numpy(), np.stack(ask["ask"].to_numpy()).astype(np.float64, copy=False)
        out = []
        centre = at.centres[int(data["cell"].iloc[0])]
        some = slice(None, None, max(1, len(x) // 64))
        for s in range(0, len(q), 64):
            part, who = q[s : s + 64], names[s : s + 64]
            table = at.tables(part)
            score = np.zeros((len(part), len(x)), np.float32)
            for j in range(code.shape[1]):
                score += table[:, j, :].take(code[:, j], axis=1)
            score += (part @ centre)[:, None].astype(np.float32)
            # How far the scan is out for each query, from rows spread over the cell.
            out_by = np.sqrt(((part @ x[some].T - score[:, some]) ** 2).mean(axis=1))
            for i in range(len(part)):
                score[i, ids == who[i]] = -np.inf
                near = best_of(score[i], rerank)
                exact = inner(x[near], part[i])
                if len(near) < len(x):
                    least = np.sort(exact)[-min(k, len(exact))] - margin * out_by[i]
                    near = np.union1d(near, np.flatnonzero(score[i] >= least))
                near = near[ids[near] != who[i]]
                exact = inner(x[near], part[i])
                top = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(top), who[i]), ids[near[top]], exact[top]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    # A candidate lies in one cell and chunk and a query in one piece, so that no pair comes twice.
    hits = queries.groupBy("cell", "chunk", "piece").cogroup(dealt.groupBy("cell", "chunk", "piece")).applyInPandas(scan, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = hits.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
