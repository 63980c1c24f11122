"""Language-model scores of whole documents, beside a smoothed unigram base.

Counts cover every training document: each task counts words, Spark adds the
counts up by a 64-bit hash of the word. The most frequent words become symbols
of the recurrent model; every other word is a member of one of a fixed number
of groups by its ending. The model gives the probability of a symbol; inside a
group a word has its smoothed share of the group's counts. So

    log p(word) = log p(symbol | text so far) [+ log share of the word in its group].

The recurrent model (see ``gru``) is trained on every training document, once,
in one of several rounds by hash. In each round every task trains on its share
from the same parameters and Spark averages the results by tokens. A caller who
wants a quicker model of less text may train on one document in ``one_in``. Words too rare for the table that tasks hold (at most
``table_words`` entries) get their counts by an ordinary join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrabrook.llm import gru
from spectrabrook.llm.common import fold, small_batches, stage

LN10 = float(np.log(10.0))


def tokens(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z; the end is a token of its own, added by the callers."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64).view(np.int64)


def groups_of(words: Iterable[bytes], groups: int) -> np.ndarray:
    """Rare words' groups: by their last three bytes."""
    return np.fromiter((zlib.crc32(w[-3:]) for w in words), np.int64) % groups


@dataclass
class Vocabulary:
    """What a task needs to turn words into symbols and shares."""

    groups: int
    hashes: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    symbols: np.ndarray  # a frequent word's symbol, or -1
    group_symbol: np.ndarray
    group_total: np.ndarray  # counts of a group's words, smoothed
    end: int
    end_count: int
    total: float  # N + 0.1 (V + 1)
    symbol_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def class_size(self) -> int:
        return max(1, round(len(self.symbol_counts) ** 0.5))


def count_words(docs: DataFrame, text: str, groups: int, flush: int = 200_000) -> DataFrame:
    """(h, g, c): hash, group and count of each word of docs, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def emit():
            cols = [pa.array(word_hashes(seen)), pa.array(groups_of(seen, groups).astype(np.int32)), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, names=["h", "g", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(tokens(t))
            if len(seen) > flush:
                yield emit()
        if seen:
            yield emit()

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, g int, c long")
    return rows.groupBy("h").agg(F.first("g").alias("g"), F.sum("c").alias("c"))


def build(counts: DataFrame, training_docs: int, groups: int, head: int, table_words: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts of words outside its table."""
    bucket = F.floor(F.log2("c") * 16)
    sizes = counts.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect()  # one row per sixteenth of an octave
    room, least = table_words, None
    for r in sizes:
        room -= r["count"]
        if room < 0:
            break
        least = r["b"]
    in_table = F.lit(False) if least is None else bucket >= least
    top = counts.filter(in_table).toPandas()  # at most table_words rows
    sums = counts.groupBy("g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(groups), np.zeros(groups)
    for r in sums:
        n[r["g"]], v[r["g"]] = r["n"], r["v"]
    total = n.sum() + training_docs + 0.1 * (v.sum() + (training_docs > 0) + 1)
    top = top.sort_values(["c", "h"], ascending=[False, True], kind="stable")
    first = top.head(head)
    np.subtract.at(n, first["g"].to_numpy(), first["c"].to_numpy())
    np.subtract.at(v, first["g"].to_numpy(), 1)
    group_total = n + 0.1 * (v + 1)
    # Symbols by falling count: frequent words, groups, the end.
    mass = np.r_[first["c"].to_numpy(float), group_total, float(training_docs)]
    order = np.argsort(-mass, kind="stable")
    symbol = np.empty(len(mass), np.int64)
    symbol[order] = np.arange(len(mass))
    symbols = np.full(len(top), -1, np.int64)
    symbols[: len(first)] = symbol[: len(first)]
    by_hash = np.argsort(top["h"].to_numpy(), kind="stable")
    words = Vocabulary(groups, top["h"].to_numpy()[by_hash], top["c"].to_numpy()[by_hash], symbols[by_hash], symbol[len(first) : len(first) + groups], group_total, int(symbol[-1]), training_docs, float(total), mass[order])
    return words, counts.filter(~in_table).select("h", "c")


class Lookup:
    """Words to slots of arrays, with a cache that is emptied when it holds most words."""

    def __init__(self, v: Vocabulary, most: int = 400_000):
        self.v, self.most = v, most
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        # Longer than the words known, by up to a factor of two.
        self.symbol = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.int64)
        self.tail = np.zeros(0, bool)
        self.base, self.share = np.zeros(0), np.zeros(0)

    def _learn(self, words: list[bytes]) -> None:
        v, first = self.v, len(self.slot)
        self.slot.update(zip(words, range(first, first + len(words)), strict=True))
        h, g = word_hashes(words), groups_of(words, v.groups)
        at = np.minimum(np.searchsorted(v.hashes, h), max(len(v.hashes) - 1, 0))
        hit = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
        sym = np.where(hit, v.symbols[at], -1) if len(v.hashes) else np.full(len(h), -1)
        logc = np.log10(np.where(hit, v.counts[at], 0) + 0.1) if len(v.hashes) else np.zeros(len(h))
        logc = np.where(hit, logc, 0.0)  # a tail word's comes by the join
        new = {"symbol": np.where(sym >= 0, sym, v.group_symbol[g]), "hash": h, "tail": ~hit, "base": logc - np.log10(v.total), "share": np.where(sym >= 0, 0.0, logc - np.log10(v.group_total[g]))}
        for name, x in new.items():
            held = getattr(self, name)
            if len(self.slot) > len(held):
                held = np.concatenate([held[:first], np.zeros(2 * len(self.slot) - first, held.dtype)])
                setattr(self, name, held)
            held[first : first + len(x)] = x

    def slots(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each document the slot of each word; words not seen before are learnt on the way."""
        size = [len(d) for d in docs]
        words = list(chain.from_iterable(docs))
        if len(self.slot) > self.most:
            self._clear()
        found = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            found[new] = [self.slot[words[i]] for i in new]
        return np.split(found, np.cumsum(size)[:-1])


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def train_round(spark, ids: DataFrame, p: dict[str, np.ndarray], start: int, task_tokens: int, tokens_in_round: int, piece: int = 16_384) -> dict[str, np.ndarray]:
    """Every task trains on its share of ids from p; the average by tokens of what they find."""
    shared = spark.sparkContext.broadcast(p)
    size = _pack(p).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [np.frombuffer(x, np.int16) for b in batches for x in b.column(0).to_pylist()]
        docs.sort(key=lambda d: (len(d), d.tobytes()))  # the same order whatever order rows arrived in
        if not docs:
            return
        found, seen = gru.train(shared.value, docs, start, lanes=min(576, max(8, sum(map(len, docs)) // 4096)))
        flat = _pack(found)
        parts = [flat[i : i + piece] for i in range(0, size, piece)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), task % 32), pa.int32()), pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), float(seen))), pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "part", "seen", "mean"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seen", "mean"])
        seen = pdf["seen"].sum()
        mean = np.sum([np.frombuffer(x, np.float32) * (n / seen) for x, n in zip(pdf["mean"], pdf["seen"], strict=True)], axis=0)
        return pd.DataFrame({"bucket": [0], "part": pdf["part"].iloc[:1].to_numpy(), "seen": [seen], "mean": [mean.astype(np.float32).tobytes()]})

    schema = "bucket int, part int, seen double, mean binary"
    tasks = max(1, -(-tokens_in_round // task_tokens))
    sums = ids.select("ids").repartition(tasks).mapInArrow(run, schema).groupBy("bucket", "part").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).toPandas()
    if not len(sums):
        return p
    flat = np.concatenate([np.frombuffer(x, np.float32) for x in sums.sort_values("part")["mean"]])
    return _unpack(flat, p)


def score_documents(docs: DataFrame, trains: Column, text: str = "text", doc_id: str = "doc_id", one_in: int = 1, rounds: tuple[int, ...] = (0, 1, 2, 2), head: int = 1792, groups: int = 255, hidden: int = 24, table_words: int = 1 << 18, task_tokens: int = 2_400_000, seed: int = 5) -> DataFrame:
    """One row per input row: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score.

    trains is a condition on docs: the rows to learn from. Null texts count as
    empty and hold the end token alone. Rows repeat as in docs, and repeated
    training rows count each time. Very long texts are scored whole, the state
    carried from window to window. Without training rows every word is unknown
    and the model is uniform. An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), trains.alias("trains"))
    learn = rows.filter("trains")
    counts = stage(count_words(learn, "text", groups), "lm-counts")
    training_docs = learn.count()
    v, tail = build(counts, training_docs, groups, head, table_words)
    shared = spark.sparkContext.broadcast(v)
    train_tokens = int(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]) + training_docs

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        look = Lookup(v)
        end_base = np.log10(v.end_count + 0.1) - np.log10(v.total)
        for b in batches:
            found = look.slots([tokens(t) for t in b.column(4).to_pylist()])
            rare = [look.hash[s[look.tail[s]]] for s in found]
            cols = [pa.array([len(s) + 1 for s in found], pa.int64()), pa.array([len(s) - len(r) + (v.end_count > 0) for s, r in zip(found, rare, strict=True)], pa.int64())]
            cols += [pa.array([float(look.base[s].sum()) + end_base for s in found], pa.float64()), pa.array([float(look.share[s].sum()) for s in found], pa.float64())]
            cols += [pa.array([np.append(look.symbol[s], v.end).astype(np.int16).tobytes() for s in found], pa.binary()), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], names=["row", "key", "doc_id", "trains", "n_tokens", "n_known", "base", "share", "ids", "tail"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), "doc_id", "trains", "text")
    encoded = stage(numbered.mapInArrow(encode, "row long, key long, doc_id long, trains boolean, n_tokens long, n_known long, base double, share double, ids binary, tail array<long>"), "lm-encoded")
    sample = encoded.filter(F.col("trains") & (F.pmod("key", F.lit(one_in)) == 0))
    of_round = F.array(*map(F.lit, rounds))[F.pmod(F.shiftrightunsigned("key", 20), F.lit(len(rounds))).cast("int")]
    sizes = {r["r"]: r["n"] for r in sample.groupBy(of_round.alias("r")).agg(F.sum("n_tokens").alias("n")).collect()}
    p = gru.initial(v.symbol_counts, v.class_size, hidden, seed)
    for r in sorted(set(rounds)):
        if sizes.get(r):
            p = train_round(spark, sample.filter(of_round == r), p, v.end, task_tokens, int(sizes[r]))
    model, end = spark.sparkContext.broadcast(p), v.end

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush():
            logp, at = gru.log_likelihoods(model.value, ids, end) / LN10, 0
            for b in held:
                scores = b.column(6).to_numpy() + logp[at : at + b.num_rows]
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(scores)], names=["row", "doc_id", "trains", "n_tokens", "n_known", "base", "score"])

        for b in batches:
            new = [np.frombuffer(x, np.int16) for x in b.column(7).to_pylist()]
            ids += new
            size += sum(map(len, new))
            held.append(b.select(range(7)))
            if size > 4_000_000:
                yield from flush()
                held, ids, size = [], [], 0
        if ids:
            yield from flush()

    scored = stage(encoded.select("row", "doc_id", "trains", "n_tokens", "n_known", "base", "share", "ids").mapInArrow(score, "row long, doc_id long, trains boolean, n_tokens long, n_known long, base double, score double"), "lm-scores")
    rare = encoded.select("row", F.explode("tail").alias("h")).join(tail, "h", "left")
    more = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("log_c"), F.count("c").alias("known"))
    done = scored.join(more, "row", "left")
    extra = F.coalesce("log_c", F.lit(0.0))
    return done.select("doc_id", "trains", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))


def lm_scores(docs: DataFrame, folds: int = 10, **how) -> DataFrame:
    """score_documents learning from rows whose crc32 of doc_id modulo folds is not zero; held_out marks the others."""
    scored = score_documents(docs, fold(F.col("doc_id"), folds) != 0, **how)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
