"""Substring deduplication by content-defined chunks.

A 16-bit gear hash rolls over the UTF-8 bytes; each step shifts it by one bit
and adds the byte's entry of a fixed random table, so a position's value depends
on its last sixteen bytes only. A position cuts where the value is low and no
other low one lies within ``least`` bytes before it: cuts depend on nearby bytes
alone, and what is inserted moves those around it and no others. Chunks are
deduplicated by a 64-bit digest across documents. A passage counts as repeated
where neighbouring chunks that other documents hold too add up to ``least_words``
words or more; shorter chance repeats are left alone. Each of its chunks stays in
the smallest document that holds that chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrabrook.llm.common import small_batches, stage

REGISTER = 16
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32, 0]] = True


def gear_table(seed: int = 20240607) -> np.ndarray:
    """The 256 entries; zero for NUL, which separates texts."""
    table = np.random.default_rng(seed).integers(0, 1 << REGISTER, 256).astype(np.uint16)
    table[0] = 0
    return table


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling: the sum over j < 16 of table[byte i-j] << j."""
    h = table[data]
    for k in (1, 2, 4, 8):
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint16(k)
        h = wide
    return h


def chunk(texts: list[bytes], rate: int = 24, least: int = 10, most: int = 1024, table: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the ends of its chunks, their digests, and how many words begin in each."""
    gap = b"\0" * REGISTER
    joined = gap + gap.join(texts) + gap
    data = np.frombuffer(joined, np.uint8)
    cut = np.flatnonzero(gear(data, gear_table() if table is None else table) < (1 << REGISTER) // rate) + 1
    cut = cut[np.r_[True, np.diff(cut) >= least]] if len(cut) else cut
    blank = _BLANK[data]
    starts = np.cumsum(~blank & np.r_[True, blank[:-1]], dtype=np.int64)
    out, at = [], REGISTER
    for t in texts:
        end = at + len(t)
        lo, hi = np.searchsorted(cut, [at + 1, end])
        ends = np.append(cut[lo:hi], end) if len(t) else cut[:0]
        begin = np.r_[at, ends[:-1]] if len(t) else ends
        if len(t) and (ends - begin).max() > most:
            ends = np.concatenate([np.append(np.arange(b + most, e, most), e) for b, e in zip(begin.tolist(), ends.tolist(), strict=True)])
            begin = np.r_[at, ends[:-1]]
        digest = np.fromiter((xxhash.xxh3_64_intdigest(joined[b:e]) for b, e in zip(begin.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
        words = starts[ends - 1] - np.where(begin > 0, starts[begin - 1], 0) if len(t) else ends
        out.append((ends - at, digest.view(np.int64), words))
        at = end + REGISTER
    return out


def chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per document: row, doc_id, and arrays of chunk ends (bytes), digests and words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table()
        for b in batches:
            got = chunk([(t or "").encode("utf-8", "replace") for t in b.column(2).to_pylist()], table=table, **how)
            offset = pa.array(np.r_[0, np.cumsum([len(g[0]) for g in got])].astype(np.int32))
            flat = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3)]
            lists = [pa.ListArray.from_arrays(offset, pa.array(x.astype(t))) for x, t in zip(flat, (np.int32, np.int64, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["row", "doc_id", "ends", "digests", "words"])

    return rows.mapInArrow(run, "row long, doc_id long, ends array<int>, digests array<long>, words array<int>")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = 20, **how) -> DataFrame:
    """Passages that other documents hold too, one row per piece with one first document.

    doc_id, start and stop (bytes of the UTF-8 text), n_words, n_chunks,
    first_doc_id (the smallest doc_id that holds each of its chunks), stays (true
    in that document) and digest. A passage of least_words words or more is split
    where the first document changes, so that each chunk stays in its own first
    document; a piece may be shorter. Documents without such passages
    have no row. A passage that repeats only within its document doesn't count;
    rows that share a doc_id are one document, as are rows without one. Null
    texts are empty and have no chunks; very long texts are chunked whole. An
    empty table gives an empty result; other columns are not read.
    """
    found = stage(chunks(docs, text, doc_id, **how), "chunks")
    doc = F.coalesce("doc_id", F.lit(-(2**63)))
    seen = found.select(doc.alias("doc"), F.explode(F.array_distinct("digests")).alias("digest"))
    shared = stage(seen.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter(F.col("first") != F.col("last")).select("digest", "first"), "shared-chunks")
    each = found.select("row", doc.alias("doc"), F.posexplode(F.arrays_zip("ends", "digests", "words")).alias("pos", "c")).select("row", "doc", "pos", F.col("c.digests").alias("digest"), F.col("c.ends").alias("stop"), F.col("c.words").alias("words"))
    hits = each.join(shared, "digest")
    along = Window.partitionBy("row").orderBy("pos")
    near = F.lag("pos").over(along).eqNullSafe(F.col("pos") - 1)
    same = near & F.lag("first").over(along).eqNullSafe(F.col("first"))
    marked = hits.withColumn("_run", (~near).cast("int")).withColumn("_piece", (~same).cast("int"))
    numbered = marked.withColumn("run", F.sum("_run").over(along)).withColumn("piece", F.sum("_piece").over(along))
    whole = Window.partitionBy("row", "run")
    spans = (
        numbered.groupBy("row", "doc", "run", "piece")
        .agg(F.min("pos").alias("pos"), F.max("stop").alias("stop"), F.sum("words").cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), F.min("first").alias("first"), F.xxhash64(F.sum(F.xxhash64("digest").cast("decimal(38,0)"))).alias("digest"))
        .withColumn("_passage", F.sum("n_words").over(whole))
        .filter(F.col("_passage") >= least_words)
    )
    start = F.when(F.col("pos") == 0, 0).otherwise(F.element_at("ends", F.col("pos")))
    of_row = found.select("row", "doc_id", "ends")
    none = F.lit(-(2**63))
    return spans.join(of_row, "row").select(
        "doc_id",
        start.cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"),
        "n_words",
        "n_chunks",
        F.when(F.col("first") != none, F.col("first")).alias("first_doc_id"),
        (F.col("doc") == F.col("first")).alias("stays"),
        "digest",
    )


def cut_repeats(docs: DataFrame, spans: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the spans that don't stay cut out of their texts; doc_id must be unique."""
    gone = spans.filter(~F.col("stays") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cut"))
    cols = [c for c in docs.columns]

    @F.pandas_udf("string")
    def cut(texts, cuts):
        import pandas as pd

        out = []
        for t, spans in zip(texts, cuts, strict=True):
            if t is None or spans is None or not len(spans):
                out.append(t)
                continue
            raw, at, parts = t.encode("utf-8", "replace"), 0, []
            gaps = []
            for s in spans:
                if gaps and s["start"] <= gaps[-1][1]:
                    gaps[-1][1] = max(gaps[-1][1], s["stop"])
                else:
                    gaps.append([s["start"], s["stop"]])
            for start, stop in gaps:
                # A character with bytes on both sides of an edge stays.
                while start < stop and raw[start] & 0xC0 == 0x80:
                    start += 1
                while start < stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                    stop -= 1
                parts.append(raw[at:start])
                at = stop
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    small_batches(docs.sparkSession)
    joined = docs.join(gone, docs[doc_id] == gone["_id"], "left")
    return joined.select(*[cut(docs[c], gone["_cut"]).alias(c) if c == text else docs[c] for c in cols])
