"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that link differ in at most three of 64 bits, so they agree on at
least one of four 16-bit blocks. Each distinct fingerprint goes to four tries,
one per block, rotated so that the block comes first. The block's value is the
exchange key, that is, the top sixteen levels of the trie; below it a task
walks pairs of nodes together, adds the differing bits on the way down, and
drops a pair once its Hamming budget is exceeded. Equal texts and equal
fingerprints are one leaf. Groups above ``cell_rows`` are dealt out as pairs of
chunks, so that no task holds a hot group. A first walk with a budget of one
bit joins dense neighbourhoods cheaply; node pairs that already lie in one
class need no second visit. A task reports a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.llm.common import small_batches, stage
from spectrabrook.llm.components import components

BITS, BLOCKS = 64, 4
WIDTH = BITS // BLOCKS


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 if there are no words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    n = max(1, len(parts) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=n)
    of_byte = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts = np.bincount(of_byte.ravel(), minlength=2048).reshape(8, 256)
    bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = (counts @ bit).ravel()
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, key: bool = False) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long; with key, also a hash of the text."""
    small_batches(docs.sparkSession)
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    rows = docs.select(*cols, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], names=["doc_id", "key", "fp"])

    out = rows.mapInArrow(run, "doc_id long, key long, fp long")
    return out if key else out.drop("key")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest row of each class after the links a-b, starting from the classes in label."""
    label = label.copy()
    while len(a):
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def trie_links(group: np.ndarray, value: np.ndarray, budget: int, depth: int, label: np.ndarray, slice_pairs: int = 20_000) -> np.ndarray:
    """Classes of rows after linking values of one group within budget bits below the first depth bits.

    group and value are sorted together; values are unsigned with the shared
    bits on top. A node is a range of rows. Pairs of nodes descend together;
    pairs of single rows are compared at once.
    """
    n = len(value)
    if n < 2:
        return label
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    same = np.r_[0, np.cumsum(label[1:] != label[:-1])]
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, lo, hi, lo.copy(), hi.copy(), np.zeros(len(lo), np.int64))]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    found = 0
    while todo:
        level, alo, ahi, blo, bhi, far = todo.pop()
        if len(alo) > slice_pairs:
            for i in range(0, len(alo), slice_pairs):
                s = slice(i, i + slice_pairs)
                todo.append((level, alo[s], ahi[s], blo[s], bhi[s], far[s]))
            continue
        settled = (label[alo] == label[blo]) & (same[ahi - 1] == same[alo]) & (same[bhi - 1] == same[blo])
        single = (ahi - alo == 1) & (bhi - blo == 1)
        test = single & ~settled & (alo != blo)
        if test.any():
            a, b = alo[test], blo[test]
            near = _popcount(value[a] ^ value[b]) <= budget
            left.append(a[near])
            right.append(b[near])
            found += int(near.sum())
            if found > 2_000_000:
                label = _forest(n, np.concatenate(left), np.concatenate(right), label)
                same = np.r_[0, np.cumsum(label[1:] != label[:-1])]
                left, right, found = [], [], 0
        go = ~settled & ~single
        if level == BITS or not go.any():
            continue
        alo, ahi, blo, bhi, far = alo[go], ahi[go], blo[go], bhi[go], far[go]
        if level not in ones:
            ones[level] = np.r_[0, np.cumsum((value >> np.uint64(BITS - 1 - level)) & np.uint64(1))].astype(np.int64)
        c = ones[level]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        self_pair = alo == blo
        other = ~self_pair
        # (0,0), (1,1) keep the distance; (0,1) and, unless the pair is a node with itself, (1,0) add a bit.
        parts = [
            (alo, amid, blo, bmid, far),
            (amid, ahi, bmid, bhi, far),
            (alo, amid, bmid, bhi, far + 1),
            (amid[other], ahi[other], blo[other], bmid[other], far[other] + 1),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (nxt[4] <= budget) & (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        if keep.any():
            todo.append((level + 1, *(x[keep] for x in nxt)))
    return _forest(n, np.concatenate(left), np.concatenate(right), label) if left else label


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (blk, val, ci, cj, rot): links of all their groups, as spanning forests."""

    def settle(keys: np.ndarray, rot: np.ndarray, blk: np.ndarray):
        group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
        label = np.arange(len(rot))
        for most in sorted({1, budget}):
            if most <= budget:
                label = trie_links(group, rot, most, WIDTH, label)
        child = np.flatnonzero(label != np.arange(len(rot)))
        turn = (blk * WIDTH).astype(np.uint64)
        fp = np.where(turn == 0, rot, (rot >> turn) | (rot << ((np.uint64(BITS) - turn) % np.uint64(BITS)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[label[child]])], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        rot = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        # A group may go on in the next batch: hold back the rows of the last key.
        held.append((keys, rot))
        rows += len(rot)
        if rows < 50_000:
            continue
        keys, rot = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        held, rows = [(keys[cut:], rot[cut:])], len(rot) - cut
        if cut:
            yield settle(*_sorted(keys[:cut], rot[:cut]))
    if rows:
        keys, rot = (np.concatenate(x) for x in zip(*held, strict=True))
        yield settle(*_sorted(keys, rot))


def _sorted(keys: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spark sorts longs as signed; the trie needs unsigned order within a group."""
    group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
    order = np.lexsort((rot, group))
    return keys[order], rot[order], keys[order, 0]


def links(fps: DataFrame, budget: int = 3, cell_rows: int = 4096) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within budget bits of each other.

    fps has one row per distinct fingerprint, in a long column fp.
    """
    turned = [F.expr(f"(shiftleft(fp, {i * WIDTH}) | shiftrightunsigned(fp, {BITS - i * WIDTH}))") if i else F.col("fp") for i in range(BLOCKS)]
    rows = fps.select(F.posexplode(F.array(*turned)).alias("blk", "rot")).withColumn("val", F.shiftrightunsigned("rot", BITS - WIDTH).cast("int"))
    hot = rows.groupBy("blk", "val").count().filter(F.col("count") > cell_rows).select("blk", "val", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    dealt = rows.join(hot, ["blk", "val"], "left").withColumn("own", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("rot"), F.col("chunks")).cast("int")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))).select("blk", "val", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "rot")
    sorted_cells = cells.repartition("blk", "val", "ci", "cj").sortWithinPartitions("blk", "val", "ci", "cj")
    return sorted_cells.mapInArrow(lambda it: _walk(it, budget), "u long, v long")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, budget: int = 3, cell_rows: int = 4096) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, key (a hash of the text).

    component_id is the smallest doc_id reached over links of at most budget
    differing bits, the row's own included. Rows without words have fingerprint
    zero and link like any other. Null texts count as empty; a row with a null
    doc_id takes part, and its group's id is null only if all its ids are. Rows
    that repeat stay rows of their own; very long texts are hashed whole. An
    empty table gives an empty result; other columns of docs are not read.
    """
    fps = stage(fingerprints(docs, text, doc_id, words, key=True), "fingerprints")
    least = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct-fps")
    found = components(links(least.select("fp"), budget, cell_rows))
    joined = stage(least.join(found, least["fp"] == found["node"], "left").select("fp", "lo", F.coalesce("root", "fp").alias("root")), "classes")
    ids = joined.groupBy("root").agg(F.min("lo").alias("component_id"))
    of_fp = joined.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "key")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs without those that repeat a near-duplicate of smaller doc_id."""
    groups = near_groups(docs, text, doc_id, **how)
    lost = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(lost, docs[doc_id].cast("long").eqNullSafe(lost["_id"]) & (key == lost["_key"]), "left_anti")
