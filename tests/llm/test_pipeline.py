"""The pipeline against its stages' rules, on the smallest table."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabrook.llm import jaccard, mixing, toxicity

SF = "/root/testdata/sf0.001"


def five_word_shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    both = len(a & b)
    return both >= 0.8 * (len(a) + len(b) - both) - 1e-9


def test_pipeline_matches_brute_force(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    left = {i: r for i, r in rows.items() if i not in bad}
    largest = {}
    for i, r in left.items():
        largest[r["text"].encode().lower()] = max(i, largest.get(r["text"].encode().lower(), i))
    left = {i: left[i] for i in largest.values()}
    # The stage's rule: five words, a similarity of 0.8 or more, the smallest id of a class stays.
    sets = {i: five_word_shingles(r["text"]) for i, r in left.items()}
    group = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if group[b] > group[a] and similar(sets[a], sets[b]):
                    group[b], changed = group[a], True
    left = {i: left[i] for i in set(group.values())}
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(docs.filter(F.col("doc_id").isin(list(left)))).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_proto=corpus_pipeline.piece_model())
    want = Counter()
    for i, r in left.items():
        ids = sp.encode(r["text"], add_bos=True, add_eos=True)
        if taken[i]:
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += taken[i]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_near_copies_match_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rnd.choices(words, k=15))
    rows = [(i, f"{' '.join(rnd.choices(words, k=rnd.randint(20, 90)))} {line}") for i in range(60)]
    base = rnd.choices(words, k=200)
    rows += [(100 + i, " ".join(rnd.choice(words) if rnd.random() < 0.015 else w for w in base)) for i in range(60)]
    for i in range(40):
        t = rows[rnd.randrange(60)][1].split()
        for _ in range(rnd.randint(1, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((200 + i, " ".join(t)))
    rows += [(300, "a b c"), (301, "A  b c"), (302, "a b d"), (303, ""), (304, "  "), (305, None), (305, None), (None, "a b c")]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).collect()]

    sets = [five_word_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    want = Counter((i, t) for g, (i, t) in zip(group, rows, strict=True) if i == least[g])
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, SF).collect())
    assert got == want
    assert corpus_pipeline.near_copies(spark, df.limit(0), SF).count() == 0


def test_equal_words_are_one_shingle_from_five_words_on(spark):
    rows = [(n, " ".join(["w"] * n)) for n in range(1, 9)] + [(20, "a b c d e"), (21, "a b c d e a b c d")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, SF).collect()) == [1, 2, 3, 4, 5, 20, 21]


def test_one_text_of_a_repeated_doc_id_stays(spark):
    text = [f"w{i}" for i in range(60)]
    near = [" ".join(text), " ".join([*text, "x"]), " ".join([*text, "y"])]
    other = [" ".join(f"v{i}" for i in range(50)), " ".join(f"v{i}" for i in range(51))]
    rows = [(7, t) for t in near] + [(9, near[0]), (None, near[1])] + [(None, t) for t in other]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, SF).collect()]
    assert sorted((i for i, _ in kept), key=str) == [7, None]
    assert all(t in (near if i else other) for i, t in kept)


def test_signatures_bound_the_difference_and_votes_match_the_rule():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[n // 4 :], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)])
        apart = int(np.bitwise_count((jaccard.signature(a) ^ jaccard.signature(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0
        want = sum(1 << k for k in range(64) if 2 * int(((a >> np.uint64(k)) & np.uint64(1)).sum()) > len(a))
        assert jaccard.vote(a) % (1 << 64) == want
