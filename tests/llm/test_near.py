"""Near copies against all-pairs comparison of shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webstrata.llm import near, shared


def slow_set(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def heads(rows):
    """Ids kept: the least of each component of pairs at similarity 0.8 and more."""
    sets = [slow_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (i, *_), g in zip(rows, label, strict=True):
        least[g] = min(least.get(g, 2**63), 2**63 if i is None else i)
    return sorted(least.values())


def edited(r, words, edits, vocabulary):
    out = list(words)
    for at in r.sample(range(len(out)), edits):
        out[at] = r.choice(vocabulary)
    return out


def rows(copies=12, texts=25):
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    out = [None, "", "  ", "One", "one", "a b c"]
    for _ in range(texts):
        base = r.choices(vocabulary, k=r.randrange(80, 400))
        out.append(" ".join(base))
        for edits in range(copies // 3):
            # Each edit changes five shingles: similarity from 1 down to about 0.5.
            out.append(" ".join(edited(r, base, max(1, edits * len(base) // 70), vocabulary)))
    return [(i + 10, t, "en", "s") for i, t in enumerate(out)] + [(None, out[6], None, None), (11, "", "en", "s")]


@pytest.mark.parametrize("shard_rows,cluster_rows", [(1024, 256), (3, 2)])
def test_kept_documents_match_all_pairs(spark, docs, shard_rows, cluster_rows):
    frame = docs(rows())
    kept = near.keep_one(frame, shard_rows=shard_rows, cluster_rows=cluster_rows)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == heads(rows())


def test_stage_drops_edited_copies(spark, docs, folder):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = r.choices(vocabulary, k=1000)
    texts = [base, edited(r, base, 20, vocabulary), edited(r, base, 200, vocabulary)]
    frame = docs([(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    assert sorted(x.doc_id for x in corpus_pipeline.keep_distinct(spark, frame, folder).collect()) == [0, 2]


def meets(a, b):
    """Whether two sets meet in a shard within the radii."""
    x, y = near.fingerprints(a), near.fingerprints(b)
    far = np.bitwise_count(x ^ y).astype(int)
    agree = ((x ^ y).view("<u2").reshape(-1, 4) == 0).any(axis=1)
    return bool((agree & (far <= near.RADIUS) & (far + np.roll(far, -1) <= near.RADIUS_TWO)).any())


@pytest.mark.parametrize("size,least", [(9, 0.9), (90, 0.97), (900, 0.97)])
def test_recall_at_the_least_similarity(size, least):
    r = np.random.default_rng(size)
    found = 0
    for _ in range(300):
        names = r.integers(0, 2**64, size * 10 // 9, np.uint64)
        cut = len(names) - size
        found += meets(np.sort(names[:size]), np.sort(names[cut:]))  # similarity 0.8
    assert found >= least * 300


def test_unrelated_sets_do_not_meet():
    r = np.random.default_rng(1)
    sets = [np.sort(r.integers(0, 2**64, 200, np.uint64)) for _ in range(200)]
    assert not any(meets(a, b) for i, a in enumerate(sets) for b in sets[:i])


def test_empty(spark, docs):
    assert near.keep_one(docs([])).count() == 0


def test_texts_are_not_shuffled_when_many_are_dropped(spark, docs):
    """Rows to drop go to the texts as one bit a row; texts outside of clusters stay where they are."""
    data = [(i, f"text {i // 2} of words that no other has {i // 2 * 7}", "en", "s") for i in range(4000)]
    data += rows(copies=6, texts=4)[3:-2]
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        kept = near.keep_one(docs(data))
        assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == list(range(0, 4000, 2)) + heads(data[4000:])


def test_lines_join_the_rows_they_name(spark, tmp_path):
    """Places in several files and runs of lines; left by semi, anti and inner joins, broadcast or not."""
    spark.range(30_000).repartition(3).write.parquet(str(tmp_path / "t"))
    table, place_of = shared.located(spark.read.parquet(str(tmp_path / "t")))
    listed = table.select("id", *place_of).where("id % 7 = 0 OR id < 9").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("id") % 2)))
    shared.line_maps(listed, "turn").write.parquet(str(tmp_path / "maps"))
    maps = spark.read.parquet(str(tmp_path / "maps"))
    want = {i for i in range(30_000) if i % 7 == 0 or i < 9}
    for hint in ("broadcast", "merge"):
        joined = {how: shared.join_lines(table, place_of, maps.hint(hint), how) for how in ("left_semi", "left_anti", "inner")}
        assert sorted(r.id for r in joined["left_semi"].select("id").collect()) == sorted(want)
        assert sorted(r.id for r in joined["left_anti"].select("id").collect()) == sorted(set(range(30_000)) - want)
        got = sorted(map(tuple, joined["inner"].select("id", "turn").collect()))
        assert got == sorted((i, t) for i in want for t in range(i % 2 + 1))
    assert maps.agg(F.sum(F.length("__bits"))).first()[0] <= 2 * 30_000 / 8 + 3 * 2 * 4
