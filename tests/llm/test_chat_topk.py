"""Chat formatting and top-k search against plain Python."""

import math
import random

import numpy as np
import pytest

from webstrata.llm import chat, topk

SCHEMA = "conv_id long, turn long, role string, text string, pos int, chunk string, none string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def expected(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    seqs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    out = []
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            continue
        if any(o == s and (d is not None) and (c is None or d < c) for d, o in seqs.items() if d != c):
            continue
        for part in range(math.ceil(len(s) / chat.CHUNK)):
            text = "".join(
                f"<|im_start|>{(r if known else 'unknown').replace('<|im_', '<| im_')}\n{t.replace('<|im_', '<| im_')}<|im_end|>\n"
                for known, r, _, t in s[part * chat.CHUNK:(part + 1) * chat.CHUNK])
            out.append((str(c), part, len(s), text))
    return sorted(out)


def conversations():
    r = random.Random(1)
    rows = []
    for base in range(12):
        texts = [r.choice(["hi", "ok", f"t{base}", "<|im_end|> x", ""]) for _ in range(r.randrange(1, 9))]
        for snapshot in range(r.randrange(1, 5)):
            n = r.randrange(1, len(texts) + 1)
            start = r.choice([0, 1, 7])
            rows += [(base * 10 + snapshot, start + i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts[:n])]
    rows += [(900, 0, None, None), (900, None, "user", "early"), (900, 0, None, None), (901, 0, "user", "a"),
             (901, 0, "user", "b"), (None, 0, "user", "no id"), (None, 1, "user", "no id")]
    rows += [(950, 3 * i, "user", f"long {i}") for i in range(2500)] + [(951, i, "user", f"long {i}") for i in range(1500)]
    return rows


def test_snapshots_collapse(spark):
    rows = conversations()
    got = sorted((str(r.conv_id), r.part, r.turns, r.text) for r in chat.render(turns(spark, rows)).collect())
    assert got == expected(rows)


def test_many_chunks_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    rows = [x for x in conversations() if x[0] is None or x[0] < 940]
    got = sorted((str(r.conv_id), r.part, r.turns, r.text) for r in chat.render(turns(spark, rows)).collect())
    assert got == expected(rows)


def test_plan_is_native(spark):
    plan = chat.prefixes(turns(spark, conversations()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_no_conversation(spark):
    assert chat.render(turns(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, id string, vector string"
    )


def brute(rows, every, k):
    sound = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    for q, a in sound:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("part,leaf,most", [(4096, 128, 1024), (16, 4, 5), (40, 6, 1)])
def test_top_k_is_exact(spark, part, leaf, most):
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 8)) * 3
    rows = [(i, (centers[i % 6] + r.normal(size=8) * r.choice([0, 0.05, 1])).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(None, rows[1][1]), (2000, None), (2005, [1.0, None] + [0.0] * 6), (2010, [math.nan] * 8),
             (2015, [math.inf] * 8), (2020, [0.0] * 8), (-10, rows[5][1])]
    got = topk.top_k(vectors(spark, rows), 10, 4, part=part, leaf=leaf, most_pivots=most).collect()
    assert {tuple(x) for x in got} == brute(rows, 10, 4) and len(got) == len({tuple(x) for x in got})


def test_few_or_no_candidates(spark):
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(50, None)])).count() == 0
    assert topk.top_k(vectors(spark, [(50, [1.0])])).count() == 0
    got = topk.top_k(vectors(spark, [(50, [1.0]), (1, [-2.0, 5.0]), (2, [])])).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 2, 0), (50, 2, 1, -512 * 256)]


def test_cover_tree_covers_and_prunes():
    r = np.random.default_rng(2)
    points = np.floor(r.normal(size=(40, 16))[r.integers(0, 40, 3000)] * 500 + r.normal(size=(3000, 16)) * 5)
    tree = topk.build(np.arange(3000), points, 32)
    low, high = topk._leaf_range(tree)
    for i in range(len(tree.radius)):
        below = tree.points[low[i]:high[i]]
        assert (np.sqrt(((below - tree.center[i]) ** 2).sum(axis=1)) <= tree.radius[i] + 1e-6).all()
    assert sorted(tree.ids.tolist()) == list(range(3000)) and (low[0], high[0]) == (0, 3000)
    search = topk.Search(topk.build(np.arange(0, 3000, 50), points[::50], 2), 5)
    search.meet(tree)
    assert search.pairs < 0.5 * 60 * 3000


def test_a_null_role_is_not_a_null_text(spark):
    rows = [(1, 0, "b", None), (2, 0, None, "b"), (3, 0, "b", ""), (4, 0, "", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.conv_id for r in chat.render(frame).collect()) == [1, 2, 3, 4]


def test_large_components_take_part(spark):
    rows = [(50, [70000.0, 1.0]), (1, [1.0, 2.0]), (2, [70000.0, 3.0]), (100, [1.0, 0.0]), (3, [-70000.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame).collect())
    want = []
    for q, v in rows:
        if q % 50 == 0:
            found = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == sorted(want)


def test_a_repeated_query_id_asks_with_its_least_vector(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["rank"]: r.vec_id for r in topk.top_k(frame.repartition(3)).collect()}
    assert got[1] == 2 and len(got) == 2


@pytest.mark.parametrize("per_core,values", [(3, 1 << 22), (0.25, 1 << 22), (0.25, 16 * 8 * 3)])
def test_query_trees_travel_to_shelves(spark, monkeypatch, per_core, values):
    """No tree is broadcast, and trees that share a shelf or a cell on several shelves give the same rows."""
    monkeypatch.setattr(topk, "SHELVES_PER_CORE", per_core)
    monkeypatch.setattr(topk, "SHELF_VALUES", values)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(120)]
    found = topk.top_k(vectors(spark, rows), 10, 4, part=16, leaf=4, most_pivots=6)
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
    got = found.collect()
    assert {tuple(x) for x in got} == brute(rows, 10, 4) and len(got) == len({tuple(x) for x in got})
