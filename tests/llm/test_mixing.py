"""Mixing against a word-by-word replay of the schedule."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from webstrata.llm import mixing


def targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total = Fraction(sum(sizes.values()))
    out, capped = {}, {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        out = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: Fraction(most * sizes[s]) for s in free if out[s] > most * sizes[s]}
        if not over:
            return {**out, **capped}
        capped |= over


def rows():
    r = random.Random(4)
    out = [(i, "w " * r.choice([0, 1, 5, 60, 700]), None, r.choice(["a", "b", "c", "é", None])) for i in range(150)]
    out += [(900, "small source", None, "tiny"), (901, None, None, "empty"), (902, None, None, "a")]
    return out + [(903, "x " * 4000, None, "a"), (5, "again", None, "b"), (5, "again", None, "b"), (None, "n n", None, "b")]


def test_shares_are_the_filled_targets():
    r = random.Random(1)
    for _ in range(50):
        sizes = {s: r.choice([0, 1, 7, 100, 5000]) for s in r.sample(["a", "b", "ba", "é", "z", None], r.randrange(1, 7))}
        got = {p.source: Fraction(p.numerator, p.denominator) for p in mixing.shares(sizes)}
        assert got == targets(sizes)


@pytest.mark.parametrize("slots", [1 << 17, 300])
def test_taken_is_a_replay_of_the_slots(spark, docs, slots):
    data = rows()
    got = mixing.taken(docs(data).repartition(4), slots=slots).collect()
    sizes = Counter()
    for _, text, _, source in data:
        sizes[source] += len((text or "").split())
    want_target, total = targets(sizes), sum(sizes.values())
    parts = mixing.shares(sizes)
    block = max(1, -(-total // max(slots, 1024 * len(parts))))
    count = Counter()
    for i in range(-(-total // block)):
        point = i * mixing.GOLDEN % 2**32
        count[next(p.source for p in parts if p.low <= point < p.high)] += 1
    taken = Counter()
    for source in sizes:
        own = [(hashlib.md5(f"0:{'' if d is None else d}".encode()).hexdigest(), d is not None, d or 0, len((t or "").split()))
               for d, t, _, s in data if s == source]
        stream = [(d if known else None) for _, known, d, n in sorted(own) for _ in range(n)]
        words = min(count[source] * block, 3 * len(stream))
        for w in range(words):
            taken[source, stream[w % len(stream)]] += 1
    mine = Counter()
    for r, (d, _, _, s) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(data, key=lambda x: (x[0] is None, x[0] or 0))):
        assert r.taken <= 3 * r.size
        mine[s if r.doc_id != 5 else next(x[3] for x in data if x[0] == 5), r.doc_id] += r.taken
    for r in got:
        assert r.source_size in set(sizes.values())
        assert any(abs(r.target - float(t)) < 1e-6 for t in want_target.values())
    five = sum(v for (s, d), v in taken.items() if d == 5)
    assert sum(v for (s, d), v in mine.items() if d == 5) == five
    for key, value in taken.items():
        if key[1] != 5:
            assert mine[key] == value, key
    for source, target in want_target.items():
        there = sum(v for (s, _), v in taken.items() if s == source)
        assert abs(there - target) <= max(0.02 * float(target), 4 * block)


def test_reruns_agree(spark, docs):
    first, second = (
        sorted(map(tuple, mixing.taken(docs(rows()).repartition(n)).collect()), key=str) for n in (2, 7)
    )
    assert first == second


def test_mixed_documents_hold_the_words_taken(spark, docs):
    frame = docs(rows())
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    got = Counter()
    texts = {}
    for i, text, *_ in rows():
        texts.setdefault(i, []).append(text or "")
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.taken(frame).collect():
        want[r.doc_id] += r.taken
    assert got == +want


def test_schedule_is_even(spark):
    parts = mixing.shares({"a": 1000, "b": 1000, "c": 1000})
    owners = [r.owner for r in mixing.schedule(spark, 600, parts).orderBy("slot").collect()]
    for start in range(0, 600, 100):
        part = Counter(owners[start:start + 100])
        assert all(abs(part[i] - 100 * parts[i].target / 3000) <= 3 for i in range(3))


def test_empty(spark, docs):
    assert mixing.taken(docs([])).count() == 0
    assert mixing.mixed(docs([])).count() == 0
    only = mixing.taken(docs([(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in only] == [(0, 0, 0.0)] * 2


def test_small_sources_reach_their_targets_beside_a_hot_one(spark, docs, folder):
    r = random.Random(9)
    data = [(i, "w " * 20_000, None, "hot") for i in range(200)]
    data += [(1000 + i, "w " * r.randrange(1, 120), None, f"s{i % 40}") for i in range(80)]
    sizes = Counter()
    for _, text, _, source in data:
        sizes[source] += len(text.split())
    want = targets(sizes)
    # Blocks of about 100 words: many targets are below one, or a few.
    got = Counter()
    for x in mixing.taken(docs(data), slots=1, exact=True).collect():
        got[next(s for i, _, _, s in data if i == x.doc_id)] += x.taken
    assert all(abs(got[s] - t) <= 0.5 for s, t in want.items())
    out = Counter()
    for x in corpus_pipeline.mix_sources(spark, docs(data), folder).collect():
        out[x.source] += len(x.text.split())
    assert out == got
    made = mixing.mix(
        spark.createDataFrame([(i, i, s, len(t.split())) for i, t, _, s in data], "row long, id long, source string, size long"),
        slots=1, exact=True,
    )
    pieces = made.pieces.collect()
    assert sum(p.words for p in pieces) == sum(got.values())
    assert all(0 <= p.slot < -(-sum(sizes.values()) // made.block) for p in pieces)


def test_taken_names_the_golden_slots_of_a_source(spark, docs):
    """The slots of a source are the points frac(i * golden ratio) inside its interval of targets."""
    data = rows()
    got = {r["source"]: r["slots"] for r in mixing.taken(docs(data), slots=500, exact=True).join(
        docs(data).select("doc_id", "source"), "doc_id").collect() if r["doc_id"] in (900, 903)}
    sizes = Counter()
    for _, text, _, source in data:
        sizes[source] += len((text or "").split())
    total, want, low = sum(sizes.values()), {}, Fraction(0)
    number = -(-total // max(1, -(-total // max(500, 1024 * len(sizes)))))
    points = [Fraction(i * mixing.GOLDEN % 2**32, 2**32) for i in range(number)]
    goals = targets(sizes)
    for s in sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]:
        high = low + goals[s] / total
        want[s] = sum(int(low * 2**32) <= p * 2**32 < int(high * 2**32) for p in points)
        low = high
    assert got == {"tiny": want["tiny"], "a": want["a"]}


def test_texts_are_not_shuffled_when_the_places_are_many(spark, docs):
    """Places taken go to the texts as one bit a row; beyond the broadcast bound rows are the same."""
    frame = docs([(i, f"w{i} " * (i % 5 + 1), None, "abc"[i % 3]) for i in range(4000)])
    seen = []
    for bound in ("8k", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        try:
            out = mixing.mixed(frame, exact=True)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning" in plan) == (bound == "-1")
            seen.append(sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen[0] == seen[1]
    got = Counter(i for i, _, _ in seen[0])
    assert len(got) > 1500 and max(got.values()) > 1
