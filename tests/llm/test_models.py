"""Quality, toxicity and language: mathematics by brute force, held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from webstrata.llm import langid, quality, shared, toxicity


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, quality int, toxic int, text string, id string")


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    steps = r.normal(size=(2, 2))
    lengths = np.array([3, 0, 1, 5, 2])
    emission = r.normal(size=int(lengths.sum()))
    good, expected = quality.marginals(emission, lengths, steps)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        own = emission[at:at + n]
        at += n
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = math.exp(sum(e for e, s in zip(own, y) if s) + sum(steps[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        for t in range(n):
            want.append(sum(w for y, w in weights.items() if y[t]) / total)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(expected, pairs)


def test_neighbours_stay_inside_their_document():
    field = quality.fit([b"GOOD line here.\nmore of it.", b"### $$$\n!!! ###"] * 10, [1, 0] * 10)
    alone = [quality.score_texts(field, [t])[0] for t in (b"GOOD line here.", b"### $$$")]
    assert np.allclose(quality.score_texts(field, [b"GOOD line here.", None, b"### $$$"])[[0, 2]], alone)


def junk(r):
    return "\n".join(" ".join(r.choice(["###", "BUY!!", "$$$"]) for _ in range(8)) for _ in range(4))


def prose(r):
    return "\n".join(" ".join(r.choice(["the", "cat", "ran", "home", "again"]) for _ in range(9)) + "." for _ in range(4))


def quality_rows():
    r = random.Random(2)
    return [(i, junk(r) if i % 4 == 0 else prose(r), int(i % 4 > 0)) for i in range(200)]


def test_quality_of_held_out_documents(spark, docs):
    rows = quality_rows()
    frame = docs([(i, t, None, None) for i, t, _ in rows])
    labels = labelled(spark, [(i, q, None) for i, _, q in rows] + [(5, None, None), (None, 1, None)])
    got = {r.doc_id: r for r in quality.assess(frame, labels).collect()}
    for i, _, q in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == q == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1
    kept = quality.accept(frame, labels)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, q in rows if q]


def test_held_out_labels_are_never_learned(spark, docs):
    rows = quality_rows()
    frame = docs([(i, t, None, None) for i, t, _ in rows])
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q, None) for i, _, q in rows]
    scores = [
        sorted(map(tuple, quality.assess(frame, labelled(spark, x)).collect()))
        for x in ([(i, q, None) for i, _, q in rows], flipped)
    ]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("operator", [quality.assess, toxicity.assess])
def test_odd_texts_and_tables(spark, docs, operator):
    odd = [(1, None, None, None), (2, "", None, None), (3, " \n ", None, None), (None, "some words", None, None),
           (4, "word " * 50_000, None, None), (4, "word " * 50_000, None, None), (6, "\n" * 5000, None, None)]
    labels = labelled(spark, [(i, i % 2, i % 2) for i in range(8)])
    got = operator(docs(odd), labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    assert operator(docs([]), labels).count() == 0
    nothing = operator(docs(odd), labelled(spark, [])).collect()
    assert {r.score for r in nothing} == {0.5}


def test_logistic_and_windows():
    assert toxicity.windows(3).tolist() == [0]
    for n in range(1, 60):
        covered = {i for s in toxicity.windows(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))
    x = np.array([-2.0, -1, 1, 2] * 50)
    scale, shift = toxicity.logistic(x, (x > 0).astype(float))
    assert scale > 1 and abs(shift) < 0.1


def test_grams_share_buckets_with_misspellings():
    bucket, owner = toxicity.grams_of(["rotten", "rottten", "other"])
    sets = [set(bucket[owner == i]) for i in range(3)]
    assert len(sets[0]) == 6 + 5 + 4 + 1
    assert len(sets[0] & sets[1]) >= 6 and not sets[0] & sets[2]
    alone = [set(toxicity.grams_of([w])[0]) for w in ("rotten", "rottten", "other")]
    assert sets == alone and toxicity.grams_of([])[0].tolist() == []


def test_toxicity_of_held_out_and_misspelt(spark, docs):
    r = random.Random(3)
    syllables = ["ba", "ne", "lo", "ti", "ru", "sem", "or", "ka"]
    rows = []
    for i in range(600):
        words = ["".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(r.randrange(10, 80))]
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["blockhead", "dimwitted"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    frame = docs([(i, t, None, None) for i, t, _ in rows] + [(9001, "ba ne lo blockheaad ti ru", None, None)])
    labels = labelled(spark, [(i, None, t) for i, _, t in rows])
    got = {x.doc_id: x for x in toxicity.assess(frame, labels).collect()}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == t for i, t in held) >= 0.95 * len(held)
    assert got[9001].predicted == 1


def longest_match_phrases(text, sample):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i:i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_phrases_are_longest_matches():
    r = random.Random(5)
    samples = {k: ["".join(r.choices(a, k=300))] for k, a in (("x", "abc "), ("y", "bcd "), ("z", "aé🎉"))}
    model = langid.fit(samples)
    texts = ["".join(r.choices("abcdé🎉 ?", k=r.randrange(1, 200))) for _ in range(40)] + ["", "a"]
    got = langid.phrases(model, texts)
    # Symbols outside the basic plane are one symbol to the model, like all rare ones.
    plain = {k: v[0].replace("🎉", "\0") for k, v in samples.items()}
    for i, text in enumerate(texts):
        for j, lang in enumerate(model.languages):
            known = text.replace("🎉", "\0").replace("?", "\0")
            assert got[i, j] == longest_match_phrases(known, plain[lang]), (text, lang)


def test_long_texts_are_parsed_in_segments():
    model = langid.fit({"x": ["abab" * 50], "y": ["cdcd" * 50]})
    text = "ab" * 5000
    names, scores = langid.identify_texts(model, [text, "cdcdcdcd", "?? 12", None, ""])
    assert names == ["x", "y", "und", "und", "und"] and scores[0] > 0.99 and scores[2:].tolist() == [0, 0, 0]


def test_language_of_held_out_documents(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 0


def test_language_of_odd_tables(spark, docs):
    odd = [(1, None, "en", None), (2, "", "en", None), (3, "123 ...", "en", None), (None, "word", None, None), (4, "word", None, None)]
    assert {r.lang_pred for r in langid.identify(docs(odd)).collect() if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify(docs([])).count() == 0
    unlabelled = langid.identify(docs([(i, "some text", None, None) for i in range(5)])).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    one = langid.identify(docs([(i, "some text", "en", None) for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    frame = docs([(i, "some text", "en", None) for i in range(9)] + [(20, "...", None, None), (21, None, None, None)])
    kept = langid.accept(frame)
    assert kept.columns == frame.columns and kept.count() == 9


SYLLABLES = {
    "x": ["ka", "lo", "mi", "tun", "re", "sel", "da", "po", "vin", "gra"],
    "y": ["che", "ur", "oz", "bin", "lak", "ye", "fim", "dor", "wu", "ist"],
    "z": ["qua", "jeb", "hox", "pfi", "nym", "cru", "zag", "eth", "bly", "vok"],
}


def invented(r, lang, words):
    own = random.Random(lang)
    vocabulary = ["".join(own.choices(SYLLABLES[lang], k=own.randrange(1, 4))) for _ in range(400)]
    return " ".join(r.choices(vocabulary, k=words))


def test_noise_and_languages_never_learned_are_rejected(spark, docs):
    r = random.Random(6)
    rows = [(i, invented(r, "xy"[i % 2], r.randrange(30, 120)), "xy"[i % 2], "s") for i in range(200)]
    noise = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=400)) for _ in range(20)]
    odd = [(1000 + i, t, None, "s") for i, t in enumerate(noise + [invented(r, "z", 80) for _ in range(20)])]
    kept = {x.doc_id for x in langid.accept(docs(rows + odd)).collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 0.99 * len(rows)


def many_characters(r, first, words):
    """Unspaced text of a script with 1,500 characters from ``first``, the low ones more often."""
    return "".join(chr(first + int(1500 * r.random() ** 2)) for _ in range(words))


def test_scripts_of_many_characters_are_told_apart():
    r = random.Random(7)
    own = {}
    # Two languages over the same 1,500 characters with words of their own, and one beyond U+FFFF.
    for lang, first in (("han", 0x4E00), ("kan", 0x4E00), ("ext", 0x20000)):
        own[lang] = [many_characters(r, first, r.randrange(1, 4)) for _ in range(1500)]
    for k, first in enumerate((0x430, 0x3B1, 0x561, 0x10D0, 0x905)):
        own[f"a{k}"] = ["".join(chr(first + r.randrange(22)) for _ in range(r.randrange(2, 8))) for _ in range(400)]
    own["x"] = [invented(r, "x", 1) for _ in range(400)]
    text = {k: lambda n, k=k, v=v: ("" if k in ("han", "kan", "ext") else " ").join(r.choices(v, k=n)) for k, v in own.items()}
    model = langid.fit({k: [text[k](200) for _ in range(10)] for k in own})
    texts = [(k, text[k](150)) for k in own for _ in range(10)]
    names, _ = langid.identify_texts(model, [t for _, t in texts])
    assert sum(n == k for n, (k, _) in zip(names, texts)) >= 0.97 * len(texts)
    assert len(model.symbols) > 2000


def test_tables_of_long_documents_only_are_learned_from(spark, docs):
    r = random.Random(6)
    good, bad = ("the river runs past the old town " * 3, "zzq xxkw 0101 ~~ qqpz "), ("kill fool idiot ", "lovely day friend ")
    texts = []
    for i in range(80):
        kind = good[i % 2]
        texts.append((i, "\n".join(" ".join(r.sample(kind.split(), len(kind.split()))) for _ in range(900)), "en", "s"))
    frame = docs(texts)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2)) for i in range(80)], "doc_id long, quality int, toxic int")
    scored = quality.assess(frame, labels).collect()
    assert all(x.predicted == int(x.doc_id % 2 == 0) for x in scored)
    found = toxicity.assess(frame, labels).collect()
    assert {x.predicted for x in found} == {0, 1} and sum(x.predicted == x.doc_id % 2 for x in found) > 70
    assert {x.lang_pred for x in langid.identify(frame).collect()} == {"en"}


def test_a_stretch_has_whole_lines_of_a_long_text(spark):
    text = "\n".join(f"line {i} end" for i in range(500))
    frame = spark.createDataFrame([(i, text) for i in range(20)], "id long, text string")
    rows = frame.select("id", shared.stretch(frame.text, frame.id, 300).alias("t")).collect()
    assert {len(x.t) for x in rows} == {300} and len({x.t for x in rows}) > 5
    for x in rows:
        assert set(shared.whole_lines(x.t, True).split("\n")) <= set(text.split("\n"))


def plain_toxicity(model, text):
    """Score of a text by loops: n-grams of every word, every window, the worst one."""
    mask, prime = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def bucket(value):
        return ((value ^ (value >> 31)) * prime & mask) >> (64 - toxicity.BUCKET_BITS)

    def word_value(word):
        codes = [ord(c) for c in f"<{word}>"]
        found = []
        for n in toxicity.GRAMS:
            for i in range(len(codes) - n + 1):
                value = n
                for c in codes[i:i + n]:
                    value = (value * prime + c) & mask
                found.append(bucket(value))
        found.append(bucket(sum(c * pow(prime, i + 1, 1 << 64) for i, c in enumerate(codes)) & mask))
        return sum(model.values[b] for b in found) / len(found)

    words = toxicity.words_of(text)
    if not words or model.scale == 0:
        return model.prior
    values = [word_value(w) for w in words]
    last = max(len(words) - toxicity.WINDOW, 0)
    starts = sorted({*range(0, last + 1, toxicity.STRIDE), last})
    means = [sum(values[s:s + toxicity.WINDOW]) / len(values[s:s + toxicity.WINDOW]) for s in starts]
    return 1 / (1 + math.exp(-(model.scale * (max(means) + model.bias) + model.shift)))


def test_toxicity_scores_equal_plain_loops():
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdé日", k=r.randrange(1, 12))) for _ in range(60)] + ["x" * 90]
    texts = [None, "", "!!", "One two"] + [" ".join(r.choices(vocabulary, k=r.randrange(1, 60))) for _ in range(60)]
    model = toxicity.fit(texts, [i % 3 == 0 for i in range(len(texts))])
    values = np.random.default_rng(0).normal(size=toxicity.BUCKETS)
    for own in (model, toxicity.Model(values, 0.3, 1.7, -0.2, 0.4), toxicity.Model(values, scale=0.0, prior=0.25)):
        got = own.scores(texts, {})
        assert np.allclose(got, [plain_toxicity(own, t) for t in texts], atol=1e-9)
