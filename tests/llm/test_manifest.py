"""Merkle manifest: trees, multiproofs and the audit against plain recursion."""

import hashlib
import random
import zlib

import pytest

from webstrata.llm import manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, source, lang, chars, text):
    return h("".join(map(part, (doc_id, source, lang, chars, text))))


def tree(leaves):
    """Levels of digests, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i:i + 2])) for i in range(0, len(now), 2)])
    return levels


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at & ~1:(at & ~1) + 2]
        out.append([None if i == at & 1 else d for i, d in enumerate(run)])
        at >>= 1
    return out


def fold(digest, steps):
    for run in steps:
        digest = h("".join(digest if d is None else d for d in run))
    return digest


def slow(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    by_lang = {}
    for i, text, lang, source, chars in rows:
        by_lang.setdefault(lang, []).append((i, leaf(i, source, lang, chars, text), source, chars, text))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda r: (first(r[0]), r[1]))
    trees = {lang: tree([r[1] for r in own]) for lang, own in by_lang.items()}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for at, (i, digest, source, chars, text) in enumerate(by_lang[lang]):
            steps = proof(trees[lang], at) + proof(top, n)
            shown = digest
            if i is not None and chars is not None and zlib.crc32(str(i).encode()) % 7 == 0:
                shown = leaf(i, source, lang, chars + 1, text)
            folded = fold(shown, steps)
            siblings = "".join(d for run in steps for d in run if d is not None)
            out.append((i, digest, trees[lang][-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 8, 13, 64, 100])
def test_multiproof_is_minimal_and_complete(leaves):
    r = random.Random(leaves)
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(leaves)]
    levels = [[bytes.fromhex(d) for d in level] for level in tree([d.hex() for d in digests])]
    for _ in range(20):
        held = sorted(r.sample(range(leaves), r.randint(1, leaves)))
        wanted = manifest.missing_nodes(held, leaves)
        assert len(wanted) == len(set(wanted))
        # Nothing that is fetched could be derived from the leaves held.
        for level, at in wanted:
            assert not set(range(at << level, min(at + 1 << level, leaves))) <= set(held)
        nodes = manifest.derive({i: digests[i] for i in held}, {(n, i): levels[n][i] for n, i in wanted}, leaves)
        assert nodes[-1][0] == levels[-1][0]
        for i in held:
            steps = manifest.expand(nodes, i, leaves)
            assert manifest.fold(digests[i], steps) == levels[-1][0]
            assert [s for _, s in steps if s] == [
                bytes.fromhex(d) for run in proof([[x.hex() for x in v] for v in levels], i) for d in run if d
            ]


def test_neighbouring_leaves_lack_few_nodes():
    wanted = manifest.missing_nodes(range(1000, 2000), 1 << 20)
    assert len(wanted) <= 2 * 20


@pytest.mark.parametrize("height,part_leaves", [(12, 8192), (2, 4), (1, 1), (3, 2)])
def test_audit_equals_recursion(spark, docs, height, part_leaves):
    r = random.Random(3)
    langs = ["de", "en", "en", "en", None, "é", "zz", "x y", ""]
    rows = [(i, r.choice([None, "", "text", "é" * 9]), r.choice(langs), r.choice([None, "s", "ß"])) for i in range(90)]
    rows += rows[:4] + [(5, "other", "en", "s"), (None, None, None, None), (None, "t", "en", None), (1000, "one", "only", "s")]
    frame = docs(rows)
    want = slow([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in frame.collect()])
    assert sorted((tuple(r) for r in manifest.audit(frame.repartition(5), height=height, part_leaves=part_leaves).collect()), key=str) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_keeps_the_whole_tree(spark, docs):
    rows = docs([(i, f"t{i}", "en" if i < 21 else "de", "s") for i in range(30)])
    leaves = rows.selectExpr("lang", "doc_id AS id", "unhex(sha2(text, 256)) AS digest", "unhex(sha2(text, 256)) AS claimed")
    built = manifest.build(leaves, height=2)
    number = {r.lang: r.tree for r in built.languages.collect()}
    assert number == {"de": 0, "en": 1}
    for lang, first, last in (("de", 21, 30), ("en", 0, 21)):
        want = {
            (level, at): d for level, row in enumerate(tree([h(f"t{i}") for i in range(first, last)])) for at, d in enumerate(row)
        }
        nodes = built.documents.nodes.where(f"tree = {number[lang]}").collect()
        assert {(r.level, r.at): r.digest.hex() for r in nodes} == want and len(nodes) == len(want)


def test_single_document_and_empty(spark, docs):
    one = manifest.audit(docs([(1, "a", "en", "s")])).collect()
    assert [tuple(r) for r in one] == slow([(1, "a", "en", "s", 1)])
    assert manifest.audit(docs([])).count() == 0
