"""Near copies against a plain comparison of all pairs of texts."""

import random

import pytest
from pyspark.sql import functions as F

from daymart.llm import near_texts

NAMES = ["row", "key", "node", "a.b", "digest", "text2"]


def plain_kept(rows):
    """Places of (id, text) that stay: one by one, unless an earlier staying one is alike."""
    sets = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((words, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}))
    kept = []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        words, own = sets[k]
        for other in kept:
            theirs = sets[other][1]
            if words == sets[other][0] or (words and sets[other][0] and 5 * len(own & theirs) >= 4 * len(own | theirs)):
                break
        else:
            kept.append(k)
    return kept


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + 1] = [[], ["new%d" % rng.randrange(10**6)], [out[at], "more%d" % rng.randrange(10**6)]][kind]
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(3000)]
    out = [(None, None), (None, "one two"), (3, ""), (4, " \n"), (5, None), (6, "one two"), (7, "ONE\ttwo"), (8, "a b c d e"), (9, "a b c d f")]
    number = 20
    for length in (100, 300, 1000):
        for _ in range(12):
            words = [rng.choice(vocab) for _ in range(length)]
            out.append((number, " ".join(words)))
            for edits in (1, length // 60, length // 50, length // 45, length // 40, length // 15):
                number += 1
                out.append((number, edited(rng, words, edits)))
            number += 1
    # A family of many copies of one text, each with edits of its own.
    words = [rng.choice(vocab) for _ in range(400)]
    out += [(1000 + k, edited(rng, words, rng.randint(1, 6))) for k in range(60)]
    out += [(2000 + k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 400)))) for k in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], schema).repartition(4)


@pytest.mark.parametrize("rounds", [4, 0])
def test_what_stays_equals_brute_force(docs, rows, monkeypatch, rounds):
    """Held against the earliest of each group in rounds, or all pairs at once."""
    monkeypatch.setattr(near_texts, "ROUNDS", rounds)
    want = [rows[k] for k in plain_kept(rows)]
    kept = near_texts.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert 100 < len(want) < len(rows) - 100
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_repeated_rows_and_empty_tables(spark, docs, rows):
    once = near_texts.without_near_copies(docs).collect()
    twice = near_texts.without_near_copies(docs.unionByName(docs)).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, twice))
    assert near_texts.without_near_copies(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "x y")] * 5 + [(None, "x y")], "doc_id long, text string")
    assert [tuple(r) for r in near_texts.without_near_copies(same).collect()] == [(1, "x y")]


def test_all_near_fingerprints_are_linked(spark, monkeypatch):
    """Tiles of a few nodes, in one band and the next: every pair within the radius is joined, and no other is."""
    monkeypatch.setattr(near_texts, "TILE", 16)
    rng = random.Random(3)
    base = [rng.getrandbits(256) for _ in range(8)]
    prints = []
    for k in range(240):
        value = rng.choice(base)
        for _ in range(rng.randrange(24)):
            value ^= 1 << rng.randrange(256)
        prints.append((k.to_bytes(16, "big"), value.to_bytes(32, "big"), rng.choice([95, 100, 105])))
    nodes = spark.createDataFrame(prints, "node binary, print binary, size int").repartition(3)
    near = {(a, b) for i, (a, p, m) in enumerate(prints) for b, q, n in prints[i + 1 :] if (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() <= 20}
    every = [tuple(sorted((bytes(r.a), bytes(r.b)))) for r in near_texts.links(nodes, radius=20, every=True).collect()]
    assert set(every) == near and len(every) == len(near)

    def roots(pairs):
        root = {a: a for a, *_ in prints}
        for _ in range(20):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    some = [(bytes(r.a), bytes(r.b)) for r in near_texts.links(nodes, radius=20).collect()]
    assert len(some) < len(near) and roots(some) == roots(near)


def test_a_large_family_makes_few_pairs(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, edited(rng, words, 2)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    printed = near_texts._printed(docs.select(F.col("doc_id").alias("id"), "text", F.lit(0).cast("long").alias("digest")), 5)
    assert near_texts.links(printed).count() < 4 * 600
    assert near_texts.without_near_copies(docs).count() == len(plain_kept(rows))
