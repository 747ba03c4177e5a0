"""Spelling variants, matrix BPE and fill-in-middle against plain versions."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from daymart.llm import fill_in_middle, matrix_bpe, queries, spelling
from tests.conftest import SMALL

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, n long, form string, id string, word string, bytes binary"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    letters = "abcdeéñ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)]

    def varied(word):
        at, kind = rng.randrange(len(word)), rng.randrange(6)
        return {0: word[:at] + word[at + 1 :], 1: word[:at] + rng.choice(letters) + word[at:], 2: word[:at] + rng.choice(letters) + word[at + 1 :]}.get(kind, word)

    def prose(n):
        return "".join(varied(stems[min(int(rng.expovariate(0.1)), 39)]) + rng.choice([" ", " ", "\n", ", ", "\r\n", "  ", " 12 ", "\t", "×", "日本"]) for _ in range(n))

    out = [None, "", " \n\t ", "\n", "\n\n", "a", "tail\n", "<P>", "x <S>\ny", "<M", "<P\n>", "a\nb $1 \\1\n{2}"]
    out += ["ab" * 3000, "A" * 50 + "\n" * 400, "Straße ÉCOLE école don't we'll \x1c \x85 \u2028", "<|endoftext|> 𝒳\n𝒴", prose(20000), prose(4000).upper()]
    out += [prose(rng.randint(1, 300)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, 1, "psm", "x", "y", b"z") for k, t in enumerate(texts)]
    rows += [rows[16], rows[20]]  # repeated rows
    rows += [(None, texts[17], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least_n=5, times=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_n}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, found in near.items():
        if found:
            top = min(found, key=lambda x: (-words[x], x))
            if words[top] >= times * words[w]:
                forms[w] = top

    def root(w):
        return root(forms[w]) if w in forms else w

    return [(w, forms.get(w), root(w), n, len(near[w]), words.get(forms.get(w))) for w, n in words.items()]


@pytest.mark.parametrize("times", [2, 5])
def test_spelling_variants(docs, rows, times):
    want = plain_variants(rows, times=times)
    assert sum(form is not None for _, form, *_ in want) > 10
    same(map(tuple, spelling.spelling_variants(docs, times=times).collect()), want)


def test_spelling_variants_with_frequent_grams(docs, rows, monkeypatch):
    """Where no gram and where every gram counts as frequent, the same words are near."""
    want = plain_variants(rows)
    for share in (1, 10**9):
        monkeypatch.setattr(spelling, "SHARE", share)
        same(map(tuple, spelling.spelling_variants(docs).collect()), want)


def test_spelling_chains_and_edges(spark, none):
    assert spelling.spelling_variants(none).collect() == []
    with pytest.raises(ValueError, match="shorter"):
        spelling.spelling_variants(none, least_chars=5)
    with pytest.raises(ValueError, match="circles"):
        spelling.spelling_variants(none, times=1)
    # A chain of ten forms, each once as frequent as the one before it.
    chain = ["x" * 6 + "y" * k for k in range(11)]
    counted = spark.createDataFrame([(w, 2 ** (k + 1)) for k, w in enumerate(chain)], "word string, n long")
    forms = spark.createDataFrame(list(zip(chain[:-1], chain[1:], strict=True)), "word string, form string")
    assert {r.root for r in spelling.roots_of(forms).collect()} == {chain[-1]}
    near = {(r.word, r.near) for r in spelling.near_words(counted).collect()}
    assert near == {(a, b) for a in chain for b in chain if one_edit(a, b)}


def test_one_edit_leaves_a_listed_gram():
    """The bound holds: near words share one of the lists that the bound asks for, whatever is frequent."""
    rng = random.Random(2)
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(6, 14)))
        frequent = {bytes(rng.choice(b"abc\x01\x02") for _ in range(rng.randint(2, 3))) for _ in range(rng.randint(0, 40))}
        at = rng.randrange(len(word))
        other = rng.choice([word[:at] + word[at + 1 :], word[:at] + b"d" + word[at:], word[:at] + b"d" + word[at + 1 :]])
        if len(other) < 6:
            continue
        sides = []
        for own in (word, other):
            own = spelling.FIRST + own + spelling.LAST
            grams = spelling.grams_of(own, frequent)
            assert spelling.bound_of(grams) < len(grams)
            sides.append({("L", s, own[: e + 1]) for s, e in grams} | {("R", len(own) - 1 - e, own[s:]) for s, e in grams})
            assert len(grams) - spelling.bound_of(grams) >= 1
        own = spelling.FIRST + word + spelling.LAST
        grams = spelling.grams_of(own, frequent)
        shared = sum(("L", s, own[: e + 1]) in sides[1] or ("R", len(own) - 1 - e, own[s:]) in sides[1] for s, e in grams)
        assert shared >= len(grams) - spelling.bound_of(grams)


@pytest.fixture(scope="module")
def engine():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matrix_bpe(docs, rows, none, engine):
    want = [(i, np.array(engine.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in rows]
    want = [(i, len(ids) // 4, ids, raw) for i, ids, raw in want]
    got = matrix_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    same([(*tuple(r)[:2], bytes(r[2]), bytes(r[3])) for r in matrix_bpe.decode(got, RANKS).collect()], want)
    both = matrix_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    same([(*tuple(r)[:2], bytes(r[2]), bytes(r[3])) for r in both.collect()], want)
    assert matrix_bpe.encode(none, RANKS, public_tokenizers.PATTERN).collect() == []
    assert matrix_bpe.decode(got.limit(1).withColumn("token_ids", F.lit(None).cast("binary")), RANKS).first().bytes is None


def test_matrix_rounds_are_exact(engine, monkeypatch):
    """Pieces of all lengths, in matrices and, beyond LONG, from the heap; a task that keeps starting afresh."""
    ranks = matrix_bpe.ranks_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(4)
    words = ["".join(rng.choice(["ab", "ing", "é", "日", "x", "the", "ß", "aaaa"]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    monkeypatch.setattr(matrix_bpe, "CELLS", 256)
    want = [engine.encode_ordinary(w) for w in words]
    for long in (1024, 40, 1):
        monkeypatch.setattr(matrix_bpe, "LONG", long)
        assert [i.tolist() for i in ranks.encode_pieces([w.encode() for w in words])] == want
    known = matrix_bpe.Known(ranks)
    for text in (" ".join(words[:50]), "", words[3]):
        numbers = known.numbers(text)
        known.learn()
        assert known.tokens(numbers).tolist() == engine.encode_ordinary(text)


def test_white_space_is_unicodes(engine):
    ranks = matrix_bpe.ranks_of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    known = matrix_bpe.Known(ranks)
    for c in [*range(0x3100), 0xFEFF, 0x1F600]:
        text = f"the{chr(c)}the 7{chr(c)}7 {chr(c)}{chr(c)} the"
        numbers = known.numbers(text)
        known.learn()
        assert known.tokens(numbers).tolist() == engine.encode_ordinary(text), hex(c)


def plain_middle(i, text, percent=100):
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return i, n, "plain", None, None, text
    if h4 % 100 < 50:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent", [100, 40, 0])
def test_fill_in_middle(docs, rows, none, percent):
    made = fill_in_middle.fill_in_middle(docs, percent=percent)
    same(map(tuple, made.collect()), [plain_middle(i, t, percent) for i, t in rows])
    back = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")))
    same(map(tuple, back.collect()), rows)
    assert fill_in_middle.fill_in_middle(none).collect() == []


def test_fill_in_middle_of_very_long_texts(spark):
    """A hundred thousand lines, and one line of a million characters: the pattern neither recurses nor backtracks."""
    texts = ["é\r\nb$1\\n\n" * 50_000, "z" * 1_000_000, "\n" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fill_in_middle.fill_in_middle(docs)
    same(map(tuple, made.collect()), [plain_middle(i, t) for i, t in enumerate(texts)])
    assert "MapIn" not in made._jdf.queryExecution().executedPlan().toString()


def test_queries_over_the_small_tables(spark, engine):
    docs = [(r.doc_id, r.text or "") for r in queries.documents(spark, SMALL).collect()]

    def sha(raw):
        return hashlib.sha256(raw).hexdigest()

    want = []
    for i, text in docs:
        ids = engine.encode_ordinary(text)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())))
    same(map(tuple, queries.op12_matrix_bpe(spark, SMALL).collect()), want)
    same(map(tuple, queries.op11_spelling_variants(spark, SMALL).collect()), plain_variants(docs))
    middle = [plain_middle(i, t) for i, t in docs]
    same(map(tuple, queries.op13_fill_in_middle(spark, SMALL).collect()), [(*m[:5], sha(m[5].encode()), sha(t.encode())) for m, (_, t) in zip(middle, docs, strict=True)])
