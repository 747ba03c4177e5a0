"""Words and their spelling variants: an index of variable-length grams, and forms followed to their roots.

Words are counted in the tasks that read the texts. Then:

* *Gram dictionary.* Grams of LEAST to LONGEST characters of all words are counted; those held by more than
  one in SHARE of all grams of their length are frequent, and every one-character extension of a frequent gram
  is in the dictionary. So the frequent ones are at most SHARE for a length, whatever the corpus, and lists
  of frequent grams are split where a longer gram tells them apart.
* *Decomposition.* From each place of a word (with a mark at either end) the longest gram of the dictionary is
  taken, unless one taken before covers it. Where a gram stops depends on its own characters only.
* *Bound.* One edit at place i can change only the grams that end at i to i + LONGEST - 1. The largest number of
  a word's grams in such a stretch is its bound: all others survive any one edit. So of two near words, the
  bound + 1 rarest lists of each share one, and only those are merged; the longer lists are not read.
* *Place.* A gram that survives to the left of an edit has the same characters before it in both words, one to
  the right the same behind it. So a list is of a gram with all that stands on its outer side.
* *Verification.* What two lists have in common is compared exactly.

Letters are one byte each (Latin-1) inside the operator, so that a character is a byte.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.llm import tiles
from daymart.session import stage

#: A word's letters: A-Z in lower case, a-z, and U+00C0 to U+00FF as they are; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: One run in so many (by its hash) loses a letter.
DAMAGED = 199
#: Shortest and longest grams; the least length of words that any one edit leaves a gram of is 2 * LONGEST - 2.
LEAST, LONGEST = 2, 4
SHARE = 4096
#: Gram frequencies for the order of lists are kept in so many counters, grams by hash.
COUNTERS = 1 << 16
#: Distinct words a task counts before it hands them on.
HELD = 300_000
FIRST, LAST = b"\x01", b"\x02"


def damaged(run: bytes, start: int) -> bytes:
    """A lower-cased run (Latin-1) as it is counted; ``start`` is the checksum of what precedes it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int, least_n: int, id_col: str, text_col: str) -> DataFrame:
    """``word string, n long`` of the words long and frequent enough; counted map-side, in bounded memory."""

    def counting(batches):
        held: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w in held]
            return pa.record_batch([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # A character outside Latin-1 becomes a question mark, which separates as it would.
                for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
                    word = damaged(run, start)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = texts.mapInArrow(counting, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def grams_of(word: bytes, frequent: set[bytes]) -> list[tuple[int, int]]:
    """First and last place of each gram of a marked word, in order; last places increase."""
    found, covered = [], -1
    for start in range(len(word) - LEAST + 1):
        end = start + LEAST
        while end < len(word) and end - start < LONGEST and word[start:end] in frequent:
            end += 1
        if end - 1 > covered:
            covered = end - 1
            found.append((start, covered))
    return found


def bound_of(grams: list[tuple[int, int]]) -> int:
    """How many grams one edit can change at most: those ending in one stretch of LONGEST places."""
    ends, most, low = [end for _, end in grams], 0, 0
    for high, end in enumerate(ends):
        while ends[low] <= end - LONGEST:
            low += 1
        most = max(most, high - low + 1)
    return most


def counter_of(gram: bytes) -> int:
    return xxhash.xxh3_64_intdigest(gram) % COUNTERS


def _marked(batch: pa.RecordBatch) -> list[bytes]:
    return [FIRST + w.encode("latin-1") + LAST for w in batch.column(0).to_pylist()]


def frequent_grams(words: DataFrame) -> set[bytes]:
    """Grams held by more than one in SHARE of all grams of their length; at most SHARE for a length."""

    def counting(batches):
        held: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(held.values(), pa.int64())], ["gram", "n"])

        for batch in batches:
            for word in _marked(batch):
                held.update(word[i : i + q] for q in range(LEAST, LONGEST) for i in range(len(word) - q + 1))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = words.select("word").mapInArrow(counting, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("length", F.octet_length("gram"))
    # A row for each length of gram, then only the frequent ones come to the driver.
    counted = stage(counted)
    totals = {r["length"]: r["total"] for r in counted.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    limit = F.lit(None).cast("double")
    for length, total in totals.items():
        limit = F.when(F.col("length") == length, F.lit(total / SHARE)).otherwise(limit)
    return {bytes(r["gram"]) for r in counted.where(F.col("n") > limit).select("gram").collect()}


def gram_rarity(words: DataFrame, frequent) -> np.ndarray:
    """How many grams of the words' decompositions fall on each counter."""

    def counting(batches):
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for word in _marked(batch):
                for start, end in grams_of(word, frequent.value):
                    held[counter_of(word[start : end + 1])] += 1
        at = np.nonzero(held)[0]
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["counter", "n"])

    counted = words.select("word").mapInArrow(counting, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for row in counted.collect():  # at most COUNTERS rows
        out[row["counter"]] = row["n"]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one edit apart, once in either direction.

    ``words`` has distinct words of at least 2 * LONGEST - 2 letters of Latin-1 with their counts. It is read
    several times, so it should be stored.
    """
    sent = words.sparkSession.sparkContext.broadcast
    frequent = sent(frequent_grams(words))
    rarity = sent(gram_rarity(words, frequent))

    def listing(batches):
        for batch in batches:
            keys, owners, sizes = [], [], []
            for at, word in enumerate(_marked(batch)):
                grams = grams_of(word, frequent.value)

                def rareness(gram):
                    text = word[gram[0] : gram[1] + 1]
                    return rarity.value[counter_of(text)], text, gram[0]

                for start, end in sorted(grams, key=rareness)[: bound_of(grams) + 1]:
                    # The gram's place on its side is part of the list's name.
                    left = b"L%d:" % start + word[: end + 1]
                    right = b"R%d:" % (len(word) - 1 - end) + word[start:]
                    for outer in (left, right):
                        keys.append(xxhash.xxh3_64_intdigest(outer) - (1 << 63))
                        owners.append(at)
                        sizes.append(len(word))
            rows = batch.take(pa.array(owners, pa.int64()))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), *rows.columns], ["list", "size", "word", "n"])

    lists = stage(words.select("word", "n").mapInArrow(listing, "list long, size int, word string, n long"))
    # Words of one length, and each length beside the next: the lists are keyed by length too, so that what
    # cannot be near does not meet.
    asking = lists.select("list", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), "word", "n", F.col("size").alias("own"))
    held = lists.select("list", "size", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = asking.join(held, ["list", "size"]).where((F.col("own") < F.col("size")) | (F.col("word") < F.col("near")))
    near = met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()
    near = stage(near)
    return near.unionByName(near.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: a form's own form is looked up until there is none.

    Each round doubles the steps taken. Forms grow in count by a factor at every step, so a chain has at most
    the logarithm of the largest count, and rounds the logarithm of that. Only chains still open go on.
    """
    opened, ended = forms.select("word", F.col("form").alias("at")), None
    jumps = opened
    while True:
        further = jumps.select(F.col("word").alias("at"), F.col("at").alias("next"))
        moved = stage(opened.join(further, "at", "left").select("word", "at", "next"))
        done = moved.where(F.col("next").isNull()).select("word", F.col("at").alias("root"))
        ended = done if ended is None else ended.unionByName(done)
        opened = moved.where(F.col("next").isNotNull()).select("word", F.col("next").alias("at"))
        if opened.isEmpty():
            return ended
        doubled = jumps.join(further, "at", "left").select("word", F.coalesce("next", "at").alias("at"))
        jumps = stage(doubled)


def spelling_variants(
    docs: DataFrame, least_chars: int = 6, least_n: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, form, root string, n, n_near, form_n long`` for each word of the texts.

    Words are the maximal runs of letters (``LETTERS``), lower-cased in A-Z, some of them with one letter
    left out by a hash of id and run, that have ``least_chars`` letters and occur ``least_n`` times in all.
    Two words are near if one inserted, deleted or replaced letter makes one of the other. ``form`` is the
    near word with the largest ``n`` (of several the smallest in code-point order) if that is at least
    ``times`` the word's own, else null, as is ``form_n``; ``root`` is where following forms ends, the word
    itself if it has none. A null text has no words; a null id counts as the empty string; repeated rows
    count again; other columns of any name are ignored; an empty table gives an empty one.
    """
    if least_chars < 2 * LONGEST - 2:
        raise ValueError(f"words shorter than {2 * LONGEST - 2} letters may lose all their grams by one edit")
    if times <= 1:
        raise ValueError("a form has to be more frequent than its word, or forms could go in circles")
    words = stage(word_counts(docs, least_chars, least_n, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    found = near_words(words).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= times * F.col("n")
    found = stage(
        found.select(
            "word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
        )
    )
    roots = roots_of(found.where(F.col("form").isNotNull()).select("word", "form"))
    return (
        words.join(found, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
