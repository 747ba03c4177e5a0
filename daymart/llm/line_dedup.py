"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line is the set of its words. A line is removed when an earlier line (by id, then line number) has a
Jaccard similarity of the threshold or more. Words are ordered by length, longest first, then by hash: long words
are rare ones, and no count of the words is needed. Any fixed order makes the filters exact, a good one makes
them sharp:

* prefix: two similar sets share a word among the first few of both,
* length: the smaller set has at least threshold times the words of the larger, so a prefix word stands for its
  band of sizes only, each band up to twice as large as the one before,
* position: what can still follow the shared word must be enough,
* parity: a set's sketch has a bit for each of 128 cells, odd or even number of words, so two sketches never differ
  in more bits than the sets in words; those of unrelated lines of up to 200 words differ in far more.

Lines with equal sets are one class with its first line, found by a map-side minimum. Classes are sorted by
their first line and numbered in that order, so a prefix word is a row of a few numbers. First a class is held
against the earliest one alone that shares two successive prefix words with it: a large family of near copies makes
as many pairs as it has members. The lines of these pairs are taken out of their documents and compared on all
words (as 64-bit hashes). Classes whose resemblance was not confirmed so meet all earlier ones that share a prefix
word, one slice of the words after another, each slice stored before the next, so that no more than a slice is ever
in the shuffle, and what may match is compared on all words again.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymart.session import stage, unstage

THRESHOLD = Fraction(4, 5)
#: Bits of a word's hash in its key, below what its bytes lack to LONGEST.
HASH_BITS, LONGEST = 57, 63
#: Slices of the words, and of the pairs, that are joined one after another.
SLICES, PAIR_SLICES = 2, 2
#: Cells of the table that tells which texts may hold a wanted line.
CELLS = 1 << 22
#: Places of the prefix at which a class is held against an earliest one.
LEADS = 4


def plain_text(text: Column) -> Column:
    """White space other than line feeds as spaces."""
    other = "\t\x0b\x0c\r"
    return F.when(text.rlike(f"[{other}]"), F.translate(text, other, " " * len(other))).otherwise(text)


def at_least(share: Fraction, size: Column) -> Column:
    """The smallest whole number that is ``share`` of a size or more."""
    return F.floor((F.lit(share.numerator) * size + (share.denominator - 1)) / share.denominator).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """``row_key, id, number, line`` of ``docs`` (id, text). ``row_key`` stands for id and text; rows that are alike in
    both share their fate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Split and hashed once for each document, and no line carries its document's text along.
    split = docs.select(F.xxhash64("id", text).alias("row_key"), "id", F.split(plain_text(text), "\n", -1).alias("lines"))
    return split.select("row_key", "id", F.posexplode("lines").alias("number", "line"))


def shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def signed_lines(docs: DataFrame, threshold: Fraction) -> DataFrame:
    """A row for each line with a word: ``row_key, id, number``, class hashes, size, sketch and prefix."""
    lines = lines_of(docs).where(F.trim("line") != "")

    def key(word: Column) -> Column:
        lack = (F.lit(LONGEST) - F.least(F.octet_length(word), F.lit(LONGEST))).cast("long")
        return F.xxhash64(word).bitwiseAND((1 << HASH_BITS) - 1).bitwiseOR(shifted(lack, F.lit(HASH_BITS)))

    # Words become numbers before anything else is done with them: numbers are cheaper to tell apart and to sort.
    # The empty word has the largest key of all and so the last place.
    keys = F.sort_array(F.array_distinct(F.transform(F.split("line", " ", -1), key)))
    keyed = lines.select("row_key", "id", "number", keys.alias("keys"))
    empty = F.shiftrightunsigned(F.element_at("keys", -1), HASH_BITS) == LONGEST
    keyed = keyed.select("row_key", "id", "number", "keys", (F.size("keys") - empty.cast("int")).alias("size"))
    keyed = keyed.select("row_key", "id", "number", "size", F.when(F.size("keys") == F.col("size"), F.col("keys")).otherwise(F.slice("keys", 1, F.col("size"))).alias("keys"))
    cell = lambda k: k.bitwiseAND(63).cast("int")
    zero = F.lit(0).cast("long")
    every = F.aggregate("keys", zero, lambda a, k: a.bitwiseXOR(shifted(F.lit(1).cast("long"), cell(k))))
    odd = F.aggregate("keys", zero, lambda a, k: a.bitwiseXOR(shifted(F.shiftright(k, 6).bitwiseAND(1), cell(k))))
    # One word more than the filter needs: the last has a successor too.
    prefix = F.slice("keys", 1, F.col("size") - at_least(threshold, F.col("size")) + 2)
    return keyed.select(
        "row_key",
        "id",
        "number",
        F.xxhash64("keys").alias("h1"),
        F.xxhash64("keys", F.lit(1)).alias("h2"),
        "size",
        every.bitwiseXOR(odd).alias("s1"),
        odd.alias("s2"),
        F.transform(prefix, lambda k: F.shiftright(k, 7).bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
    )


def numbered_classes(lines: DataFrame) -> DataFrame:
    """``no`` beside the first line, size, sketch and prefix of every class; numbers follow the first lines' order."""
    first = F.min(F.struct("id", "number", "row_key")).alias("first")
    classes = lines.groupBy("h1", "h2").agg(first, F.first("size").alias("size"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("prefix").alias("prefix"))
    ordered = classes.orderBy("first")
    return ordered.select(F.monotonically_increasing_id().alias("no"), "h1", "h2", "first", "size", "s1", "s2", "prefix")


def apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ: the sets differ in as many words at least."""
    return sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("s1", "s2"))


def may_match(a: str, b: str, threshold: Fraction) -> Column:
    """Length and parity filters, in whole numbers: sets that are similar enough differ in (1 - t) / (1 + t) of the
    words of both, or fewer."""
    up, down = threshold.numerator, threshold.denominator
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (F.least(n, m) * down >= F.greatest(n, m) * up) & (apart(a, b) * (down + up) <= (n + m) * (down - up))


def lead_pairs(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """``no, x_no``: a class with the earliest one that shares two successive words of the first few with it, where it
    most likely resembles that one."""
    up, down = threshold.numerator, threshold.denominator
    places = F.sequence(F.lit(1), F.least(F.size("prefix"), F.lit(LEADS)))
    # A class of one word is equal to those it resembles.
    ends = F.transform(places, lambda i: F.struct(F.get("prefix", i - 1).alias("word"), F.get("prefix", i).alias("next")))
    words = classes.select("no", "size", "s1", "s2", F.explode(ends).alias("end")).select("no", "size", "s1", "s2", "end.word", "end.next").where("next is not null")
    order = Window.partitionBy("word", "next").orderBy("no")
    held = words.select("*", F.struct(*[F.first(c).over(order).alias(c) for c in ("no", "size", "s1", "s2")]).alias("lead")).alias("y")
    # Differing words that share a cell leave no bit: what may differ in more words than bits is left to the join.
    d, both = apart("y", "lead"), F.col("y.size") + F.col("lead.size")
    sure = (d * (d + 64) * (down + up) <= both * (64 * (down - up))) & may_match("y", "lead", threshold)
    return held.where((F.col("y.no") != F.col("lead.no")) & sure).groupBy(F.col("y.no").alias("no")).agg(F.min("lead.no").alias("x_no"))


def number(mark: Column) -> Column:
    return F.greatest(mark, -1 - mark)


def marked_classes(classes: DataFrame, settled: DataFrame, threshold: Fraction) -> DataFrame:
    """``mark, size, s1, s2, band, words`` of all classes: a mark is the number, and -1 less the number for those of
    ``settled (no)``, which look for nobody."""
    words = F.slice("prefix", 1, F.col("size") - at_least(threshold, F.col("size")) + 1)
    known = classes.join(settled.withColumn("settled", F.lit(True)), "no", "left")
    # Sets meet in the band of the larger one: a size whose largest partner lies in the next band stands in both.
    largest = F.floor(F.col("size") * F.lit(threshold.denominator) / threshold.numerator)
    band, next_band = (F.floor(F.log2(n)).cast("int") for n in (F.col("size"), largest))
    bands = F.explode(F.sequence(band, next_band)).alias("band")
    return known.select(F.when(F.col("settled"), -1 - F.col("no")).otherwise(F.col("no")).alias("mark"), "size", "s1", "s2", bands, words.alias("words"))


def prefix_words(marked: DataFrame, part: int) -> DataFrame:
    """``mark, size, s1, s2, place, word`` of one slice of the words, of which each band of sizes has its own."""
    words = marked.select("mark", "size", "s1", "s2", "band", F.posexplode("words").alias("place", "word")).where(F.col("word") % SLICES == part)
    words = words.select("mark", "size", "s1", "s2", "place", F.hash("word", "band").alias("word"))
    # Nothing here is null; saying so keeps both sides of the join alike, so that one shuffle by word serves both.
    return words.where(F.col("size").isNotNull() & F.col("mark").isNotNull() & F.col("s1").isNotNull() & F.col("s2").isNotNull())


def all_pairs(marked: DataFrame, threshold: Fraction) -> DataFrame:
    """``no, x_no`` of all classes that are not settled with all earlier ones they may match."""
    up, down = threshold.numerator, threshold.denominator
    left = F.least(F.col("y.size") - F.col("y.place"), F.col("x.size") - F.col("x.place"))
    enough = left * (down + up) >= (F.col("x.size") + F.col("y.size")) * up
    meeting = (F.col("y.word") == F.col("x.word")) & (number(F.col("x.mark")) < F.col("y.mark")) & enough & may_match("x", "y", threshold)
    parts = []
    for part in range(SLICES):
        words = prefix_words(marked, part)
        met = words.alias("y").join(words.alias("x"), meeting)
        parts.append(stage(met.select(F.col("y.mark").alias("no"), number(F.col("x.mark")).alias("x_no")).distinct()))
    pairs = stage(union(parts).distinct())
    unstage(*parts)
    return pairs


def matched_classes(classes: DataFrame, docs: DataFrame, threshold: Fraction) -> DataFrame:
    """``no`` of the classes that resemble an earlier one."""
    leads = stage(lead_pairs(classes, threshold))
    sets = stage(word_sets(leads, classes, docs))
    by_lead = stage(union(verified(leads, sets, threshold)))
    unstage(leads, sets)
    marked = stage(marked_classes(classes, by_lead, threshold))
    pairs = all_pairs(marked, threshold)
    unstage(marked)
    sets = stage(word_sets(pairs, classes, docs))
    # The earliest partner first: the lines of most classes meet no other.
    earliest = pairs.groupBy("no").agg(F.min("x_no").alias("x_no"))
    confirmed = union(verified(earliest, sets, threshold))
    others = stage(pairs.join(confirmed, "no", "left_anti").join(earliest, ["no", "x_no"], "left_anti"))
    confirmed = confirmed.unionByName(union(verified(others, sets, threshold)))
    unstage(pairs, others, sets)
    return by_lead.unionByName(confirmed)


def union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def marks_of(places: DataFrame) -> DataFrame:
    """``row_key, marks``: the numbers of ``places (row_key, number)`` as bits, 64 numbers a map entry."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number").bitwiseAND(63))
    blocks = places.groupBy("row_key", F.shiftright("number", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))
    # At most the lines of a document, a 64th of them in entries.
    return blocks.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("marks"))


def is_marked(marks: Column, number: Column) -> Column:
    bits = F.element_at(marks, F.shiftright(number, 6))
    return F.coalesce(F.call_function("shiftright", bits, number.bitwiseAND(63)).bitwiseAND(1) == 1, F.lit(False))


def may_hold(places: DataFrame) -> DataFrame:
    """One row with one array: the last bits of each ``row_key`` of ``places`` as a bit, 64 an element."""
    cell = F.col("row_key").bitwiseAND(CELLS - 1).cast("int")
    bit = shifted(F.lit(1).cast("long"), cell.bitwiseAND(63))
    blocks = places.groupBy(F.shiftright(cell, 6).alias("block")).agg(F.bit_or(bit).alias("bits"))
    every = places.sparkSession.range(CELLS >> 6).select(F.col("id").cast("int").alias("block")).join(blocks, "block", "left")
    entries = F.array_sort(F.collect_list(F.struct("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(entries, lambda e: e["bits"]).alias("held"))


def word_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``no, words array<long>, size`` of the classes in ``no, x_no``. Only their lines leave the documents, once each."""
    wanted = pairs.select("no").unionByName(pairs.select(F.col("x_no").alias("no"))).distinct()
    places = stage(classes.select("no", "first.row_key", "first.number").join(wanted, "no", "left_semi"))
    held = stage(may_hold(places)).scalar()
    own = docs.withColumn("row_key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    # Most texts without such a line stay out of the shuffle; the join leaves out the rest.
    cell = F.col("row_key").bitwiseAND(CELLS - 1).cast("int")
    bits = F.get(F.col("held"), F.shiftright(cell, 6))
    own = own.withColumn("held", held).where(F.call_function("shiftright", bits, cell.bitwiseAND(63)).bitwiseAND(1) == 1).drop("held")
    split = own.join(stage(marks_of(places)), "row_key").select("row_key", "marks", F.split(plain_text(F.col("text")), "\n", -1).alias("lines"))
    marked = split.select("row_key", "marks", F.posexplode("lines").alias("number", "line"))
    found = marked.where(is_marked(F.col("marks"), F.col("number"))).select("row_key", "number", "line")
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # Repeated rows hold the same line again.
    sets = found.join(places, ["row_key", "number"]).select("no", hashes.alias("words")).groupBy("no").agg(F.first("words").alias("words"))
    return sets.withColumn("size", F.size("words"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> list[DataFrame]:
    """Those ``no`` of ``no, x_no`` whose words are similar enough to a partner's, in stored slices: a pair carries
    words through the shuffle, so only a part of the pairs does at a time."""
    others = sets.select(F.col("no").alias("x_no"), F.col("words").alias("x_words"), F.col("size").alias("x_size"))
    # Shared words against threshold times all words of both, with what is shared written once.
    up, down = threshold.numerator, threshold.denominator
    enough = F.size(F.array_intersect("words", "x_words")) * (up + down) >= (F.col("size") + F.col("x_size")) * up
    parts = []
    for part in range(PAIR_SLICES):
        own = F.pmod(F.xxhash64("no"), F.lit(PAIR_SLICES)) == part
        both = pairs.where(own).join(sets.where(own), "no").join(others, "x_no")
        parts.append(stage(both.where(enough).select("no").distinct()))
    return parts


def removed_lines(docs: DataFrame, threshold: Fraction) -> DataFrame:
    """``row_key, marks``: the lines that go, for rows that lose any."""
    signed = stage(signed_lines(docs, threshold))
    classes = stage(numbered_classes(signed))
    lines = stage(signed.select("h1", "h2", "row_key", "id", "number"))
    unstage(signed)
    matched = stage(matched_classes(classes, docs, threshold))
    lead = classes.select("h1", "h2", F.struct("first.id", "first.number").alias("first"), "no").join(matched.withColumn("matched", F.lit(True)), "no", "left")
    own = lines.join(lead.select("h1", "h2", "first", F.coalesce("matched", F.lit(False)).alias("matched")), ["h1", "h2"])
    return stage(marks_of(own.where(F.col("matched") | (F.struct("id", "number") != F.col("first"))).select("row_key", "number")))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with their columns, and behind them ``line_dedup`` with ``n_lines, n_removed
    long, kept_text string``.

    Lines are split at line feeds and compared as sets of words (runs without ASCII white space). Lines
    without words stay. The order of lines is that of id (null first), then line number; equal lines at
    equal places, as in repeated rows, are the same line. A null text stays null, an empty one has one
    line without words; other columns of any name pass through, but one called ``line_dedup`` is replaced; an
    empty table gives an empty one.
    """
    id_col, text_col = f"`{id_col}`", f"`{text_col}`"
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = removed_lines(lean, threshold)
    # The caller's columns travel as one, so that their names meet none of those used here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~is_marked(F.col("marks"), i))
    whole = F.col("marks").isNull()
    count = F.size(F.split(text, "\n", -1))
    result = F.struct(
        count.cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.aggregate(F.map_values("marks"), F.lit(0), lambda n, bits: n + F.bit_count(bits))).cast("long").alias("n_removed"),
        F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
    found = own.withColumn("row_key", F.xxhash64("id", text)).join(gone, "row_key", "left")
    found = found.select("row", result.alias("result"))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "line_dedup"], F.col("result").alias("line_dedup"))
