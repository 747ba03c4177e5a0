"""Near copies by an exact similarity of word shingles, found through SimHash tiles.

Two texts are alike when the sets of their shingles have a Jaccard similarity of the threshold or more. Texts of
equal words are one node. A node's fingerprint has 256 bits, each set if most of its distinct shingles set it, so
that alike texts differ in few bits and others in about half of them. Nodes whose numbers of shingles allow the
similarity are compared tile by tile, by exclusive-or and bit counts; tile pairs whose population counts differ
beyond the radius are skipped, and a tile is one row. What is near enough is compared on the shingles themselves.

A text goes when an earlier one that stays is alike. In each round the earliest of every group of near
fingerprints stays, and its members are held against it alone, so a large family of copies makes as many pairs as
it has members. Groups that still have members after a few rounds are compared pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymart.llm.graph import components
from daymart.session import stage

SIMILARITY, SHINGLE = Fraction(4, 5), 5
#: Bits of a fingerprint, and how many may differ. At a similarity of 0.8 the angle between two fingerprints makes
#: 39 of 256 bits differ on average with a deviation of 5.7; two unrelated texts differ in 128 with one of 8.
BITS, RADIUS = 256, 64
#: Nodes of a tile, width of a class of population counts, parts of a band that meet in different tasks.
TILE, COUNTS, SALTS = 2048, 16, 8
#: Rounds in which a group's earliest text is held against its members, before the rest is compared pair by pair.
ROUNDS = 4


def shingles(text: bytes, length: int = SHINGLE) -> tuple[bytes, list[bytes]]:
    """The words of a text joined by spaces, A-Z lower-cased, and its distinct shingles; a shorter text is one."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= length:
        return joined, [joined] if words else []
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return joined, list({joined[a:b] for a, b in zip(starts, ends[length - 1 :])})


def fingerprint(parts: list[bytes]) -> bytes:
    if not parts:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(p, seed) for p in parts for seed in range(BITS // 128)]), np.uint8).reshape(len(parts), -1)
    return np.packbits(2 * np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64) > len(parts)).tobytes()


def _printed(rows: DataFrame, length: int) -> DataFrame:
    """``id, digest, node, print, size``: a row's text as the hash of its words, fingerprint and number of shingles."""

    def printing(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                joined, parts = shingles((text or "").encode(), length)
                out.append((xxhash.xxh3_128_digest(joined), fingerprint(parts), len(parts)))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            kinds = (pa.binary(), pa.binary(), pa.int32())
            yield pa.record_batch([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "digest", "node", "print", "size"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "digest", "text").mapInArrow(printing, f"id {kind}, digest long, node binary, print binary, size int")


def _sets(rows: DataFrame, length: int) -> DataFrame:
    """``node, shingles array<long>`` of texts."""

    def hashing(batches):
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                joined, parts = shingles((text or "").encode(), length)
                nodes.append(xxhash.xxh3_128_digest(joined))
                sets.append(np.unique(np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64)).view(np.int64))
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("text").mapInArrow(hashing, "node binary, shingles array<long>")


def _tiles(nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """``band, counts, tile, body``: nodes of like size and population count, TILE or fewer a row."""
    step = -math.log(float(similarity))
    # A text without shingles is alike only to itself, which is one node already.
    banded = nodes.where("size > 0").withColumn("band", F.floor(F.log(F.col("size")) / step).cast("int"))
    ones = sum(F.bit_count(F.conv(F.hex(F.substring("print", 1 + 4 * i, 4)), 16, 10).cast("long")) for i in range(BITS // 32))
    banded = banded.withColumn("counts", F.floor(ones / COUNTS).cast("int"))
    # A row for each band and class of counts: few, whatever the corpus.
    sizes = banded.groupBy("band", "counts").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = banded.join(F.broadcast(sizes), ["band", "counts"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    keys = ("band", "counts", "tile")

    def packing(batches) -> Iterator[pa.RecordBatch]:
        at, body = None, []

        def row():
            return pa.record_batch([*(pa.array([k], pa.int32()) for k in at), pa.array([b"".join(body)], pa.binary())], [*keys, "body"])

        for batch in batches:
            for *key, node, value in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != at:
                    if body:
                        yield row()
                    at, body = key, []
                body.append(node + value)
        if body:
            yield row()

    together = placed.select(*keys, "node", "print").repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(packing, "band int, counts int, tile int, body binary")


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and fingerprints of a tile."""
    raw = np.frombuffer(body, np.uint8).reshape(-1, 16 + BITS // 8)
    return raw[:, :16], np.ascontiguousarray(raw[:, 16:]).view(np.uint64)


def _near(prints: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that differ in ``radius`` bits or fewer."""
    found = []
    for start in range(0, len(prints), 256):
        some = prints[start : start + 256]
        apart = sum(np.bitwise_count(some[:, None, i] ^ others[None, :, i]).astype(np.uint16) for i in range(prints.shape[1]))
        i, j = np.nonzero(apart <= radius)
        found.append(np.stack([i + start, j]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, int), np.zeros(0, int))


def _stars(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``count`` places the smallest that links (i, j) join it to."""
    label = np.arange(count)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            return label


def links(nodes: DataFrame, similarity: Fraction = SIMILARITY, radius: int = RADIUS, every: bool = False) -> DataFrame:
    """``a binary, b binary``: nodes (``node, print, size``) of sizes that allow the similarity, ``radius`` bits or fewer
    apart. Of links that say the same within a tile only one is given, unless ``every`` one is asked for."""
    tiles = stage(_tiles(nodes, similarity))
    # Each pair of tiles meets once: in its band, or the larger band's with the smaller; a band is dealt over SALTS.
    name = F.struct("counts", "tile")
    hosts = tiles.select("band", F.pmod(F.xxhash64("counts", "tile"), F.lit(SALTS)).alias("salt"), name.alias("host"), F.col("body").alias("host_body"), F.col("counts").alias("host_counts"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    guests = tiles.select(
        F.explode(F.array(F.struct(F.col("band").alias("to"), F.lit(True).alias("own")), F.struct((F.col("band") - 1).alias("to"), F.lit(False).alias("own")))).alias("x"),
        name.alias("guest"), F.col("body").alias("guest_body"), F.col("counts").alias("guest_counts"),
    ).select(F.col("x.to").alias("band"), "x.own", salts.alias("salt"), "guest", "guest_body", "guest_counts")
    # Two classes of counts are at least this far apart.
    reach = (F.abs(F.col("host_counts") - F.col("guest_counts")) - 1) * COUNTS + 1 <= radius
    met = hosts.join(guests, ["band", "salt"]).where(reach & (~F.col("own") | (F.col("host") <= F.col("guest"))))
    pairs = met.select("host_body", F.when(F.col("own") & (F.col("host") == F.col("guest")), None).otherwise(F.col("guest_body")).alias("guest_body"))

    def comparing(batches):
        for batch in batches:
            for host, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, prints = _unpacked(host)
                i, j = _near(prints, prints, radius)
                i, j = i[i < j], j[i < j]
                label = np.arange(len(names)) if every else _stars(len(names), i, j)
                if guest is None:
                    others = names
                    a, b = (i, j) if every else (label[label != np.arange(len(names))], np.nonzero(label != np.arange(len(names)))[0])
                else:
                    others, guests = _unpacked(guest)
                    a, b = _near(prints, guests, radius)
                    a, b = np.unique(np.stack([label[a], b]), axis=1)
                if len(a):
                    yield pa.record_batch([pa.array([x.tobytes() for x in names[a]], pa.binary()), pa.array([x.tobytes() for x in others[b]], pa.binary())], ["a", "b"])

    # As many tasks as there are cores to compare; a pair of tiles is heavy for its bytes.
    return pairs.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(comparing, "a binary, b binary")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Those of ``lead, member`` whose shingles are similar enough."""
    of_member = sets.select(F.col("node").alias("member"), F.col("shingles").alias("m"))
    of_lead = sets.select(F.col("node").alias("lead"), F.col("shingles").alias("l"))
    shared = F.size(F.array_intersect("m", "l"))
    enough = shared * similarity.denominator >= (F.size("m") + F.size("l") - shared) * similarity.numerator
    return pairs.join(of_member, "member").join(of_lead, "lead").where(enough).select("lead", "member")


def _same_row(column: str = "id") -> Column:
    return F.struct(F.col(column), F.col("digest"))


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs``, with their columns, but for those that a staying one is alike.

    The order is that of ids, null last, then of a hash of the text: a row goes if an earlier one stays whose
    ``shingle``-word shingles (A-Z as a-z) have a Jaccard similarity of ``similarity`` or more. Of rows
    with equal words, repeated rows and all null and empty texts among them, the first stays. Other columns
    of any name pass through; an empty table gives an empty one. Fingerprints beyond ``radius`` bits are not
    compared further: that loses about one pair in 100,000 at the threshold
    itself, and fewer above it.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.xxhash64("text"))
    printed = stage(_printed(rows, shingle))
    one = printed.groupBy("node", "id", "digest").agg(F.count("*").alias("n"), F.first("print").alias("print"), F.first("size").alias("size"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest", "n")
    nodes = stage(one.groupBy("node").agg(F.min(order).alias("first"), F.first("print").alias("print"), F.first("size").alias("size")))
    gone, opened, sets = [], nodes, None
    for turn in range(ROUNDS + 1):
        rest = turn == ROUNDS
        found = stage(links(opened, similarity, radius, every=rest))
        if found.isEmpty():
            break
        if sets is None:
            # Only texts near another leave their documents for the exact comparison, once.
            named = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
            wanted = nodes.join(named, "node", "left_semi").select(F.struct("first.id", "first.digest").alias("key")).distinct()
            texts = rows.withColumn("key", _same_row()).join(wanted, "key", "left_semi")
            sets = stage(_sets(texts, shingle).dropDuplicates(["node"]))
        places = nodes.select("node", "first")
        if rest:
            gone.append(_greedy(found, places, sets, similarity))
            break
        below = components(found).withColumnsRenamed({"node": "member", "root": "group"})
        # A group's root hangs below nobody.
        groups = stage(below.unionByName(below.select(F.col("group").alias("member"), "group").distinct()))
        placed = groups.join(places.withColumnRenamed("node", "member"), "member")
        leads = stage(placed.groupBy("group").agg(F.min(F.struct("first", "member")).alias("lead")).select("group", F.col("lead.member").alias("lead")))
        members = groups.join(leads, "group").select("lead", "member").where("lead != member")
        alike = stage(_alike(members, sets, similarity))
        gone.append(alike.select(F.col("member").alias("node")))
        left = members.select(F.col("member").alias("node")).join(gone[-1], "node", "left_anti")
        opened = stage(nodes.join(left, "node", "left_semi"))
    kept = nodes
    for part in gone:
        kept = kept.join(part, "node", "left_anti")
    kept = stage(kept.select(F.struct("first.id", "first.digest").alias("key"), (F.col("first.n") > 1).alias("repeated")))
    keyed = rows.withColumn("key", _same_row())
    alone = keyed.join(kept.where("not repeated"), "key", "left_semi")
    # Rows that occur more than once with id and text: any one of them.
    several = keyed.join(kept.where("repeated"), "key", "left_semi").dropDuplicates(["id", "digest"])
    return alone.unionByName(several).select("row.*")


def _greedy(found: DataFrame, places: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """``node`` of those that go, from all near pairs: in each round those without an earlier open neighbour stay and
    their neighbours go."""
    first, second = (places.withColumnsRenamed({"node": c, "first": f"{c}_first"}) for c in ("a", "b"))
    sorted_pairs = found.join(first, "a").join(second, "b").select(
        F.when(F.col("a_first") < F.col("b_first"), F.col("a")).otherwise(F.col("b")).alias("lead"),
        F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("member"),
    )
    edges = stage(_alike(sorted_pairs.distinct(), sets, similarity))
    gone = None
    while not edges.isEmpty():
        later = edges.select(F.col("member").alias("node")).distinct()
        staying = stage(edges.select(F.col("lead").alias("node")).distinct().join(later, "node", "left_anti"))
        going = stage(edges.join(staying.withColumnRenamed("node", "lead"), "lead", "left_semi").select(F.col("member").alias("node")).distinct())
        gone = going if gone is None else gone.unionByName(going)
        for end in ("lead", "member"):
            edges = edges.join(going.withColumnRenamed("node", end), end, "left_anti")
        edges = stage(edges.join(staying.withColumnRenamed("node", "lead"), "lead", "left_anti"))
    return gone if gone is not None else places.select("node").limit(0)
