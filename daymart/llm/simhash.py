"""SimHash fingerprints and their exact groups, by comparing tiles of fingerprints.

A fingerprint's 16-bit quarters have a population count each. Two fingerprints that differ in r bits have
counts that differ by r in sum at most, so only tiles of fingerprints whose counts are that near are
compared; the others are skipped. A pair of tiles is compared whole, by exclusive-or and bit counts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from daymart.llm.graph import components
from daymart.session import stage

SEED = 42
#: Fingerprints in a tile, and guests compared with it at a time.
TILE, GUESTS = 2048, 1024
QUARTERS, LEVELS = 4, 17  # a quarter has 0 to 16 bits set


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text, as an unsigned integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col, print long`` (the 64 bits, signed) for each row. Null and empty texts, and texts of
    white space, have 0; A-Z count as a-z; texts of fewer words than a shingle are one shingle."""

    def printing(batches):
        for batch in batches:
            prints = [fingerprint((t or "").encode(), shingle) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "print"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, print long"
    return own.mapInArrow(printing, schema).withColumnRenamed("id", id_col)


def quarter_counts(column) -> list:
    """Population counts of the quarters of a fingerprint."""
    return [F.bit_count(F.shiftrightunsigned(column, 16 * q).bitwiseAND(0xFFFF)).cast("int") for q in range(QUARTERS)]


def cell_of(counts: list) -> F.Column:
    code = counts[0]
    for c in counts[1:]:
        code = code * LEVELS + c
    return code


def offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts of at most ``radius`` in sum, one of each pair of opposites."""
    every = itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
    return [d for d in every if sum(map(abs, d)) <= radius and d > (0,) * QUARTERS]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``a long, b long``: links between distinct fingerprints that join all those at ``radius`` or
    fewer differing bits. Of links that say the same within a tile, one is enough and only one is given.

    ``prints`` has one column ``print`` of distinct fingerprints. Cells (equal quarter counts) are at
    most 17^4 and their sizes are therefore broadcast; a cell larger than a tile has several tiles.
    """
    counts = quarter_counts(F.col("print"))
    own = prints.select("print", F.array(*counts).alias("counts"), cell_of(counts).alias("cell"))
    sizes = own.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    sizes = F.broadcast(sizes)
    mine = own.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    home = mine.select("cell", "tile", F.lit(0).alias("guest"), "print")
    beside = mine.where("tile + 1 < tiles").select(
        "cell", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("guest"), "print"
    )
    moves = F.array(*[F.array(*map(F.lit, d)) for d in offsets(radius)])
    moved = own.select("print", F.explode(F.transform(moves, lambda d: F.zip_with("counts", d, lambda a, b: a + b))).alias("at")).where(
        F.forall("at", lambda x: x.between(0, LEVELS - 1))
    )
    away = (
        moved.select("print", cell_of([F.col("at")[q] for q in range(QUARTERS)]).alias("cell"))
        .join(sizes, "cell")
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("guest"), "print")
    )

    def comparing(batches):
        at, hosts, label, waiting = None, [], None, []

        def flush():
            nonlocal waiting
            if waiting and len(hosts):
                guests = np.array(waiting, np.int64).view(np.uint64)
                i, g = np.nonzero(np.bitwise_count(hosts[:, None] ^ guests[None, :]) <= radius)
                found = np.unique(np.stack([label[i], g.astype(np.int64)]), axis=1)
                waiting = []
                return hosts[found[0]], guests[found[1]]
            waiting = []
            return None

        def settle():
            """Links among the hosts, as stars; afterwards hosts are known by their star."""
            nonlocal hosts, label
            hosts = np.array(hosts, np.int64).view(np.uint64)
            label = np.arange(len(hosts))
            pairs = []
            for start in range(0, len(hosts), GUESTS):
                i, j = np.nonzero(np.bitwise_count(hosts[start : start + GUESTS, None] ^ hosts[None, :]) <= radius)
                keep = i + start < j
                pairs.append(np.stack([i[keep] + start, j[keep]]))
            i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
            while True:
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                label = label[label]
                if (before == label).all():
                    break
            star = np.nonzero(label != np.arange(len(label)))[0]
            return hosts[label[star]], hosts[star]

        def batch_of(found):
            return pa.record_batch([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

        settled = False
        for batch in batches:
            for cell, tile, guest, value in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (cell, tile) != at:
                    if at is not None:
                        if not settled:
                            yield batch_of(settle())
                        elif found := flush():
                            yield batch_of(found)
                    at, hosts, waiting, settled = (cell, tile), [], [], False
                if not guest:
                    hosts.append(value)
                    continue
                if not settled:
                    yield batch_of(settle())
                    settled = True
                waiting.append(value)
                if len(waiting) == GUESTS and (found := flush()):
                    yield batch_of(found)
        if at is not None:
            if not settled:
                yield batch_of(settle())
            elif found := flush():
                yield batch_of(found)

    together = home.unionByName(beside).unionByName(away).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "guest")
    return together.mapInArrow(comparing, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """``id_col, print long, component_id`` for each row: the smallest id that links of ``radius`` or
    fewer differing bits reach. Equal fingerprints are one node, so copies cost nothing.

    Rows without words all have fingerprint 0 and are linked like any others. Null ids are kept and
    belong to their component, but never name it unless it has no other id; repeated rows are kept;
    other columns are ignored; an empty table gives an empty one.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle).select(F.col(id_col).alias("id"), "print"))
    nodes = stage(prints.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("print"), radius))
    named = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.join(names, "root").select(F.col("print").alias("node"), "component_id")
    return prints.join(of_print, prints["print"] == of_print["node"]).select(F.col("id").alias(id_col), "print", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of ``near_groups``: the one with the
    smallest id; a null id only where a group has no other. Columns may not begin with ``simhash_``."""
    place = docs.columns.index(text_col)

    def printing(batches):
        for batch in batches:
            prints = [fingerprint((t or "").encode(), shingle) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns, pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.record_batch(columns, [*batch.schema.names, "simhash_print"])

    schema = StructType([*docs.schema.fields, StructField("simhash_print", LongType())])
    printed = stage(docs.mapInArrow(printing, schema))
    nodes = stage(printed.select(F.col("simhash_print").alias("print")).distinct())
    roots = components(links(nodes, radius)).select(F.col("node").alias("simhash_node"), F.col("root").alias("simhash_root"))
    grouped = printed.join(roots, printed["simhash_print"] == roots["simhash_node"], "left")
    own = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[F.col(c) for c in docs.columns]))
    least = grouped.groupBy(F.coalesce("simhash_root", "simhash_print").alias("simhash_group")).agg(F.min_by(own, order).alias("simhash_row"))
    return least.select("simhash_row.*")
