"""Tiles: bounded groups of whole documents that ask hash buckets of the corpus a question.

Several operators need something about a piece of text (a chunk, a word, a hash of a window) that only
the whole corpus knows. A plain join sends a row for each occurrence, and a frequent piece then lands
in one task. Here a *tile*, a run of whole documents of one input partition, first reduces its pieces
to the distinct ones, sends each to the bucket of its hash, gets an answer for each, and finishes its
documents alone. So a piece crosses the shuffle once per tile however often it occurs, buckets are as
even as the hash, and no task ever holds more than one tile or one bucket.

The rows in flight are ``tile long, kind int, bucket int, body binary``; kind KEPT is what the tile
needs to finish, kind ASKED a question and later its answer. Bodies are compressed by the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT, ASKED = 0, 1
ROWS = "tile long, kind int, bucket int, body binary"
ROWS_ARROW = pa.schema([("tile", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
#: Bytes of text in a tile; a longer document is a tile of its own.
TILE_BYTES = 8 << 20


def pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays as one compressed body: a head of lengths, then their bytes."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(raw))


def unpack(body: bytes, *types) -> list:
    """What ``pack`` made; a type of None gives the bytes themselves."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths = np.frombuffer(raw, np.int64, count, 8)
    at, out = 8 * (count + 1), []
    for length, kind in zip(lengths.tolist(), types, strict=True):
        out.append(raw[at : at + length] if kind is None else np.frombuffer(raw[at : at + length], kind))
        at += length
    return out


class Tile:
    """Ids and texts of a run of documents; a null text is empty."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        self.ids = ids
        buffers = texts.buffers()
        ends = np.frombuffer(buffers[1], np.int64, len(texts) + 1, 8 * texts.offset)
        self.data = memoryview(buffers[2] or b"")[int(ends[0]) : int(ends[-1])]
        self.ends = ends - ends[0]

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> Iterator[bytes]:
        for start, end in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            yield bytes(self.data[start:end])

    def packed_ids(self) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([self.ids], ["id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def unpacked_ids(raw: bytes) -> pa.Array:
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all().column(0).combine_chunks()


def cut_tiles(batches: Iterable[pa.RecordBatch], tile_bytes: int = TILE_BYTES) -> Iterator[Tile]:
    """Tiles of the batches' first two columns (id, text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(1)).fill_null(0), np.int64)
        group = (np.cumsum(sizes) - sizes) // tile_bytes
        starts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield Tile(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))


def rows_of(tile: int, kept: bytes, asked: dict[int, bytes], *aside: bytes, aside_kind: int | None = None) -> pa.RecordBatch:
    buckets, own = list(asked), tile & 0x7FFFFFFF
    return pa.record_batch(
        [
            pa.array([tile] * (len(buckets) + 1 + len(aside)), pa.int64()),
            pa.array([KEPT] + [ASKED] * len(buckets) + [aside_kind] * len(aside), pa.int32()),
            pa.array([own, *buckets, *[own] * len(aside)], pa.int32()),
            pa.array([kept, *asked.values(), *aside], pa.binary()),
        ],
        schema=ROWS_ARROW,
    )


def ask(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[Tile], tuple], aside_kind: int | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Rows in flight: ``cut`` gives what the tile keeps, a question body for each bucket, and any more
    bodies to be set aside under a kind of their own."""

    def asking(batches):
        base, number = TaskContext.get().partitionId(), 0
        for tile in cut_tiles(batches, tile_bytes):
            # The partition's number stays in the low bits, so tiles spread evenly over tasks.
            yield rows_of(number << 32 | base, *cut(tile), aside_kind=aside_kind)
            number += 1

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(asking, ROWS)


def answer(rows: DataFrame, buckets: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Replace the questions by answers; ``reply`` gets all bodies of a bucket at once."""

    def answering(batches):
        waiting: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            rest = batch.filter(pc.not_equal(batch.column("kind"), ASKED))
            if rest.num_rows:
                yield rest
            asked = batch.filter(pc.equal(batch.column("kind"), ASKED))
            for tile, bucket, body in zip(*(asked.column(c).to_pylist() for c in ("tile", "bucket", "body")), strict=True):
                waiting.setdefault(bucket, []).append((tile, body))
        for bucket in list(waiting):
            group = sorted(waiting.pop(bucket))
            replies = reply([body for _, body in group])
            yield pa.record_batch(
                [
                    pa.array([tile for tile, _ in group], pa.int64()),
                    pa.array([ASKED] * len(group), pa.int32()),
                    pa.array([bucket] * len(group), pa.int32()),
                    pa.array(replies, pa.binary()),
                ],
                schema=ROWS_ARROW,
            )

    return rows.repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int")).mapInArrow(answering, ROWS)


def finish(rows: DataFrame, buckets: int, done: Callable[[int, bytes, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One call of ``done(tile, kept, answers in bucket order)`` for each tile."""

    def finishing(batches):
        at, kept, answers = None, b"", []
        for batch in batches:
            for tile, kind, body in zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "body")), strict=True):
                if tile != at:
                    if at is not None:
                        yield from done(at, kept, answers)
                    at, kept, answers = tile, b"", []
                if kind == KEPT:
                    kept = body
                else:
                    answers.append(body)
        if at is not None:
            yield from done(at, kept, answers)

    return (
        rows.repartitionById(buckets, F.pmod("tile", F.lit(buckets)).cast("int"))
        .sortWithinPartitions("tile", "kind", "bucket")
        .mapInArrow(finishing, schema)
    )


def bucket_count(docs: DataFrame) -> int:
    """As many buckets as the session's shuffles have partitions."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Numbers(dict):
    """A number for each distinct key, in order of first use."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value
