"""Byte-level BPE by ranks, many pieces at once in padded matrices.

A text is split into pieces by the pattern; each piece is merged on its own. The pieces that a task has not
met yet are laid, one a row, into matrices of like lengths, token ids padded at the right. Beside each lies the
matrix of what every adjacent pair would merge to, found by hashing. In a round every row merges its leftmost
pair of the smallest rank and closes up; the two pairs beside the new token are looked up again, rows without
a pair are done and taken out, and columns that no row reaches are cut off. As ids are ranks, a pair's rank
and its merged token are one number.

A row takes as many rounds as it has merges, each over its whole width, so the few pieces longer than
LONG bytes (a text without spaces) are one row each whose smallest rank comes from a heap instead.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.llm import tiles

#: No pair: larger than any rank.
NONE = np.int32(2**31 - 1)
#: Longest piece that shares a matrix, and cells of a matrix.
LONG, CELLS = 1024, 1 << 20
#: Bytes of text worked on at once, and bytes of pieces a task remembers before it starts afresh.
GROUP_BYTES, REMEMBERED = 4 << 20, 16 << 20
#: White space as Unicode states it; the pattern engine here would count four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ENCODED = "id {id_type}, n_tokens long, token_ids binary"


class PairTable:
    """Open addressing over flat arrays: (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(merged) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, waiting = self._slot(keys), np.arange(len(keys))
        while waiting.size:
            free = waiting[self.keys[at[waiting]] < 0]
            self.keys[at[free]] = keys[free]  # of those that want one slot the last gets it
            self.values[at[free]] = merged[free]
            waiting = waiting[self.keys[at[waiting]] != keys[waiting]]
            at[waiting] = (at[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair; a negative id is padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        met, found = self.keys[at], self.values[at]
        other = np.nonzero((met != keys) & (met >= 0) & (keys >= 0))[0]
        found = np.where(met == keys, found, NONE)
        while other.size:
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            met = self.keys[at[other]]
            hit = met == keys[other]
            found[other[hit]] = self.values[at[other[hit]]]
            other = other[~hit & (met >= 0)]
        return found


class Ranks:
    """Ranks of a tokenizer as read from lines of ``base64 rank``, with all pairs that make a token."""

    def __init__(self, lines: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines.splitlines()))}
        self.bytes_of = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        made = [
            (self.ids[token[:k]], self.ids[token[k:]], i)
            for token, i in self.ids.items()
            for k in range(1, len(token))
            if token[:k] in self.ids and token[k:] in self.ids
        ]
        self.pairs = PairTable(*np.array(made, np.int64).reshape(-1, 3).T)
        self.pattern = regex.compile(with_unicode_space(pattern))

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist() if i < len(table)])

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of every piece: itself where it is a token, else by merging."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ids.get(piece)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            height = max(1, CELLS // width)
            for start in range(0, len(members), height):
                own = members[start : start + height]
                for i, ids in zip(own, self._merge_matrix([pieces[i] for i in own], width), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        filled = np.arange(width) < lengths[:, None]
        ids = np.full(filled.shape, -1, np.int32)
        ids[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(filled.shape, NONE, np.int32)  # of the pair that begins at each token
        at, beside = np.nonzero(filled[:, 1:])
        ranks[at, beside] = self.pairs.find(ids[at, beside], ids[at, beside + 1])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while rows.size:
            first = ranks.argmin(1)  # the leftmost of the smallest
            best = ranks[np.arange(len(rows)), first]
            done = best == NONE
            if done.any():
                for row, own, n in zip(rows[done].tolist(), ids[done], lengths[done].tolist(), strict=True):
                    out[row] = own[:n].copy()
                rows, ids, ranks, lengths, first, best = (x[~done] for x in (rows, ids, ranks, lengths, first, best))
                if not rows.size:
                    break
                reach = int(lengths.max())
                ids, ranks = ids[:, :reach], ranks[:, :reach]
            every, columns = np.arange(len(rows)), np.arange(ids.shape[1])
            # Close up behind the merged pair; what comes in at the right is padding.
            behind = columns > first[:, None]
            ids = np.where(behind, np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)[:, 1:], ids)
            ranks = np.where(behind, np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE)[:, 1:], ranks)
            ids[every, first] = best
            lengths -= 1
            after = np.where(first + 1 < lengths, ids[every, np.minimum(first + 1, ids.shape[1] - 1)], -1)
            ranks[every, first] = self.pairs.find(best, after)
            inner = np.nonzero(first)[0]
            before = first[inner] - 1
            ranks[inner, before] = self.pairs.find(ids[inner, before], best[inner])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One very long row: the leftmost pair of the smallest rank from a heap of (rank, place)."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:]).tolist() + [int(NONE)]
        ids = ids.tolist()
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(rank, i) for i, rank in enumerate(ranks) if rank != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def rank_of(i: int) -> int:
            if i < 0 or right[i] >= len(ids):
                return int(NONE)
            pair = ids[i], ids[right[i]]
            if pair not in known:
                known[pair] = int(self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))[0])
            return known[pair]

        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue  # merged into another token, or beside one, since it was put here
            gone = right[i]
            ids[i], ranks[gone], right[i] = rank, int(NONE), right[gone]
            ids[gone] = -1
            if right[i] < len(ids):
                left[right[i]] = i
            for k in (i, left[i]):
                if k >= 0:
                    ranks[k] = rank_of(k)
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        merged = np.array(ids, np.int32)
        return merged[merged >= 0]


def with_unicode_space(pattern: str) -> str:
    return pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


@functools.lru_cache(maxsize=2)
def ranks_of(lines: bytes, pattern: str) -> Ranks:
    return Ranks(lines, pattern)


class Known:
    """Token ids of the pieces a task has met, in one flat array that grows."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.clear()

    def clear(self) -> None:
        self.number, self.new, self.size = tiles.Numbers(), 0, 0
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        number = self.number
        return np.array([number[p] for p in self.ranks.pattern.findall(text)], np.int64)

    def learn(self) -> None:
        """Encode what has been numbered since the last time."""
        pieces = [p.encode() for p in itertools.islice(self.number, self.new, None)]
        if not pieces:
            return
        found = self.ranks.encode_pieces(pieces)
        self.size += sum(map(len, pieces))
        more = np.concatenate(found)
        used = int(self.ends[-1])
        if used + more.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros(max(self.flat.size, more.size), np.int32)])
        self.flat[used : used + more.size] = more
        self.ends = np.concatenate([self.ends, used + np.cumsum([f.size for f in found], dtype=np.int64)])
        self.new += len(pieces)

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """Token ids of a run of pieces, gathered at once."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        until = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (until - sizes), sizes) + np.arange(until[-1] if until.size else 0)]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``id_col, n_tokens long, token_ids binary`` for each row of ``docs``; with ``decoded`` also ``bytes``,
    what ``decode`` makes of the ids, without another pass.

    ``token_ids`` are unsigned 32-bit integers in little-endian order: what the ranks at ``ranks_path``
    (read by the driver, bounded by the vocabulary) give for the whole text, split by ``pattern``, special
    tokens being ordinary text. A null or empty text has no tokens; a null id is kept; repeated rows come
    out as often as they come in; other columns of any name are ignored; an empty table gives an empty one.
    A task holds a few megabytes of text, or one text where that is longer; nothing is shuffled.
    """
    with open(ranks_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def encoding(batches):
        ranks = ranks_of(sent.value, pattern)
        known = Known(ranks)
        for tile in tiles.cut_tiles(batches, GROUP_BYTES):
            if known.size > REMEMBERED:
                known.clear()
            pieces = [known.numbers(text.decode()) for text in tile.texts()]
            known.learn()
            ids = [known.tokens(p) for p in pieces]
            columns = [tile.ids, pa.array([i.size for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())]
            if decoded:
                columns.append(pa.array([ranks.decode(i) for i in ids], pa.binary()))
            yield pa.record_batch(columns, ["id", "n_tokens", "token_ids", "bytes"][: len(columns)])

    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ENCODED.format(id_type=own.schema["id"].dataType.simpleString()) + ", bytes binary" * decoded
    return own.mapInArrow(encoding, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, token_ids, bytes binary``: the bytes that the ids stand for. Null ids give null;
    an id outside the vocabulary stands for nothing."""
    with open(ranks_path, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def decoding(batches):
        ranks = ranks_of(sent.value, "")
        for batch in batches:
            raw = [None if b is None else ranks.decode(np.frombuffer(b, "<u4")) for b in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], ["id", "n_tokens", "token_ids", "bytes"])

    own = encoded.select(F.col(f"`{id_col}`").alias("id"), "n_tokens", "token_ids")
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(decoding, ENCODED.format(id_type=kind) + ", bytes binary").withColumnRenamed("id", id_col)
