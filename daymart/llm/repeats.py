"""Repeated passages, found by anchors at the places of a difference cover.

A difference cover of a period holds, for any two word positions, an equal shift of both that lands
both on cover places. So if two windows are equal, some pair of shorter windows inside them, at cover
places, is equal too. Only these anchors are hashed and counted over the corpus. Where an anchor
repeats, every full window that could hold it is a candidate; candidates are hashed in full and counted,
and the words of those that occur twice or more are removed. No two documents are ever paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from daymart.llm import tiles

#: Perfect difference covers, by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """A hash of each window of ``width`` values, put together from windows of powers of two."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, current, out, done = int(factor), 1, values, np.zeros(n, np.uint64), 0
    while True:
        if width & span:
            out = out * np.uint64(power) + current[done : done + n]
            done += span
        if 2 * span > width:
            return mixed(out)
        current = current[:-span] * np.uint64(power) + current[span:]
        power, span = power * power % 2**64, 2 * span


class Words:
    """The words of a tile's documents, one behind the other."""

    def __init__(self, ends: np.ndarray, text: bytes):
        self.words, counts, start = [], [], 0
        for end in ends.tolist():
            own = text[start:end].split()
            self.words += own
            counts.append(len(own))
            start = end
        self.counts = np.array(counts, np.int64)
        number = tiles.Numbers()
        ids = np.fromiter(map(number.__getitem__, self.words), np.int64, len(self.words))
        self.values = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)[ids] if number else np.zeros(0, np.uint64)
        starts = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(ids)) - np.repeat(starts, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place  # words from here to the document's end


class Keys:
    """Distinct hashes of chosen windows, in the order in which buckets answer."""

    def __init__(self, words: Words, width: int, chosen: np.ndarray, buckets: int, checked: bool):
        self.chosen = chosen
        first = windows(words.values, width, FACTORS[0])[chosen] if chosen.size else np.zeros(0, np.uint64)
        second = (windows(words.values, width, FACTORS[1])[chosen] >> np.uint64(32)).astype(np.uint32) if checked and chosen.size else None
        bucket = ((first >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((first, bucket) if second is None else (second, first, bucket))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = first[order[1:]] != first[order[:-1]]
            if second is not None:
                new[1:] |= second[order[1:]] != second[order[:-1]]
        group = np.cumsum(new) - 1
        self.which = np.empty(len(order), np.int64)
        self.which[order] = group
        lead = order[new]
        self.first, self.bucket = first[lead], bucket[lead]
        self.second = None if second is None else second[lead]
        self.several = np.bincount(group, minlength=len(lead)) > 1

    def questions(self) -> dict[int, bytes]:
        borders = [0, *(np.nonzero(np.diff(self.bucket))[0] + 1).tolist(), len(self.bucket)] if len(self.bucket) else [0]
        nothing = np.zeros(0, np.uint32)
        return {
            int(self.bucket[a]): tiles.pack(self.first[a:b], nothing if self.second is None else self.second[a:b], np.packbits(self.several[a:b]))
            for a, b in zip(borders[:-1], borders[1:], strict=True)
        }

    def repeated(self, answers: list[bytes]) -> np.ndarray:
        """The chosen places whose hash occurs twice or more in the corpus."""
        flags = [np.unpackbits(bits, count=int(n[0])) for n, bits in (tiles.unpack(a, np.int64, np.uint8) for a in answers)]
        if not flags:
            return self.chosen[:0]
        return self.chosen[np.concatenate(flags).astype(bool)[self.which]]


def count_keys(bodies: list[bytes]) -> list[bytes]:
    """For each key of each body whether the corpus has it twice or more."""
    parts = [tiles.unpack(b, np.uint64, np.uint32, np.uint8) for b in bodies]
    sizes = [len(p[0]) for p in parts]
    first = np.concatenate([p[0] for p in parts])
    second = np.concatenate([p[1] for p in parts])
    several = np.concatenate([np.unpackbits(p[2], count=n) for p, n in zip(parts, sizes, strict=True)]).astype(bool)
    order = np.lexsort((second, first)) if len(second) else np.argsort(first, kind="stable")
    same = first[order[1:]] == first[order[:-1]]
    if len(second):
        same &= second[order[1:]] == second[order[:-1]]
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice |= several
    ends = np.cumsum(sizes).tolist()
    return [tiles.pack(np.array([n]), np.packbits(twice[e - n : e])) for e, n in zip(ends, sizes, strict=True)]


def covered(places: np.ndarray, before: int, after: int, total: int) -> np.ndarray:
    """Positions from ``place - before`` up to ``place + after`` (exclusive) of any place."""
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, np.maximum(places - before, 0), 1)
    np.add.at(edges, np.minimum(places + after, total), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, period: int = 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words long, n_removed long, kept_text string`` for each row of ``docs``.

    Words are the runs of anything but ASCII white space. A word goes when a window of ``window`` words
    around it also starts anywhere else, in this or another row; all windows are judged on the input,
    so every copy of a passage goes. ``kept_text`` joins the other words by one space.

    A null or empty text has no words; a text shorter than a window keeps all; repeated rows repeat
    each other; null ids are kept; other columns are ignored; an empty table gives an empty one. Windows
    are compared by 96 bits of hash.
    """
    if period not in COVERS or window < period:
        raise ValueError(f"period must be one of {sorted(COVERS)} and not above window")
    n, width, cover = tiles.bucket_count(docs), window - period + 1, np.isin(np.arange(period), COVERS[period])

    def anchors(words: Words) -> Keys:
        fits = (words.left >= width) & (words.place + words.left >= window) & cover[words.place % period]
        return Keys(words, width, np.nonzero(fits)[0], n, checked=False)

    def candidates(words: Words, wanted: np.ndarray) -> Keys:
        return Keys(words, window, np.nonzero(wanted & (words.left >= window))[0], n, checked=True)

    def cut(tile: tiles.Tile):
        text = bytes(tile.data)
        return tiles.pack(tile.packed_ids(), tile.ends[1:], text), anchors(Words(tile.ends[1:], text)).questions()

    def extend(number: int, kept: bytes, answers: list[bytes]):
        ids, ends, text = tiles.unpack(kept, None, np.int64, None)
        words = Words(ends, text)
        places = anchors(words).repeated(answers)
        # A window holding the anchor starts at most period - 1 words before it, in the same document.
        wanted = np.zeros(len(words.place) + 1, np.int64)
        np.add.at(wanted, places - np.minimum(words.place[places], period - 1), 1)
        np.add.at(wanted, places + 1, -1)
        wanted = np.cumsum(wanted[:-1]) > 0
        yield tiles.rows_of(number, tiles.pack(ids, ends, text, np.packbits(wanted)), candidates(words, wanted).questions())

    def remove(_number: int, kept: bytes, answers: list[bytes]):
        ids, ends, text, bits = tiles.unpack(kept, None, np.int64, None, np.uint8)
        words = Words(ends, text)
        wanted = np.unpackbits(bits, count=len(words.place)).astype(bool)
        gone = covered(candidates(words, wanted).repeated(answers), 0, window, len(words.place))
        texts, removed, at = [], [], 0
        for count in words.counts.tolist():
            own, lost = words.words[at : at + count], gone[at : at + count]
            removed.append(int(lost.sum()))
            if removed[-1]:
                own = [own[i] for i in np.nonzero(~lost)[0].tolist()]
            texts.append(b" ".join(own).decode())
            at += count
        yield pa.record_batch(
            [tiles.unpacked_ids(ids), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            ["id", "n_words", "n_removed", "kept_text"],
        )

    asked = tiles.answer(tiles.ask(docs, id_col, text_col, cut), n, count_keys)
    again = tiles.answer(tiles.finish(asked, n, extend, tiles.ROWS), n, count_keys)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_text string"
    return tiles.finish(again, n, remove, schema).withColumnRenamed("id", id_col)
