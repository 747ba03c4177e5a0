"""Byte-level BPE encoding with chunks shared across documents, and decoding.

A rolling hash over the last 32 bytes cuts every text where its low bits are zero, so equal passages
are cut alike wherever they stand. A distinct chunk of a tile goes to the bucket of its hash once, and
the bucket encodes each distinct chunk of the corpus once. Encoded alone, a chunk is wrong only near
its ends: the split of a text into words reads from left to right and forgets all when a word ends, and
a word always ends where white space follows a visible character. So the tokens of a chunk between its
first and its last such place are those of the whole text. What lies between the last place of one
chunk and the first of the next is encoded again, over as many chunks as it takes until both sides
agree on a token boundary. The result is exactly that of encoding the whole text.

Special tokens of the vocabulary are found in the text first and are borders of their own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame

from daymart.llm import tiles

#: Cut rules: mean, least and largest bytes of a chunk.
MEAN_BITS, LEAST, LARGEST = 10, 256, 8192
WINDOW = 32
#: Compression of what crosses the shuffle, and bytes of text in a tile.
LEVEL, TILE_BYTES = 6, 6 << 20
GEAR = np.random.default_rng(20240101).integers(0, 2**32, 256, dtype=np.uint32)
#: The fixed split of byte-level BPE into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A visible ASCII character with white space behind it: a word ends here in any text.
BORDER = re.compile(rb"[!-~](?=[ \t\n\r])")
#: Rows that leave a task together.
ROWS_OUT = 500
ENCODED = "id {id_type}, n_tokens long, token_ids binary"


@functools.lru_cache(maxsize=2)
def vocabulary(definition: str) -> Vocabulary:
    return Vocabulary(definition)


class Vocabulary:
    """Vocabulary, merges and special tokens read from a tokenizer definition (JSON text)."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        splitter = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE definition without normalizer is needed")
        if splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("only the plain byte-level split is supported")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        plain = {t: i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in plain.items()}
        merged = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [plain[a + b] for a, b in merged]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges")
        self.encoder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        by_id = {i: b for b, i in ranks.items()} | {i: b for b, i in self.special.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.special_pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or rb"(?!)")

    def encode(self, text: bytes) -> list[int]:
        """Tokens of a text without special tokens."""
        return self.encoder.encode_ordinary(text.decode("utf-8"))

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])

    def text(self, ids: np.ndarray) -> str:
        return self.decode(ids[ids < len(self.bytes_of)]).decode("utf-8", "replace")


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ends of chunks that the rolling hash allows, at borders of characters."""
    if data.size < 2:
        return np.zeros(0, np.int64)
    rolling, span = GEAR[data], 1
    while span < WINDOW:
        rolling[span:] += rolling[:-span] << np.uint32(span)
        span *= 2
    # The hash of the last WINDOW bytes is mixed into the top bits.
    allowed = (rolling[:-1] >> np.uint32(32 - MEAN_BITS)) == 0
    allowed &= (data[1:] & 0xC0) != 0x80
    return np.nonzero(allowed)[0] + 1


def chunks_of(data: np.ndarray, start: int, end: int, places: np.ndarray):
    """Borders of the chunks of data[start:end]."""
    at, borders = start, [start]
    while at < end:
        k = int(np.searchsorted(places, at + LEAST))
        stop = int(places[k]) if k < len(places) else end
        if min(stop, end) > at + LARGEST:
            stop = at + LARGEST
            while stop > at and data[stop] & 0xC0 == 0x80:
                stop -= 1
        at = min(stop, end)
        borders.append(at)
    return borders


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col, n_tokens long, token_ids binary`` for each row of ``docs``, in any order; with
    ``decoded`` also ``text``, what ``decode`` makes of the ids, without another pass.

    ``token_ids`` are unsigned 32-bit integers in little-endian order, the ids that the definition at
    ``tokenizer_path`` (read by the driver, bounded by the vocabulary) gives for the whole text.
    A null or empty text has no tokens; a null id is kept; repeated rows come out as often as they come
    in; other columns of any name are ignored; an empty table gives an empty one. A text of any length
    is one tile at most.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    n = tiles.bucket_count(docs)

    def cut(tile: tiles.Tile):
        vocab = vocabulary(sent.value)
        data, text = np.frombuffer(tile.data, np.uint8), bytes(tile.data)
        places, number, buckets = cut_places(data), tiles.Numbers(), []
        items, counts = [], []  # of all documents: a chunk's number, or -1 - id of a special token
        for start, end in zip(tile.ends[:-1].tolist(), tile.ends[1:].tolist(), strict=True):
            had = len(items)
            parts, at = [], start
            for found in vocab.special_pattern.finditer(text, start, end):
                parts += [(at, found.start(), None), (0, 0, vocab.special[found[0]])]
                at = found.end()
            for first, last, special in [*parts, (at, end, None)]:
                if special is not None:
                    items.append(-1 - special)
                    continue
                borders = chunks_of(data, first, last, places)
                items += [number[text[a:b]] for a, b in zip(borders[:-1], borders[1:], strict=True)]
            counts.append(len(items) - had)
        asked: dict[int, list[tuple[int, bytes]]] = {}
        for chunk, index in number.items():
            asked.setdefault(xxhash.xxh3_64_intdigest(chunk) % n, []).append((index, chunk))
        # Chunks are numbered anew by bucket, the order in which answers come back.
        renumber = np.zeros(len(number) + 1, np.int32)
        renumber[[i for b in sorted(asked) for i, _ in asked[b]]] = np.arange(len(number), dtype=np.int32)
        items = np.array(items, np.int64)
        items = np.where(items >= 0, renumber[np.maximum(items, 0)], items).astype(np.int32)
        kept = tiles.pack(tile.packed_ids(), np.array(counts, np.int32), items)
        return kept, {
            b: tiles.pack(np.array([len(c) for _, c in own], np.uint32), b"".join(c for _, c in own), level=LEVEL)
            for b, own in asked.items()
        }

    def reply(bodies: list[bytes]) -> list[bytes]:
        vocab, known, out = vocabulary(sent.value), {}, []
        for body in bodies:
            lengths, text = tiles.unpack(body, np.uint32, None)
            ends, parts = [0, *np.cumsum(lengths, dtype=np.int64).tolist()], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                chunk = text[a:b]
                if (found := known.get(chunk)) is None:
                    found = known[chunk] = encoded_chunk(vocab, chunk)
                parts.append(found)
            marks = np.array([x[:2] for x in parts], np.int32).reshape(-1, 2)
            ids = np.concatenate([x[2] for x in parts])
            high = (ids >> 16).astype(np.uint16)
            sizes = np.array([x[2].size for x in parts], np.uint32)
            out.append(tiles.pack(sizes, marks, ids.astype(np.uint16), high if high.any() else high[:0], level=LEVEL))
        return out

    def done(_tile: int, kept: bytes, answers: list[bytes]):
        vocab = vocabulary(sent.value)
        raw, counts, items = tiles.unpack(kept, None, np.int32, np.int32)
        chunks = []
        for body in answers:
            sizes, marks, low, high = tiles.unpack(body, np.uint32, np.int32, np.uint16, np.uint16)
            ids = low.astype(np.uint32)
            if high.size:
                ids |= high.astype(np.uint32) << 16
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            chunks += [(ids[e - s : e], a, b) for e, s, (a, b) in zip(ends, sizes.tolist(), marks.reshape(-1, 2).tolist(), strict=True)]
        ids, known, at, out = tiles.unpacked_ids(raw), {}, 0, []
        for count in counts.tolist():
            own = items[at : at + count].tolist()
            at += count
            out.append(joined(vocab, own, chunks, known))
        for start in range(0, len(out), ROWS_OUT):
            part = out[start : start + ROWS_OUT]
            columns = [pa.array([o.size for o in part], pa.int64()), pa.array([o.tobytes() for o in part], pa.binary())]
            if decoded:
                columns.append(pa.array([vocab.text(o) for o in part], pa.string()))
            yield pa.record_batch([ids.slice(start, ROWS_OUT), *columns], ["id", "n_tokens", "token_ids", "text"][: 3 + decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = tiles.answer(tiles.ask(docs, id_col, text_col, cut, tile_bytes=TILE_BYTES), n, reply)
    schema = ENCODED.format(id_type=kind) + ", text string" * decoded
    return tiles.finish(rows, n, done, schema).withColumnRenamed("id", id_col)


def encoded_chunk(vocab: Vocabulary, chunk: bytes) -> tuple[int, int, np.ndarray]:
    """Tokens before the first sure border, before the last one, and all; -1 where there is none."""
    ids = np.array(vocab.encode(chunk), np.uint32)
    borders = [m.end() for m in BORDER.finditer(chunk)]
    if not borders:
        return -1, -1, ids
    ends = np.cumsum(vocab.lengths[ids])
    first, last = np.searchsorted(ends, [borders[0], borders[-1]]).tolist()
    if ends[first] != borders[0] or ends[last] != borders[-1]:
        return -1, -1, ids  # no agreement on a token's end here: the whole chunk is encoded again
    return first + 1, last + 1, ids


def joined(vocab: Vocabulary, items: list[int], chunks: list, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Tokens of one text from those of its chunks."""
    parts, open_ids = [], []  # open_ids: tokens since the last sure border, to be encoded again

    def close():
        if len(open_ids) == 1:
            parts.append(open_ids[0])
        elif open_ids:
            text = vocab.decode(np.concatenate(open_ids))
            if text not in known:
                known[text] = np.array(vocab.encode(text), np.uint32)
            parts.append(known[text])
        open_ids.clear()

    for item in items:
        if item < 0:
            close()
            parts.append(np.array([-1 - item], np.uint32))
            continue
        ids, first, last = chunks[item]
        if first < 0 or not open_ids:
            if first < 0:
                open_ids.append(ids)
            else:  # the text, or what follows a special token, begins here
                parts.append(ids[:last])
                open_ids.append(ids[last:])
            continue
        open_ids.append(ids[:first])
        close()
        parts.append(ids[first:last])
        open_ids.append(ids[last:])
    close()
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, token_ids, text string``: the text that the ids stand for, special tokens
    included. Bytes that are no UTF-8 become the replacement character. Null ids give a null text; an
    id outside the vocabulary stands for nothing."""
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def decoding(batches):
        vocab = vocabulary(sent.value)
        for batch in batches:
            texts = [None if b is None else vocab.text(np.frombuffer(b, "<u4")) for b in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], ["id", "n_tokens", "token_ids", "text"])

    own = encoded.select(encoded[id_col].alias("id"), "n_tokens", "token_ids")
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(decoding, ENCODED.format(id_type=kind) + ", text string").withColumnRenamed("id", id_col)


def digest(ids: list[int]) -> str:
    """Hash of a list of ids, for tests."""
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
