"""Greedy word-piece counts with a linear longest-match automaton.

The vocabulary is a trie of byte strings. Where a longest match ends inside a node, the failure link
names the node to go on from and the popped count says how many pieces are finished by going there, so a
word is read once, byte by byte, and no piece is ever cut out.
"""

from __future__ import annotations

import functools
import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.llm import tiles

#: Words whose counts a task remembers before it starts afresh.
REMEMBERED = 300_000


class Automaton:
    """Pieces that begin with a space open a word; the others continue one."""

    def __init__(self, pieces: list[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        parents, complete = [(0, 0)], {0: False}
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(parents)
                    complete[len(parents)] = False
                    parents.append((node, byte))
                node = self.step[key]
            complete[node] = bool(piece)
        self.link, self.popped = [-1] * len(parents), [0] * len(parents)
        children: dict[int, list[int]] = {}
        for node, (parent, _) in enumerate(parents[1:], 1):
            children.setdefault(parent, []).append(node)
        waiting = deque(children.get(0, []))
        while waiting:
            node = waiting.popleft()
            waiting.extend(children.get(node, []))
            if complete[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            parent, byte = parents[node]
            at, popped = self.link[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.step:
                popped += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.step[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 for a word that the vocabulary cannot spell."""
        step, link, popped = self.step, self.link, self.popped
        node, pieces = 0, 0
        for byte in word:
            while (after := step.get(node << 8 | byte)) is None:
                pieces += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = after
        while node > 0:
            pieces += popped[node]
            node = link[node]
        return pieces if node == 0 else 1


class Counts(dict):
    """Pieces of each word, worked out when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.automaton.count(b" " + word)
        return value


@functools.lru_cache(maxsize=2)
def automaton(definition: str) -> Automaton:
    return Automaton(pieces_of(definition))


def pieces_of(definition: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer definition (JSON text) as byte strings, special tokens left out."""
    spec = json.loads(definition)
    special = {t["content"] for t in spec["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [bytes(to_byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words long, n_pieces long, longest_word_pieces long`` for each row of ``docs``.

    Words are the runs of anything but ASCII white space; a word with a space before it is cut greedily
    into the longest pieces of the vocabulary at ``vocabulary_path`` (read by the driver, bounded by the
    vocabulary). A null or empty text has no words and counts 0; null ids and repeated rows are kept;
    other columns are ignored; an empty table gives an empty one. Rows are read one by one, so a very
    long text needs only its own memory.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def counting(batches):
        machine = automaton(sent.value)
        known = Counts(machine)
        for batch in batches:
            words, pieces, longest = [], [], []
            for text in batch.column(1).to_pylist():
                own = [known[w] for w in (text or "").encode().split()]
                words.append(len(own))
                pieces.append(sum(own))
                longest.append(max(own, default=0))
                if len(known) > REMEMBERED:
                    known = Counts(machine)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, pieces, longest))],
                ["id", "n_words", "n_pieces", "longest_word_pieces"],
            )

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, n_words long, n_pieces long, longest_word_pieces long"
    return own.mapInArrow(counting, schema).withColumnRenamed("id", id_col)
