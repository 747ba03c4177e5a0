"""A hidden Markov language model over words, trained on the corpus and scored exactly.

A word belongs to a class (a hash of its last three bytes; the text's end has a class of its own). Hidden
states emit classes, a class emits its words in proportion to their counts in the corpus:
``P(text) = P(classes under the states) * product of P(word | class)``. So what is trained by
Baum-Welch is bounded (states x classes) and goes to every task, while word counts, which grow with the
corpus, are exchanged between tiles and buckets of words.

Each round of Baum-Welch is one pass over the stored class sequences; tasks sum expected counts and the
driver normalises the sums. Sequences are cut into blocks whose transfer matrices are worked out side by
side, which makes the scaled forward and backward recursions exact for texts of any length without a
step for each word of the longest one.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.llm import tiles
from daymart.session import shared_folder

STATES, CLASSES, ROUNDS, SEED = 4, 256, 4, 7
#: Smoothing of word counts, steps of a block, steps between rescalings.
ADDED, BLOCK, RESCALE = 0.1, 64, 8
#: A row in flight that holds the class sequences of a tile's training documents.
SEQUENCES = 2
END = b""


def word_class(word: bytes) -> int:
    """0 for the end, else 1 to CLASSES - 1."""
    return 0 if word == END else 1 + zlib.crc32(word[-3:]) % (CLASSES - 1)


@dataclass(frozen=True)
class States:
    start: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # classes x states


def first_states(class_counts: np.ndarray) -> States:
    """The classes' shares, disturbed a little in each state so that states can part; a state stays likely."""
    noise = np.exp(0.5 * np.random.default_rng(SEED).standard_normal((CLASSES, STATES)))
    emits = (class_counts + 1.0)[:, None] * noise
    moves = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1))
    np.fill_diagonal(moves, 0.9)
    return States(np.full(STATES, 1 / STATES), moves, emits / emits.sum(0))


class Blocks:
    """Sequences of classes as blocks of at most BLOCK steps, longest blocks first."""

    def __init__(self, lengths: np.ndarray, classes: np.ndarray):
        per = -(-lengths // BLOCK)
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths)), per)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(lengths[owner] - index * BLOCK, BLOCK)
        self.order = np.argsort(-size, kind="stable")  # place in steps -> block
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.sizes = size[self.order]
        self.active = np.searchsorted(-self.sizes, -np.arange(BLOCK), side="left")
        starts = (first[owner] + index * BLOCK)[self.order]
        self.steps = [classes[starts[:n] + t] for t, n in enumerate(self.active.tolist())]
        # Blocks in turn: documents with the most blocks first, so that those with a next block are in front.
        self.documents = np.argsort(-per, kind="stable")
        self.per = per
        self.block_of = np.cumsum(per) - per
        self.turns = [self.documents[: int((per > j).sum())] for j in range(int(per.max(initial=0)))]

    def transfers(self, model: States) -> tuple[np.ndarray, np.ndarray]:
        """For each place a matrix (states before x states after), and the logarithm it was divided by."""
        n = len(self.order)
        whole, logs = np.zeros((n, STATES, STATES)), np.zeros(n)
        current = np.eye(STATES)[None] * model.emits[self.steps[0]][:, None, :]
        for t in range(1, BLOCK + 1):
            go = int(self.active[t]) if t < BLOCK else 0
            whole[go : len(current)] = current[go:]
            if not go:
                break
            current = (current[:go].reshape(-1, STATES) @ model.moves).reshape(go, STATES, STATES)
            current *= model.emits[self.steps[t]][:, None, :]
            if t % RESCALE == 0:
                top = current.max((1, 2))
                current /= top[:, None, None]
                logs[:go] += np.log(top)
        top = whole.max((1, 2))
        return whole / top[:, None, None], logs + np.log(top)

    def forward(self, model: States, whole: np.ndarray, logs: np.ndarray):
        """Scaled state vectors before each place's block, and the log-likelihood of each sequence."""
        before = np.zeros((len(self.order), STATES))
        total = np.zeros(len(self.per))
        after = np.zeros((len(self.per), STATES))
        for j, docs in enumerate(self.turns):
            at = self.place[self.block_of[docs] + j]
            enter = after[docs] @ model.moves if j else np.broadcast_to(model.start, (len(docs), STATES))
            before[at] = enter
            leave = np.einsum("ni,nij->nj", enter, whole[at])
            scale = leave.sum(1)
            after[docs] = leave / scale[:, None]
            total[docs] += np.log(scale) + logs[at]
        return before, total

    def backward(self, model: States, whole: np.ndarray) -> np.ndarray:
        """Scaled chances of all that follows each place's block, by the state at its last step."""
        behind = np.ones((len(self.order), STATES))
        follow = np.ones((len(self.per), STATES))
        for j in range(len(self.turns) - 1, -1, -1):
            docs = self.turns[j]
            at = self.place[self.block_of[docs] + j]
            behind[at] = follow[docs]
            back = np.einsum("nij,nj->ni", whole[at], follow[docs]) @ model.moves.T
            follow[docs] = back / back.sum(1, keepdims=True)
        return behind


def log_likelihoods(model: States, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance of each sequence of classes; every length is 1 or more."""
    if not len(lengths):
        return np.zeros(0)
    blocks = Blocks(lengths, classes)
    return blocks.forward(model, *blocks.transfers(model))[1]


def expected_counts(model: States, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Expected starts, moves and emissions of all sequences, and their log-likelihood, as one row."""
    starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    if not len(lengths):
        return np.concatenate([starts, moves.ravel(), emits.ravel(), [0.0]])
    blocks = Blocks(lengths, classes)
    whole, logs = blocks.transfers(model)
    before, total = blocks.forward(model, whole, logs)
    behind = blocks.backward(model, whole)
    n, ahead = len(blocks.order), []
    value = before
    for t, seen in enumerate(blocks.steps):
        if not len(seen):
            break
        value = (value[: len(seen)] @ model.moves if t else value) * model.emits[seen]
        value /= value.sum(1, keepdims=True)
        ahead.append(value)
    last = np.zeros((n, STATES))  # forward vector at each block's last step
    back, first = behind.copy(), None
    for t in range(len(ahead) - 1, -1, -1):
        seen = blocks.steps[t]
        ends = int(blocks.active[t + 1]) if t + 1 < BLOCK else 0
        last[ends : len(seen)] = ahead[t][ends:]
        belief = ahead[t] * back[: len(seen)]
        belief /= belief.sum(1, keepdims=True)
        for k in range(STATES):
            emits[:, k] += np.bincount(seen, belief[:, k], CLASSES)
        right = model.emits[seen] * back[: len(seen)]
        if t:
            left = ahead[t - 1][: len(seen)]
            right /= ((left @ model.moves) * right).sum(1, keepdims=True)
            moves += model.moves * (left.T @ right)
            back[: len(seen)] = right @ model.moves.T
            back[: len(seen)] /= back[: len(seen)].sum(1, keepdims=True)
        else:
            first = (belief, right)
    belief, right = first
    starts += belief[blocks.place[blocks.block_of]].sum(0)
    for j in range(1, len(blocks.turns)):  # moves from a block to the next one of the same sequence
        docs = blocks.turns[j]
        left = last[blocks.place[blocks.block_of[docs] + j - 1]]
        into = right[blocks.place[blocks.block_of[docs] + j]]
        into = into / ((left @ model.moves) * into).sum(1, keepdims=True)
        moves += model.moves * (left.T @ into)
    return np.concatenate([starts, moves.ravel(), emits.ravel(), [total.sum()]])


def next_states(sums: np.ndarray) -> States:
    starts, moves, emits = np.split(sums[:-1], [STATES, STATES + STATES**2])
    starts, moves, emits = starts + 0.1, moves.reshape(STATES, STATES) + 0.1, emits.reshape(CLASSES, STATES) + 0.1
    return States(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def held_out(ids: pa.Array) -> np.ndarray:
    """Rows whose crc32 of the id as text is divisible by ten; a null id counts as the empty text."""
    texts = pc.cast(ids, pa.string()).fill_null("").to_pylist()
    return np.array([zlib.crc32(t.encode()) % 10 == 0 for t in texts], bool)


def summed(rows: DataFrame, width: int) -> np.ndarray:
    """Element-wise sum of one row of numbers for each task, ``cell long, value double``."""
    out = np.zeros(width)
    for cell, value in rows.groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double``.

    Tokens are the words of the text in lower case (A-Z) and one end. Rows that are not held out train
    word counts and states. ``base_score`` is the smoothed unigram log10 probability; ``score`` that of
    the model. Words never met in training share the smoothing of their class.

    A null or empty text is its end alone; null ids are held out; repeated rows count as often as they
    come; other columns are ignored; an empty table gives an empty one; without training rows all words
    are unknown. Driver and tasks hold STATES x CLASSES numbers, a tile or a bucket of words.
    """
    spark, n = docs.sparkSession, tiles.bucket_count(docs)

    def cut(tile: tiles.Tile):
        number, counts, ids = tiles.Numbers(), [], []
        end = number[END]
        for text in tile.texts():
            own = [*map(number.__getitem__, text.lower().split()), end]
            counts.append(len(own))
            ids += own
        ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
        words = list(number)
        classes = np.fromiter(map(word_class, words), np.uint8, len(words))
        learns = ~held_out(tile.ids)
        taught = ids[np.repeat(learns, counts)]
        times = np.bincount(taught, minlength=len(words))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        kept = tiles.pack(tile.packed_ids(), counts, place[ids], classes[order])
        borders = [0, *(np.nonzero(np.diff(bucket[order]))[0] + 1).tolist(), len(order)]
        asked = {}
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            own = order[a:b].tolist()
            asked[int(bucket[own[0]])] = tiles.pack(b"\n".join(words[i] for i in own), times[own].astype(np.int64))
        return kept, asked, tiles.pack(counts[learns], classes[taught])

    def reply(bodies: list[bytes]) -> list[bytes]:
        total: dict[bytes, int] = {}
        requests = []
        for body in bodies:
            raw, times = tiles.unpack(body, None, np.int64)
            words = raw.split(b"\n")  # a word has no line feed; the end is the empty word
            requests.append(words)
            for word, count in zip(words, times.tolist(), strict=True):
                total[word] = total.get(word, 0) + count
        # The first answer of a bucket also carries its tokens and distinct words by class.
        known = {w: c for w, c in total.items() if c}
        classes = np.fromiter(map(word_class, known), np.int64, len(known))
        of_class = np.concatenate(
            [np.bincount(classes, list(known.values()), CLASSES), np.bincount(classes, minlength=CLASSES)]
        ).astype(np.int64)
        return [
            tiles.pack(np.array([total[w] for w in words], np.int64), of_class if k == 0 else of_class[:0])
            for k, words in enumerate(requests)
        ]

    path = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    tiles.answer(tiles.ask(docs, id_col, text_col, cut, SEQUENCES), n, reply).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(tiles.ROWS).parquet(path)

    def class_sums(batches):
        sums = np.zeros(2 * CLASSES)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                own = tiles.unpack(body, None, np.int64)[1]
                if own.size:
                    sums += own
        yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums)], ["cell", "value"])

    pair = "cell long, value double"
    answers = stored.where(F.col("kind") == tiles.ASKED).select("body")
    tokens, distinct = np.split(summed(answers.mapInArrow(class_sums, pair), 2 * CLASSES), 2)
    model = first_states(tokens)
    sequences = stored.where(F.col("kind") == SEQUENCES).select("body")
    for _ in range(rounds):

        def expecting(batches, model=model):
            sums = None
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    own = expected_counts(model, *tiles.unpack(body, np.int64, np.uint8))
                    sums = own if sums is None else sums + own
            if sums is not None:
                yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums)], ["cell", "value"])

        width = STATES + STATES**2 + CLASSES * STATES + 1
        model = next_states(summed(sequences.mapInArrow(expecting, pair), width))

    every, types = float(tokens.sum()), float(distinct.sum())
    class_total = tokens + ADDED * (distinct + 1)

    def scoring(_number: int, kept: bytes, answers: list[bytes]):
        raw, counts, ids, classes = tiles.unpack(kept, None, np.int64, np.uint32, np.uint8)
        ids_out = tiles.unpacked_ids(raw)
        seen = np.concatenate([tiles.unpack(a, np.int64, np.int64)[0] for a in answers])
        base = np.log10((seen + ADDED) / (every + ADDED * (types + 1)))
        within = np.where(classes == 0, 0.0, np.log10((seen + ADDED) / class_total[classes]))
        first = np.cumsum(counts) - counts
        states = log_likelihoods(model, counts, classes[ids].astype(np.int64)) / np.log(10)
        yield pa.record_batch(
            [
                ids_out,
                pa.array(held_out(ids_out)),
                pa.array(counts),
                pa.array(np.add.reduceat((seen > 0)[ids].astype(np.int64), first)),
                pa.array(np.full(len(counts), int(every))),
                pa.array(np.add.reduceat(base[ids], first)),
                pa.array(np.add.reduceat(within[ids], first) + states),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = (
        f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double"
    )
    return tiles.finish(stored.where(F.col("kind") != SEQUENCES), n, scoring, schema).withColumnRenamed("id", id_col)
