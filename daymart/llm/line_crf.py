"""Quality by labelling lines: a linear-chain conditional random field marks content or boilerplate.

Each line has a few features (symbols, capitals, repetition, separators, length); the field scores a
label for each line and each pair of neighbouring labels, and Viterbi decoding gives the best labelling
of the whole document. A document is kept when content lines hold enough of its words.

Lines have no labels of their own, so training labels every line of a document by the document's
label. Lines that good and bad documents share then count for content, because good documents have
far more of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols", "capitals", "repeated", "neighbours", "earlier", "bars", "marks", "digits", "short", "stop")
CONTENT, BOILERPLATE = 0, 1
#: Least share of words in content lines; base rules: least words, largest percentage of repeated words.
KEEP_SHARE, LEAST_WORDS, REPEAT_PERCENT = 0.6, 50, 50


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each line with a word, and the number of its words. Shares lie in 0..1."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        letters = len(line) - n + 1
        symbols = sum(line.count(c) for c in SYMBOLS)
        capitals = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = len(line) - len(line.translate(None, b"0123456789"))
        same = sum(a == b for a, b in zip(words, words[1:])) if n > 1 else 0
        rows.append(
            (
                1.0,
                min(symbols / n, 1.0),
                capitals / max(letters, 1),
                1 - len(set(words)) / n,
                same / n,
                float(line in seen),
                min(2 * words.count(b"|") / n, 1.0),
                min(line.count(b"!") / n, 1.0),
                digits / max(letters, 1),
                float(n < 4),
                float(line.rstrip().endswith((b".", b"!", b"?"))),
            )
        )
        sizes.append(n)
        seen.add(line)
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Field:
    """weights: label x feature; moves: previous label x label; share: least share of content words."""

    weights: np.ndarray
    moves: np.ndarray
    share: float = KEEP_SHARE

    def decode(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of the lines of each document: Viterbi over all documents at once, longest first."""
        sizes = np.array([len(x) for x in features], np.int64)
        order = np.argsort(-sizes, kind="stable")
        top = int(sizes.max(initial=0))
        if not top:
            return [np.zeros(0, np.int64) for _ in features]
        starts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        scores = np.concatenate([features[i] for i in order]) @ self.weights.T
        came = np.zeros(scores.shape, np.int8)
        active = np.searchsorted(-sizes[order], -np.arange(top), side="left")  # documents with more than t lines
        best = scores[starts[: active[0]]]
        ended = np.zeros((len(features), 2))
        for t in range(1, top):
            n = active[t]
            ended[n : len(best)] = best[n:]
            through = best[:n, :, None] + self.moves
            at = starts[:n] + t
            came[at] = through.argmax(1)
            best = through.max(1) + scores[at]
        ended[: len(best)] = best
        labels = np.zeros(len(scores), np.int8)
        label = ended.argmax(1)
        for t in range(top - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            labels[at] = label[:n]
            label[:n] = came[at, label[:n]]
        out: list = [None] * len(features)
        for k, i in enumerate(order):
            out[i] = labels[starts[k] : starts[k] + sizes[i]]
        return out


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves that maximise the mean conditional log-likelihood of the lines' labels (Adam)."""
    kept = sorted((x for x in documents if len(x[0])), key=lambda x: -len(x[0]))
    weights, moves = np.zeros((2, len(FEATURES))), np.zeros((2, 2))
    if not kept:
        weights[CONTENT, 0] = 1.0
        return weights, moves
    sizes = np.array([len(x) for x, _ in kept])
    labels = np.array([y for _, y in kept])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate([x for x, _ in kept])
    total, top = len(every), int(sizes.max())
    active = np.searchsorted(-sizes, -np.arange(top), side="left")
    seen_weights, seen_moves = np.zeros_like(weights), np.zeros_like(moves)
    for y in (0, 1):
        seen_weights[y] = every[np.repeat(labels, sizes) == y].sum(0)
        seen_moves[y, y] = (sizes[labels == y] - 1).sum()
    speed, size, flat = 0.0, 0.0, np.zeros(weights.size + moves.size)
    for step in range(1, rounds + 1):
        scores = every @ weights.T
        local = np.exp(scores - scores.max(1, keepdims=True))
        going = np.exp(moves)
        ahead, scale = np.zeros((total, 2)), np.ones(total)
        for t in range(top):
            at = starts[: active[t]] + t
            value = local[at] * (ahead[at - 1] @ going if t else 1.0)
            scale[at] = value.sum(1)
            ahead[at] = value / scale[at, None]
        back, pairs = np.ones((total, 2)), np.zeros((2, 2))
        for t in range(top - 1, 0, -1):
            at = starts[: active[t]] + t
            value = local[at] * back[at] / scale[at, None]
            back[at - 1] = value @ going.T
            pairs += going * (ahead[at - 1].T @ value)
        belief = ahead * back
        belief /= belief.sum(1, keepdims=True)
        gradient = np.concatenate([((seen_weights - belief.T @ every) / total).ravel(), ((seen_moves - pairs) / total).ravel()])
        gradient -= decay * flat
        speed = 0.9 * speed + 0.1 * gradient
        size = 0.999 * size + 0.001 * gradient**2
        flat = flat + rate * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.999**step)) + 1e-8)
        weights, moves = flat[: weights.size].reshape(weights.shape), flat[weights.size :].reshape(2, 2)
    return weights, moves


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = 3000,
    sample_lines: int = 200_000,
    share: float = KEEP_SHARE,
) -> Field:
    """A field from at most ``sample_docs`` labelled rows (a hash of the id chooses them) and
    ``sample_lines`` of their lines; label 1 is good. This is the only bounded sample of the operator.
    Of a document with more lines than a fiftieth of ``sample_lines`` a run of so many, which a hash of the
    id chooses, takes part. Documents come in hash order, and one that does not fit is skipped.
    Null labels, ids or texts take no part; without labelled rows every line is content."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample_docs)
    )

    longest = max(1, sample_lines // 50)

    def reading(batches):
        for batch in batches:
            rows = []
            for text, place in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = line_features((text or "").encode().split(b"\n"))[0]
                start = place % max(1, len(own) - longest + 1)
                rows.append(own[start : start + longest].astype(np.float32).tobytes())
            yield pa.record_batch([batch.column(3), batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["place", "id", "label", "rows"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The chosen ids are at most sample_docs rows, and of the rows of one id one text is taken.
    labelled = own.where("text is not null").join(F.broadcast(chosen), "id")
    found = labelled.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "label", F.xxhash64("id").alias("place"))
    schema = f"place long, id {own.schema['id'].dataType.simpleString()}, label int, rows binary"
    sample, used = [], 0
    for _, _, label, raw in sorted(found.mapInArrow(reading, schema).collect()):
        rows = np.frombuffer(raw, np.float32).reshape(-1, len(FEATURES)).astype(float)
        if used + len(rows) > sample_lines:
            continue
        used += len(rows)
        sample.append((rows, CONTENT if label == 1 else BOILERPLATE))
    return Field(*fit(sample), share)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    if size < 2_000_000:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")
VERDICTS = "{kind}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"


def verdicts(texts: list[str | None], field: Field) -> dict[str, list]:
    """MEASURES, base_failed and kept of each text."""
    rows, features, sizes = [], [], []
    for text in texts:
        raw = (text or "").encode()
        words = raw.split()
        lines = raw.split(b"\n")
        spoken = [x for x in lines if x.strip()]
        chars = len(text or "") - sum(raw.count(c) for c in b"\x20\x09\x0a\x0b\x0c\x0d")
        symbols = sum(raw.count(c) for c in SYMBOLS)
        rows.append([len(words), chars, symbols, len(spoken) - len(set(spoken)), repeated_words(words)])
        x, n = line_features(lines)
        features.append(x)
        sizes.append(n)
    failed, kept = [], []
    for row, labels, n in zip(rows, field.decode(features), sizes, strict=True):
        row.append(int(n[labels == CONTENT].sum()))
        failed.append(row[0] < LEAST_WORDS or 100 * row[4] > REPEAT_PERCENT * row[0])
        kept.append(not failed[-1] and row[5] >= field.share * row[0])
    return {name: [r[k] for r in rows] for k, name in enumerate(MEASURES)} | {"base_failed": failed, "kept": kept}


#: Rows that are decoded together.
TOGETHER = 2000


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measures, ``base_failed`` and ``kept`` for each row.

    A null or empty text has no words and fails; null ids and repeated rows are kept as rows; other
    columns are ignored; an empty table gives an empty one. Ties between labellings go to content.
    """

    def judging(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                found = verdicts(part.column(1).to_pylist(), field)
                columns = [pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in found.items()]
                yield pa.record_batch([part.column(0), *columns], ["id", *found])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {own.schema['id'].dataType.simpleString()}, "
    return own.mapInArrow(judging, VERDICTS.format(kind=kind)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns, of any name, in one pass."""

    def keeping(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                kept = pa.array(verdicts(part.column(1).to_pylist(), field)["kept"], pa.bool_())
                yield part.select([0]).filter(kept)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    nested = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    return nested.mapInArrow(keeping, nested.select("row").schema).select("row.*")
