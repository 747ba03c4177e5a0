"""Secrets in texts: fixed patterns, and random strings told from identifiers by character Markov models.

Two first-order models over the same characters are compared: one of random strings, trained on the
values that the patterns find (the labelled secrets of the corpus), one of ordinary identifiers, trained
on all other text. A run of token characters whose log-likelihood ratio exceeds the prior odds against
a secret is reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns; the least length is that of the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Characters of the models; every other character is one and the same border.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1
CODE = np.zeros(256, np.intp)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, STATES)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: One run of token characters in a million is taken for a secret beforehand.
PRIOR_ODDS = 1e-6


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of every pattern, in code points, by start and kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(raw: bytes) -> np.ndarray:
    """How often each character follows each, borders included, as one row of STATES * STATES."""
    codes = CODE[np.frombuffer(b"\n" + raw + b"\n", np.uint8)]
    return np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES)


@dataclass(frozen=True)
class Model:
    """ratio: log-likelihood ratio of each pair of characters; threshold: least sum that is reported."""

    ratio: np.ndarray
    threshold: float

    def score(self, run: str) -> float:
        codes = CODE[np.frombuffer(b"\n" + run.encode("ascii") + b"\n", np.uint8)]
        return float(self.ratio[codes[:-1] * STATES + codes[1:]].sum())


def fitted(random: np.ndarray, ordinary: np.ndarray, prior_odds: float = PRIOR_ODDS) -> Model:
    """Models from counts of character pairs, with one added to each count."""
    logs = []
    for counts in (random, ordinary):
        table = counts.reshape(STATES, STATES).astype(float)
        table[0, 0] = 0  # between two borders there is no run
        table += 1
        logs.append(np.log(table / table.sum(1, keepdims=True)).ravel())
    return Model(logs[0] - logs[1], -float(np.log(prior_odds)))


def train(docs: DataFrame, text_col: str = "text", prior_odds: float = PRIOR_ODDS) -> Model:
    """Models from all texts. Each task sums its counts; the driver gets one row for each pair of
    characters (STATES squared at most). Without any text both models are even and nothing is reported."""

    def counting(batches):
        random, every = np.zeros(STATES * STATES, np.int64), np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    every += transitions(text.encode())
                    values = "\n".join(text[a:b] for *_, a, b in base_spans(text))
                    if values:
                        random += transitions(values.encode())
        cells = np.nonzero(every | random)[0]
        yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(random[cells]), pa.array(every[cells])], ["cell", "random", "every"])

    own = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = own.mapInArrow(counting, "cell long, random long, every long").groupBy("cell").agg(F.sum("random"), F.sum("every"))
    random, every = np.zeros(STATES * STATES), np.zeros(STATES * STATES)
    for cell, a, b in counts.collect():
        random[cell], every[cell] = a, b
    return fitted(random, np.maximum(every - random, 0), prior_odds)


def spans_of(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) of pattern matches and of random strings that no pattern match touches."""
    base = base_spans(text)
    out, k = [x[:3] for x in base], 0
    reach = 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and model.score(m[0]) > model.threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<kind,start,end>>`` for each row, by start, then kind as listed in KINDS.

    Offsets are code points, the end is exclusive, a span of kind assign covers name and value. A null
    or empty text has an empty list; null ids and repeated rows are kept; other columns are ignored; an
    empty table gives an empty one; the whole text is read whatever its length.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scanning(batches):
        for batch in batches:
            found = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, model)] if t else []
                for t in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(span))], ["id", "spans"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return own.mapInArrow(scanning, schema).withColumnRenamed("id", id_col)
