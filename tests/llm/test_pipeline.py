"""The pipeline's stages on the smallest tables, each against a plain version of what it decides."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from check_oracles import compare, open_tables
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from daymart.llm import line_crf, queries
from daymart.session import stage
from tests.conftest import SMALL
from tests.llm.test_near_texts import plain_kept


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SMALL)))
    return out


def test_columns_stay(steps):
    for after in steps[1:-1]:
        assert after.columns == steps[0].columns and after.dtypes == steps[0].dtypes


def test_quality(spark, steps):
    field = line_crf.train(steps[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = steps[0].collect()
    kept = line_crf.verdicts([r.text for r in rows], field)["kept"]
    assert sorted(r for r, k in zip(rows, kept) if k) == sorted(steps[1].collect())
    assert 0 < steps[1].count() < len(rows)


def test_lines(steps):
    seen, want = [], {}
    for r in sorted(steps[1].collect()):
        lines = []
        for line in r.text.split("\n"):
            words = frozenset(line.encode().split())
            if words:
                if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                    seen.append(words)
                    continue
                seen.append(words)
            lines.append(line)
        text = "\n".join(lines)
        if text.encode().split():
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in steps[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_copies_and_mix(steps):
    before, after = steps[2].collect(), steps[3].collect()
    assert sorted(after) == sorted(before[k] for k in plain_kept([(r.doc_id, r.text) for r in before]))
    mixed = steps[4].collect()
    assert set(mixed) <= set(after) and max(mixed.count(r) for r in set(mixed)) <= 3


def test_encoding(steps, spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def digests(r):
        ids = tok.encode(r.text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        return r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()

    want = sorted(map(digests, steps[4].collect()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps[5].collect()) == want
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()) == want


def test_near_copies_of_the_whole_table(spark, steps):
    """On the documents themselves, where copies and near copies have not been thinned by other stages."""
    rows = steps[0].collect()
    want = [rows[k].doc_id for k in plain_kept([(r.doc_id, r.text) for r in rows])]
    got = corpus_pipeline.near_copies(spark, steps[0], SMALL)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and len(want) < len(rows)


NAMES = ["row", "key", "id", "node", "marks", "mix_size", "mix_copies", "simhash_print", "line_dedup_gone", "a.b", "place", "size", "col"]


def test_stages_take_nulls_repeats_and_any_names(spark, steps):
    """Null ids, texts and sources, empty and very long texts, repeated rows, names that the operators use themselves."""
    some = steps[0].limit(60).collect()
    long = "\n".join(f"line {k} of a very long text with its number {k * 7919}" for k in range(20_000))
    rows = [tuple(r) for r in some] + [tuple(some[3])] * 3
    columns = steps[0].columns
    for i, values in enumerate(({"text": None}, {"text": ""}, {"doc_id": None}, {"source": None}, {"text": long}, dict.fromkeys(columns), dict.fromkeys(columns))):
        rows.append(tuple({**some[i].asDict(), **values}[c] for c in columns))
    docs = spark.createDataFrame(rows, steps[0].schema).withColumns({f"`{n}`" if "." in n else n: F.lit(k) for k, n in enumerate(NAMES)})
    docs = docs.toDF(*columns, *NAMES)
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, SMALL)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        found = after.collect()
        whole = {tuple(r) for r in docs.collect()}
        if name != "line dedup":
            assert {tuple(r) for r in found} <= whole
        assert 0 < len(found) <= 3 * len(rows)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert encoded.count() == len(rows)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SMALL).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = open_tables(SMALL)
    assert compare(name, spark, con, SMALL) == ""
