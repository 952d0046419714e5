"""The pipeline's stages in turn, each on what its predecessor kept, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestar.llm import language_id, packing

from .test_ngram_join import brute
from .test_operators import filled, library


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = {"en": ["the", "and", "house", "water", "with", "river"], "de": ["der", "und", "haus", "wasser", "mit", "fluss"]}
    rows = []
    for i in range(90):
        k = "en" if i % 2 else "de"
        t = " ".join(rng.choice(words[k]) + str(rng.randrange(50)) + "x" for _ in range(rng.choice([20, 60, 300])))
        rows.append((i, t, k, f"s{i % 3}", len(t)))
        if i % 9 == 0:
            rows.append((1000 + i, t + " tail", k, "s1", len(t) + 5))
    rows += [(2000, None, None, None, None), (2001, "12 34 ...", "en", "s0", 9), (2002, "write to a.b@mail.org or +1 (234) 567-8901 the house and water", "en", "s0", 60), (3, rows[3][1], "de", "s0", 1)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        out[name] = (before, docs.collect())

    before, after = out["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {2000, 2001}
    before, after = out["near_duplicates"]
    comp = {d: c for d, _, c in brute([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)}
    assert sorted(r["doc_id"] for r in after) == sorted(set(comp.values()))
    before, after = out["personal_data"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert text[2002] == "write to [EMAIL] or [PHONE] the house and water" and len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = out["source_mix"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += size(r["text"])
    taken = Counter()
    for r in after:
        taken[r["source"]] += size(r["text"])
    most = max(size(r["text"]) for r in before)
    assert all(abs(taken[s] - t) <= 2 * most for s, t in filled(dict(sizes)).items())
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    before, after = out["packing"]
    tokens = Counter()
    for r in before:
        tokens[r["doc_id"]] += len(library(packing.TOKENIZER, r["text"])) + 1
    got = Counter()
    for r in after:
        got[r["doc_id"]] += r["length"]
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert got == tokens


def test_language_stage_without_labels(spark):
    """Nothing to learn: texts with a letter stay. Something to learn: a null lang is filled, a given one stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stage = lambda rows: {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), "").collect()}
    rows = [(1, "the house", None, "s", 9), (2, "вода", None, "s", 4), (3, "12 34", None, "s", 5), (4, None, None, "s", None)]
    assert stage(rows) == {1: None, 2: None}
    known = [(i, "the house and the water" if i % 2 else "der fluss und das haus", "en" if i % 2 else "de", "s", 23) for i in range(100, 140)]
    assert stage([*rows, (5, "der fluss", "en", "s", 9), (6, "und das haus", None, "s", 12), *known]) == {1: "en", 2: stage([*rows, *known])[2], 5: "en", 6: "de"} | {r[0]: r[2] for r in known}


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert language_id.VOCABULARY
