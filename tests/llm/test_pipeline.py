"""The pipeline and the registered queries of the corpus operators."""

import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genoflux.llm import language_id, queries, secret_scan
from genoflux.llm.tokens import encoder

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_components, brute_readings, brute_secrets, jaccard  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        at[name] = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert at["near-dedup"] <= at["language"] and at["decontamination"] <= at["near-dedup"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for _, t in at["decontamination"] for i in items)
    assert {d for d, _ in at["secrets"]} == {d for d, _ in at["decontamination"]}
    e, want = encoder("word_bpe_49k.json"), set()
    for d, t in at["secrets"]:
        ids = np.frombuffer((e.plain(t) if t else b"") + np.uint32(0).tobytes(), "<u4")
        want |= {(d, k, zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def holds_item(text, items):
    """Whether a text has consistent windows of an item on a diagonal; items are of 13 words or more."""
    read = brute_readings(text)[:2]
    windows = defaultdict(list)
    for row in read:
        for lo in range(len(row) - 12):
            windows[tuple(c for c, _, _ in row[lo : lo + 13])].append((lo, row[lo : lo + 13]))
    for item in items:
        for row in brute_readings(item)[:2]:
            value, clash = defaultdict(dict), defaultdict(bool)
            for at in range(len(row) - 12):
                x = row[at : at + 13]
                if sum(not s for _, _, s in x) >= 5:
                    for lo, y in windows.get(tuple(c for c, _, _ in x), ()):
                        clash[lo - at] |= any(value[lo - at].setdefault(a, b) != b for (_, a, s), (_, b, _) in zip(x, y) if s)
            if not all(clash.values()):
                return True
    return False


def test_run_against_brute_force(spark):
    """Every stage's decisions, document by document and pair by pair."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.Classifier(language_id.learn(docs.where(~language_id.held_out(docs["doc_id"]))))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if not model.classify(t)[2]]
    group = brute_components([t for _, t in rows], lambda a, b: 0.5 < len(a) / max(1, len(b)) < 2 and jaccard(a, b) >= 0.8)
    first = {g: min(d for (d, _), h in zip(rows, group) if h == g) for g in set(group)}
    rows = [(d, t) for (d, t), g in zip(rows, group) if d == first[g]]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [x for x in items if len(x.split()) >= 13]
    rows = [(d, t) for d, t in rows if not holds_item(t, items)]
    got = spark.createDataFrame(corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, SF), SF), SF).collect(), docs.schema)
    assert {r["doc_id"] for r in got.collect()} == {d for d, _ in rows}
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.STAGES[3][1](spark, got, SF).collect()}
    novel = secret_scan.Scanner(secret_scan.learn(got))
    for d, t in rows:
        assert not any(t[a:z] in masked[d] for _, a, z in brute_secrets(t))
        assert (masked[d] == t) == (not novel.scan(t))
        assert re.sub(r"\[SECRET\]", "", masked[d]) in t or "[SECRET]" in masked[d]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(masked)
    at = defaultdict(list)
    for r in pieces:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in at.values():
        assert sum(n for _, n in x) <= 2048 and all(a == sum(n for b, n in x if b < a) for a, _ in x)


def test_stages_take_nulls_repeats_and_any_columns(spark):
    text = "this is an ordinary text about a river and the people who live at it, with a secret = abcdefghijkl0 in its line " * 3
    names = ["score", "lang_pred", "rejected", "lang_score", "doc", "hash", "stays", "hit_id", "hit_hash", "text_hash", "spans", "component"]
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " more", None), (None, text + " other", "en"), (3, None, None), (4, "", "en"), (5, " \n ", None), (6, "word " * 40_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({x: F.lit("own") for x in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert out.columns == docs.columns
        assert all(r[x] == "own" for r in out.collect() for x in names)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows)
    once = corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()
    # texts without a word are alike; null ids come first
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in once) == [(False, 0), (True, 3), (True, 6)]
    assert corpus_pipeline.STAGES[2][1](spark, docs, SF).count() == len(rows)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
