"""The registered queries on the smallest tables, against SQL or plain Python, and the pipeline stage by stage."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline
from tests.compare import compare, duck
from unitloom.llm import decontaminate, minhash, packing, secret_scan
from unitloom.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    _, n, verdict = compare(spark, duck(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert n > 0 and verdict == "ok", verdict


@pytest.mark.parametrize("name, table", [("op2_secret_scan", "documents"), ("op4_wrapper_induction", "pages"), ("op9_link_graph", "pages"), ("op10_toxicity", "documents")])
def test_one_row_per_input_row(spark, name, table):
    assert QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_articles_hold_all_their_words(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in QUERIES["op4_wrapper_induction"](spark, SF_DIR).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        expected = re.sub(r"<[^>]*>", " ", article)
        import html

        assert r["text"].split() == html.unescape(expected).split()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        kept.append(docs.collect())
        assert number == 4 or docs.columns == columns
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op10_toxicity"](spark, SF_DIR).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept[0]} == set(source) - toxic

    words = sorted((r["doc_id"], minhash.word_codes(r["text"])) for r in kept[0])
    parent = {i: i for i, _ in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(words):
        for j, b in words[k + 1 :]:
            longest = max(len(a), len(b))
            if longest and min(len(a), len(b)) >= 0.8 * longest and minhash.edit_distance(a, b, int(0.2 * longest)) is not None:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {r["doc_id"] for r in kept[1]} == {find(i) for i, _ in words}

    word_list = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = word_list(r["text"])
        windows |= {tuple(w[i : i + decontaminate.WINDOW]) for i in range(max(len(w) - decontaminate.WINDOW + 1, 1))} if w else set()
    short = {len(w) for w in windows}
    clean = set()
    for r in kept[1]:
        w = word_list(r["text"])
        if not any(tuple(w[i : i + n]) in windows for n in short for i in range(len(w) - n + 1)):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in kept[2]} == clean

    assert {r["doc_id"] for r in kept[3]} == clean
    for r in kept[3]:
        assert not secret_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    by_sequence = {}
    for r in kept[4]:
        by_sequence.setdefault(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in kept[4]} == clean and max(by_sequence.values()) <= packing.CAPACITY
    assert len(by_sequence) <= -(-sum(by_sequence.values()) // packing.CAPACITY) + 1
