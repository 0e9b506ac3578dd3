"""What a Python worker holds: the tables of one operator, and a batch's texts a few at a time; what rounds leave in the driver."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from unitloom.llm import components, minhash, packing, secret_scan, toxicity


def fill():
    packing.token_bytes(["one two"], packing.vocabulary_path())
    secret_scan.encoder(secret_scan.vocabulary_path())
    minhash.word_codes("one two")


def held():
    kept = {"packing": packing._tokenizer.cache_info().currsize, "secret_scan": secret_scan.encoder.cache_info().currsize, "minhash": len(minhash._known)}
    return {name for name, n in kept.items() if n}


def few_labels(spark):
    docs = spark.createDataFrame([(i, f"dimwit a{i} {i}" if i % 2 else f"river b{i} {i}") for i in range(40)], "doc_id long, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")


def test_a_stage_drops_what_the_stages_before_it_kept(spark):
    docs, labels = few_labels(spark)
    score = toxicity.scorer(docs, labels).func
    fill()
    assert held() == {"packing", "secret_scan", "minhash"}
    got = list(score(iter([pa.array(["you dimwit", "", None]), pa.array([], pa.string())])))
    assert [len(x) for x in got] == [3, 0] and got[0].to_pylist()[1:] == [0.0, 0.0]
    assert held() == set()


def test_tables_stay_between_tasks_of_one_operator():
    for name in ("packing", "secret_scan", "minhash"):
        fill()
        packing.turn_to(name)
        assert held() == {name}


def test_a_batch_is_not_copied_into_python_as_a_whole(spark):
    score = toxicity.scorer(*few_labels(spark)).func
    batch = pa.array(["river stone " * 2_000] * 1_500)
    tracemalloc.start()
    try:
        assert sum(len(x) for x in score(iter([batch]))) == len(batch)
        assert tracemalloc.get_traced_memory()[1] < batch.nbytes / 8
    finally:
        tracemalloc.stop()


def test_operators_on_arrow_batches_keep_nulls_and_order(spark):
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"doc {i} api_key=abcdef{i:04d} " + "word " * (i % 5)) for i in range(1_300)]
    docs = spark.createDataFrame([*rows, (None, "token=abcdefgh")], "doc_id long, text string").repartition(2)
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert clean == {i: t if not t else f"doc {i} [secret] " + "word " * (i % 5) for i, t in rows} | {None: "[secret]"}
    cut = {r["doc_id"]: r["length"] for r in packing.pieces(docs).collect()}
    assert set(cut) == set(clean) and all((cut[i] == 1) == (not t) for i, t in rows)
    assert packing.pieces(docs.limit(0)).count() == 0
    sketched = {(r["node"], r["n_words"], len(r["keys"])) for r in minhash._sketched(docs.selectExpr("cast(doc_id as string) as key", "text")).collect()}
    assert len(sketched) == 1 + 1 + sum(1 for _, t in rows if t)


def test_rounds_of_joins_do_not_square_the_planners_estimate(spark, capsys):
    path = spark.range(200).selectExpr("id as u", "id + 1 as v")
    for _ in range(2):
        found = components.connected(path)
        assert [tuple(r) for r in found.orderBy("node").collect()] == [(i, 0) for i in range(201)]
        found.explain("cost")
        assert "E+" not in capsys.readouterr().out
        path = found.selectExpr("node as u", "node + 1 as v").filter("v < 201")
