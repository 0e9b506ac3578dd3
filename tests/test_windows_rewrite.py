from __future__ import annotations

from pyspark.sql import functions as F

from unitloom.functions import boundary_weight
from unitloom.operators import rewrite, windows as win
from unitloom.sources import unit_store


def test_doc_flags_and_store(spark, tmp_path):
    docs = [["one"], ["two ", "three ", "four ", "five"], ["six ", "seven"], ["eight ", "nine ", "ten"]]
    rows = [("s", d, i, u, len(u), i == 0) for d, us in enumerate(docs) for i, u in enumerate(us)]
    units = spark.createDataFrame(rows, "shard string, doc_id bigint, pos bigint, unit string, n_bytes bigint, doc_start boolean")
    unit_store.write_units(units, str(tmp_path / "u"))
    back = unit_store.read_units(spark, str(tmp_path / "u"))
    flags = [r.doc_start for r in back.orderBy("doc_id", "pos").collect()]
    assert flags == [i == 0 for us in docs for i in range(len(us))]
    meta = unit_store.shard_meta(back).first()
    assert (meta.n_units, meta.n_docs, meta.n_bytes) == (sum(map(len, docs)), len(docs), sum(len(u) for us in docs for u in us))


def test_store_refuses_long_units(spark, tmp_path):
    units = spark.createDataFrame([("s", 1, 0, "x" * 40, 40, True)], "shard string, doc_id bigint, pos bigint, unit string, n_bytes bigint, doc_start boolean")
    try:
        unit_store.write_units(units, str(tmp_path / "bad"))
    except Exception as e:
        assert "unit length out of range" in str(e)
    else:
        raise AssertionError("a 40-byte unit was stored")


def test_missing_shards_fail(spark, tmp_path):
    units = spark.createDataFrame([("s", 1, 0, "x", 1, True)], "shard string, doc_id bigint, pos bigint, unit string, n_bytes bigint, doc_start boolean")
    unit_store.write_units(units, str(tmp_path / "u"))
    try:
        unit_store.read_units(spark, str(tmp_path / "u"), only=["other"])
    except FileNotFoundError:
        return
    raise AssertionError("an empty selection was accepted")


def test_segment_lengths(spark):
    lengths = [[1, 4, 2], [7], [5, 1, 1]]
    # The second window goes on with a document that began before it.
    flags = [[i == 0 and (w, k) != (1, 0) for k, n in enumerate(ns) for i in range(n)] for w, ns in enumerate(lengths)]
    df = spark.createDataFrame([(w, i, bool(f)) for w, fs in enumerate(flags) for i, f in enumerate(fs)], "window_id bigint, idx bigint, doc_start boolean")
    segments = win.doc_segments(df)
    got: dict[int, list[int]] = {}
    for r in segments.orderBy("window_id", "first_idx").collect():
        got.setdefault(r.window_id, []).append(r.length)
    assert list(got.values()) == lengths
    allowed = {r.window_id: r.allowed for r in win.attention_pairs(segments).collect()}
    assert allowed == {w: sum(n * (n + 1) // 2 for n in ns) for w, ns in enumerate(lengths)}
    weights = [r.w for r in df.filter("window_id = 0").orderBy("idx").select(boundary_weight().alias("w")).collect()]
    assert weights == [0.0 if f else 1.0 for f in flags[0]]


def test_mapping_keeps_first_flag(spark):
    units = spark.createDataFrame(
        [("s", 1, 0, "keep ", 5, True), ("s", 1, 1, "unhappy ", 8, False), ("s", 2, 0, "outrun", 6, True), ("s", 2, 1, "now", 3, False)],
        "shard string, doc_id bigint, pos bigint, unit string, n_bytes bigint, doc_start boolean",
    )
    mapping = spark.createDataFrame([("unhappy ", ["un", "happy "]), ("outrun", ["out", "run"])], "unit string, pieces array<string>")
    for limit in (100, 0):  # broadcast and shuffled form
        out = rewrite.renumber(rewrite.apply_mapping(units, mapping, max_rows=limit)).orderBy("doc_id", "pos").collect()
        assert [(r.doc_id, r.pos, r.unit) for r in out] == [(1, 0, "keep "), (1, 1, "un"), (1, 2, "happy "), (2, 0, "out"), (2, 1, "run"), (2, 2, "now")]
        assert [r.doc_start for r in out] == [True, False, False, True, False, False]


def test_fit_windows(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "units array<string>")
    assert rewrite.fit_windows(df, 3).first().units == ["a", "b", "c"]
    assert rewrite.fit_windows(df, 8).first().units == ["a", "b", "c", "d"]


def test_cascade_conserves(spark):
    # One rare unit that is made of frequent ones, which begin and end it.
    words = {"rain ": 12, "coat ": 7, "under": 5, "cover": 9, "s ": 30, "7": 4, "undercoverraincoats ": 1}
    freq = spark.createDataFrame(list(words.items()), "unit string, cnt bigint")
    scorer = rewrite.bigram_scorer(freq, 2)
    mapping, floor = rewrite.resplit_cascade(scorer(freq), freq.filter("cnt >= 4").select("unit"), scorer, 5.0, 3, 32)
    got = {r.unit: list(r.pieces) for r in mapping.collect()}
    assert "undercoverraincoats " in got
    for unit, pieces in got.items():
        assert "".join(pieces) == unit
        assert all(p in words or len(p.encode()) <= 3 for p in pieces)
    assert got["undercoverraincoats "][:2] == ["under", "cover"] and got["undercoverraincoats "][-1] == "s "
    stats = rewrite.verify_stats(freq, mapping, floor, 5.0).first()
    assert stats.n_in == sum(words.values()) and stats.n_out >= stats.n_in


def test_pandas_scorer_hook(spark):
    def fn(batches):
        for pdf in batches:
            yield pdf.assign(ok=pdf["unit"].str.len() < 3, entropy=0.1)

    out = rewrite.pandas_scorer(fn)(spark.createDataFrame([("ab",), ("abc",)], "unit string"))
    assert {r.unit: r.ok for r in out.collect()} == {"ab": True, "abc": False}


def test_vocabulary_pieces_greedy(spark):
    units = spark.createDataFrame([("abcdxyz",), ("zzz",), ("éab",), ("qqqqqéqqq",)], "unit string")
    vocab = spark.createDataFrame([("ab",), ("abc",), ("dx",), ("d",)], "unit string")
    for limit in (100, 0):  # set in every task, and joined
        got = {r.unit: list(r.pieces) for r in rewrite.vocabulary_pieces(units, vocab, 4, limit).collect()}
        assert got == {"abcdxyz": ["abc", "dx", "yz"], "zzz": ["zzz"], "éab": ["é", "ab"], "qqqqqéqqq": ["qqqq", "qéq", "qq"]}


def test_typos(spark):
    words = ["weathervane", "was", "lighthouse", "ab", "x", "four", "Zürich", "日本語です", "12345"] + [f"word{i}abc" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "unit string")
    out = {r.unit: r.typo for r in rewrite.typo_variants(df, seed=1).collect()}
    assert "ab" not in out and "x" not in out
    assert len(out) > 290
    for unit, typo in out.items():
        assert typo != unit and 0 < len(typo.encode()) <= 32
        if len(unit.encode()) <= 4:
            assert len(typo) == len(unit)
    shapes = {len(t) - len(u) for u, t in out.items()}
    assert {-1, 0, 1} <= shapes
    case = {r.unit: r.typo for r in rewrite.forced_typos(df, "case", 1).collect()}
    assert all(t.lower() == u.lower() and t != u for u, t in case.items())
    trans = {r.unit: r.typo for r in rewrite.forced_typos(df, "trans", 1).collect()}
    assert all(sorted(t) == sorted(u) and t != u for u, t in trans.items())
    assert rewrite.forced_typos(df.filter("unit = 'four'"), "del", 1).count() == 0


def test_typo_probability(spark):
    df = spark.createDataFrame([("ab",), ("the",), ("common",), ("rareword",)], "unit string")
    top = spark.createDataFrame([("common",)], "unit string")
    got = {r.unit: round(r.p, 9) for r in rewrite.typo_probability(df, top, 0.4, 0.25).collect()}
    assert got == {"ab": 0.0, "the": 0.2, "common": 0.1, "rareword": 0.4}


def test_rotation_covers_all_shards(spark):
    shards = spark.createDataFrame([(f"s{i}",) for i in range(5)], "shard string")
    plan = win.rotation_plan(shards, resident=2, every=3, steps=15, seed=1).collect()
    assert {r.shard for r in plan} == {f"s{i}" for i in range(5)}
    blocks: dict[int, list] = {}
    for r in sorted(plan, key=lambda r: (r.block, r.slot)):
        blocks.setdefault(r.block, []).append(r.shard)
    assert all(len(set(b)) == 2 for b in blocks.values())
    assert all(blocks[b][1] == blocks[b + 1][0] for b in range(len(blocks) - 1))
    again = win.rotation_plan(shards, resident=2, every=3, steps=15, seed=1).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))
    assert win.rotation_plan(shards, 2, 3, 15, 2).orderBy("block", "slot").collect() is not None


def test_windows_with_hot_shard(sliced):
    docs = sliced.createDataFrame(
        [("hot" if i % 3 else f"s{i % 5}", i, "w " * (i % 23 + 1)) for i in range(200)], "shard string, doc_id bigint, text string"
    )
    size = 16
    got = win.make_windows(win.sequence_units(docs, size), size).collect()
    expect, number = [], 0
    by: dict[str, list] = {}
    for s, d, t in docs.orderBy("shard", "doc_id").collect():
        by.setdefault(s, []).extend((d, p) for p in range(len(t) // 2))
    for s in sorted(by):
        for i in range(len(by[s]) // size * size):
            expect.append((number + i // size, i % size, s, *by[s][i]))
        number += len(by[s]) // size
    assert sorted((r.window_id, r.idx, r.shard, r.doc_id, r.pos) for r in got) == expect


def test_rolling_blocks_score_every_unit_once_behind_its_context(spark):
    for size in (4, 5, 1):
        rows = [("s", d, p, f"{d}.{p}") for d, n in enumerate((1, 4, 5, 13)) for p in range(n)]
        units = spark.createDataFrame(rows, "shard string, doc_id bigint, pos bigint, unit string")
        blocks = win.rolling_eval_blocks(units, size).orderBy("doc_id", "block").collect()
        for doc in range(4):
            mine = [u for _, d, _, u in rows if d == doc]
            own = [b for b in blocks if b.doc_id == doc]
            assert [u for b in own for u in b.scored] == mine
            done = 0
            for b in own:
                assert len(b.context) + len(b.scored) <= size
                assert b.context == (mine[done - size // 2 : done] if done and size > 1 else [])
                done += len(b.scored)
    assert win.rolling_eval_blocks(units.limit(0), 4).count() == 0


def test_merge_pass_is_the_fold_and_copies_no_list(spark):
    import random

    draw = random.Random(3)
    shapes = [[], ["a"], ["é" * 6, "b"]] + [["x" * draw.randint(1, 12) for _ in range(draw.randint(2, 60))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(shapes)), "window_id bigint, units array<string>")
    coins = df.select("window_id", F.transform("units", lambda u, i: win.coin(0.6, 5, F.col("window_id"), i)).alias("c"))
    coins = {r.window_id: r.c for r in coins.collect()}
    merged = win.merge_pass(df, 0.6, 16, 5)
    for r in merged.collect():
        want, i, units = [], 0, shapes[r.window_id]
        while i < len(units):
            two = i + 1 < len(units) and coins[r.window_id][i] and len((units[i] + units[i + 1]).encode()) <= 16
            want.append(units[i] + units[i + 1] if two else units[i])
            i += 2 if two else 1
        assert r.units == want
    assert "aggregate(" not in merged._jdf.queryExecution().optimizedPlan().toString()
