from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from unitloom.functions import CORE, RUNS, WORD_NEXT, WORD_PREV, chunk_chars
from unitloom.operators import segment as seg

TEXTS = [
    "Hello, world! This is a test.",
    "don't stop; we're here, it's John's.",
    "你好,世界 mixed 中文 text",
    "emoji 🙂🙂 here ½ ² x",
    "def f(x):\n    return x**2  # code",
    "...leading and trailing...",
    "a",
    "!!!",
    "pneumonoultramicroscopicsilicovolcanoconiosis",
    "Ünïcödé Ελληνικά слово é",
    " lead  double   triple 1 2 a 3b ",
    "tab\tand\r\nnewline",
]


def spec_word(text: str, merge: str) -> list[str]:
    """Independent statement of the word rule, character by character."""
    kind = lambda ch: {"N": "D", "L": "W"}.get(unicodedata.category(ch)[0], "S")
    runs: list[str] = []
    for ch in text:
        if runs and kind(ch) != "D" and kind(runs[-1][-1]) == kind(ch):
            runs[-1] += ch
        else:
            runs.append(ch)
    out: list[str] = []
    carry = ""
    for i, run in enumerate(runs):
        digit_before = bool(out) and kind(out[-1][0]) == "D"
        digit_after = i + 1 < len(runs) and kind(runs[i + 1][0]) == "D"
        if run == " " and merge == "prev" and out and not digit_before:
            out[-1] += run
        elif run == " " and merge == "next" and i + 1 < len(runs) and not digit_after:
            carry = run
        else:
            out.append(carry + run)
            carry = ""
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def arrays(docs, pattern, l_max=None):
    return {r.id: list(r.u) for r in docs.select("id", seg.unit_array("text", pattern, l_max).alias("u")).collect()}


@pytest.mark.parametrize("merge,pattern", [("prev", WORD_PREV), ("next", WORD_NEXT)])
def test_word_rule(docs, merge, pattern):
    for i, units in arrays(docs, pattern).items():
        assert units == spec_word(TEXTS[i], merge)


@pytest.mark.parametrize("pattern", [WORD_PREV, WORD_NEXT, RUNS, CORE])
def test_roundtrip_and_bound(docs, pattern):
    for l_max in (None, 16, 4):
        for i, units in arrays(docs, pattern, l_max).items():
            assert "".join(units) == TEXTS[i]
            if l_max:
                assert all(1 <= len(u.encode()) <= l_max for u in units)


def test_core_spot_values(spark):
    cases = {"Hello, world!": ["Hello, ", "world!"], "你好,世界": ["你", "好,", "世", "界"], "don't stop": ["don't ", "stop"], "": []}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: list(r.u) for r in df.select("text", seg.unit_array("text", CORE).alias("u")).collect()}
    assert got == cases


def test_core_survives_long_delimiter_runs(spark):
    df = spark.createDataFrame([("x" + "- " * 50000,)], "text string")
    assert df.select(F.size(seg.unit_array("text", CORE)).alias("n")).first().n == 1


def test_chunk_chars(spark):
    # Greedy by whole characters: a character goes to a new piece when the old one would pass the cap.
    def greedy(text, cap):
        out = [""]
        for c in text:
            if out[-1] and len((out[-1] + c).encode()) > cap:
                out.append("")
            out[-1] += c
        return out

    texts = ["übergrößer", "x→y⇒z", "ok", "тест 123", "𝔘𝔫𝔦 code"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for cap in (3, 5):
        got = [list(r.u) for r in df.select(chunk_chars("t", cap).alias("u")).collect()]
        assert got == [greedy(t, cap) for t in texts]


def test_combined_boundaries_conserve_bytes(spark):
    docs = spark.createDataFrame([("s", i, t) for i, t in enumerate(TEXTS)] + [("s", 99, "")], "shard string, doc_id bigint, text string")
    for p, pure in ((0.0, False), (0.5, False), (1.0, False), (0.5, True)):
        rows = seg.combine_boundaries(docs, p=p, seed=3, l_max=5, pure=pure).orderBy("doc_id", "pos").collect()
        got: dict[int, bytes] = {}
        for r in rows:
            assert 1 <= len(r.unit) <= 5 and r.n_bytes == len(r.unit)
            assert r.doc_start == (r.pos == 0)
            got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.unit)
        assert got == {i: t.encode() for i, t in enumerate(TEXTS)}


def test_combined_boundaries_are_baked(spark):
    docs = spark.createDataFrame([("s", i, t * 5) for i, t in enumerate(TEXTS)], "shard string, doc_id bigint, text string")
    built = lambda d: sorted((r.doc_id, r.pos, bytes(r.unit)) for r in seg.combine_boundaries(d, seed=1).collect())
    assert built(docs) == built(docs.repartition(3))


def test_byte_offsets(spark):
    docs = spark.createDataFrame([("s", 1, "aé 中x 🙂!"), ("s", 2, "b")], "shard string, doc_id bigint, text string")
    for r in seg.byte_offsets(docs).collect():
        text = {1: "aé 中x 🙂!", 2: "b"}[r.doc_id].encode()
        assert text[r.byte_off : r.byte_off + len(r.unit.encode())].decode() == r.unit


def test_cutting_a_batch_takes_memory_for_some_rows_only():
    import tracemalloc

    import pyarrow as pa

    from unitloom.functions import arrays

    text = b"ab " * 200
    cuts = list(range(1, len(text)))
    peaks = []
    for rows in (500, 4000):
        data, at = pa.array([text] * rows, pa.binary()), pa.array([cuts] * rows, pa.list_(pa.int64()))
        work = lambda some, places: arrays._slice_rows(some, places, 32)
        tracemalloc.start()
        got = arrays._in_slices(work, data, at)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(got) == rows and got[rows - 1].as_py() == [bytes([b]) for b in text]
    assert peaks[1] < 1.5 * peaks[0]
    odd = pa.array([b"abc", None, b"", b"defg"] * 200, pa.binary()), pa.array([[1], None, [], [2]] * 200, pa.list_(pa.int64()))
    assert arrays._in_slices(work, *odd).to_pylist() == arrays._slice_rows(*odd, 32).to_pylist()
    assert arrays._in_slices(work, odd[0][:0], odd[1][:0]).to_pylist() == []
