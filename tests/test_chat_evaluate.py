from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitloom.functions import gold_index, stderr
from unitloom.operators import chat, evaluate as ev
from tests.test_segment import spec_word

CONVS = {
    1: [("system", "You are helpful."), ("user", "Summarize: the fox "), ("assistant", "A fast fox.\nOk"), ("user", "!?<|x"), ("assistant", "")],
    2: [("user", "What is 2+2?"), ("assistant", "It is 4.")],
    3: [("note", "plain text "), ("user", " lead"), ("note", "glued words"), ("other", " more 12"), ("gpt", "answer "), ("human", "")],
}


def whole(turns, sep, system=True):
    """Rendering and target spans of one conversation, written out step by step."""
    text, spans = "", []
    for role, content in turns:
        kind = {"human": "user", "gpt": "assistant"}.get(role, role)
        if kind in ("user", "assistant") or (kind == "system" and system):
            text += f"<|{kind}|>"
        if kind == "assistant":
            spans.append((len(text.encode()), len((text + content + "<|end|>").encode())))
            content += "<|end|>"
        text += content + sep
    return text, spans


@pytest.mark.parametrize("sep", ["", " ", "\n"])
@pytest.mark.parametrize("system", [True, False])
def test_pieces_equal_whole_conversation(sliced, sep, system):
    rows = [(c, t, r, x) for c, turns in CONVS.items() for t, (r, x) in enumerate(turns)]
    df = sliced.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    rendered = chat.render_turns(df, F.lit(sep), system=system)
    got: dict[int, list] = {}
    for r in chat.chat_units(rendered).orderBy("conv_id", "byte_off").collect():
        got.setdefault(r.conv_id, []).append((r.byte_off, r.unit, r.is_target))
    for c, turns in CONVS.items():
        text, spans = whole(turns, sep, system)
        expect, off = [], 0
        for u in spec_word(text, "prev"):
            expect.append((off, u, any(s <= off < e for s, e in spans)))
            off += len(u.encode())
        assert got[c] == expect


def test_normalize_turns_shapes(spark):
    a = spark.createDataFrame([(1, [{"role": "user", "content": "hi"}])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    b = spark.createDataFrame([(1, [{"from": "human", "value": "hi"}])], "conv_id bigint, conversations array<struct<from:string,value:string>>")
    assert chat.normalize_turns(a).first().text == "hi"
    assert chat.normalize_turns(b).first().role == "human"
    with pytest.raises(ValueError):
        chat.normalize_turns(spark.range(1))


def test_context_candidate_split(spark):
    cases = [
        ("2 + 2 =", " four or so", ["four ", "or ", "so"], False),  # blanks at the border belong to neither side's words
        ("the first\n", "second", ["second"], True),  # the line end moves over and is a unit of its own, one more than the answer alone has
        ("kett", "le!", ["le", "!"], True),  # cut inside a word
        ("no answer", " \t", [], True),  # nothing but blanks
    ]
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _, _) in enumerate(cases)], "i int, ctx string, cont string")
    for r in chat.split_by_byte_boundary(df).orderBy("i").collect():
        _, _, units, fallback = cases[r.i]
        assert list(r.cont_units) == units and r.fallback == fallback


def test_truncate_context(spark):
    df = spark.createDataFrame([(list("abcdef"), list("xy")), (list("abc"), list("uvwxyz"))], "ctx_units array<string>, cont_units array<string>")
    got = [(list(r.ctx_units), list(r.cont_units)) for r in chat.truncate_context(df, 5).collect()]
    assert got == [(["d", "e", "f"], ["x", "y"]), ([], ["u", "v", "w", "x", "y"])]


def choice_rows(seed=0, items=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(items):
        gold = int(rng.integers(-1, 4))
        for c in range(int(rng.integers(2, 5))):
            rows.append((i, c, -float(rng.integers(1, 9)), -float(rng.integers(1, 9)), int(rng.integers(1, 4)), int(rng.integers(1, 9)), gold))
    return rows


def test_accuracy_and_ties(spark):
    rows = choice_rows()
    df = spark.createDataFrame(rows, "item_id bigint, choice_idx bigint, raw double, uncond double, n_units bigint, n_chars bigint, gold bigint")
    got = {r.metric: r for r in ev.mc_accuracy(ev.item_picks(df)).collect()}
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    score = {"acc_raw": lambda r: r[2], "acc_unit": lambda r: r[2] / r[4], "acc_char": lambda r: r[2] / r[5], "acc_unit_pmi": lambda r: (r[2] - r[3]) / r[4]}
    for metric, f in score.items():
        hits = sum(max(rs, key=lambda r: (f(r), -r[1]))[1] == rs[0][6] for rs in by.values() if rs[0][6] >= 0)
        assert got[metric].n_hit == hits and got[metric].n == len(by)


def test_length_bias_matches_numpy(spark):
    rows = choice_rows(3)
    df = spark.createDataFrame(rows, "item_id bigint, choice_idx bigint, raw double, uncond double, n_units bigint, n_chars bigint, gold bigint")
    got = ev.length_bias(df).first()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    x, y, ties = [], [], 0
    for rs in by.values():
        u, s = np.array([r[4] for r in rs], float), np.array([r[2] / r[4] for r in rs])
        x.extend(u - u.mean())
        y.extend(s - s.mean())
        ties += (np.abs(s - s.max()) < 1e-9).sum() > 1
    assert got.r_within == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert got.n_ties == ties
    few = ev.length_bias(df.filter("item_id = 0").limit(2)).first()
    assert few.r_within is None


def test_small_helpers(spark):
    row = spark.range(1).select(stderr(F.lit(0.25), F.lit(100)).alias("s")).first()
    assert row.s == pytest.approx(0.0433013, abs=1e-6)
    df = spark.createDataFrame([("2",), ("b",), ("zz",)], "t string")
    got = [r.g for r in df.select(gold_index("t", F.array(F.lit("a"), F.lit("b"))).alias("g")).collect()]
    assert got == [2, 1, -1]


def test_auroc(sliced):
    rng = np.random.default_rng(1)
    data = [(int(rng.integers(0, 20)), bool(rng.random() < 0.4)) for _ in range(400)]
    got = ev.auroc(sliced.createDataFrame(data, "s bigint, y boolean"), "s", "y").first().auroc
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got == pytest.approx(want, abs=1e-12)
