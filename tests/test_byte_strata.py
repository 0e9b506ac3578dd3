"""Attributes of target bytes against a plain walk over a window's bytes."""

from __future__ import annotations

from collections import Counter

from unitloom.operators import evaluate as ev

WINDOWS = {
    0: ["The ", "qui", "ck ", " ", "1 ", "été, ", "x", "\t", "extraordinary"],
    1: [" ", " ", "a"],
    2: ["only"],
}


def plain(units, n, k_max):
    raw = [u.encode() for u in units]
    text = b"".join(raw)
    out, end = Counter(), 0
    for i, unit in enumerate(raw):
        end += len(unit)
        for delta in range(1, min(k_max, len(b"".join(raw[i + 1 : i + 1 + n]))) + 1):
            p = end + delta - 1
            c = text[p]
            kind = (
                "space" if c in b" \t\n\r" else "digit" if chr(c).isdigit() and c < 128 else "letter" if c < 128 and chr(c).isalpha()
                else "punct" if c in b".,!?;:'\"-()" else "other"
            )
            first, last = p, p
            while first > 0 and text[first - 1] != 32:
                first -= 1
            while last + 1 < len(text) and text[last + 1] != 32:
                last += 1
            size = last - first + 1
            length = "none" if c == 32 else "1-2" if size <= 2 else "3-5" if size <= 5 else "6-8" if size <= 8 else "9+"
            place = "none" if kind not in ("letter", "space") else "space" if kind == "space" else "first" if p == first else "last" if p == last else "mid"
            ahead = "later" if delta > 1 else "end" if text[p + 1 : p + 2] == b" " else "inside"
            out[delta, c, kind, length, place, ahead] += 1
    return out


def test_targets_carry_what_they_are_in_the_window(spark):
    rows = [("s", w, i, i, u, i == 0) for w, units in WINDOWS.items() for i, u in enumerate(units)]
    windowed = spark.createDataFrame(rows, "shard string, window_id bigint, seq bigint, idx bigint, unit string, doc_start boolean")
    for n, k_max in ((1, 4), (3, 16)):
        got = Counter(tuple(r) for r in ev.target_attributes(windowed, n, k_max).select("delta", "byte", "class", "word_len", "place", "ahead").collect())
        assert got == sum((plain(units, n, k_max) for units in WINDOWS.values()), Counter())
    assert ev.target_attributes(windowed.limit(0), 2, 4).count() == 0


def test_strata_may_be_columns_taken_together(spark):
    cells = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 6.0)], "x string, y int, v double")
    got = {(r.x, r.y): (r.n, r["mean"]) for r in ev.stratified_loss(cells, ["x", ("x", "y")], "v").collect()}
    assert got == {("a", None): (2, 3.0), ("b", None): (1, 6.0), ("a", 1): (1, 2.0), ("a", 2): (1, 4.0), ("b", 1): (1, 6.0)}


def test_counted_targets_are_the_same_targets(spark):
    rows = [("s", w, i, i, u, i == 0) for w in range(600) for i, u in enumerate(WINDOWS[w % 3])]
    windowed = spark.createDataFrame(rows, "shard string, window_id bigint, seq bigint, idx bigint, unit string, doc_start boolean")
    counted = ev.target_attributes(windowed, 3, 16, counted=True).collect()
    got = {(r.delta, r.byte, r["class"], r.word_len, r.place, r.ahead): r.n for r in counted}
    assert len(got) == len(counted)
    assert got == {k: 200 * n for k, n in sum((plain(units, 3, 16) for units in WINDOWS.values()), Counter()).items()}
