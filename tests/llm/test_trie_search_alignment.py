"""Prefix trie, collision-counting search and token alignment against plain Python, with edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitloom.llm import collision_search, prefix_trie, token_alignment

TURNS = "conv_id long, turn int, role string, text string, key string, own string"


# ---- prefix trie ----


def plain_trie(rows):
    """Nodes by their paths, from all prefixes of all rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    n_words = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])
    out = []
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * n_words(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(held) if len(paths[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(held), len(path), parent, len(held), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "k", "o") for r in rows], TURNS)
    return sorted((tuple(r) for r in prefix_trie.rebuilt_trie(df).collect()), key=str)


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 3, 3, 5, 9])):
            rows.append((c - 30, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "", "a\tb c", None, "x" * 30])))
    return rows


@pytest.mark.parametrize("block", [1, 2, 7, 5_000])
def test_trie_equals_all_prefixes(sliced, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = random_turns(block, 150)
    assert trie_rows(sliced, rows) == plain_trie(rows)


def test_trie_of_copies_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60) for t in range(4)]
    rows += [(100, None, None, None), (100, None, "user", "b"), (100, 1, "user", "c"), (100, 1, "user", "c"), (None, 0, "user", "lost"), (103, 0, "user", "z")]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == []


def test_trie_of_a_long_conversation(spark):
    rows = [(c, t, "user", "w " * (t % 3)) for c in (1, 2) for t in range(3_000)] + [(2, 3_000, "user", "more")]
    df = spark.createDataFrame([(*r, "k", "o") for r in rows], TURNS)
    got = prefix_trie.trie(prefix_trie.conversations_of(df)).collect()
    assert len(got) == 3_002 and {r[3] for r in got} == {1, 2}


def test_a_forest_of_any_split_adds_up():
    rng = random.Random(5)
    turn = lambda i: hashlib.md5(str(i).encode()).digest()
    keys = sorted({b"".join(turn(rng.randrange(2)) for _ in range(rng.randrange(7))) for _ in range(40)})
    whole = prefix_trie.Forest(keys, [[2] * 9] * len(keys), [1] * len(keys), list(range(len(keys))), [""] * len(keys), -1, -1).nodes(0)
    assert all(r[0] == prefix_trie.FINAL for r in whole)
    totals = lambda rows, c: sum(r[c] for r in rows if r[5] == 0)
    for cut in range(1, len(keys)):
        common = prefix_trie.shared_turns(keys[cut - 1], keys[cut])
        parts = []
        for some, before, after in ((slice(0, cut), -1, common), (slice(cut, None), common, -1)):
            low = list(range(len(keys)))[some]
            parts += prefix_trie.Forest(keys[some], [[2] * 9] * len(low), [1] * len(low), low, [""] * len(low), before, after).nodes(before)
        for column in (7, 8, 9, 10):  # n_convs, n_children, n_leaves, saved_tokens of the root
            assert totals(parts, column) == totals(whole, column)


# ---- collision-counting search ----


def plain_neighbours(rows, k):
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for i, v in seen:
        if i % 100 == 0:
            near = sorted((float(collision_search.distance(np.array([w]), np.array(v))[0]), j) for j, w in seen if j != i and len(w) == len(v))
            out += [(i, r, j, d) for r, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


def search_rows(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, v int, h1 string")
    return sorted(tuple(r) for r in collision_search.search(df, F.col("vec_id") % 100 == 0, k).collect())


def test_search_finds_what_a_scan_finds(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + rng.standard_normal(24) * (0.05 if i % 2 else 1)).tolist()) for i in range(3_000)]
    want, got = set(plain_neighbours(rows, 10)), set(search_rows(spark, rows))
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.99


def test_search_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 301)] + [(i, [1.0, 2.0, 3.0 + i]) for i in range(301, 320)]
    rows += [(400, None), (401, []), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (700, [float("nan"), 1.0, 1.0]), (800, [float("inf"), 1.0, 1.0])]
    rows += [(None, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 3.0]), (900, [1.0, 2.0]), (1000, [-0.0, 1.0, 0.0]), (1001, [0.0, 1.0, -0.0])]
    assert search_rows(spark, rows) == plain_neighbours(rows, 10)
    assert search_rows(spark, []) == []
    few = [(0, [1.0, 0.5]), (1, [3.0, 0.0]), (2, [2.0, 0.0])]
    assert search_rows(spark, few) == plain_neighbours(few, 10) and len(search_rows(spark, few)) == 2


def test_search_of_very_long_vectors_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "SHARD_BYTES", 8 * 5_000 * 20)
    monkeypatch.setattr(collision_search, "BLOCK_BYTES", 8 * 5_000 * 2)
    rng = np.random.default_rng(4)
    rows = [(i * 50, rng.standard_normal(5_000).tolist()) for i in range(300)]
    want, got = set(plain_neighbours(rows, 10)), set(search_rows(spark, rows))
    assert len(got & want) / len(want) >= 0.99 and len(got) == len(want)


# ---- token alignment ----

TEXTS = [
    "The quick brown fox, jumped over the lazy dog.", "", None, "naïve café 東京タワー", "a▁b", "  two  blanks\n\nand lines ", "<|endoftext|> <s> </s> <0x41>", "\x00\x01 \U0001f600",
    "Привет мир", "word", "The quick brown fox, jumped over the lazy dog.", "x" * 3_000, "nospace" * 500 + " end", "1234567890 3.14159", "\ttab", "The the THE",
]


def plain_alignment(texts):
    """Per text all overlapping token pairs found by comparing every pair of byte ranges."""
    from tokenizers import Tokenizer
    import sentencepiece

    first = Tokenizer.from_file(token_alignment.vocabulary_path(token_alignment.BYTE_LEVEL))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=token_alignment.vocabulary_path(token_alignment.PIECES))
    letters = token_alignment.byte_of_letter()
    found, counts = [], {}
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            spell_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
            spell_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(s) for s in spell_a]).tolist(), np.cumsum([len(s) for s in spell_b]).tolist()
                starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
                for i in range(len(a)):
                    for j in range(len(b)):
                        if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]:
                            links.append((a[i], b[j]))
                for low, high in zip([0, *sorted(set(ends_a) & set(ends_b))], sorted(set(ends_a) & set(ends_b))):
                    in_a = [str(x) for x, s in zip(a, starts_a) if low <= s < high]
                    in_b = [str(x) for x, s in zip(b, starts_b) if low <= s < high]
                    groups.append(f"{','.join(in_a)}|{','.join(in_b)}")
            else:
                a, b = [], []
        found.append((a, b, links, groups))
        for link in links:
            counts[link] = counts.get(link, 0) + 1
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for doc, (a, b, links, groups) in enumerate(found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def aligned_rows(spark, texts):
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, n long, key string")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(tuple(r[c] for c in columns) for r in token_alignment.align_documents(df).collect())


@pytest.mark.parametrize("head", [0, 5, 1 << 16])
def test_alignment_equals_all_pairs_of_ranges(spark, monkeypatch, head):
    monkeypatch.setattr(token_alignment, "HEAD", head)
    assert aligned_rows(spark, TEXTS) == plain_alignment(TEXTS)


def test_alignment_of_documents(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    assert aligned_rows(spark, texts) == plain_alignment(texts)


def test_alignment_of_nothing_and_of_repeated_rows(spark):
    assert aligned_rows(spark, []) == []
    df = spark.createDataFrame([(None, "one two"), (3, "one two"), (3, "one two")], "doc_id long, text string")
    rows = token_alignment.align_documents(df).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [None, 3, 3] and {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]}


def test_small_tasks_hand_their_counts_on(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "GATHER", 1)
    monkeypatch.setattr(token_alignment, "HOLD", 1)
    monkeypatch.setattr(token_alignment, "TOGETHER", 2)
    assert aligned_rows(spark, TEXTS) == plain_alignment(TEXTS)


def test_very_long_texts_have_the_tokens_of_the_vocabulary_file():
    from tokenizers import Tokenizer

    path = token_alignment.vocabulary_path(token_alignment.BYTE_LEVEL)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for text in (" " * 150_000, "ab" * 60_000, "é\n" * 40_000, "<|endoftext|>" * 3, " " * 300_000 + "x"):
        assert token_alignment.byte_level(path).encode([text]) == [plain.encode(" " + text, add_special_tokens=False).ids]
