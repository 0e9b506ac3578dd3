"""Alignment of two tokenisations of every text, and the corpus-wide counts of linked token ids.

Each text is tokenised whole by both vocabularies.  Offsets where tokens of both end just before a token that is
marked with a space are anchors; they are verified by the ends of both sides and cut the text into windows of token ids,
mostly one word each.  A window's alignment depends on its ids alone, so it is remembered by the two tuples of ids.

Counts of id pairs are summed in the tasks first.  The ``HEAD`` most frequent pairs are looked up in a broadcast table of that
size; only rarer pairs of a text are shuffled to meet their counts, so no key of that join is hot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import durable, ship

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is kept in four bytes, so a vocabulary may have this many.
MOST_IDS = 1 << 16
#: Pairs in the broadcast table: 1 MB.
HEAD = 1 << 16
#: Windows in each of the two generations that a worker remembers, and ids of one beyond which a window is aligned each time.
MEMORY, LONG_WINDOW = 300_000, 48
#: Links gathered before they are summed, and distinct pairs a task holds before it hands them on.
GATHER, HOLD = 1 << 21, 1 << 20
#: Texts tokenised in one call.
TOGETHER = 256

#: Characters beyond which the slower library encodes a text: the faster one has a stack for runs of a few million blanks only.
LONG_TEXT = 200_000

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, whether they begin with a space, and their lengths."""

    def __init__(self, tokens: list[bytes], encode):
        if len(tokens) > MOST_IDS:
            raise ValueError(f"a vocabulary of {len(tokens)} ids; {MOST_IDS} are supported")
        self.tokens, self.encode = tokens, encode
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens], dtype=bool)


@lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary file whose ids are in the order of its merges, so that they serve as ranks."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_of_letter()
    special = {i for i, token in tokenizer.get_added_tokens_decoder().items() if token.special}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    tokens = [name.encode() if i in special else bytes(letters[c] for c in name) for i, name in enumerate(names)]
    ranks = {token: i for i, token in enumerate(tokens) if i not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [tokenizer.encode(" " + t, add_special_tokens=False).ids if len(t) > LONG_TEXT else fast.encode_ordinary(" " + t) for t in texts]

    return Vocabulary(tokens, encode)


@lru_cache(maxsize=4)
def pieces(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        tokens.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode())
    return Vocabulary(tokens, lambda texts: model.encode(texts, num_threads=1))


def align(windows: list[bytes], a: Vocabulary, b: Vocabulary) -> list[tuple[str, bytes]]:
    """Of every window (its two tuples of ids over the same bytes, as ``keyed`` writes them) the groups as text, each with a ``;``
    behind it, and the linked pairs (first id * MOST_IDS + second id, four bytes each).

    All windows are laid end to end; a link ends at every offset where a token of either side ends, a group where both do.
    """
    flat = np.frombuffer(b"".join(windows), np.uint32)
    tokens = np.cumsum([len(w) // 4 for w in windows])
    second = flat >= MOST_IDS
    ids_a, ids_b = flat[~second], flat[second] - np.uint32(MOST_IDS)
    last_a = tokens - np.cumsum(second)[tokens - 1]
    end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    ends = np.zeros(end_a[-1] + 1, dtype=np.int8)
    ends[end_a] = 1
    ends[end_b] += 2
    cuts = np.flatnonzero(ends)
    of_a, of_b = np.cumsum((ends[cuts] & 1) != 0), np.cumsum((ends[cuts] & 2) != 0)
    both = ends[cuts] == 3
    at_a, at_b = of_a - ((ends[cuts] & 1) != 0), of_b - ((ends[cuts] & 2) != 0)
    links = (ids_a[at_a] * np.uint32(MOST_IDS) + ids_b[at_b]).tobytes()
    # Tokens in the order of the text: a group's tokens of the first side, then those of the second.
    groups_a, groups_b = np.r_[0, of_a[both]], np.r_[0, of_b[both]]
    group_of_a = np.searchsorted(groups_a, np.arange(len(ids_a)), "right") - 1
    group_of_b = np.searchsorted(groups_b, np.arange(len(ids_b)), "right") - 1
    spelt = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    spelt[np.arange(len(ids_a)) + groups_b[group_of_a]] = ids_a + MOST_IDS * (ends[end_a] == 3)
    spelt[np.arange(len(ids_b)) + groups_a[group_of_b + 1]] = ids_b + MOST_IDS * (2 + (ends[end_b] == 3))
    names = _names()
    text = [names[i] for i in spelt.tolist()]
    tokens = [0, *tokens.tolist()]
    linked = [0, *(4 * (np.searchsorted(cuts, end_a[last_a - 1]) + 1)).tolist()]
    return [("".join(text[s:e]), links[t:u]) for s, e, t, u in zip(tokens, tokens[1:], linked, linked[1:])]


def keyed(a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> list[bytes]:
    """Each window's ids in four bytes each, those of the first side, then those of the second plus MOST_IDS."""
    mixed = np.empty(len(a) + len(b), dtype=np.uint32)
    mixed[np.arange(len(a)) + np.repeat(start_b[:-1], np.diff(start_a))] = a
    mixed[np.arange(len(b)) + np.repeat(start_a[1:], np.diff(start_b))] = b + np.uint32(MOST_IDS)
    raw, ends = mixed.tobytes(), (4 * (start_a + start_b)).tolist()
    return [raw[s:e] for s, e in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def _names() -> list[str]:
    """Ids with what follows them: inside a group or at its end, first side (``,`` or ``|``), then second side (``,`` or ``;``)."""
    return [f"{i}{sign}" for sign in ",|,;" for i in range(MOST_IDS)]


class Aligner:
    """Alignment of whole texts, window by window, with a bounded memory of windows."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b, self.known, self.older = a, b, {}, {}

    def windows(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """The alignments of windows; those not remembered are aligned together."""
        found = list(map(self.known.get, keys))
        if None in found:
            own = {key: self.older.get(key) for key, value in zip(keys, found) if value is None}
            new = [key for key, value in own.items() if value is None]
            if new:
                own.update(zip(new, align(new, self.a, self.b)))
            found = [value or own[key] for key, value in zip(keys, found)]
            if len(self.known) >= MEMORY:
                self.known, self.older = {}, self.known
            self.known.update((key, value) for key, value in own.items() if len(key) <= 4 * LONG_WINDOW)
        return found

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token places of both sides at which windows begin, and their ends."""
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at_a = np.flatnonzero(self.a.spaced[a[1:]])
        at_b = np.flatnonzero(self.b.spaced[b[1:]])
        ends = np.zeros(end_a[-1] + 1, dtype=np.int8)
        ends[end_a[at_a]] = 1
        ends[end_b[at_b]] += 1
        at_a, at_b = at_a[ends[end_a[at_a]] == 2] + 1, at_b[ends[end_b[at_b]] == 2] + 1
        return np.r_[0, at_a, len(a)], np.r_[0, at_b, len(b)]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray] | None]:
        """Per text (n_a, n_b, n_groups, n_links, digest, linked pairs), or None where the tokens don't spell the text."""
        keys, sizes = [], []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = b" " + text.encode()
            if b"".join(map(self.a.tokens.__getitem__, a)) != whole or b"".join(map(self.b.tokens.__getitem__, b)) != whole:
                sizes.append(None)
                continue
            ids_a, ids_b = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
            start_a, start_b = self.cuts(ids_a, ids_b)
            keys += keyed(ids_a, ids_b, start_a, start_b)
            sizes.append((len(a), len(b), len(start_a) - 1))
        found, at = self.windows(keys), 0
        for size in sizes:
            if size is None:
                yield None
                continue
            own = found[at : at + size[2]]
            at += size[2]
            groups = "".join([part for part, _ in own])
            links = np.frombuffer(b"".join([linked for _, linked in own]), dtype=np.uint32)
            yield *size[:2], groups.count(";"), len(links), hashlib.sha256(groups[:-1].encode()).hexdigest(), links


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(byte_level(path_a), pieces(path_b))


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its figures with its distinct pairs and how often it links them; and, with a pair, counts summed over a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(path_a, path_b)
        gathered, waiting = [], 0
        held, times = np.empty(0, np.uint32), np.empty(0, np.int64)

        def summed():
            pairs = np.concatenate([held, *(g[0] for g in gathered)])
            counts = np.concatenate([times, *(g[1] for g in gathered)])
            found, place = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, place, counts)
            return found, total

        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.iloc[at : at + TOGETHER]
                texts = [t or "" for t in some["text"]]
                aligned = aligner.texts([t for t in texts if t])
                rows = []
                for doc_id, text in zip(some["doc_id"], texts):
                    found = next(aligned) if text else None
                    if found is None:
                        rows.append((doc_id, 0, 0, 0, 0, "", b"", b""))
                        continue
                    pairs, counts = np.unique(found[5], return_counts=True)
                    gathered.append((pairs, counts))
                    waiting += len(pairs)
                    rows.append((doc_id, *found[:5], pairs.tobytes(), zlib.compress(counts.astype(np.uint32).tobytes(), 1)))
                out = pd.DataFrame(rows, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out.assign(pair=pd.Series(pd.NA, index=out.index, dtype="Int32"), n=pd.Series(pd.NA, index=out.index, dtype="Int64"))
                if waiting > GATHER:
                    held, times = summed()
                    gathered, waiting = [], 0
                    if len(held) > HOLD:
                        yield _counts(held, times)
                        held, times = held[:0], times[:0]
        held, times = summed()
        if len(held):
            yield _counts(held, times)

    return docs.mapInPandas(run, f"{DOCUMENT}, pairs binary, times binary, pair int, n long")


def _counts(pairs: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    nothing = pd.Series([None] * len(pairs), dtype="Int64")
    text = pd.Series([None] * len(pairs), dtype=object)
    named = {c: nothing for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pd.DataFrame({**named, "groups_sha256": text, "pairs": text, "times": text, "pair": pairs.view(np.int32), "n": n})


def _known(stored: DataFrame, head) -> DataFrame:
    """Each document with the sums over its frequent pairs, and a row for each of its other pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counts, top = head.value
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.iloc[at : at + TOGETHER]
                n_best, total, rest = [], [], []
                for key, pairs, times in zip(some["key"], some["pairs"], some["times"]):
                    # Sorted as signed numbers, like the broadcast table.
                    pairs = np.frombuffer(pairs, np.int32)
                    times = np.frombuffer(zlib.decompress(times), np.uint32).astype(np.int64) if len(times) else np.empty(0, np.int64)
                    place = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
                    hit = names[place] == pairs if len(names) else np.zeros(len(pairs), bool)
                    n_best.append(int((times[hit] * top[place[hit]]).sum()))
                    total.append(int((times[hit] * counts[place[hit]]).sum()))
                    if not hit.all():
                        rest.append(pd.DataFrame({"key": key, "pair": pairs[~hit].astype(np.int64), "times": times[~hit]}))
                own = some[["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
                own["doc_id"] = own["doc_id"].astype("Int64")
                # A name that no pair has, so that documents are spread evenly by the join.
                own["pair"], own["times"], own["best"], own["total"] = own["key"] + (1 << 40), 0, n_best, total
                yield pd.concat([own, *rest], ignore_index=True) if rest else own

    wide = stored.select("key", *[c.split()[0] for c in DOCUMENT.split(", ")], "pairs", "times")
    return wide.mapInPandas(run, f"key long, {DOCUMENT}, pair long, times long, best long, total long")


def align_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None
) -> DataFrame:
    """One row per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``vocabulary_a`` is a byte-level tokenizer file, ``vocabulary_b`` a piece model with byte fallback (by default the public ones).
    Null and empty texts, and texts that either side's tokens don't spell byte for byte (such as ones with U+2581), have zeros and an
    empty digest.  Repeated rows each count and each give a row; null ids are kept; an empty table gives no rows; other columns
    are ignored, whatever their names.  A very long text is tokenised whole, in the memory of one task; ties for the highest
    count are all best.  The tokens are computed once and the pairs written to the checkpoint folder.
    """
    path_a = vocabulary_a or vocabulary_path(BYTE_LEVEL)
    path_b = vocabulary_b or vocabulary_path(PIECES)
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stored = durable(_aligned(plain, path_a, path_b).withColumn("key", F.monotonically_increasing_id()))
    counts = stored.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = durable(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(MOST_IDS - 1))))
    # One row per id of the second vocabulary: MOST_IDS at most.
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    flagged = durable(counts.join(most, "b").select(F.col("pair").cast("long").alias("pair"), "n", (F.col("n") == F.col("most")).alias("top")))
    often = flagged.orderBy(F.desc("n"), "pair").limit(HEAD).toPandas().sort_values("pair")
    head = (often["pair"].to_numpy(np.int32), often["n"].to_numpy(np.int64), often["top"].to_numpy(np.int64))
    known = _known(stored.filter("pair is null"), docs.sparkSession.sparkContext.broadcast(head))
    met = known.join(flagged, "pair", "left")
    n_best = F.sum(F.coalesce("best", F.when(F.col("top"), F.col("times")), F.lit(0)))
    total = F.sum(F.coalesce("total", F.col("times") * F.col("n"), F.lit(0)))
    per = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    rows = met.groupBy("key").agg(*per, n_best.alias("n_best"), total.alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return rows.drop("key")
