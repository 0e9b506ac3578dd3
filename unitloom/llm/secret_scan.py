"""Secrets in text: three fixed patterns, and strings that a tokenizer's vocabulary compresses badly.

Natural words, even unknown ones, fall into few vocabulary entries; a random key needs one
entry for every one or two characters.  A run of key characters counts as random when
its characters per token stay under ``max_ratio``, unless it has the shape of a known
digest (hex of a digest's length), a UUID, a number, or an identifier whose words, each taken alone and
in lower case where that is shorter, reach ``max_ratio`` together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keeps, ship, turn_to

# Patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PLAIN = re.compile(r"(?:[A-Z]?[a-z]{2,})+[0-9]{0,4}|[A-Z]{2,}[0-9]{0,4}|[0-9]{1,8}")

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts that are replaced at a time, so that a worker's memory doesn't follow the batch.
TOGETHER = 500
MAX_RATIO = 1.9

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a rank file, once per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


keeps("secret_scan", encoder.cache_clear)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds; a match that is too short is dropped, not shortened."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_MIN]
    return sorted(found)


def known_shape(run: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    """Digests, UUIDs, numbers and identifiers of plain words are known strings, not keys; the tokens tell whether words are plain."""
    if run.isdigit() or (len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)):
        return True
    if UUID.fullmatch(run) or len(set(run)) < 8:
        return True
    if not all(PLAIN.fullmatch(word) for word in re.split(r"[+/_=-]+", run) if word):
        return False
    words = WORD.findall(run)
    tokens = sum(min(len(encode(word)), len(encode(word.lower()))) for word in words)
    return sum(map(len, words)) >= max_ratio * tokens


def random_spans(text: str, encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the runs with few characters per token."""
    return [
        (m.start(), 3, m.end())
        for m in RUN.finditer(text)
        if not known_shape(m[0], encode, max_ratio) and len(m[0]) < max_ratio * len(encode(m[0]))
    ]


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document row: counts by kind, digest of the base spans, and all spans.

    Reads only ``doc_id`` and ``text``; other columns are ignored whatever their names.  A
    null or empty text has no spans; a null id stays null; repeated rows are each
    answered.  Work is one pass inside the scan's own splits, without a shuffle, and a
    document is held by one task only as long as it is scanned.
    """
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("secret_scan")
        encode = encoder(path).encode_ordinary
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                extra = random_spans(text, encode, max_ratio)
                count = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                digest = hashlib.sha256(render(base).encode()).hexdigest()
                rows.append((None if pd.isna(doc_id) else int(doc_id), *count, digest, render(sorted(base + extra)), len(extra)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(scan, SCHEMA)


def redact(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO, text: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``[secret]``.

    All rows and columns stay; a column ``n_chars`` follows the new length where a text changed.
    """
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path()

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_to("secret_scan")
        encode = encoder(path).encode_ordinary
        for texts in batches:
            for at in range(0, len(texts), TOGETHER):
                some = texts.slice(at, TOGETHER).to_pylist()
                yield pa.array([None if t is None else _without(t, encode, max_ratio) for t in some], pa.string())

    done = docs.withColumn(text, clean(F.col(text)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), "n_chars"))
    return done.select(*docs.columns)


def _without(text: str, encode, max_ratio: float) -> str:
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + random_spans(text, encode, max_ratio)):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
