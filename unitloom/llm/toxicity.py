"""Toxic documents: a lexicon trie searched with Levenshtein automata, scored in context windows.

The lexicon is learnt from the labels as counts over all labelled texts.  Words of a text run
through the trie together with a Levenshtein automaton, so misspelt terms and words with a misspelt
stem are found at one edit; forms that harmless texts use are never taken for misspellings.  Each hit counts by its
term's reliability, less in quotation and more beside other hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, held_out, ship, turn_to

#: A term has at least this many different neighbours, as a share of the toxic training texts (and MIN_CONTEXTS),
#: which bounds the lexicon by a text's mean number of words over the share, whatever the corpus.
MIN_SHARE, MIN_CONTEXTS = 0.004, 3
#: Least share of toxic contexts among a term's contexts.
MIN_PRECISION = 0.9
#: A stem stands for all words that begin with it: letters, least share, least words, precision.
STEM_LETTERS, STEM_SHARE, STEM_WORDS, STEM_PRECISION = (4, 5, 6), 0.02, 3, 0.95
#: Labelled training rows that are used at most, a sample by the hash of the id; their ids are broadcast (under 10 MB).
MAX_LABELS = 200_000
#: A term or stem and its misspelling both have this many letters; shorter terms are only matched exactly.
FUZZY_LENGTH = 4
#: Words on either side of a hit that decide about quotation and company.
CONTEXT = 10
THRESHOLD = 0.7
#: Words without weight that a worker remembers before it starts anew.
KNOWN_WORDS = 200_000

WORD = re.compile(r"[^\W_]+")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as the scorer sees them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def lexicon(texts: DataFrame, counted: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(text, toxic) rows and their ``counted`` words -> (term, stem, toxic_contexts, clean_contexts).

    First words and stems are chosen by the texts that hold them, then their contexts are counted.  A context is a
    different word before the term: copies and near copies of a text repeat its contexts, so they add nothing.
    An entry must be so one-sided that chance would not give one such word in the whole
    vocabulary (a Chernoff bound times the number of words is at most 1).
    """
    share = F.col("toxic_texts") / (F.col("toxic_texts") + F.col("clean_texts"))
    terms = counted.filter((F.col("toxic_texts") >= max(MIN_CONTEXTS, MIN_SHARE * n_toxic)) & (share >= MIN_PRECISION))
    heads = F.array_distinct(F.array(*(F.substring("term", 1, n) for n in STEM_LETTERS)))
    stems = (
        counted.select(F.explode(heads).alias("stem"), "term", "toxic_texts", "clean_texts")
        .filter(F.length("term") > F.length("stem"))
        .groupBy("stem")
        .agg(F.sum("toxic_texts").alias("toxic_texts"), F.sum("clean_texts").alias("clean_texts"), F.count("*").alias("n"))
        .filter((F.col("n") >= STEM_WORDS) & (F.col("toxic_texts") >= STEM_SHARE * n_toxic) & (share >= STEM_PRECISION))
    )
    chosen = durable(
        terms.select("term", F.lit(False).alias("stem")).unionByName(stems.select(F.col("stem").alias("term"), F.lit(True).alias("stem")))
    )
    w = words(F.col("text"))
    pairs = texts.select("toxic", F.explode(F.arrays_zip(w.alias("word"), F.concat(F.array(F.lit("")), w).alias("before"))).alias("p"))
    pairs = pairs.filter("p.word is not null").select("toxic", "p.word", "p.before")
    # A word's own form and its possible stems, looked up among the chosen ones (a table of bounded size).
    forms = [F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))]
    forms += [F.struct(F.substring("word", 1, n).alias("term"), F.lit(True).alias("stem")) for n in STEM_LETTERS]
    own = pairs.select("toxic", "word", "before", F.explode(F.array(*forms)).alias("f")).filter("not f.stem or length(word) > length(f.term)")
    held = own.select("toxic", "word", "before", "f.term", "f.stem").join(F.broadcast(chosen), ["term", "stem"])
    contexts = held.groupBy("term", "stem", "word", "before").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least"))
    found = contexts.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic_contexts"), F.sum(1 - F.col("least")).alias("clean_contexts"))
    base = min(max(n_toxic / max(n_toxic + n_clean, 1), 1e-9), 0.99)
    share = F.col("toxic_contexts") / (F.col("toxic_contexts") + F.col("clean_contexts"))
    odd = F.col("toxic_contexts") * F.log(share / base) + F.when(
        F.col("clean_contexts") > 0, F.col("clean_contexts") * F.log((1 - share) / (1 - base))
    ).otherwise(0.0)
    enough = (share > base) & (odd >= math.log(max(counted.count(), 2)))
    return found.filter(enough & (share >= F.when(F.col("stem"), STEM_PRECISION).otherwise(MIN_PRECISION)))


class Trie:
    """Terms and stems as nested tables by letter; a node's ``""`` holds a term's weight, its ``"**"`` a stem's."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.root: dict = {}
        self.halves: set[tuple[bool, int, str]] = set()
        self.starts: set[tuple[int, str]] = set()
        for kind, entries in (("", terms), ("**", stems)):
            for term, weight in entries.items():
                node = self.root
                for letter in term:
                    node = node.setdefault(letter, {})
                node[kind] = weight
        for term in terms:
            if len(term) >= FUZZY_LENGTH:
                # One edit leaves one half of the term as it is.
                half = len(term) // 2
                for size in (len(term) - 1, len(term), len(term) + 1):
                    self.halves |= {(True, size, term[:half]), (False, size, term[half:])}
        for stem in stems:
            # Either the first half begins the word, or the second half stands where it belongs or one letter beside.
            half = len(stem) // 2
            self.starts |= {(0, stem[:half]), *((at, stem[half:]) for at in (half - 1, half, half + 1))}
        self.spots = {(at, len(part)) for at, part in self.starts}
        self.sizes = {(head, size, len(part)) for head, size, part in self.halves}
        self.parts: dict[int, list[tuple[bool, int]]] = {}
        for head, size, length in self.sizes:
            self.parts.setdefault(size, []).append((head, length))

    def exact(self, word: str) -> float:
        """The weight of the term, or of the heaviest stem that begins the word."""
        node, best = self.root, 0.0
        for letter in word:
            node = node.get(letter)
            if node is None:
                return best
            best = max(best, node.get("**", 0.0))
        return max(best, node.get("", 0.0))

    def may_be_near(self, word: str) -> bool:
        size = len(word)
        if any((at, word[at : at + n]) in self.starts for at, n in self.spots):
            return True
        return any((head, size, word[:n] if head else word[-n:]) in self.halves for head, n in self.parts.get(size, ()))

    def near(self, word: str) -> list[tuple[str, float]]:
        """(form, weight) of what lies at exactly one edit: the word for a term, ``beginning*`` for a stem.

        Terms, stems and forms have FUZZY_LENGTH letters or more.  A stem's last letter must stand: changed or
        missing there, any word with the letters before it would do.  A state of the automaton is (letters of the
        word read, edits made, last letter stood); states run in step with the trie's nodes, so a shared prefix is
        walked once.
        """
        found: dict[str, float] = {}
        size = len(word)
        if size < FUZZY_LENGTH or not self.may_be_near(word):
            return []
        stack = [(self.root, 0, {(0, 0, True)})]
        while stack:
            node, depth, states = stack.pop()
            if depth >= FUZZY_LENGTH:
                if "" in node and any(e + size - i <= 1 for i, e, _ in states):
                    found[word] = max(found.get(word, 0.0), node[""])
                if "**" in node:
                    for i, e, stood in states:
                        if e and stood and i >= FUZZY_LENGTH:
                            form = word[:i] + "*"
                            found[form] = max(found.get(form, 0.0), node["**"])
            for letter, child in node.items():
                if len(letter) == 1:
                    after = set()
                    for i, e, _ in states:
                        if i < size and word[i] == letter:
                            after.add((i + 1, e, True))
                        if not e:
                            after.add((i, 1, False))  # the word lacks this letter
                            if i < size:
                                after.add((i + 1, 1, False))  # another letter in its place
                                if i + 1 < size and word[i + 1] == letter:
                                    after.add((i + 2, 1, True))  # one letter too many before it
                    if after:
                        stack.append((child, depth + 1, after))
        return list(found.items())


def reliability(toxic_contexts: int, clean_contexts: int) -> float:
    return toxic_contexts / (toxic_contexts + clean_contexts + 1.0)


def look_alikes(counted: DataFrame, terms: dict[str, float], stems: dict[str, float]) -> set[str]:
    """Forms (see ``Trie.near``) that words of clean training texts have; bounded by the one-edit forms of the lexicon."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("toxicity")
        trie = Trie(terms, stems)
        for batch in batches:
            yield pd.DataFrame({"form": list({form for w in batch["term"] if not trie.exact(w) for form, _ in trie.near(w)})}, dtype="object")

    plain = counted.filter("clean_texts > 0").select("term")
    return {row[0] for row in plain.mapInPandas(match, "form string").distinct().toLocalIterator()}


def quoted_ranges(text: str) -> list[tuple[int, int]]:
    """Stretches of one line between matching quotation marks."""
    found, line_start = [], 0
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            close = QUOTES.get(line[at])
            end = line.find(close, at + 1) if close else -1
            if end > at:
                found.append((line_start + at, line_start + end))
                at = end
            at += 1
        line_start += len(line) + 1
    return found


class Scorer:
    """Scores texts with a lexicon; remembers words without weight, up to a bound."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], harmless: set[str]):
        self.trie, self.harmless, self.blank = Trie(terms, stems), harmless, set()

    def weight(self, word: str) -> float:
        found = self.trie.exact(word)
        if not found:
            found = 0.6 * max((weight for form, weight in self.trie.near(word) if form not in self.harmless), default=0.0)
        if not found:
            self.blank.add(word)
        return found

    def __call__(self, text: str | None) -> float:
        """1 minus the product of what each different term leaves in doubt, at its most telling place."""
        if not text:
            return 0.0
        text = text.lower()
        if len(self.blank) > KNOWN_WORDS:
            self.blank.clear()
        weights = {w: self.weight(w) for w in set(WORD.findall(text)) - self.blank}
        hits = []
        if any(weights.values()):
            for place, m in enumerate(WORD.finditer(text)):
                if weights.get(m[0]):
                    hits.append((place, m.start(), m[0], weights[m[0]]))
        if not hits:
            return 0.0
        quotes = quoted_ranges(text)
        strongest: dict[str, float] = {}
        for k, (place, start, word, weight) in enumerate(hits):
            company = (k > 0 and place - hits[k - 1][0] <= CONTEXT) or (k + 1 < len(hits) and hits[k + 1][0] - place <= CONTEXT)
            quoted = any(a < start < b for a, b in quotes)
            doubt = (1 - weight) * (0.5 if company else 1.0)
            telling = (1 - doubt) * (0.3 if quoted and not company else 1.0)
            strongest[word] = max(strongest.get(word, 0.0), telling)
        left = 1.0
        for telling in strongest.values():
            left *= 1 - telling
        return 1 - left


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], dict[str, float], set[str]]:
    """Weights of terms and stems, and harmless look-alikes, from labelled rows outside the held-out third."""
    usable = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = MAX_LABELS / max(usable.count(), 1)
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    known = durable(usable)
    sides = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id").select("text", "toxic")
    counted = durable(
        texts.select("toxic", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic_texts"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("clean_texts"))
    )
    terms, stems = {}, {}
    for row in lexicon(texts, counted, sides.get(1, 0), sides.get(0, 0)).toLocalIterator():
        (stems if row["stem"] else terms)[row["term"]] = reliability(row["toxic_contexts"], row["clean_contexts"])
    return terms, stems, look_alikes(counted, terms, stems)


def scorer(docs: DataFrame, labels: DataFrame):
    """An Arrow UDF text -> score whose model travels as one broadcast of lexicon size; texts are taken from a batch one at a time."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_to("toxicity")
        judge = Scorer(*model.value)
        for texts in batches:
            yield pa.array([judge(t.as_py()) for t in texts], pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts score 0; null ids are never held out and never labelled.  Without toxic labels the
    lexicon is empty and all scores are 0.  Repeated rows are each answered; other columns are ignored.
    """
    score = scorer(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = scored.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; all columns stay as they are."""
    return docs.filter(scorer(docs, labels)(F.col("text").cast("string")) < THRESHOLD)
