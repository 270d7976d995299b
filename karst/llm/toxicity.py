"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and full-width or
mathematical letters to plain ones, digits and signs that stand for letters to those
letters, zero-width characters out, punctuation to spaces. The lexicon holds whole words
and word beginnings (4 to 6 letters, for inflected forms). One automaton finds them all,
each only from the start of a word, and also the exception phrases, within which
matches don't count. The summed weights and their sum per 100 words go through a logistic
function that is fitted on labelled documents.

The lexicon is mined from a sample of fixed size, at most ``SAMPLE`` labelled documents of
each class: a term's weight is its smoothed log odds between toxic and other documents;
terms that a shorter one covers are left out. A term needs ``SUPPORT`` documents of the sample, so its size bounds
the lexicon too. Exception phrases
are mined from the same sample (pairs of words around a term that occur in other
documents only) and added to those given. Scoring reads whole texts.

Edge cases: null and empty texts have no match and get the score of such a text; held_out is null for a null doc_id; where rows of one
doc_id differ, the least text is trained on; null or unknown labels aren't trained on; without labels of both classes every score is 0.5;
equal rows get equal scores; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, fold_of, labelled
from .numeric import fit_logistic, sigmoid

#: Bounds of the sample that lexicon and scale are learned on.
SAMPLE = {0: 3000, 1: 1500}
THRESHOLD = 0.7
#: A term needs this many toxic documents and this log odds.
SUPPORT, LOG_ODDS = 3, 3.5
PREFIXES = (4, 5, 6)
#: Phrases whose words are harmless together.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid simple", "scum pond")

# Cyrillic and Greek letters and signs that look like Latin letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
ZERO_WIDTH = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for i in range(0x80):
        if not chr(i).isalnum():
            out[i] = " "
    for i in [*range(0xA0, 0xC0), *range(0x2000, 0x2070), 0xD7, 0xF7, *range(0x3000, 0x3004)]:
        if not chr(i).isalnum():
            out[i] = " "
    # full-width forms and mathematical letters, by Unicode's own compatibility rule
    for i in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(i)).lower()
        if len(plain) == 1:
            out[i] = LOOK_ALIKE.get(plain, plain if plain.isalnum() else " ")
    for a, b in LOOK_ALIKE.items():
        out[ord(a)] = b
    for c in ZERO_WIDTH:
        out[ord(c)] = None
    return out


_FOLD = _table()


def fold(text: str | None) -> str:
    """Folded text, with a space at both ends."""
    return f" {(text or '').lower().translate(_FOLD)} "


def _terms(word: str) -> list[str]:
    """Lexicon entries that a word may match: " word " and the beginnings " wor"."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if len(word) > n)]


def mine(toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> dict[str, float]:
    """Lexicon from the numbers of toxic and other documents that have each term."""

    def odds(t: str) -> float:
        return float(np.log((toxic[t] + 0.5) / (n_toxic + 1)) - np.log((other[t] + 0.5) / (n_other + 1)))

    found = {t: w for t in toxic if toxic[t] >= SUPPORT and (w := odds(t)) >= LOG_ODDS}
    out: dict[str, float] = {}
    for t in sorted(found, key=lambda t: (len(t), t)):
        # a beginning that also is rare elsewhere stands for the longer terms it covers
        if not any(t.startswith(t[: n + 1]) and t[: n + 1] in out for n in PREFIXES if len(t) > n + 1):
            out[t] = found[t]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Matcher:
    """The automaton over lexicon and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for t, w in lexicon.items():
            self.automaton.add_word(t, (len(t), w))
        for p in exceptions:
            words = " ".join(fold(p).split())
            if words:
                self.automaton.add_word(f" {words} ", (len(words) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measures(self, text: str | None) -> tuple[float, float]:
        """log(1 + sum of weights), log(1 + the sum per 100 words)."""
        folded = fold(text)
        n_words = len(folded.split())
        total = 0.0
        if len(self.automaton):
            hits, spans = [], []
            for end, (n, w) in self.automaton.iter(folded):
                if w is None:
                    spans.append((end - n + 1, end))
                else:
                    hits.append((end - n + 1, w))
            # a word counts once, by its heaviest term
            best: dict[int, float] = {}
            # both come by their ends: a phrase that covers a hit's start ends after it, so one pass over merged phrases does
            covered = _merged(spans)
            k = 0
            for at, w in sorted(hits):
                while k < len(covered) and covered[k][1] <= at:
                    k += 1
                if k == len(covered) or at < covered[k][0]:
                    best[at] = max(w, best.get(at, 0.0))
            total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(n_words, 1)))


def _sample(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    chosen = bounded_sample(labelled(labels, target), SAMPLE)
    texts = docs.select("doc_id", "text").where("text is not null")
    # the sample's rows are at most sum(SAMPLE), so the broadcast has a bound
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a term or a pair of words; "" counts the documents."""
    counts = [Counter(), Counter()]
    for b in batches:
        for text, label in zip(b.column(0), b.column(1)):
            words = fold(text.as_py()).split()
            seen = {t for w in set(words) for t in _terms(w)}
            counts[label.as_py()].update(seen)
            counts[label.as_py()][""] += 1
    terms = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(terms), 10_000):
        part = terms[i : i + 10_000]
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(part), "n_other": pa.array([counts[0][t] for t in part], pa.int64()),
             "n_toxic": pa.array([counts[1][t] for t in part], pa.int64())}
        )


def _mined_exceptions(sample: DataFrame, lexicon: dict[str, float]) -> tuple[str, ...]:
    """Pairs of words with a term that occur in SUPPORT other documents and in no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for b in batches:
            for text, label in zip(b.column(0), b.column(1)):
                words = fold(text.as_py()).split()
                hit = [any(t in lexicon for t in _terms(w)) for w in words]
                pairs = {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}
                counts.update((p, label.as_py()) for p in pairs)
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_pydict(
                {"pair": pa.array([k[0] for k in keys]), "label": pa.array([k[1] for k in keys], pa.int32()),
                 "n": pa.array([counts[k] for k in keys], pa.int64())}
            )

    rows = (
        sample.mapInArrow(run, "pair string, label int, n bigint")
        .groupBy("pair")
        .agg(F.sum(F.col("n") * F.col("label")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("label"))).alias("other"))
        .where((F.col("toxic") == 0) & (F.col("other") >= SUPPORT))
        .collect()
    )
    return tuple(sorted(r.pair for r in rows))


def train(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, target: str = "toxic"):
    """(lexicon, exceptions, logistic weights), or None without labels of both classes."""
    # read three times: a table of its own, of a size that the sample bounds
    scratch = Scratch(docs.sparkSession, "toxic")
    sample = scratch.keep(_sample(docs, labels, target))
    counted = (
        sample.mapInArrow(_count_terms, "term string, n_other bigint, n_toxic bigint")
        .groupBy("term")
        .agg(F.sum("n_other").alias("n_other"), F.sum("n_toxic").alias("n_toxic"))
        # terms below the support can't enter; the sample bounds the rest
        .where((F.col("n_toxic") >= SUPPORT) | (F.col("term") == ""))
        .collect()
    )
    toxic = Counter({r.term: r.n_toxic for r in counted})
    other = Counter({r.term: r.n_other for r in counted})
    n_toxic, n_other = toxic.pop("", 0), other.pop("", 0)
    if not n_toxic or not n_other:
        return None
    lexicon = mine(toxic, other, n_toxic, n_other)
    exceptions = (*exceptions, *_mined_exceptions(sample, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for b in batches:
            x = [matcher.measures(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1)], ["a", "b", "label"]
            )

    rows = sorted(tuple(r) for r in sample.mapInArrow(run, "a double, b double, label int").collect())
    scratch.drop_all_but()
    data = np.array(rows)
    weights = fit_logistic(data[:, :2], data[:, 2], l2=0.1)
    return lexicon, exceptions, weights


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*model[:2]) if model else None
        for b in batches:
            if model:
                x = np.array([matcher.measures(t.as_py()) for t in b.column(1)]).reshape(-1, 2)
                out = sigmoid(x @ model[2][:2] + model[2][2])
            else:
                out = np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns only where crc32(doc_id) mod 3 is not 1."""
    model = train(docs, labels.where(fold_of("doc_id", 3) != 1))
    return score(docs, model).select(
        "doc_id",
        (fold_of("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
