"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are binned measures of the line itself
(letter case, symbols, punctuation, repetition, word lengths, earlier equal lines) and of
the lines before and after it; the chain adds a weight for each pair of neighbouring
labels. A document's quality is the mean of its lines' marginal probabilities of
"good", from forward-backward, weighted by line length; its score is that mean on a logistic scale,
fitted to the documents' labels.

Only documents have labels, so those of lines are weak: a regression on single lines starts from
the document's label, and lines that clearly look like the other kind are relabelled, as long as
they are no more than half of their document. The field is fitted to these by L-BFGS; ``PAIR_SHRINK`` keeps
the pair weights from growing with the sample where labels hardly ever change, so that a few bad lines can be told in a good text.

Both are fitted on the driver, on a sample of fixed size: at most ``SAMPLE`` labelled documents of each
class and ``TRAIN_LINES`` lines of each, of a longer document a run of lines from a place that its id
gives. Scoring reads whole texts; ``label_lines`` gives the lines' labels.

Edge cases: null and empty texts are one empty line and get the score of such a line;
null or unknown labels aren't trained on; where rows of one doc_id differ, the least text is;
held_out is null for a null doc_id; without labels of both classes every score is
0.5; equal rows get equal scores; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, labelled
from .numeric import fit_logistic, minimize, sigmoid

#: Bounds of the sample that the field is fitted on.
SAMPLE = {0: 1500, 1: 1500}
TRAIN_LINES = 400
#: Shrinkage of the pair weights for each pair; certainty from which a line is relabelled, and rounds of that.
PAIR_SHRINK, SURE, ROUNDS = 0.02, 0.85, 2
#: Characters that are looked at together; a longer text is a batch of its own.
CHUNK = 2 << 20
THRESHOLD = 0.3

#: Character classes.
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _PIPE, _OTHER = range(8)
_BINS = (0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8)
#: Measures of a line, each with its bin edges.
MEASURES = {
    "upper": _BINS, "digit": _BINS, "space": _BINS, "stop": _BINS, "mark": _BINS, "pipe": _BINS, "other": _BINS,
    "distinct": (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "echo": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "mean_word": (2, 3, 4, 5, 6, 7, 9, 12),
    "again": (0.5,),
}
#: Measures of the neighbours that a line sees.
SEEN = ("upper", "stop", "mark", "pipe", "distinct", "echo")
_NAMES = list(MEASURES)
_WIDTH = 10  # bins of a measure, and one for "there is no such line"
N_FEATURES = _WIDTH * (len(_NAMES) + 2 * len(SEEN))


def _classes() -> np.ndarray:
    out = np.full(0x300, _OTHER, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        if c.isupper():
            out[i] = _UPPER
        elif c.islower() or c.isalpha():
            out[i] = _LOWER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isspace():
            out[i] = _SPACE
    for chars, k in ((".,;:'\"()-", _STOP), ("!?#*$%&<>{}[]=+@^~_/\\", _MARK), ("|", _PIPE)):
        out[[ord(c) for c in chars]] = k
    return out


_CLASS = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, characters of each line, lines of each text).

    features[i] are the numbers of the features that line i has.
    """
    per_text = [t.split("\n") for t in texts]
    lines = [x for ls in per_text for x in ls]
    counts = np.array([len(ls) for ls in per_text])
    chars = np.array([len(x) for x in lines])
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(codes, len(_CLASS) - 1)]
    # letters of other scripts count as lower case
    kind[codes >= len(_CLASS)] = _LOWER
    begin = np.concatenate(([0], np.cumsum(chars + 1)[:-1]))
    share = {}
    for name, k in (("upper", _UPPER), ("digit", _DIGIT), ("space", _SPACE), ("stop", _STOP), ("mark", _MARK), ("pipe", _PIPE), ("other", _OTHER)):
        total = np.concatenate(([0], np.cumsum(kind == k)))
        share[name] = (total[begin + chars] - total[begin]) / np.maximum(chars, 1)
    n_words, distinct, echo, again = (np.zeros(len(lines)) for _ in range(4))
    at = 0
    for ls in per_text:
        before: set[str] = set()
        for x in ls:
            words = x.split()
            n = len(words)
            if n:
                n_words[at] = n
                distinct[at] = len(set(words)) / n
                echo[at] = sum(map(str.__eq__, words, words[1:])) / n
                again[at] = x in before
                before.add(x)
            at += 1
    share |= {
        "distinct": distinct, "echo": echo, "words": n_words, "again": again,
        "mean_word": chars / np.maximum(n_words, 1),
    }
    bins = {name: np.searchsorted(MEASURES[name], share[name], "right") for name in _NAMES}
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    cols = [bins[name] for name in _NAMES]
    for name in SEEN:
        cols.append(np.where(first, _WIDTH - 1, np.roll(bins[name], 1)))
        cols.append(np.where(last, _WIDTH - 1, np.roll(bins[name], -1)))
    features = np.stack(cols, 1) + _WIDTH * np.arange(len(cols))
    return features, chars, counts


def forward_backward(emission: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
    """(log normalizer of each text, P(good) of each line, sum of the pair marginals).

    emission: log weight of "good" over "bad" of each line; pairs: 2 x 2 log weights of
    neighbouring labels. All texts take a step together, longest first.
    """
    n, begin = len(emission), np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    sizes, begin_o = counts[order], begin[order]
    node = np.stack([np.zeros(n), emission], 1)
    alpha, beta = node.copy(), np.zeros((n, 2))
    most = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, most + 1), "right")  # texts with more than t lines
    for t in range(1, most):
        i = begin_o[: live[t]] + t
        alpha[i] = node[i] + np.logaddexp(alpha[i - 1, :1] + pairs[0], alpha[i - 1, 1:] + pairs[1])
    for t in range(most - 2, -1, -1):
        i = begin_o[: live[t + 1]] + t
        x = node[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(x[:, :1] + pairs[:, 0], x[:, 1:] + pairs[:, 1])
    end = begin + counts - 1
    log_z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    per_line = np.repeat(log_z, counts)
    good = np.exp(np.minimum(0.0, alpha[:, 1] + beta[:, 1] - per_line))
    inner = np.ones(n, bool)
    inner[begin] = False
    j = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = np.exp(alpha[j - 1, a] + pairs[a, b] + node[j, b] + beta[j, b] - per_line[j]).sum()
    return log_z, good, pair


def line_labels_of(features: np.ndarray, chars: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A weak label for each line, from the documents' labels and the line's own measures (not its neighbours')."""
    features = features[:, : len(MEASURES)]
    own, doc = np.repeat(labels, counts), np.repeat(np.arange(len(counts)), counts)
    weight, n, out = np.repeat(1.0 / counts, counts), N_FEATURES, own.copy()
    size = np.maximum(chars, 1)
    half = np.bincount(doc, size)[doc] / 2
    for _ in range(ROUNDS):

        def loss(w, y=out):
            z = w[features].sum(1) + w[n]
            miss = weight * (sigmoid(z) - y)
            grad = np.append(np.bincount(features.ravel(), np.repeat(miss, features.shape[1]), n) + 0.1 * w[:n], miss.sum())
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * (w[:n] ** 2).sum()), grad

        w = minimize(loss, np.zeros(n + 1), 40)
        p = sigmoid(w[features].sum(1) + w[n])
        other = np.where(own == 1, 1 - p, p)
        # the surest first, while they are less than half of the document
        order = np.lexsort((-other, doc))
        before = np.cumsum(size[order]) - np.repeat(np.cumsum(np.bincount(doc, size)) - np.bincount(doc, size), counts)
        turned = np.zeros(len(own), bool)
        turned[order] = (other[order] >= SURE) & (before < half[order])
        out = np.where(turned, 1 - own, own)
    return out


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights: one for each feature, a bias, then the 2 x 2 pair weights. labels: of each line, or of each document."""
    line_labels = (labels if len(labels) == counts.sum() else np.repeat(labels, counts)).astype(float)
    n = N_FEATURES
    first = np.zeros(len(line_labels), bool)
    first[np.cumsum(counts) - counts] = True
    seen = np.zeros((2, 2))
    j = np.flatnonzero(~first)
    np.add.at(seen, (line_labels[j - 1].astype(int), line_labels[j].astype(int)), 1)

    def loss(w):
        emission = w[features].sum(1) + w[n]
        log_z, good, pair = forward_backward(emission, counts, w[n + 1 :].reshape(2, 2))
        score = (emission * line_labels).sum() + (seen * w[n + 1 :].reshape(2, 2)).sum()
        miss = good - line_labels
        grad = np.zeros_like(w)
        grad[:n] = np.bincount(features.ravel(), np.repeat(miss, features.shape[1]), n)
        grad[n] = miss.sum()
        grad[n + 1 :] = (pair - seen).ravel()
        shrink = np.full(len(w), l2)
        shrink[n], shrink[n + 1 :] = 0, l2 + PAIR_SHRINK * len(j)
        return log_z.sum() - score + 0.5 * (shrink * w**2).sum(), grad + shrink * w

    return minimize(loss, np.zeros(n + 5), 60)


def document_scores(texts: list[str], weights: np.ndarray | None) -> np.ndarray:
    """Score of each text: marginals of its lines, weighted by their lengths."""
    if weights is None:
        return np.full(len(texts), 0.5)
    features, chars, counts = line_features(texts)
    emission = weights[features].sum(1) + weights[N_FEATURES]
    _, good, _ = forward_backward(emission, counts, weights[N_FEATURES + 1 : N_FEATURES + 5].reshape(2, 2))
    return _scaled(_means(good, chars, counts), weights)


def _means(good: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    begin, w = np.cumsum(counts) - counts, np.maximum(chars, 1)
    return np.clip(np.add.reduceat(good * w, begin) / np.add.reduceat(w, begin), 0, 1)


def _scaled(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The means on the logistic scale that follows the pair weights, if there is one."""
    return means if len(weights) == N_FEATURES + 5 else sigmoid(weights[-2] * means + weights[-1])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> np.ndarray | None:
    """Weights from labelled documents; rows of labels are given as (doc_id, target)."""
    chosen = bounded_sample(labelled(labels, target), SAMPLE)
    texts = docs.select("doc_id", "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t, label in zip(*b.columns):
                features, chars, _ = line_features([t.as_py()])
                a = zlib.crc32(str(key.as_py()).encode()) % (len(features) - TRAIN_LINES) if len(features) > TRAIN_LINES else 0
                features, chars = features[a : a + TRAIN_LINES], chars[a : a + TRAIN_LINES]
                yield pa.RecordBatch.from_pydict(
                    {"label": pa.array([label.as_py()], pa.int32()), "n": pa.array([len(features)], pa.int32()),
                     "features": pa.array([features.astype(np.int16).tobytes()], pa.binary()),
                     "chars": pa.array([chars.astype(np.int64).tobytes()], pa.binary())}
                )

    # the sample's rows are at most sum(SAMPLE), so the broadcast has a bound
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .mapInArrow(run, "label int, n int, features binary, chars binary")
        .collect()
    )
    if len({r.label for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.label, r.n, bytes(r.features), bytes(r.chars)))
    features = np.concatenate([np.frombuffer(r.features, np.int16).reshape(r.n, -1) for r in rows]).astype(np.int64)
    chars = np.concatenate([np.frombuffer(r.chars, np.int64) for r in rows])
    counts, known = np.array([r.n for r in rows]), np.array([r.label for r in rows])
    weights = fit(features, counts, line_labels_of(features, chars, counts, known))
    _, good, _ = forward_backward(weights[features].sum(1) + weights[N_FEATURES], counts, weights[N_FEATURES + 1 :].reshape(2, 2))
    scale = fit_logistic(_means(good, chars, counts)[:, None], known, l2=0.05)
    return np.append(weights, [max(scale[0], 1e-3), scale[1]])


def _batch_scores(texts: pa.Array, weights: np.ndarray | None) -> np.ndarray:
    out, part, size = [np.empty(0)], [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= CHUNK:
            out.append(document_scores(part, weights))
            part, size = [], 0
    if part:
        out.append(document_scores(part, weights))
    return np.concatenate(out)


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_batch_scores(b.column(1), weights))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def label_lines(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, line, probability, good): every line, numbered from 0, with its marginal probability and its label."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column(0), b.column(1)):
                features, _, counts = line_features([t.as_py() or ""])
                good = np.full(len(features), 0.5)
                if weights is not None:
                    emission = weights[features].sum(1) + weights[N_FEATURES]
                    _, good, _ = forward_backward(emission, counts, weights[N_FEATURES + 1 : N_FEATURES + 5].reshape(2, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(good), b.schema.field(0).type), pa.array(np.arange(len(good))), pa.array(good), pa.array(good >= 0.5)],
                    ["doc_id", "line", "probability", "good"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line bigint, probability double, good boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; trained as in classify."""
    weights = train(docs, labels.where(fold_of("doc_id", 5) != 0))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_batch_scores(b.column(at), weights) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns only where crc32(doc_id) mod 5 is not 0."""
    weights = train(docs, labels.where(fold_of("doc_id", 5) != 0))
    return score(docs, weights).select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
