"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threatloom.llm.common import map_arrow, text_bytes, written

#: Labels of one labeller: abstains, low, high. A pattern is a number with one base-3 digit a labeller.
ABSTAIN, LOW, HIGH = 0, 1, 2
LABELLERS = ("symbols", "capitals", "marks", "repeats", "dup_lines", "short_lines", "word_length", "sentences", "variety")
#: Documents that the linear scorer learns from: a bounded sample, the first by a hash of the id.
TRAIN_DOCS = 6_000
BUCKETS, ROUNDS = 1 << 18, 150
STEPS = 60
#: Bounds on the labellers: how often a high document may be called low, and the least share of low ones called high.
MOST_FALSE_LOW, LEAST_BLIND = 0.01, 0.4
#: Score from which a document is kept, and words that the prior weighs.
KEEP, PRIOR_WORDS = 0.5, 10

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 57 if 48 <= c < 58 else c for c in range(256))


def _band(value: float, high: float, low: float) -> int:
    """HIGH up to the first limit, LOW from the second, else ABSTAIN."""
    return HIGH if value <= high else LOW if value >= low else ABSTAIN


def votes(text: bytes) -> int:
    """The pattern of all labellers for a text; every labeller abstains on a text without words."""
    words = text.split()
    if not words:
        return 0
    n, chars = len(words), sum(map(len, words))
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    marks = len(text) - len(text.translate(None, _MARKS))
    lines = [s for line in text.split(b"\n") if (s := line.strip())]
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(c for c in triples.values() if c > 1) / max(1, n - 2)
    ends = text.count(b".") + text.count(b"!") + text.count(b"?")
    found = (
        _band(symbols / n, 0.1, 0.4),
        _band(capitals / chars, 0.12, 0.4),
        _band(marks / n, 0.5, 0.9) if n >= 10 else ABSTAIN,
        _band(repeated, 0.15, 0.4) if n >= 40 else ABSTAIN,
        _band(1 - len(set(lines)) / len(lines), 0.1, 0.3) if len(lines) > 5 else ABSTAIN,
        _band(sum(len(s.split()) < 4 for s in lines) / len(lines), 0.4, 0.8) if len(lines) > 3 else ABSTAIN,
        ABSTAIN if n < 20 else HIGH if 3.5 <= chars / n <= 11 else LOW if not 2.5 <= chars / n <= 14 else ABSTAIN,
        HIGH if 0.02 <= ends / n <= 0.3 else LOW if n >= 10 and ends > 0.6 * n or n > 100 and not ends else ABSTAIN,
        ABSTAIN if n < 30 else HIGH if len(set(words)) > 8 * n ** 0.5 or len(set(words)) > 0.4 * n else LOW if len(set(words)) < 2 * n ** 0.5 else ABSTAIN,
    )
    pattern = 0
    for vote in reversed(found):
        pattern = 3 * pattern + vote
    return pattern


def _digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** k % 3 for k in range(len(LABELLERS))], axis=1)


class LabelModel:
    """Labellers that err independently given the true label: where one votes, how often low and high, for low and for high documents.

    Abstaining says nothing, so its rate is 1 for either label.
    """

    def __init__(self, share_high: float, rates: np.ndarray):
        self.share_high, self.rates = share_high, rates  # rates: labeller, label (low, high), vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with this pattern is high."""
        digits = _digits(patterns)
        logs = np.log(np.array([1 - self.share_high, self.share_high])) + sum(np.log(self.rates[k][:, digits[:, k]]).T for k in range(len(LABELLERS)))
        logs -= logs.max(axis=1, keepdims=True)
        share = np.exp(logs)
        return share[:, 1] / share.sum(axis=1)

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        weight = np.array([1 - self.share_high, self.share_high])
        right = weight[0] * self.rates[:, 0, LOW] + weight[1] * self.rates[:, 1, HIGH]
        spoken = (weight[None, :, None] * self.rates[:, :, 1:]).sum(axis=(1, 2))
        return dict(zip(LABELLERS, (right / np.maximum(spoken, 1e-12)).tolist()))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> LabelModel:
    """Fitted to a histogram of patterns, from the start where most votes decide and low needs two or more of them."""
    digits, weight = _digits(patterns), counts / max(1, counts.sum())
    low, high = (digits == LOW).sum(axis=1), (digits == HIGH).sum(axis=1)
    belief = np.where(low >= 2, 0.1, np.where(high > low, 0.9, 0.5))
    model = None
    for _ in range(steps):
        both = np.stack([weight * (1 - belief), weight * belief])
        rates = np.empty((len(LABELLERS), 2, 3))
        for k in range(len(LABELLERS)):
            for vote in range(3):
                rates[k, :, vote] = both[:, digits[:, k] == vote].sum(axis=1)
        rates[:, :, ABSTAIN], rates[:, :, 1:] = 1.0, (rates[:, :, 1:] + 1e-4) / (rates[:, :, 1:] + 1e-4).sum(axis=2, keepdims=True)
        # Low documents are low in few ways each: a labeller seldom calls a high one low, and often finds no fault with a low one.
        rates[:, 1, LOW] = np.minimum(rates[:, 1, LOW], MOST_FALSE_LOW)
        rates[:, 0, HIGH] = np.maximum(rates[:, 0, HIGH], LEAST_BLIND)
        rates[:, :, 1:] /= rates[:, :, 1:].sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip(both[1].sum(), 0.01, 0.99)), rates)
        belief = model.posterior(patterns)
    return model


def _features(word: bytes) -> tuple[int, int, int]:
    """Buckets of the word in lower case, its last four bytes, and its outline (runs of letters, digits and marks)."""
    outline, last = bytearray(), -1
    for c in word.translate(_KIND):
        if c != last:
            outline.append(c)
            last = c
    return tuple(xxhash.xxh64_intdigest(x, k) % BUCKETS for k, x in enumerate((word.lower(), word[-4:], bytes(outline))))


class _Words(dict):
    """A number for each word met; forgotten all at once before it grows large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = found = self.make(word)
        return found


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic regression on posterior labels, in one task over the bounded sample: mean word features, Adagrad on whole passes."""
    rows, columns, values, labels = [], [], [], []
    known = _Words(_features)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or b"").split()
            if not words:
                continue
            counts = Counter(f for w in words for f in known[w])
            rows.append(np.full(len(counts), len(labels)))
            columns.append(np.fromiter(counts.keys(), np.int64, len(counts)))
            values.append(np.fromiter(counts.values(), np.float64, len(counts)) / len(words))
            labels.append(label)
    if not labels:
        return
    row, column, value, label = np.concatenate(rows), np.concatenate(columns), np.concatenate(values), np.array(labels)
    used, column = np.unique(column, return_inverse=True)
    # Both labels weigh the same, whatever their share.
    share = np.clip(label.mean(), 0.01, 0.99)
    cost = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(label)
    weight, bias, past, past_bias = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(ROUNDS):
        score = 1 / (1 + np.exp(-np.bincount(row, weight[column] * value, len(label)) - bias))
        error = (score - label) * cost
        gradient = np.bincount(column, error[row] * value, len(used)) + 1e-7 * weight
        past += gradient ** 2
        past_bias += error.sum() ** 2
        weight -= 1.0 * gradient / np.sqrt(past)
        bias -= 0.3 * error.sum() / np.sqrt(past_bias)
    out = io.BytesIO()
    np.savez(out, used=used, weight=weight, bias=bias)
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])


def fit(docs: DataFrame) -> tuple[LabelModel | None, tuple[np.ndarray, float, float]]:
    """The label model over all rows of ``docs``, and the scorer's weights by bucket, bias and prior log odds.

    Votes of all documents meet as counts of patterns, of which there are at most 3 ** 9; expectation-maximisation runs on that histogram.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([votes(t or b"") for t in batch.column(0).to_pylist()], pa.int64())], ["doc_id", "pattern"])

    voted = written(map_arrow(docs.select(text_bytes(), "doc_id"), vote, "doc_id long, pattern long"), "votes")
    found = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    weights = np.zeros(BUCKETS)
    if not found:
        return None, (weights, 0.0, 0.0)
    patterns = np.array([r["pattern"] for r in found])
    labels = expectation_maximisation(patterns, np.array([r["n"] for r in found], float))
    posterior = docs.sparkSession.createDataFrame(list(zip(patterns.tolist(), labels.posterior(patterns).tolist())), "pattern long, label double")
    sample = voted.select("doc_id", "pattern").orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(TRAIN_DOCS).join(posterior, "pattern").groupBy("doc_id").agg(F.min("label").alias("label"))
    # At most TRAIN_DOCS rows of 16 bytes.
    texts = docs.select("doc_id", text_bytes()).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "text").select("text", "label")
    prior = float(np.log(labels.share_high / (1 - labels.share_high)))
    model = map_arrow(texts.coalesce(1), _train, "model binary").collect()
    if not model:
        return labels, (weights, 0.0, prior)
    saved = np.load(io.BytesIO(model[0]["model"]))
    weights[saved["used"]] = saved["weight"]
    return labels, (weights, float(saved["bias"]), prior)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, score, keep) of every row of ``docs``: the scorer's probability that the document is high, and whether it reaches KEEP.

    Whole texts are scored. The prior counts as PRIOR_WORDS words beside the text's own, so a few words decide little, and a null text or
    one without words has the prior itself. Ties and repeated
    rows score alike; a null doc_id is scored but not learned from. With no documents there is no result.
    """
    _, scorer = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, prior = shared.value
        known = _Words(lambda word: float(weights[list(_features(word))].sum()))
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = (text or b"").split()
                own = sum([known[w] for w in words]) + len(words) * bias
                out.append(1 / (1 + np.exp(-(own + PRIOR_WORDS * prior) / (len(words) + PRIOR_WORDS))))
            scores = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores), pa.array(scores >= KEEP)], ["doc_id", "score", "keep"])

    return map_arrow(docs.select(text_bytes(), "doc_id"), rows, "doc_id long, score double, keep boolean")
