"""Toxic spans by a linear-chain conditional random field.

Labels belong to documents. Tokens of toxic documents are labelled toxic where their word or one of its prefixes stands
far more often in toxic than in other documents of the training sample. The field has hashed features of the word and
of its prefixes and learns emissions and transitions by gradient steps on the exact log-likelihood. Forward-backward
marginals then mark spans, and a logistic curve over the largest and the summed marginal gives a document's score.

A text is cut into sequences of ``SEQUENCE`` words; all words of all texts are tagged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.frames import map_arrow
from anchorline.llm.kernels import (
    CHUNK, RangeHash, byte_codes, joined_bytes, lower_bytes, powers, ranges, slices_of, word_bounds,
)
from anchorline.llm.samples import bounded_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE, PREFIXES, SLOTS = 64, (4, 5, 6), 1 << 18
TEXTS_PER_LABEL = 2000  # bound of the training sample
SEQUENCES_PER_TEXT = 64  # of a training text, evenly spread
CLEAN_SEQUENCES = 12_000  # bound of the sequences without a toxic token that the field learns from, drawn at random
ODDS, HOLDERS, HOLDER_SHARE = 20.0, 3, 0.01  # a token counts as toxic from these odds and this many toxic texts on
SLICE_BYTES = 2 << 20


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slots of the word and of its prefixes; SLOTS stands for a prefix that the word is too short for."""
    table, scale = byte_codes(), powers(CHUNK + 1)
    out = np.full((len(starts), 1 + len(PREFIXES)), SLOTS, np.int32)
    for a, b in slices_of(np.append(starts, len(data)), CHUNK) if len(starts) else ():
        lo = starts[a]
        found = RangeHash(table[data[lo : ends[b - 1]]], scale)
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b, 0] = found.of(s, e) % np.uint64(SLOTS)
        for k, size in enumerate(PREFIXES):
            long = e - s >= size
            salt = np.uint64(0x9E37 * (k + 1))
            out[a:b, 1 + k][long] = (found.of(s[long], s[long] + size) + salt) % np.uint64(SLOTS)
    return out


@dataclass
class Sequences:
    """Words laid out as sequences x SEQUENCE; ``real`` marks places that hold a word."""

    cell: np.ndarray  # word number of each place
    real: np.ndarray
    text: np.ndarray  # text of each sequence

    @classmethod
    def of(cls, upto: np.ndarray) -> Sequences:
        words = np.diff(upto)
        count = -(-words // SEQUENCE)
        text = np.repeat(np.arange(len(words)), count)
        first = upto[:-1][text] + ranges(np.zeros(len(words), np.int64), count) * SEQUENCE
        cell = first[:, None] + np.arange(SEQUENCE)
        real = cell < upto[1:][text][:, None]
        return cls(np.where(real, cell, 0), real, text)


@dataclass
class Field:
    weights: np.ndarray  # SLOTS + 1; the last one is 0
    bias: float
    transition: np.ndarray  # 2 x 2
    curve: np.ndarray  # of the document score

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=-1) + self.bias

    def marginals(self, emission: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        """P(toxic) per place by forward-backward, in log odds; also the messages from both sides."""
        (t00, t01), (t10, t11) = self.transition
        left, right = np.zeros_like(emission), np.zeros_like(emission)
        for t in range(1, emission.shape[1]):
            odds = left[:, t - 1] + emission[:, t - 1]
            left[:, t] = np.logaddexp(t01, odds + t11) - np.logaddexp(t00, odds + t10)
        for t in range(emission.shape[1] - 2, -1, -1):
            odds = right[:, t + 1] + emission[:, t + 1]
            right[:, t] = np.where(real[:, t + 1], np.logaddexp(t10, odds + t11) - np.logaddexp(t00, odds + t01), 0)
        with np.errstate(over="ignore"):
            return np.where(real, 1 / (1 + np.exp(-(left + emission + right))), 0), left, right

    def score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        x = document_inputs(largest, total) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def document_inputs(largest: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Inputs of the document curve; a text without words has both at 0."""
    top = np.clip(largest, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log1p(total)], axis=1)


def likely_sum(p: np.ndarray) -> np.ndarray:
    """Sum of the marginals of at least a tenth, so that length alone adds nothing."""
    return np.where(p >= 0.1, p, 0).sum(axis=1)


def toxic_words(features: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels: whether a word of a toxic text has a feature with high odds."""
    out = np.zeros(len(features), bool)
    marked = toxic[text]
    for k in range(features.shape[1]):
        pairs = np.unique(features[:, k].astype(np.int64) * len(toxic) + text)
        slot, holder = pairs // len(toxic), toxic[pairs % len(toxic)]
        with_it = np.bincount(slot[holder], minlength=SLOTS + 1)
        without = np.bincount(slot[~holder], minlength=SLOTS + 1)
        odds = ((with_it + 0.5) / (toxic.sum() + 1)) / ((without + 0.5) / ((~toxic).sum() + 1))
        strong = (odds >= ODDS) & (with_it >= max(HOLDERS, HOLDER_SHARE * toxic.sum()))
        strong[SLOTS] = False
        out |= marked & strong[features[:, k]]
    return out


def fit_field(features: np.ndarray, upto: np.ndarray, toxic: np.ndarray, epochs: int = 6, seed: int = 11) -> Field:
    rng = np.random.default_rng(seed)
    field = Field(np.zeros(SLOTS + 1), -3.0, np.zeros((2, 2)), np.array([-2.0, 0.5, 0.0]))
    text = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    label = toxic_words(features, text, toxic)
    laid = Sequences.of(upto)
    tag = label[laid.cell] & laid.real
    rich = np.flatnonzero(tag.any(axis=1))
    plain = np.flatnonzero(~tag.any(axis=1))
    plain = rng.permutation(plain)[:CLEAN_SEQUENCES]
    chosen = np.concatenate([rich, plain])
    memory = {k: np.full_like(getattr(field, k), 1e-8, dtype=float) for k in ("weights", "transition")}
    bias_memory = 1e-8
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 512)):
            slots, real, y = features[laid.cell[at]], laid.real[at], tag[at]
            emission = field.emissions(slots)
            p, left, right = field.marginals(emission, real)
            wrong = np.where(real, p - y, 0) / len(at)
            grad = np.bincount(slots.ravel(), np.repeat(wrong.ravel(), slots.shape[-1]), SLOTS + 1)
            grad[SLOTS] = 0
            # expected minus seen transitions
            both = real[:, 1:]
            before, after = left[:, :-1] + emission[:, :-1], right[:, 1:] + emission[:, 1:]
            joint = np.stack([field.transition[i, j] + i * before + j * after for i in (0, 1) for j in (0, 1)])
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            seen = y[:, :-1].astype(int) * 2 + y[:, 1:]
            step = np.array([((joint[k] - (seen == k)) * both).sum() for k in range(4)]).reshape(2, 2) / len(at)
            for name, g in (("weights", grad + 1e-6 * field.weights), ("transition", step)):
                memory[name] += g * g
                getattr(field, name).__isub__(0.5 * g / np.sqrt(memory[name]))
            bias_memory += wrong.sum() ** 2
            field.bias -= 0.1 * wrong.sum() / np.sqrt(bias_memory)
    largest, total = document_sums(field, features, laid, len(toxic))
    field.curve = logistic(document_inputs(largest, total), toxic)
    return field


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def document_sums(field: Field, features: np.ndarray, laid: Sequences, texts: int) -> tuple[np.ndarray, np.ndarray]:
    largest, total = np.zeros(texts), np.zeros(texts)
    for a in range(0, len(laid.text), 2048):
        at = slice(a, a + 2048)
        p, _, _ = field.marginals(field.emissions(features[laid.cell[at]]), laid.real[at])
        np.maximum.at(largest, laid.text[at], p.max(axis=1))
        np.add.at(total, laid.text[at], likely_sum(p))
    return largest, total


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    texts_each: int = TEXTS_PER_LABEL,
) -> Field | None:
    """Fit on at most ``texts_each`` documents per label, at most SEQUENCES_PER_TEXT sequences of each.

    Rows without id, label or text are left out; if an id or a text is labelled twice, the larger label holds; equal
    texts count once. The sampled ids are few by that bound and are broadcast, so texts of other documents do not move. None if one
    of the labels is missing.

    The bound takes a smaller share of the larger label, so the document curve is moved back to the shares of the labels
    among all labelled ids. Marginals are not: where CLEAN_SEQUENCES leaves sequences out, toxic tokens are rarer in the
    corpus than the field has seen, and more words pass a half; the curve is fitted on these same marginals.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(
        F.max(F.col(toxic).cast("int")).alias("__toxic")
    )
    known = known.select("__id", (F.col("__toxic") > 0).cast("int").alias("__toxic"))
    labelled = dict(known.groupBy("__toxic").count().collect())
    picked = bounded_sample(known, "__toxic", ["__id"], texts_each)
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(
        F.broadcast(picked), F.col("__doc") == F.col("__id")
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = joined_bytes(batch.column(0))
            starts, ends, upto = word_bounds(data, bounds)
            texts = []
            for i in range(len(bounds) - 1):
                a, b = upto[i], upto[i + 1]
                if b - a > SEQUENCE * SEQUENCES_PER_TEXT:
                    firsts = np.linspace(a, b - SEQUENCE, SEQUENCES_PER_TEXT).astype(int)
                    texts.append(b"\n".join(data[starts[f] : ends[f + SEQUENCE - 1]].tobytes() for f in firsts))
                else:
                    texts.append(data[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()), "toxic": batch.column(1)})

    found: dict[bytes, int] = {}  # of equal texts with different labels the larger one stands
    for r in map_arrow(rows.select("__text", "__toxic"), cut, "text binary, toxic int").collect():
        found[bytes(r[0])] = max(r[1], found.get(bytes(r[0]), 0))
    texts = sorted(t for t in found if t)
    toxic_flag = np.array([found[t] > 0 for t in texts], bool)
    if toxic_flag.all() or not toxic_flag.any():
        return None
    data = lower_bytes(np.frombuffer(b"".join(texts), np.uint8))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, upto = word_bounds(data, bounds)
    field = fit_field(word_features(data, starts, ends), upto, toxic_flag)
    # the part of each label's ids that the sample took
    clean_part, toxic_part = (min(1.0, texts_each / labelled[k]) for k in (0, 1))
    field.curve[0] += np.log(clean_part / toxic_part)
    return field


def tag_documents(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, score, prediction, and the byte ranges of words whose marginal is at least a half.

    Null and empty texts get the score of a text without words; without a model every score is 0. Narrow: one pass, no
    shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = joined_bytes(batch.column(1))
            scores, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for a, b in slices_of(bounds, SLICE_BYTES) if field else ():
                own = lower_bytes(data[bounds[a] : bounds[b]])
                starts, ends, upto = word_bounds(own, bounds[a : b + 1] - bounds[a])
                features = word_features(own, starts, ends)
                laid = Sequences.of(upto)
                largest, total = np.zeros(b - a), np.zeros(b - a)
                for c in range(0, len(laid.text), 1024):
                    at = slice(c, c + 1024)
                    p, _, _ = field.marginals(field.emissions(features[laid.cell[at]]), laid.real[at])
                    np.maximum.at(largest, laid.text[at], p.max(axis=1))
                    np.add.at(total, laid.text[at], likely_sum(p))
                    for s, t in zip(*np.nonzero(p >= 0.5), strict=True):
                        row, word = laid.text[at][s], laid.cell[at][s, t]
                        shift = bounds[a + row] - bounds[a]
                        spans[a + row].append({"start": int(starts[word] - shift), "end": int(ends[word] - shift)})
                scores[a:b] = field.score(largest, total)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0), "score": scores,
                    "predicted": pa.array((scores >= threshold).astype(np.int32)),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
            )

    return map_arrow(rows, tag, f"doc_id {kind}, score double, predicted int, spans array<struct<start:long,end:long>>")
