"""Language of texts by a convolutional network over bytes.

Every text is cut into windows of ``WINDOW`` bytes. Bytes are embedded, filters of several widths run over them, each
filter keeps its largest value, and a softmax layer gives a probability per language; a text's probabilities are the
mean over its windows. The network is trained in numpy on a bounded sample of labelled texts.

The network has no answer for what it never saw: it gives noise and other languages probabilities as high as its own
texts get. ``LetterRuns`` tells them apart: the likelihood of a text's letters, each after the two bytes before it, as
counted in the same sample over all languages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from anchorline.llm.frames import fresh_name, map_arrow
from anchorline.llm.kernels import joined_bytes, lower_bytes, ranges, slices_of
from anchorline.llm.samples import bounded_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, EMBEDDING, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
REACH = max(WIDTHS)
TEXTS_PER_LANGUAGE = 1000  # bound of the training sample
WINDOWS_PER_TEXT = 4
UNKNOWN = "und"
SURE = 0.95  # score from which on a language found replaces another; none of those of sf0.01 and sf0.1
SLICE_BYTES, WINDOWS_AT_ONCE = 4 << 20, 64
# Least mean log likelihood of a letter and least share of letters. On the given tables held-out labelled texts have -3.24
# and 0.38 at the least, planted texts of other languages and random letters -5.7 at the most, digits and symbols with one
# letter a share under 0.001. DOUBT lets texts of few letters pass, as a key of random letters can be half of them.
LEAST_LIKELY, LEAST_LETTERS, DOUBT = -4.5, 0.05, 60.0
LETTER_CODES = np.zeros(256, np.int32)  # 0 for all that is no letter
LETTER_CODES[97:123] = np.arange(1, 27)
LETTER_CODES[128:] = np.arange(27, 155)
CODES = 155


@dataclass
class LetterRuns:
    """Counts of three codes in a row, for those that occur."""

    triple: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray) -> LetterRuns:
        code = LETTER_CODES[lower_bytes(windows.ravel())].reshape(windows.shape)
        return cls(*np.unique((code[:, :-2] * CODES + code[:, 1:-1]) * CODES + code[:, 2:], return_counts=True))

    def table(self) -> np.ndarray:
        """Log likelihood of the last code of every triple; rare contexts lean on shorter ones."""
        three = np.bincount(self.triple, self.count, CODES**3).astype(np.float32).reshape(CODES, CODES, CODES)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        likely = (two + 8 * (one + 0.5) / (one.sum() + 0.5 * CODES)) / (two.sum(axis=1, keepdims=True) + 8)
        before = three.sum(axis=2, keepdims=True)
        three += 4 * likely
        three /= before + 4
        return np.log(three, out=three).ravel()


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING; byte 0 pads and stays zero
    filters: np.ndarray  # REACH * EMBEDDING x filters; rows beyond a filter's width stay zero
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    runs: LetterRuns | None = None

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two neighbouring bytes add to every filter, at the filter's front and behind it."""
        own = [self.embedding @ self.filters[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(REACH)]
        return tuple((own[j][:, None] + own[j + 1][None]).reshape(65536, -1).astype(np.float32) for j in (0, 2))

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        n, (front, back) = len(windows), tables
        pooled = np.empty((n, front.shape[1]), np.float32)
        for a in range(0, n, WINDOWS_AT_ONCE):
            w = windows[a : a + WINDOWS_AT_ONCE].astype(np.int32)
            pairs = (w[:, :-1] << 8) | w[:, 1:]
            places = WINDOW - REACH + 1
            value = front[pairs[:, :places]]
            value += back[pairs[:, 2 : 2 + places]]
            pooled[a : a + len(w)] = value.max(axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        score = hidden @ self.weights + self.offset
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, seed: int = 7) -> ByteNetwork:
    """Fit by Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(REACH) < w, EMBEDDING)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)),
        "filters": rng.normal(0, 0.25, (REACH * EMBEDDING, total)) * mask,
        "bias": np.zeros(total),
        "weights": rng.normal(0, 0.1, (total, len(languages))),
        "offset": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embedding"][0] = 0
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, places = 0, WINDOW - REACH + 1
    for _ in range(epochs if len(languages) > 1 else 0):
        shuffled = rng.permutation(len(windows))
        for a in range(0, len(shuffled), 128):
            at = shuffled[a : a + 128]
            w, y = windows[at], labels[at]
            x = p["embedding"][w]
            columns = np.lib.stride_tricks.sliding_window_view(x.reshape(len(w), -1), REACH * EMBEDDING, axis=1)
            columns = np.ascontiguousarray(columns[:, ::EMBEDDING])
            value = columns.reshape(-1, REACH * EMBEDDING) @ p["filters"]
            value = value.reshape(len(w), places, total)
            best = value.argmax(axis=1)
            pooled = np.take_along_axis(value, best[:, None], 1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            score = hidden @ p["weights"] + p["offset"]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            score /= score.sum(axis=1, keepdims=True)
            score[np.arange(len(w)), y] -= 1
            score /= len(w)
            back = (score @ p["weights"].T) * (pooled > 0)
            picked = columns[np.arange(len(w))[:, None], best]  # texts x filters x inputs
            into = (back[:, :, None] * p["filters"].T[None]).reshape(len(w), total, REACH, EMBEDDING)
            byte = np.stack([w[np.arange(len(w))[:, None], best + j] for j in range(REACH)], axis=2)
            grad = {
                "embedding": np.stack(
                    [np.bincount(byte.ravel(), into[..., e].ravel(), 256) for e in range(EMBEDDING)], axis=1
                ),
                "filters": np.einsum("bf,bfk->kf", back, picked) * mask,
                "bias": back.sum(0),
                "weights": hidden.T @ score,
                "offset": score.sum(0),
            }
            grad["embedding"][0] = 0
            step += 1
            for k, g in grad.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                move = m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
                p[k] -= (0.003 * move).astype(np.float32)
    return ByteNetwork(languages, *(p[k] for k in ("embedding", "filters", "bias", "weights", "offset")))


def window_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover each text: text number and first byte. The last window ends with the text."""
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    first = ranges(np.zeros(len(sizes), np.int64), count) * WINDOW
    return text, np.minimum(first, np.maximum(sizes[text] - WINDOW, 0))


def cut_windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Windows of WINDOW bytes, padded with 0 behind short texts."""
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    short = np.flatnonzero(size < WINDOW)
    if len(short):
        out[short] = np.where(np.arange(WINDOW) < size[short, None], out[short], 0)
    return out


def training_windows(texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` windows of each text, evenly spread."""
    data, bounds = joined_bytes(texts)
    sizes = np.diff(bounds)
    count = np.minimum(-(-sizes // WINDOW), most)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = ranges(np.zeros(len(sizes), np.int64), count)
    room = np.maximum(sizes[text] - WINDOW, 0)
    first = room * nth // np.maximum(count[text] - 1, 1)
    return text, cut_windows(data, bounds[text] + first, sizes[text])


def fit_language(labelled: DataFrame, text: str = "text", lang: str = "lang", texts_each: int = TEXTS_PER_LANGUAGE) -> ByteNetwork | None:
    """A network for the languages of ``labelled``; rows without text or label are left out. At most ``texts_each``
    texts of a language, and WINDOWS_PER_TEXT windows of a text, reach the driver. None if nothing is labelled."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text <> '' AND lang IS NOT NULL")
    picked = bounded_sample(rows, "lang", ["text"], texts_each)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, windows = training_windows(batch.column(0), WINDOWS_PER_TEXT)
            yield pa.RecordBatch.from_pydict(
                {"lang": batch.column(1).take(pa.array(number)), "bytes": pa.array([w.tobytes() for w in windows], pa.binary())}
            )

    found = sorted(tuple(r) for r in map_arrow(picked.select("text", "lang"), cut, "lang string, bytes binary").collect())
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    windows = np.frombuffer(b"".join(bytes(r[1]) for r in found), np.uint8).reshape(-1, WINDOW)
    model = train(windows, np.array([languages.index(r[0]) for r in found]), languages)
    model.runs = LetterRuns.of(windows)
    return model


def classify(texts: pa.Array, letters: np.ndarray, model: ByteNetwork | None, tables) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text, -1 if there is none, and its mean probability."""
    data, bounds = joined_bytes(texts)
    best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
    for a, b in slices_of(bounds, SLICE_BYTES) if model else ():
        sizes = np.diff(bounds[a : b + 1])
        number, first = window_starts(sizes)
        if not len(number):
            continue
        own = data[bounds[a] : bounds[b]]
        begin = (bounds[a:b] - bounds[a])[number] + first
        sums = np.zeros((b - a, len(model.languages)))
        for c in range(0, len(number), 4096):
            part = slice(c, c + 4096)
            windows = cut_windows(own, begin[part], sizes[number[part]])
            np.add.at(sums, number[part], model.probabilities(windows, tables))
        mean = sums / np.maximum(np.bincount(number, minlength=b - a), 1)[:, None]
        best[a:b], score[a:b] = mean.argmax(axis=1), mean.max(axis=1)
    known = letters & (model is not None)
    return np.where(known, best, -1), np.where(known, np.clip(score, 0, 1), 0.0)


def letter_sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood of the letters of each text, number of bytes that are letters, bytes."""
    data, bounds = joined_bytes(texts)
    total, letters = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for a, b in slices_of(bounds, SLICE_BYTES):
        code = LETTER_CODES[lower_bytes(data[bounds[a] : bounds[b]])]
        if not len(code):
            continue
        own = bounds[a : b + 1] - bounds[a]
        first = own[:-1][np.diff(own) > 0]
        last, before = np.roll(code, 1), np.roll(code, 2)
        last[first] = 0
        before[first] = 0
        before[np.minimum(first + 1, len(code) - 1)] = 0
        is_letter = code > 0
        before *= CODES
        before += last
        before *= CODES
        before += code
        sums = np.concatenate([[0.0], np.cumsum(np.where(is_letter, table[before], 0), dtype=np.float64)])
        total[a:b] = np.diff(sums[own])
        letters[a:b] = np.diff(np.concatenate([[0], np.cumsum(is_letter)])[own])
    return total, letters, np.diff(bounds)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict_language(docs: DataFrame, model: ByteNetwork | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, predicted language, its probability. A text that is null or has no letter is ``und`` with score 0,
    as is every text without a model. Narrow: one pass, no shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), has_letter(text).alias("letters"))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pair_tables() if model else None
        for batch in batches:
            best, score = classify(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), model, tables)
            names = [model.languages[i] if i >= 0 else UNKNOWN for i in best]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": score})

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows, predict, f"doc_id {kind}, lang_pred string, score double")


def keep_known(
    docs: DataFrame, model: ByteNetwork | None, least: float = 0.0, text: str = "text", lang: str | None = None
) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of at least ``least``; all columns stay. A column named
    as ``lang``, of strings, gets the language found where it is null or the score is at least SURE.

    A text has one of the model's languages if it has a letter, LEAST_LETTERS of its bytes are letters, and its letters
    follow one another as in the training texts (LEAST_LIKELY). Texts of a dozen letters or fewer, and of a few dozen in a near language, are too short for
    the last test and pass it. Without a model no row stays.
    """
    flagged = docs.select("*", has_letter(text).alias(fresh_name(docs, "__letters")))
    at, told = docs.columns.index(text), None if lang is None else docs.columns.index(lang)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pair_tables() if model else None
        likely = model.runs.table() if model and model.runs else None
        for batch in batches:
            flags = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            best, score = classify(batch.column(at), flags, model, tables)
            stays = (best >= 0) & (score >= least)
            if likely is not None:
                total, letters, size = letter_sums(batch.column(at), likely)
                stays &= (letters >= LEAST_LETTERS * size) & (total >= LEAST_LIKELY * letters - DOUBT)
            out = batch.select(range(batch.num_columns - 1))
            if told is not None:
                names = [model.languages[i] if i >= 0 else UNKNOWN for i in best]
                found = pc.if_else(pa.array(score >= SURE), pa.array(names, pa.string()), batch.column(told))
                out = out.set_column(told, lang, pc.coalesce(found, pa.array(names, pa.string())))
            yield out.filter(pa.array(stays))

    return map_arrow(flagged, keep, docs.schema)
