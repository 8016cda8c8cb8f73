"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 2- to 4-grams of lower-cased words with their borders, hashed to
``BUCKETS`` rows of an embedding table. The mean embedding of a text goes through a
linear softmax; table and softmax are fitted together by mini-batch stochastic gradient
descent in numpy on a bounded sample. A temperature fitted on held-back documents
calibrates the score, and the score below which 0.5 % of the right answers fall is the
rejection limit. As everything after the hash is linear, prediction averages rows of one
precomputed (bucket, language) table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_by

BUCKETS, SIZE = 1 << 16, 12
#: Bounds of the fitting sample.
FIT_ROWS, FIT_BYTES = 3000, 12_000_000
PASSES, BATCH, CHUNK, RATE = 4, 64, 240, 2.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACED = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased, other ASCII as single spaces, and a space at both ends."""
    return b" " + b" ".join((text or "").encode().translate(_SPACED).split()) + b" "


def subwords(data: bytes) -> np.ndarray:
    """Buckets of the 2- to 4-grams that have no border inside."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, inner = [], b != 32
    h, ok = b * np.uint32(0x01000193), None
    for n in (2, 3, 4):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * np.uint32(0x01000193)
        if n == 2:
            keep = inner[:-1] | inner[1:]
        else:
            ok = inner[1 : len(b) - 1] if n == 3 else ok[:-1] & inner[2 : len(b) - 1]
            keep = ok
        x = h + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        out.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16))[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    """Languages, the (bucket, language) table, bias, temperature, and the rejection limit."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, text: str | None) -> np.ndarray:
        grams = subwords(plain(text))
        return self.bias + (self.table[grams].mean(0) if len(grams) else 0)

    def scores(self, text: str | None) -> np.ndarray:
        z = self.logits(text).astype(float) * self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(sample: pd.DataFrame, seed: int = 7) -> LanguageModel:
    """A model of the sample's (text, lang); every fifth row calibrates. Without rows there are no languages."""
    languages = sorted(sample["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng, known = np.random.default_rng(seed), {x: i for i, x in enumerate(languages)}
    chunks, labels = [], []
    back = sample.iloc[4::5] if len(sample) >= 50 else sample
    for text, lang in zip(*(sample.drop(back.index)[c] for c in ("text", "lang")), strict=True) if len(sample) >= 50 else zip(sample["text"], sample["lang"], strict=True):
        data = plain(text)
        for at in range(0, len(data), CHUNK):
            if len(g := subwords(data[at : at + CHUNK])):
                chunks.append(g)
                labels.append(known[lang])
    y, n = np.array(labels, int), len(languages)
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.3, (SIZE, n)), np.zeros(n)
    steps = max(1, PASSES * -(-len(chunks) // BATCH))
    step = 0
    for _ in range(PASSES):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            these = order[at : at + BATCH]
            sizes = np.array([len(chunks[i]) for i in these])
            flat, starts = np.concatenate([chunks[i] for i in these]), np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None]
            z = hidden @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(these)), y[these]] -= 1
            rate = RATE * (1 - step / steps)
            down = p @ weights.T
            weights -= rate * hidden.T @ p / len(these)
            bias -= rate * p.mean(0)
            # the mean's share of each subword is small, so its rate is taken per document, not per batch
            each = np.repeat(-rate * down / sizes[:, None], sizes, axis=0)
            used, place = np.unique(flat, return_inverse=True)
            table[used] += np.stack([np.bincount(place, each[:, k]) for k in range(SIZE)], 1).astype(np.float32)
            step += 1
    model = LanguageModel(languages, (table @ weights).astype(np.float32), bias)
    z, truth = np.stack([model.logits(t) for t in back["text"]]), back["lang"].map(known).to_numpy()
    best = np.inf
    for t in np.geomspace(0.25, 16, 25):
        s = z * t
        s = s - s.max(1, keepdims=True)
        p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(z)), truth], 1e-12)).mean()
        if loss < best - 1e-6:
            right = p.argmax(1) == truth
            best, model.temperature, model.limit = loss, float(t), float(np.quantile(p.max(1)[right], 0.005)) if right.any() else 0.0
    return model


def train(docs: DataFrame, usable: Column, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> LanguageModel:
    """Fit on a bounded sample, dealt over the languages, of the rows that are ``usable`` and have a language and a text."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return fit(bounded_by(rows.select(key, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "lang", key, "text", most_rows, most_bytes))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, rejected.

    ``lang_pred`` is the likeliest language and ``score`` its calibrated probability;
    ``rejected`` marks scores below the model's limit. A text that is null or has no
    letter is ``und`` with score 0, rejected; so is every text under a model without
    languages. Repeated rows are each answered; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for whole in batches:
            names, scores = [], []
            for text in whole.column("text"):
                value = text.as_py()
                if not m.languages or not value or not _LETTER.search(value):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = m.scores(value)
                k = int(p.argmax())
                names.append(m.languages[k])
                scores.append(float(p[k]))
            low = [n == UNKNOWN or s < m.limit for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([whole.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)
