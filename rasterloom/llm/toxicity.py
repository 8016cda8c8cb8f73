"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

Voters are word lists, patterns, and words or word beginnings mined from a bounded
labelled sample, each with an exact binomial tail that is corrected for how many were
tried. A generative label model has one hidden label for each document; every voter has
hit rates under either label, and voters correlate beyond what the label explains. It is
fitted by expectation maximisation over labelled and unlabelled documents alike: the given
labels are one more voter, whose hit rates are estimated as well, and which abstains where
there is none. Correlations that are beyond chance weigh the voters down, so that copies
of a voter count as one. The posteriors of the documents with a given label are the
targets of a logistic regression over the votes, which gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import _SPACED
from .sampling import bounded, limit, place
from .shared import trim

# Insults and slurs of contempt, by list.
LEXICONS = {
    "stupidity": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "brainless", "dimwit"),
    "worth": ("worthless", "pathetic", "loser", "losers", "useless", "failure", "nobody"),
    "filth": ("scum", "trash", "garbage", "filth", "vermin", "disgusting", "vile", "pig"),
    "ridicule": ("clown", "clowns", "joke", "buffoon", "freak", "weirdo"),
    "hate": ("hate", "despise", "loathe"),
    "violence": ("kill", "die", "hang", "shoot", "burn"),
    "german": ("idioten", "dumm", "dummkopf", "trottel", "abschaum", "versager", "arschloch", "ekelhaft"),
    "french": ("crétin", "débile", "connard", "minable", "ordure", "salaud", "imbécile"),
    "spanish": ("idiota", "estúpido", "imbécil", "basura", "asqueroso", "inútil", "cabrón"),
}

# Patterns over the text as it stands.
PATTERNS = {
    "addressed": r"(?i)\byou(?:\s+are|'re|\s+r)?\s+(?:\w+\s+){0,2}(?:idiot|moron|loser|clown|scum|trash|pig|fool|freak)\b",
    "shouting": r"(?:\b[A-Z]{3,}\b[^\w\n]*){6,}",
    "outcry": r"(?:!{2,}.{0,80}){3}",
}

FIT_ROWS, FIT_BYTES = 8000, 24_000_000
#: Bounds of the unlabelled documents that the label model also sees.
FREE_ROWS, FREE_BYTES = 4000, 8_000_000
#: What the given labels' hit rates are before any is seen: hits and misses under either label.
TRUST = ((49.0, 1.0), (1.0, 49.0))
#: Standard errors from which on a correlation counts.
BEYOND_CHANCE = 5.0
#: Lengths, in bytes, of the word beginnings that are mined.
HEADS = (4, 5, 6, 7)
#: Flukes expected among all mined voters; most mined voters.
FLUKE, MOST_MINED = 0.1, 400
THRESHOLD = 0.7


def words(text: str | None) -> set[bytes]:
    """Distinct lower-cased words; ASCII other than letters parts them."""
    return set((text or "").encode().translate(_SPACED).split())


def marks(word: bytes) -> list[bytes]:
    """The word itself and its beginnings."""
    return [word + b"$", *[word[:n] for n in HEADS if len(word) >= n]]


@dataclass
class ToxicityModel:
    """Voters by mark and by pattern, and the classifier's weights over them."""

    by_mark: dict[bytes, list[int]]
    patterns: list[tuple[int, str]]
    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: Of the label model, for each voter: hit rate given toxic, hit rate given clean, share of a vote.
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    #: Estimated share of label 1 among the given labels of toxic and of clean documents.
    gold: np.ndarray = field(default_factory=lambda: np.array([0.98, 0.02]))

    def __post_init__(self):
        self.compiled = [(k, regex.compile(p)) for k, p in self.patterns]
        self.starts = {m[:4] for m in self.by_mark}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "compiled"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.compiled = [(k, regex.compile(p)) for k, p in self.patterns]

    def votes(self, text: str | None) -> list[int]:
        """The voters that hit the text."""
        out: set[int] = set()
        for word in words(text):
            if word[:4] in self.starts or len(word) < 4 and word + b"$" in self.by_mark:
                for mark in marks(word):
                    out.update(self.by_mark.get(mark, ()))
        out.update(k for k, p in self.compiled if text and p.search(text))
        return sorted(out)

    def score(self, text: str | None) -> float:
        hit = self.votes(text)
        return float(1 / (1 + np.exp(-(self.bias + (self.weights[hit].sum() if hit else 0.0)))))


def _tail(hits: int, of: int, rate: float) -> float:
    """Log of the chance of at least ``hits`` of ``of`` at ``rate``."""
    k = np.arange(hits, of + 1)
    one = np.array([lgamma(of + 1) - lgamma(x + 1) - lgamma(of - x + 1) + x * log(rate) + (of - x) * log(1 - rate) for x in k])
    return float(np.logaddexp.reduce(one))


def mine(texts: list[str], toxic: np.ndarray) -> list[bytes]:
    """Marks that go with the label beyond chance, fewest that cover the toxic texts first."""
    rate = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < rate < 1:
        return []
    seen, bad, held = Counter(), Counter(), []
    for text in (t for t, y in zip(texts, toxic, strict=True) if y):
        own = {m for w in words(text) for m in marks(w)}
        bad.update(own)
        held.append(own)
    # only marks of toxic texts are tried, so only they are counted
    for text in texts:
        seen.update({m for w in words(text) for m in marks(w) if m in bad})
    tried = Counter(seen.values())
    at_least, total = {}, 0
    for n in sorted(tried, reverse=True):
        total += tried[n]
        at_least[n] = total
    found = {}
    for m, t in bad.items():
        if t >= 3 and t > 3 * rate * seen[m] and (p := _tail(t, seen[m], rate)) < log(FLUKE / at_least[seen[m]]):
            found[m] = p
    chosen, left, tally = [], [x & found.keys() for x in held], Counter()
    for own in left:
        tally.update(own)
    while tally and len(chosen) < MOST_MINED:
        best = min(tally, key=lambda m: (-tally[m], found[m], len(m), m))
        if tally[best] < 2:
            break
        chosen.append(best)
        rest = []
        for own in left:
            if best in own:
                tally.subtract(own)
            else:
                rest.append(own)
        left, tally = rest, +tally
    # marks that cover nothing new still vote
    more = sorted(found.keys() - set(chosen), key=lambda m: (found[m], m))
    return chosen + more[: MOST_MINED - len(chosen)]


def _shares(left: np.ndarray) -> np.ndarray:
    """How much of a vote each voter has, from what the label leaves unexplained: 1 alone, 1/n for n copies."""
    spread = np.sqrt((left**2).mean(0)) + 1e-9
    tied = (left.T @ left) / len(left) / spread[:, None] / spread[None, :]
    np.fill_diagonal(tied, 1.0)
    tied[tied < BEYOND_CHANCE / np.sqrt(len(left))] = 0.0
    # weights under which each voter and those it goes with add up to one vote
    share = np.linalg.solve(tied + 0.05 * np.eye(len(tied)), np.full(len(tied), 1.05))
    return np.clip(share, 1 / tied.sum(1), 1.0)


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label for each row of 0/1 ``votes``, the voters' rates and shares, and the hit rates of the given labels ``known`` (0, 1, or -1 for none)."""
    n, j = votes.shape
    given, says = known >= 0, (known == 1).astype(float)
    start = says[given].mean() if given.any() else 0.1
    q = np.where(given, np.where(says == 1, 0.98, 0.02), start)
    share, rates, gold = np.ones(j), np.zeros((j, 2)), np.zeros(2)
    for turn in range(rounds):
        prior = (q.sum() + 1) / (n + 2)
        rates[:, 0] = (votes.T @ q + 0.5) / (q.sum() + 2)
        rates[:, 1] = (votes.T @ (1 - q) + 0.05) / ((1 - q).sum() + 2)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        for k, part in enumerate((q, 1 - q)):
            hits, misses = TRUST[k]
            gold[k] = ((part * says)[given].sum() + hits) / (part[given].sum() + hits + misses)
        if turn in (0, 5):
            share = _shares(votes - (q[:, None] * rates[:, 0] + (1 - q)[:, None] * rates[:, 1])) if j else share
        hit, miss = np.log(rates[:, 0] / rates[:, 1]) * share, np.log((1 - rates[:, 0]) / (1 - rates[:, 1])) * share
        told = np.where(says == 1, np.log(gold[0] / gold[1]), np.log((1 - gold[0]) / (1 - gold[1])))
        z = np.log(prior / (1 - prior)) + votes @ (hit - miss) + miss.sum() + np.where(given, told, 0.0)
        newer = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        moved, q = np.abs(newer - q).max(), newer
        if moved < 1e-4:
            break
    return q, np.column_stack([rates, share]), gold


def regress(votes: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, by damped Newton steps."""
    x = np.column_stack([votes, np.ones(len(votes))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + keep * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def fit(sample: pd.DataFrame) -> ToxicityModel:
    """A model of the sample's (text, label 0/1, or -1 for none). Without both labels the lists alone vote, with equal weight."""
    texts, y = [t or "" for t in sample["text"]], sample["label"].to_numpy(int)
    given = y >= 0
    by_mark: dict[bytes, list[int]] = {}
    names: list[str] = []
    for name, listed in LEXICONS.items():
        for w in listed:
            by_mark.setdefault(w.encode() + b"$", []).append(len(names))
        names.append(name)
    patterns = [(len(names) + i, p) for i, p in enumerate(PATTERNS.values())]
    names += list(PATTERNS)
    fixed = len(names)
    for m in mine([t for t, k in zip(texts, given, strict=True) if k], y[given]):
        by_mark.setdefault(m, []).append(len(names))
        names.append(m.decode(errors="replace"))
    model = ToxicityModel(by_mark, patterns, names)
    if len(set(y[given].tolist())) < 2:
        model.weights, model.bias, model.rates = np.r_[np.full(fixed - len(PATTERNS), 3.0), np.zeros(len(names) - fixed + len(PATTERNS))], -2.0, np.tile([0.5, 0.1, 1.0], (len(names), 1))
        return model
    votes = np.zeros((len(texts), len(names)), np.float32)
    for i, t in enumerate(texts):
        votes[i, model.votes(t)] = 1
    target, model.rates, model.gold = label_model(votes, y)
    # posteriors without a given label are less sharp, and would only blunt the weights
    model.weights, model.bias = regress(votes[given], target[given])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES, free_rows: int = FREE_ROWS, free_bytes: int = FREE_BYTES) -> ToxicityModel:
    """Fit on bounded samples of the ``usable`` rows with and without a label; of several labels of one key the largest counts."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(key).agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.where(usable & F.col(text_col).isNotNull()).select(key, F.col(text_col).alias("text"))
    n, least = known.agg(F.count("*"), F.min(place(key, "labels"))).first()
    picked = known.where(place(key, "labels") < limit(2 * most_rows / max(n, 1), least)) if n > 2 * most_rows else known
    sample = bounded(rows.join(F.broadcast(picked), key), key, "text", most_rows, most_bytes)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    top = limit(min(free_rows / max(n, 1), free_bytes / max(size, 1)), None)
    below = lambda df: df.where(place(key, "free") <= top)
    free = below(rows).join(F.broadcast(below(known).select(key)), key, "left_anti").toPandas().sort_values(key)
    return fit(pd.concat([sample, free.assign(label=-1)], ignore_index=True))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= threshold), voters (names that hit).

    Null, empty and wordless texts get the score of a text without hits. Repeated rows are
    each answered; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double, predicted int, voters array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for whole in batches:
            scores, voters = [], []
            for text in whole.column("text"):
                hit = m.votes(text.as_py())
                scores.append(float(1 / (1 + np.exp(-(m.bias + (m.weights[hit].sum() if hit else 0.0))))))
                voters.append([m.names[k] for k in hit])
            yield pa.RecordBatch.from_arrays([whole.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(voters, pa.list_(pa.string()))], names=[id_col, "score", "predicted", "voters"])

    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` the model doesn't call toxic, with all their columns, in one pass without a join."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for whole in batches:
            yield whole.filter(pa.array([m.score(t.as_py()) < threshold for t in whole.column(columns.index(text_col))], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
