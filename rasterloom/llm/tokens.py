"""Token ids of texts by a public tokenizer file, by their distinct white-space separated chunks.

A tokenizer that drops white space and never merges across it gives a text the ids of
its chunks in order, so each distinct chunk of a batch of texts is encoded once; Arrow
finds the distinct ones and puts their ids where they stand. Chunks of plain Latin
letters, with or without signs behind them, are a word and a run of signs: words are
spelt as the file's vocabulary spells them and go through its BPE model in one call.
Other plain chunks are split by the file's own pattern first. Everything else, and every
file that isn't built this way, goes through the whole tokenizer. What isn't a word is
kept in a memo of two generations: chunks met since the last change, and those met
before it, so frequent ones stay.
"""

from __future__ import annotations

import json
import os
import sys
import types
from collections.abc import Iterable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Chunks in a generation of the memo (some 40 MB).
MEMO = 200_000
#: ASCII that is neither letter nor digit nor space; a pattern for runs of these takes them whole where nothing follows.
_SIGNS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Chunks in a line that goes through the model.
LINE = 512
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿŒœ]+")
_LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿŒœ]+\z"

# How byte-level vocabularies spell bytes: what prints in Latin-1 as itself, the rest in order from U+0100.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: chr(b) for b in _PRINTS} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)).difference(_PRINTS)))} | {0x20: " "}


def default_path() -> str:
    """Where the word tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spelt(line: str) -> str:
    """Pieces as a byte-level vocabulary spells them; spaces between them stay."""
    return line if line.isascii() else line.encode().decode("latin-1").translate(_SPELT)


def _offsets(array: pa.Array) -> np.ndarray:
    """Where the values of an unsliced large string or binary array begin and end."""
    return np.frombuffer(array.buffers()[1], "<i8", len(array) + 1)


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    """What lies between these places."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i8")), data])


class Encoder:
    """Encodes texts to little-endian ids of ``width`` bytes (2 where the vocabulary allows it)."""

    def __init__(self, path: str):
        # a worker has one core, and forks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pattern = self._pattern(spec)
        if self.pattern:
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            if hasattr(self.bare.model, "_resize_cache"):  # each piece comes once
                self.bare.model._resize_cache(0)
            self.ends = np.zeros(self.full.get_vocab_size(), bool)
            for piece, at in self.full.get_vocab().items():
                self.ends[at] = piece.endswith(spec["model"]["end_of_word_suffix"])

    @staticmethod
    def _pattern(spec: dict):
        """The splitting pattern, if the file is of the kind the memo is right for."""
        try:
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
            fits = kinds == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"]
            fits = fits and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
            return regex.compile(split["pattern"]["Regex"]) if fits else None
        except (KeyError, TypeError, ValueError):
            return None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.full.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, lines: list[str], counts: np.ndarray) -> pa.Array | None:
        """Ids of chunks that are so many pieces each, from lines of spelt pieces; None if they don't come out piece by piece."""
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
        stops, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(counts)
        if len(stops) != last[-1] or stops[-1] != len(ids):
            return None
        return _binary(np.append(0, stops[last - 1]) * ids.itemsize, pa.py_buffer(ids.tobytes()))

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of chunks of plain letters, a piece each."""
        if not len(words):
            return pa.array([], pa.large_binary())
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, len(words), LINE), len(words)], pa.int32()), words.cast(pa.string())), " ")
        got = self._pieces([_spelt(x.lower()) for x in lines.to_pylist()], np.ones(len(words), int))
        return pa.array(self._whole(words.to_pylist()), pa.large_binary()) if got is None else got

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of any kind, by the memo."""
        if len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo
        new = set(chunks).difference(self.memo)
        if again := new & self.old.keys():
            self.memo |= zip(again, map(self.old.__getitem__, again), strict=True)
            new -= again
        easy, hard = [], []
        for t in new:
            (easy if _PLAIN.fullmatch(t) and "<|" not in t else hard).append(t)
        if easy:
            found = [self.pattern.findall(t.lower()) for t in easy]
            lines = [_spelt(" ".join(chain.from_iterable(found[i : i + LINE]))) for i in range(0, len(found), LINE)]
            got = self._pieces(lines, np.array([len(f) for f in found]))
            if got is None:
                hard += easy
            else:
                self.memo.update(zip(easy, got.to_pylist(), strict=True))
        if hard:
            self.memo.update(zip(hard, self._whole(hard), strict=True))
        return [self.memo[t] for t in chunks]

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks."""
        core = pc.ascii_rtrim(chunks, characters=_SIGNS)
        # letters, perhaps with signs behind them, are one or two pieces whatever the pattern finds elsewhere
        is_word = pc.match_substring_regex(core, _LETTERS)
        at = np.flatnonzero(np.asarray(is_word))
        words = pc.ascii_lower(core.filter(is_word)).dictionary_encode()
        starts = _offsets(chunks)
        cut = np.append(np.stack([starts[:-1], starts[:-1] + np.diff(_offsets(core))], 1), starts[-1])
        signs = _binary(cut, chunks.buffers()[2]).take(pa.array(2 * at + 1)).cast(pa.large_string()).dictionary_encode()
        runs = signs.dictionary.to_pylist()
        others = self._others([*runs, *chunks.filter(pc.invert(is_word)).to_pylist()])
        made = pa.array(others[: len(runs)], pa.large_binary()).take(signs.indices)
        made = pc.binary_join_element_wise(self._words(words.dictionary).take(words.indices), made, pa.scalar(b"", pa.large_binary()))
        order = np.argsort(np.append(at, np.flatnonzero(~np.asarray(is_word))))
        return pa.concat_arrays([made, pa.array(others[len(runs) :], pa.large_binary())]).take(pa.array(order))

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """This process's encoder of a file: its memo serves all tasks that the worker runs one after the other."""
        held = sys.modules.setdefault("_rasterloom_worker", types.ModuleType("_rasterloom_worker")).__dict__
        key = ("encoder", path)
        if key not in held:
            held[key] = cls(path)
        return held[key]

    @staticmethod
    def forget() -> None:
        """Free this process's encoders."""
        if held := sys.modules.get("_rasterloom_worker"):
            held.__dict__.clear()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        if not self.pattern:
            return self._whole(texts)
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        places = split.values.dictionary_encode()
        ids = self._chunks(places.dictionary).take(places.indices)
        raw, cut = ids.buffers()[2], _offsets(ids)[np.asarray(split.offsets)].tolist()
        return [raw[i:j].to_pybytes() for i, j in pairwise(cut)]
