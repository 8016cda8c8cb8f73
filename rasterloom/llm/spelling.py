"""Spelling variants: words of a corpus within one edit of each other, by Aho-Corasick over halves.

One edit leaves one half of a word as it is: the first at the start of the other word, or
the second at its end, and lengths differ by one at most. So a word's two halves, with
its length, are two entries; entries are dealt by hash to shards of bounded size, and a
task builds a shard's automaton of halves. Every word is scanned by each shard that can
hold a half of a word near it (of three lengths, two halves each). Where the automaton
finds a half, its place and the lengths must fit; what remains of both words must then
be one edit apart, which is looked up among the owners' remainders with one place left
out, so words that share a half are never compared in pairs. A half that very many words
share is dealt over several shards.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, stage_table

PATTERN = "[A-Za-zÀ-ÿ]+"
#: One run in so many, by hash, loses a code point.
SLIP = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: Halves in a shard, on average.
SHARD = 8_192
#: Owners of one half in a shard; what has more is split.
OWNERS = 4_096


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, each as it stands after its slip, long and frequent enough.

    A run slips where ``slip`` divides the CRC-32 of ``id:run`` (a null id is empty): the
    code point at that hash modulo the run's length goes. Null and empty texts have no runs.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    word = F.col("run")
    if slip:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(h % slip == 0, less).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _half(word: str | Column, length: Column, second: bool) -> Column:
    """The half of a word of ``length`` code points that ``word`` would share with it."""
    first = F.floor(length / 2).cast("int")
    return F.substr(word, F.length(word) - (length - first) + 1) if second else F.substr(word, F.lit(1), first)


def _entry(length: Column, second: bool) -> Column:
    return F.xxhash64(F.lit(second), length, _half("word", length, second))


def _shard(entry: Column, part: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(entry, part), F.lit(shards))


def dealt(words: DataFrame, shards: int, owners: int = OWNERS) -> DataFrame:
    """shard, role (0: owner of a half, 1: word to scan), second (which half is owned), word, n."""
    length = F.length("word")
    held = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("second"), _entry(length, s).alias("entry")) for s in (False, True)])).alias("x")).select("word", "n", "x.*")
    shared = stage_table(held.groupBy("entry").agg(F.count("*").alias("owners")).where(F.col("owners") > owners).select("entry", F.ceil(F.col("owners") / owners).alias("parts")), "entries")
    held = held.join(shared, "entry", "left")
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    own = held.select(_shard(F.col("entry"), part, shards).alias("shard"), F.lit(0).alias("role"), "second", "word", "n")
    reach = F.array(*[_entry(length + d, s) for d in (-1, 0, 1) for s in (False, True)])
    scan = words.select("word", F.explode(reach).alias("entry")).join(shared, "entry", "left")
    scan = scan.select("word", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "entry")
    scan = scan.select(_shard(F.col("entry"), F.col("part"), shards).alias("shard"), "word").distinct()
    return own.unionByName(scan.select("shard", F.lit(1).alias("role"), F.lit(None).cast("boolean").alias("second"), "word", F.lit(None).cast("bigint").alias("n")))


class Shard:
    """The automaton of some words' halves, and those words by what remains of them."""

    def __init__(self):
        self.entries: dict[tuple[bool, int, str], int] = {}
        self.exact: dict[tuple[int, str], tuple[str, int]] = {}
        self.without: dict[tuple[int, int, str], list[tuple[str, int]]] = defaultdict(list)
        self.automaton: ahocorasick.Automaton | None = None

    def own(self, word: str, n: int, second: bool) -> None:
        cut = len(word) // 2
        half, rest = (word[cut:], word[:cut]) if second else (word[:cut], word[cut:])
        entry = self.entries.setdefault((second, len(word), half), len(self.entries))
        self.exact[entry, rest] = (word, n)
        for i in range(len(rest)):
            self.without[entry, i, rest[:i] + rest[i + 1 :]].append((word, n))

    def build(self) -> None:
        held = defaultdict(list)
        for (second, length, half), entry in self.entries.items():
            held[half].append((second, length, len(half), entry))
        self.automaton = ahocorasick.Automaton()
        for half, owners in held.items():
            self.automaton.add_word(half, owners)
        self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The owners one edit away, each once: by its second half only if its first isn't the word's start."""
        size = len(word)
        for end, owners in self.automaton.iter(word):
            for second, length, half, entry in owners:
                if abs(length - size) > 1 or end != (size - 1 if second else half - 1):
                    continue
                rest = word[: size - half] if second else word[half:]
                for owner in self._one_edit(entry, rest, length - size):
                    if owner[0] != word and not (second and word.startswith(owner[0][: length // 2])):
                        yield owner

    def _one_edit(self, entry: int, rest: str, longer: int) -> Iterator[tuple[str, int]]:
        if longer == 0:
            return chain.from_iterable(self.without.get((entry, i, rest[:i] + rest[i + 1 :]), ()) for i in range(len(rest)))
        if longer > 0:
            return iter({owner for i in range(len(rest) + 1) for owner in self.without.get((entry, i, rest), ())})
        found = (self.exact.get((entry, rest[:i] + rest[i + 1 :])) for i in range(len(rest)))
        return iter({owner for owner in found if owner})


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best (times, form) within a shard; rows come by shard, owners first."""
    at = shard = None
    for batch in batches:
        out = [[], [], [], []]
        for number, role, second, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "role", "second", "word", "n")), strict=True):
            if number != at:
                at, shard = number, Shard()
            if role == 0:
                shard.own(word, n, second)
            elif shard.entries:
                if shard.automaton is None:
                    shard.build()
                found = list(shard.near(word))
                if found:
                    form, times = min(found, key=lambda x: (-x[1], x[0]))
                    for column, value in zip(out, (word, len(found), times, form), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "times", "form"])


def neighbours(words: DataFrame, shard: int = SHARD, owners: int = OWNERS) -> DataFrame:
    """word, n, n_near (words exactly one edit away), times and form (the most frequent of them, or the first of those in code-point order; null without any). ``words`` has distinct words."""
    shards = -(-2 * words.count() // shard) or 1
    rows = dealt(words, shards, owners)
    found = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "role").mapInArrow(_scanned, "word string, n_near bigint, times bigint, form string")
    told = found.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", F.struct((-F.col("times")).alias("less"), "form").alias("best"))
    none = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<less bigint, form string>").alias("best"))
    each = told.unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return each.select("word", "n", "n_near", (-F.col("best.less")).alias("times"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of word, form: where following forms ends. Chains halve in each step, so a chain takes as many steps as its length has bits."""
    reached = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        newer = stage_table(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_table(reached)
        reached = newer.select("word", "root")
        if newer.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, slip: int | None = SLIP, shard: int = SHARD, owners: int = OWNERS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are what ``vocabulary`` counts. A word's form is the most frequent of the words
    one edit away, if it is ``ratio`` times as frequent; a word without one is its own root.
    Repeated rows count each. Null texts, empty texts and an empty table have no words.
    ``ratio`` is above 1, so forms never lead back.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = stage_table(vocabulary(docs, id_col, text_col, slip), "words")
    near = neighbours(words, shard, owners)
    has = F.coalesce(F.col("times") >= ratio * F.col("n"), F.lit(False))
    found = stage_table(near.select("word", "n", "n_near", F.when(has, F.col("form")).alias("form"), F.when(has, F.col("times")).alias("form_n")), "forms")
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
