"""Evaluation texts leaking into training text, by template canonicalisation.

Numbers, units after a number, and names are replaced with typed placeholders. Windows of the canonical words of corpus
documents are hash-joined with those of the items; a filter of bounded size lets only windows through that may have a partner,
so the corpus is read once, however many items there are. A window leaks an item verbatim where all words are the item's own,
and re-parameterised where the words in its slots are a consistent renaming: each word of the item stands for one word of
the document, and the other way round. A window of fewer template words than half its length is no template: it is joined by
its words as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import WORD, WordHashes, mixed
from quillspark.storage import written

#: Characters that are removed and do not end a word, and words that are units after a number.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
UNITS = frozenset("ms s sec min h hz khz mhz ghz kb mb gb tb mm cm m km mg g kg ml l k w kw v percent prozent".split())
_SENTENCE = re.compile(r"(?:^|[.!?:]\s+|\n\s*)[\"'“„«¿¡(]*(\w+)")
#: Base of the window hash: a fixed odd number of 64 bits.
_BASE = 0x9E3779B97F4A7C15
_LITERAL = np.uint64(0xD1B54A32D192ED03)


def plain_words(text: str | None) -> list[str]:
    """Words of the casefolded text, without invisible characters, in composed form."""
    if not text:
        return []
    text = INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.casefold())


def fixed_words(size: int) -> int:
    """Template words that make a window of `size` words a template."""
    return (size + 1) // 2


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    total = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        total = total * np.uint64(_BASE) + h[k : k + n]
    return total


class Templates:
    """Join keys of the windows of texts. What is known of a word is remembered, and forgotten at `most` words."""

    def __init__(self, lexicon: frozenset[str], most: int = 500_000):
        self.lexicon, self.most, self.hashes = lexicon, most, WordHashes(most)
        self.known: dict[str, int] = {}
        self.rows: list[tuple[int, int, bool, bool, bool]] = []
        self.unit, self.table = np.uint64(self.hashes["<unit>"]), None

    def _number(self, word: str) -> int:
        if (n := self.known.get(word)) is None:
            n = self.known[word] = len(self.rows)
            number, fixed = word[0].isdigit(), word in self.lexicon
            self.rows.append((self.hashes["<number>" if number else word if fixed else "<name>"], self.hashes[word], fixed and not number, number, word in UNITS))
            self.table = None
        return n

    def columns(self, words: list[str], first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each word: canonical hash, hash without what stands before, hash of the word itself, and whether it is a template
        word, in its context and without. `first`: places of the texts' first words."""
        if len(self.known) >= self.most:
            self.known.clear()
            self.rows.clear()
        ids = np.fromiter(map(self._number, words), dtype=np.int64, count=len(words))
        if self.table is None:
            canonical, literal, fixed, number, unit = zip(*self.rows) if self.rows else ((),) * 5
            self.table = (np.array(canonical, dtype=np.uint64), np.array(literal, dtype=np.uint64), np.array(fixed, dtype=bool), np.array(number, dtype=bool), np.array(unit, dtype=bool))
        free, literal, fixed, number, unit = (x[ids] for x in self.table)
        after = np.zeros(len(ids), dtype=bool)
        after[1:] = number[:-1]
        after[first[first < len(ids)]] = False
        is_unit = unit & after
        return np.where(is_unit, self.unit, free), free, literal, fixed & ~is_unit, fixed

    @staticmethod
    def keys(columns: tuple[np.ndarray, ...], size: int) -> np.ndarray:
        """The join key of every window of `size` words: its template's, or its words' where it is none. What stands before
        a window plays no part."""
        shown, free, literal, fixed, fixed_free = columns
        n = len(shown) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        power = np.uint64(pow(_BASE, size - 1, 1 << 64))
        template = window_hashes(shown, size) + (free[:n] - shown[:n]) * power
        sums = np.concatenate([[0], np.cumsum(fixed)])
        count = sums[size:] - sums[:n] + fixed_free[:n].astype(int) - fixed[:n].astype(int)
        return mixed(np.where(count >= fixed_words(size), template, window_hashes(literal, size) ^ _LITERAL) + np.uint64(size))


def slots_of(words: list[str], lexicon: frozenset[str]) -> int:
    """Bits of the places of a window that are slots; 0 where the window is no template."""
    bits, fixed = 0, 0
    for k, w in enumerate(words):
        number = w[0].isdigit()
        is_fixed = not number and w in lexicon and not (k and words[k - 1][0].isdigit() and w in UNITS)
        fixed += is_fixed
        bits |= 0 if is_fixed else 1 << k
    return bits if fixed >= fixed_words(len(words)) else 0


def lexicon_of(items: DataFrame, text: str, most: int) -> frozenset[str]:
    """Words that are part of templates: of the items' words seen in lower case, or at the start of a sentence in two texts or more,
    the `most` that stand in most texts (a bound on what is broadcast: all others are slots, which takes nothing from verbatim
    leaks). All other words but numbers are names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, bool, bool]] = []
            for t in batch.column(0).to_pylist():
                t = unicodedata.normalize("NFC", INVISIBLE.sub("", t))
                lower = {w.casefold() for w in WORD.findall(t) if w[0].islower()}
                first = {w.casefold() for w in _SENTENCE.findall(t)}
                rows += [(w, w in lower, w in first) for w in lower | first]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))], names=["word", "lower", "first"])

    words = items.select(text).mapInArrow(run, "word string, lower boolean, first boolean").groupBy("word").agg(F.count("*").alias("n"), F.max("lower").alias("lower"), F.count_if("first").alias("first"))
    return frozenset(r["word"] for r in words.where("lower or first > 1").orderBy(F.desc("n"), "word").limit(most).select("word").collect())


class WindowFilter:
    """Which join keys the items' windows may have: two bits each in a field of bounded size."""

    def __init__(self, field: np.ndarray):
        self.field, self.mask = field, np.uint64(len(field) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & self.mask
            out &= (self.field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def window_filter(windows: DataFrame, least: int = 20, most: int = 28) -> WindowFilter:
    """The filter of windows.h: from 2^least to 2^most bits (32 MB), 32 for each window where that fits. Made by an aggregate."""
    bits = min(most, max(least, int(np.ceil(np.log2(32 * max(1, windows.count()))))))
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit((1 << bits) - 1))))
    size = 4096 * 8
    parts = windows.select(at.alias("at")).groupBy(F.expr(f"at div {size}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"at % {size}")).alias("bits"))
    field = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in parts.collect():
        field[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return WindowFilter(field)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 12, most_words: int = 1_000_000) -> DataFrame:
    """key, item, kind ('verbatim' or 'reparameterised'), windows, covered (share of the item's words found verbatim).

    A document leaks an item where it holds `window` consecutive words of it (all words of a shorter item) with the same
    template; case, punctuation, white space, composition and invisible characters do not matter. windows counts different
    places of the document together with their places in the item. Null and wordless texts on either side leak nothing; an item
    id with several texts leaks by any of them, a document key with several texts too. One row for each key and item. Rows of a
    null key are left out. The documents are read once; broadcast are the template words (at most `most_words`) and the filter.
    """
    kinds = [documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()]
    arrow = [pa.string() if k == "string" else pa.int64() for k in kinds]
    given = written(items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text")).distinct(), "items")
    lexicon = lexicon_of(given, "text", most_words)
    sc = documents.sparkSession.sparkContext
    words_ = sc.broadcast(lexicon)

    def rows_of(keys: list, texts: list[list[str]], picked: list[tuple[int, int, int, int]], kind: pa.DataType, more: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
        """picked: (text, size, place, join key)."""
        names = ["key", "size", "at", "h", "words"]
        columns = [
            pa.array([keys[d] for d, _, _, _ in picked], kind), pa.array([n for _, n, _, _ in picked], pa.int32()), pa.array([a for _, _, a, _ in picked], pa.int32()),
            pa.array(np.array([h for _, _, _, h in picked], dtype=np.uint64).view(np.int64)), pa.array([texts[d][a : a + n] for d, n, a, _ in picked], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, t) for _, t, x in more]], names=[*names, *[n for n, _, _ in more]])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(words_.value)
        for batch in batches:
            texts = [plain_words(t) for t in batch.column(1).to_pylist()]
            picked = []
            for d, w in enumerate(texts):
                if w:
                    size = min(window, len(w))
                    picked += [(d, size, a, int(h)) for a, h in enumerate(known.keys(known.columns(w, np.zeros(1, dtype=np.int64)), size))]
            more = [("slots", pa.int32(), [slots_of(texts[d][a : a + n], words_.value) for d, n, a, _ in picked]), ("n_words", pa.int32(), [len(texts[d]) for d, _, _, _ in picked])]
            yield rows_of(batch.column(0).to_pylist(), texts, picked, arrow[1], more)

    windows = written(
        given.mapInArrow(of_items, f"key {kinds[1]}, size int, at int, h long, words array<string>, slots int, n_words int").select(F.col("key").alias("item"), "size", F.col("at").alias("pos"), "h", F.col("words").alias("theirs"), "slots", "n_words"), "windows"
    )
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` of them
    filter_ = sc.broadcast(window_filter(windows))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(words_.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [plain_words(t) for t in batch.column(1).to_pylist()]
            lengths = np.array([len(w) for w in texts], dtype=np.int64)
            owner, start = np.repeat(np.arange(len(texts)), lengths), np.concatenate([[0], np.cumsum(lengths)])
            columns = known.columns([w for ws in texts for w in ws], start[:-1])
            picked = []
            for n in sizes:
                h = known.keys(columns, n)
                hit = np.flatnonzero(filter_.value.has(h))
                hit = hit[owner[hit] == owner[hit + n - 1]]
                picked += [(int(d), n, int(g - start[d]), int(h[g])) for d, g in zip(owner[hit], hit)]
            yield rows_of(keys, texts, picked, arrow[0], [])

    docs = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    met = docs.mapInArrow(of_documents, f"key {kinds[0]}, size int, at int, h long, words array<string>").join(windows, ["size", "h"])
    same = F.col("words") == F.col("theirs")
    is_slot = lambda k: F.getbit(F.col("slots"), k) == 1
    places = F.sequence(F.lit(0), F.col("size") - 1)
    slot_places = F.filter(places, is_slot)
    distinct = lambda x: F.size(F.array_distinct(F.transform(slot_places, x)))
    one, two = (lambda k: F.get("theirs", k)), (lambda k: F.get("words", k))
    pairs = distinct(lambda k: F.struct(one(k), two(k)))
    renamed = (F.col("slots") > 0) & F.forall(places, lambda k: is_slot(k) | (one(k) == two(k))) & (pairs == distinct(one)) & (pairs == distinct(two))
    leaked = met.withColumn("same", same).where(F.col("same") | renamed)
    by = leaked.groupBy("key", "item").agg(
        F.max("same").alias("verbatim"), F.count_distinct("at", "pos").cast("int").alias("windows"), F.max("n_words").alias("n"), F.collect_set(F.when(F.col("same"), F.struct("pos", "size", "n_words"))).alias("found")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1))))) / F.array_max(F.transform("found", lambda x: x["n_words"]))
    return by.select(F.col("key").alias(key), F.col("item").alias(item), F.when(F.col("verbatim"), "verbatim").otherwise("reparameterised").alias("kind"), "windows", F.least(F.lit(1.0), F.coalesce(covered, F.lit(0.0))).alias("covered"))
