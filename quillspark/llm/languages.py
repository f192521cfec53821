"""Languages of documents and of their segments, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of letters is the product of its letters' vectors, each rotated by
its place; a text is the sum of its runs, and a language prototype the sum of the samples' vectors, each scaled to
length one. A text's language is the prototype of largest cosine. As cosine is linear in the runs up to the text's
length, the dot product of every possible run with every prototype is tabulated once; a text is then scored by looking
its runs up, which gives the same result as adding up its vectors.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.samples import bounded_sample

#: Characters of a block of texts that are scored at once.
BLOCK = 250_000
LETTERS = 27  # a to z without accents, and the gap between words
DROPPED = 255

#: Spellings of the six languages; beyond them, a code followed by a region counts as the code.
SPELLINGS = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglês", "inglese"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "tedesco"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "francese"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "espanhol", "spagnolo"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien"),
}


@dataclass(frozen=True)
class Profiles:
    dimensions: int = 2048
    run: int = 4
    seed: int = 7
    #: Least lead of the best cosine over the second at which a sentence's language is told, from `letters` on; a shorter one
    #: needs more, up to short_lead beyond it, so that names and references of few letters are no languages.
    letters: int = 35
    lead: float = 0.04
    short_lead: float = 0.2
    #: Bounds on the labelled rows the prototypes are made of (those of smallest hash): samples, and documents.
    samples: int = 10_000
    documents: int = 4_000
    #: Rounds in which the documents whose label agrees with the prototypes join them, and the lead under which a
    #: segment of such a document joins though it is nearer to another prototype.
    rounds: int = 2
    weak_lead: float = 0.05
    #: Steepness of the confidence: 1 / (1 + sum over the other languages of exp(-steepness * lead over each)).
    steepness: float = 40.0

    def least_lead(self, letters: np.ndarray | float) -> np.ndarray | float:
        """The lead that a text of so many letters needs; a text without letters has none that is enough."""
        need = self.lead + self.short_lead * np.maximum(0.0, 1 - np.asarray(letters) / self.letters)
        return np.where(np.asarray(letters) > 0, need, np.inf)


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x2FA20):
        ch = chr(c)
        if unicodedata.combining(ch) or c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
            table[c] = DROPPED
            continue
        base = unicodedata.normalize("NFKD", ch.lower())[:1] if c != 0xDF else "s"
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
        elif ch.isalpha():
            table[c] = {0xE6: 1, 0xC6: 1, 0x153: 15, 0x152: 15}.get(c, 0)
    return table


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, letter numbers): 0 is no letter, DROPPED a mark or invisible character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, _letter_table()[points]


def _runs(letters: np.ndarray, n: int) -> np.ndarray:
    """The number of each run of n letters; runs with a double gap do not occur as gaps are single."""
    total = np.zeros(max(0, len(letters) - n + 1), dtype=np.int64)
    for k in range(n):
        total = total * LETTERS + letters[k : len(letters) - n + 1 + k]
    return total


def _packed(text: str) -> np.ndarray:
    _, x = letters_of(" " + text + " ")
    x = x[x != DROPPED]
    return x[(x != 0) | np.concatenate([[True], x[:-1] != 0])].astype(np.int64)


def _part_vectors(how: Profiles, first: int, n: int) -> np.ndarray:
    """Vectors of all parts of n letters that stand in a run from place `first` on: products of rotated letter vectors."""
    base = np.random.default_rng(how.seed).integers(0, 2, (LETTERS, how.dimensions), dtype=np.int8) * 2 - 1
    ids = np.arange(LETTERS**n)
    v = np.ones((len(ids), how.dimensions), dtype=np.float32)
    for k in range(n):
        v *= np.roll(base, how.run - 1 - first - k, axis=1)[(ids // LETTERS ** (n - 1 - k)) % LETTERS]
    return v


def profile_table(samples: list[tuple[str, str]], languages: list[str], how: Profiles) -> np.ndarray:
    """[run, language]: dot products of every run's vector with the prototypes, over the root of the dimensions.

    A prototype is the sum of its samples' vectors, each of length one; what all prototypes share is taken off. A run's
    vector is the product of its halves' vectors, so sums over runs are products of two matrices of halves.
    """
    weights = np.zeros((LETTERS**how.run, len(languages)), dtype=np.float32)
    for lang, text in samples:
        ids, counts = np.unique(_runs(_packed(text), how.run), return_counts=True)
        if len(ids):
            weights[ids, languages.index(lang)] += counts / np.sqrt((counts.astype(float) ** 2).sum())
    k = how.run // 2
    left, right = _part_vectors(how, 0, k), _part_vectors(how, k, how.run - k)
    prototypes = np.stack([(left * (weights[:, i].reshape(len(left), len(right)) @ right)).sum(axis=0, dtype=np.float64) for i in range(len(languages))], axis=1)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=0), 1e-9)
    prototypes -= prototypes.mean(axis=1, keepdims=True)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=0), 1e-9)
    table = np.empty((LETTERS**how.run, len(languages)), dtype=np.float32)
    for i in range(len(languages)):
        table[:, i] = (left @ (right * prototypes[:, i].astype(np.float32)).T).ravel() / how.dimensions**0.5
    return table


_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n[ \t\r\f]*\n\s*|[\f]\s*")


def segments_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of sentences: cut after a sentence's end mark and at blank lines."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def scored(texts: list[str], how: Profiles, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: cosine with each prototype, and number of letters.

    The length of a text's vector is taken as the root of its number of runs: different runs are orthogonal up to
    chance, and a run seldom occurs again within a sentence. The factor is the same for every language. Texts are taken
    in blocks, so that the arrays of a block stay small.
    """
    blocks, size = [0], 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            blocks.append(k)
            size = 0
        size += len(t) + 1
    parts = [_scored_block(texts[a:b], how, table) for a, b in zip(blocks, [*blocks[1:], len(texts)])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _scored_block(texts: list[str], how: Profiles, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points, letters = letters_of("\x00".join(["", *texts, ""]))
    border = points == 0
    gap = letters == 0
    keep = letters != DROPPED
    if not keep.all():
        border, gap, letters = border[keep], gap[keep], letters[keep]
    single = border | ~gap
    single[1:] |= ~gap[:-1]
    border, letters = border[single], letters[single].astype(np.int64)
    at = np.flatnonzero(border)
    counts = np.diff(np.concatenate([[0], np.cumsum(letters > 0)])[at])
    values = table[_runs(letters, how.run)]
    sums = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=sums[1:])
    # a run counts where it lies within the gap before a text and the gap after it
    ends = np.minimum(np.maximum(at[:-1], at[1:] - how.run + 2), len(sums) - 1)
    starts = np.minimum(at[:-1], ends)
    return (sums[ends] - sums[starts]) / np.sqrt(np.maximum(ends - starts, 1))[:, None], counts


def _leads(scores: np.ndarray) -> np.ndarray:
    if scores.shape[1] < 2:
        return np.full(len(scores), np.inf)
    two = np.partition(scores, -2, axis=1)
    return two[:, -1] - two[:, -2]


def language_of_label(label: str | None) -> str | None:
    """The code of one of the six languages that a label spells; None for a missing or unknown one."""
    bare = (label or "").strip().casefold()
    for x in (bare, re.split(r"[-_]", bare)[0]):
        for code, spelled in SPELLINGS.items():
            if x in spelled:
                return code
    return None


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    how: Profiles


def fit(samples: DataFrame, documents: DataFrame | None = None, how: Profiles = Profiles(), lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Prototypes from labelled samples, then from labelled documents that agree with them (bounds: how.samples, how.documents). Without
    a sample of a known language the model has no languages and finds none in any text."""
    rows = samples.where(F.col(text).isNotNull()).select(lang, text)
    rows = [(language_of_label(r[0]), r[1]) for r in bounded_sample(rows, [text, lang], how.samples).collect()]
    rows = [r for r in rows if r[0]]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((LETTERS**how.run, 0), dtype=np.float32), how)
    table = profile_table(rows, languages, how)
    spelled = [s for c in languages for s in SPELLINGS[c]]
    bare = F.lower(F.trim(F.col(lang)))
    known = bare.isin(*spelled) | F.regexp_extract(bare, "^([^-_]*)", 1).isin(*spelled)
    labelled = [] if documents is None else bounded_sample(documents.where(F.col(text).isNotNull() & known).select(key, lang, text), [key, text], how.documents).select(lang, text).collect()
    labelled = [(language_of_label(r[0]), [r[1][a:b] for a, b in segments_of(r[1])]) for r in labelled]
    labelled = [(c, parts) for c, parts in labelled if c in languages and parts]
    for _ in range(how.rounds if labelled else 0):
        scores, letters = scored([x for _, parts in labelled for x in parts], how, table)
        leads, best = _leads(scores), scores.argmax(axis=1)
        at, more = 0, []
        for code, parts in labelled:
            own = slice(at, at + len(parts))
            at += len(parts)
            if languages[int((scores[own] * letters[own, None]).sum(axis=0).argmax())] != code:
                continue
            taken = [x for x, b, d, n in zip(parts, best[own], leads[own], letters[own]) if n >= how.letters and (languages[b] == code or d < how.weak_lead)]
            more += [(code, " ".join(taken))] if taken else []
        table = profile_table(rows + more, languages, how)
    return Model(languages, table, how)


def _confidence(scores: np.ndarray, best: int, how: Profiles) -> float:
    return float(1 / np.exp(-how.steepness * (scores[best] - scores)).sum())


def _judged(texts: list[str], model: Model, labels: list[str | None] | None = None) -> list[tuple[list[dict], list[dict]]]:
    """For each text: its languages (lang, confidence, letters) and its segments (start, end, lang, confidence). labels are
    the languages that the texts' labels spell; they count only for a text none of whose sentences has a told language."""
    how = model.how
    if not model.languages:
        return [([], []) for _ in texts]
    spans = [segments_of(t) for t in texts]
    scores, letters = scored([t[a:b] for t, s in zip(texts, spans) for a, b in s], how, model.table)
    leads, best = _leads(scores), scores.argmax(axis=1)
    sure = 1 / np.exp(-how.steepness * (scores.max(axis=1, keepdims=True) - scores)).sum(axis=1)
    told = leads >= how.least_lead(letters)
    out, at = [], 0
    for text, parts, label in zip(texts, spans, labels or [None] * len(texts)):
        segments: list[dict] = []
        weights: dict[str, list[float]] = {}
        for k, (a, b) in enumerate(parts, at):
            if not told[k]:
                if segments:
                    segments[-1]["end"] = b
                continue
            code, n = model.languages[best[k]], float(letters[k])
            w = weights.setdefault(code, [0.0, 0.0])
            w[0] += n
            w[1] += n * float(sure[k])
            if segments and segments[-1]["lang"] == code:
                last = segments[-1]
                last["confidence"] = (last["confidence"] * last["n"] + float(sure[k]) * n) / (last["n"] + n)
                last["n"] += n
                last["end"] = b
            else:
                segments.append({"start": a if segments else 0, "end": b, "lang": code, "confidence": float(sure[k]), "n": n})
        own, n = scores[at : at + len(parts)], letters[at : at + len(parts)]
        at += len(parts)
        if not segments and n.sum():
            mean = (own * n[:, None]).sum(axis=0) / n.sum()
            chosen = int(mean.argmax())
            if label in model.languages and mean[chosen] - mean[model.languages.index(label)] < how.least_lead(n.sum()):
                chosen = model.languages.index(label)
            code, c = model.languages[chosen], _confidence(mean, chosen, how)
            weights[code] = [float(n.sum()), c * float(n.sum())]
            segments = [{"start": 0, "end": len(text), "lang": code, "confidence": c, "n": float(n.sum())}]
        out.append(([{"lang": c, "confidence": w[1] / w[0], "letters": int(w[0])} for c, w in sorted(weights.items(), key=lambda x: (-x[1][0], x[0]))], [{k: s[k] for k in ("start", "end", "lang", "confidence")} for s in segments]))
    return out


_LANGS = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())]))
_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def detect(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """key, label, label_lang, languages (most letters first), segments, label_missing, label_wrong, is_mixed.

    Segments cover the text from its first sentence; a sentence too close to two prototypes for its length goes with the one
    before it. A text without one sentence that is told has the language that its label spells, unless another leads over
    it by enough for the text's length; without such a label the nearest. Null texts and texts without letters of the six
    languages have no languages or segments, and nothing is said about their label. A label that spells the right language otherwise is right. One row for each row of `df`; other columns are
    not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    arrow_kind = pa.string() if kind == "string" else pa.int64()
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.table))
    how = model.how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value, how)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            judged: list[tuple[list[dict], list[dict]]] = []
            labels = batch.column(1).to_pylist()
            spelled = {x: language_of_label(x) for x in set(labels)}
            codes = [spelled[x] for x in labels]
            at = 0
            while at < len(texts):  # blocks of about a million characters bound the arrays
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                judged += _judged([t or "" for t in texts[at:end]], known, codes[at:end])
                at = end
            told = [{x["lang"] for x in j[0]} for j in judged]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(arrow_kind), pa.array(labels, pa.string()), pa.array(codes, pa.string()), pa.array([j[0] for j in judged], _LANGS), pa.array([j[1] for j in judged], _SEGMENTS),
                    pa.array([bool(t) and c is None for t, c in zip(told, codes)]), pa.array([bool(t) and c is not None and c not in t for t, c in zip(told, codes)]), pa.array([len(t) > 1 for t in told]),
                ],
                names=["key", "label", "label_lang", "languages", "segments", "label_missing", "label_wrong", "is_mixed"],
            )

    one, part = "struct<lang:string,confidence:double,letters:int>", "struct<start:int,end:int,lang:string,confidence:double>"
    return rows.mapInArrow(run, f"key {kind}, label string, label_lang string, languages array<{one}>, segments array<{part}>, label_missing boolean, label_wrong boolean, is_mixed boolean").withColumnRenamed("key", key)
