"""Language identification with bit-sliced Bloom filters of n-grams.

One table of bit masks serves all languages: slot i holds, in bit l, slot i of language
l's Bloom filter. The AND of an n-gram's HASHES slots is the mask of all languages that
contain it, so one lookup answers for every language. A document's count for a
language is the number of its n-grams whose mask has the language's bit, corrected for
the filter's false positives, ``(count - total * fp) / (1 - fp)``; the largest decides.

Fitting reads about DOCS_PER_LANGUAGE labelled documents of each language at most (a hash of the id picks them), and the
filters hold every n-gram of theirs, whatever their number: nothing is ranked or left out. Every value of lang is learned. Tasks set
the slots of what they read, and only set slots reach the driver: the table has as many slots as fit into TABLE_BYTES, 2^SLOT_BITS at
most, so that many languages get smaller filters, whose false positives are known and taken off. Texts are hashed a window at a time.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a text whose
n-grams no filter knows gets the commonest language with score 0; with nothing to learn
from, all are ``und``; a tie goes to the language that comes first by code point; a null
id is learned from never and held out never; repeated rows get equal answers; no rows
give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import any_names, frugal, stored, worker_cache

DOCS_PER_LANGUAGE = 4000
LENGTHS = (3, 4)
#: Bytes of the tables of all languages together, and bits of a slot's number at most (HASHES of them fit 64 bits).
TABLE_BYTES = 8 << 20
SLOT_BITS = 21
HASHES = 3
#: Characters of a text that are hashed at a time; n-grams over a window's end are carried into the next.
WINDOW = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))  # ends at the first letter


def _letters_and_spaces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text between two spaces, each run of non-letters one space, a window at a time."""
    low = text.lower()
    space = True  # whether the last code point was a space
    yield np.array([32], dtype=np.uint64)
    for at in range(0, len(low), WINDOW):
        cp = _points(low[at : at + WINDOW])
        cp = np.where(_letters()[cp], cp, np.uint32(32))
        keep = cp != 32
        keep[1:] |= cp[:-1] != 32
        keep[0] |= not space
        space = bool(cp[-1] == 32)
        yield cp[keep].astype(np.uint64)
    if not space:
        yield np.array([32], dtype=np.uint64)


#: Odd factors of an n-gram's code points by place, one to add for each length, and one that mixes the sum.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_BY_LENGTH, _MIX = 0x27D4EB2F165667C5, np.uint64(0xBF58476D1CE4E5B9)


def ngram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a lower-cased text in which each run of non-letters is one space.

    An n-gram's hash is the sum of its code points times factors of their places, mixed; a longer one's sum goes on from the shorter one's.
    """
    tail = np.zeros(0, dtype=np.uint64)
    for new in _letters_and_spaces(text):
        cp = np.concatenate((tail, new))
        total = cp * _FACTORS[0]
        for k in range(1, max(LENGTHS)):
            total = total[:-1] + cp[k:] * _FACTORS[k] if len(cp) > k else total[:0]
            if k + 1 in LENGTHS:
                fresh = total[max(0, len(tail) - k) :]  # those that end among the new code points
                if len(fresh):
                    h = fresh + np.uint64(_BY_LENGTH * (k + 1) & (1 << 64) - 1)
                    h ^= h >> np.uint64(29)
                    h *= _MIX
                    h ^= h >> np.uint64(32)
                    yield h
        tail = cp[-max(LENGTHS) + 1 :]


def slot_bits(languages: int) -> int:
    """Bits of a slot's number, so that the tables of so many languages have at most TABLE_BYTES (64 languages share a word of 8 bytes, up to 8 a byte)."""
    wide = 1 if languages <= 8 else 8 * -(-languages // 64)
    return max(6, min(SLOT_BITS, (TABLE_BYTES // wide).bit_length() - 1))


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(64 - bits * (k + 1))) & mask).view(np.int64) for k in range(HASHES)]


#: The bits of each byte.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


@dataclass
class LanguageModel:
    """languages in order; words[w] is the table for languages 64 w to 64 w + 63, with 2^bits slots; common is the commonest language."""

    languages: list[str]
    common: int
    bits: int
    words: list[np.ndarray]
    false_positive: np.ndarray

    @classmethod
    def of(cls, languages: list[str], common: int, bits: np.ndarray) -> LanguageModel:
        """From rows of word, slot and the mask of the word's languages that set the slot."""
        words, size = [], slot_bits(len(languages))
        fp = np.zeros(len(languages))
        for w in range(0, len(languages), 64):
            part = languages[w : w + 64]
            kind = np.uint8 if len(languages) <= 8 else np.uint64
            table = np.zeros(1 << size, dtype=kind)
            here = bits[bits[:, 0] == w // 64]
            table[here[:, 1]] = np.ascontiguousarray(here[:, 2]).view(np.uint64).astype(kind)
            for i in range(len(part)):
                fp[w + i] = float(((table >> kind(i)) & kind(1)).mean()) ** HASHES
            words.append(table)
        return cls(languages, common, size, words, fp)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """N-grams of the text that each language's filter holds, and all n-grams."""
        found, total, times = np.zeros(len(self.languages), dtype=np.int64), 0, np.zeros(256, dtype=np.int64)
        for h in ngram_hashes(text):
            total += len(h)
            slots = _slots(h, self.bits)
            for w, table in enumerate(self.words):
                mask = table[slots[0]]
                for s in slots[1:]:
                    mask = mask & table[s]
                n = min(64, len(self.languages) - 64 * w)
                if table.dtype == np.uint8:
                    times += np.bincount(mask, minlength=256)
                else:
                    for i in range(n):
                        found[64 * w + i] += int(((mask >> np.uint64(i)) & np.uint64(1)).sum())
        if times.any():  # up to 8 languages: each mask's count goes to the languages of its bits
            found += times @ _BITS[:, : len(found)]
        return found, total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the corrected share of the text's n-grams that it holds."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found, total = self.counts(text)
        share = (found / total - self.false_positive) / (1 - np.minimum(self.false_positive, 0.999))
        best = int(np.argmax(share))
        if share[best] <= 0:
            return self.languages[self.common], 0.0
        return self.languages[best], float(min(share[best], 1.0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _set_slots(bits: int) -> Callable:
    """From rows of number (a language's) and text, the slots that the texts' n-grams set: word, slot and the mask of languages, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}  # at most 8 * TABLE_BYTES
        for batch in batches:
            for number, text in zip(batch.column("number").to_pylist(), batch.column("text")):
                table = tables.setdefault(number, np.zeros(1 << bits, dtype=bool))
                for h in ngram_hashes(text.as_py() or ""):
                    for slots in _slots(h, bits):
                        table[slots] = True
        for number, table in tables.items():
            slots = np.flatnonzero(table)
            mask = np.full(len(slots), 1 << number % 64, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), number // 64)), pa.array(slots), pa.array(mask)], names=["word", "slot", "mask"])

    return run


def fit(docs: DataFrame, learn: Column) -> LanguageModel:
    """Fit on the documents where learn holds and lang is not null, at most DOCS_PER_LANGUAGE of each language or so."""
    known = docs.filter(learn & F.col("lang").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = stored(known.groupBy("lang").count(), "lang-sizes")
    sizes = counted.orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return LanguageModel.of([], 0, np.zeros((0, 3), dtype=np.int64))
    languages = sorted(r[0] for r in sizes)
    share = {r[0]: DOCS_PER_LANGUAGE / r[1] for r in sizes}
    numbers = docs.sparkSession.createDataFrame([(lang, i, share[lang]) for i, lang in enumerate(languages)], "lang string, number int, share double")
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "doc_id"), 12).cast("double")) / float(1 << 52)
    sample = known.join(F.broadcast(numbers), "lang").filter(drawn < F.col("share")).select("number", "text")
    slots = sample.mapInArrow(frugal(_set_slots(slot_bits(len(languages)))), "word long, slot long, mask long")
    bits = stored(slots.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")), "lang-bits").toPandas()
    return LanguageModel.of(languages, languages.index(sizes[0][0]), bits[["word", "slot", "mask"]].to_numpy(dtype=np.int64))


def _predictor(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.value.predict(t.as_py()) for t in batch.column("text")]
            lang, score = [x[0] for x in out], [x[1] for x in out]
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only the text is used."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(_predictor(sent)), "doc_id long, held_out boolean, lang_pred string, score double")


@any_names("text")
def keep_identified(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The documents, all columns as they are, whose language is known with a score of at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        for batch in batches:
            good = []
            for t in batch.column("text"):
                lang, score = sent.value.predict(t.as_py())
                good.append(lang != UNKNOWN and score >= least)
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
