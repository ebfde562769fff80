"""Benchmark decontamination with suffix arrays of the training documents.

Documents are read in shards of a bounded number of words. Each task builds, for a shard, the array of its suffixes in
word order and looks every suffix of every benchmark item up in it by binary search, all at once and word by word: the range of the array that
begins with the item's words narrows until it is empty. Its depth is the longest verbatim match of that suffix in the shard; the
range at the depth of a window holds all places where the window occurs. A document with such a place is affected.

Words that no item has are one separator, which matches nothing, and suffixes that meet it before the shortest window ends
can't hold one and are left out of the array. The array is sorted as deep as the longest item, packed words at a time,
and only where suffixes are still equal. Nothing is shuffled: a row's result needs that row and the items alone.

Items are sent to the executors in blocks of at most BLOCK_BYTES of text (or one item). A benchmark of several blocks
costs one reading of the documents for each, with the results so far written to the shared folder in between.

Edge cases: null texts have no words, neither in documents nor in items, and such items occur nowhere; an item without an
id marks words but is not listed; items that share an id count once; rows may repeat and each gets its own result; a text of
any length is one row of one shard; further columns are carried along; no documents give no rows, no items no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import carrying, frugal, quoted, stored

#: Consecutive words of an item that a document must not have.
WINDOW = 10
#: Words of a shard; a longer text is a shard of its own.
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text that are sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are split into words at once.
_PIECE = 4 << 20

#: A-Z become a-z, and what is no letter, digit or part of a longer UTF-8 sequence becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """A block of the benchmark: numbered words, the items' words one after another, and all their suffixes."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]], window: int) -> None:
        split = [words_of(text or b"") for _, text in rows]
        self.ids = [i for i, _ in rows]
        self.numbers: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        self.words = np.fromiter((self.numbers[w] for words in split for w in words), dtype=np.int32, count=int(sizes.sum()))
        self.item = np.repeat(np.arange(len(rows)), sizes)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.offset = np.arange(len(self.words)) - starts
        self.left = np.repeat(sizes, sizes) - self.offset  # words from here to the item's end
        self.window = np.minimum(np.repeat(sizes, sizes), window)
        self.depth = int(sizes.max(initial=0))
        self.least = int(self.window.min(initial=window))

    def numbered(self, text: bytes | None) -> np.ndarray:
        """The numbers of a text's words, 0 for words of no item; the text is split a piece at a time."""
        parts, at = [np.empty(0, dtype=np.int32)], 0
        folded = (text or b"").translate(_FOLD)
        while at < len(folded):
            to = at + _PIECE
            to = len(folded) if to >= len(folded) else folded.find(b" ", to) % (len(folded) + 1)  # -1: to the end
            words = folded[at:to].split()
            parts.append(np.fromiter(map(self.numbers.get, words, repeat(0)), dtype=np.int32, count=len(words)))
            at = to
        return np.concatenate(parts)


def suffix_array(words: np.ndarray, least: int, depth: int, most: int) -> np.ndarray:
    """The places from which at least `least` numbers above 0 follow, in the order of the first `depth` numbers there. words end with depth zeros; most: the largest number."""
    n = len(words)
    zeros = np.flatnonzero(words == 0)
    ahead = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n) if len(zeros) else np.zeros(n, dtype=np.int64)
    places = np.flatnonzero(ahead >= max(least, 1))
    bits = max(1, int(most).bit_length())
    each = max(1, 62 // bits)

    def key(at: np.ndarray, begin: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(begin, begin + each):
            out = (out << bits) | (words[at + k] if k < depth else 0)
        return out

    first = key(places, 0)
    order = np.argsort(first, kind="stable")
    places, first = places[order], first[order]
    group = np.cumsum(np.concatenate(([0], first[1:] != first[:-1]))) if len(places) else places
    for begin in range(each, depth, each):
        same = np.concatenate((group[1:] == group[:-1], [False])) if len(places) else np.zeros(0, dtype=bool)
        same[1:] |= same[:-1].copy()
        open_ = np.flatnonzero(same)  # in a group of several
        if not len(open_):
            break
        at, g = places[open_], group[open_]
        now = key(at, begin)
        order = np.lexsort((now, g))
        places[open_], now, g = at[order], now[order], g[order]
        new = np.concatenate(([False], (g[1:] == g[:-1]) & (now[1:] != now[:-1])))
        step = np.zeros(len(places), dtype=np.int64)
        step[open_] = new
        group = group + np.cumsum(step)
    return places


def _bound(words: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, value: np.ndarray, right: bool) -> np.ndarray:
    """For each range of places, the first whose number at depth is not below (right: is above) value."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        found = words[places[middle] + depth]
        before = found <= value[open_] if right else found < value[open_]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]


def look_up(items: Items, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of the items: the longest match, a place of it, and the range of places that have its window (empty without one)."""
    n = len(items.words)
    longest, where = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    begin, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    now = np.arange(n) if len(places) else np.zeros(0, dtype=np.int64)
    low, high = np.zeros(len(now), dtype=np.int64), np.full(len(now), len(places), dtype=np.int64)
    depth = 0
    while len(now):
        value = items.words[now + depth]
        low, high = (_bound(words, places, low, high, depth, value, right) for right in (False, True))
        some = low < high
        now, low, high, depth = now[some], low[some], high[some], depth + 1
        longest[now], where[now] = depth, places[low] if len(now) else -1
        full = items.window[now] == depth
        begin[now[full]], end[now[full]] = low[full], high[full]
        more = items.left[now] > depth
        now, low, high = now[more], low[more], high[more]
    return longest, where, begin, end


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and its members, for ranges begin to end."""
    sizes = end - begin
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)


class Shard:
    """Texts laid end to end as numbers, with their suffix array and what the items' suffixes find in it."""

    def __init__(self, items: Items, numbered: list[np.ndarray]) -> None:
        gap = np.zeros(1, dtype=np.int32)
        self.items = items
        self.sizes = np.array([len(x) for x in numbered], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.words = np.concatenate([y for x in numbered for y in (x, gap)] + [np.zeros(items.depth + 64, dtype=np.int32)])
        self.places = suffix_array(self.words, items.least, items.depth, len(items.numbers))
        self.longest, self.where, self.begin, self.end = look_up(items, self.words, self.places)

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def hits(self) -> tuple[np.ndarray, list[list[int]]]:
        """Which words lie in a window, and the items of each text."""
        known = np.flatnonzero(self.begin < self.end)
        size = self.items.window[known]
        windows, which = np.unique(np.stack((self.begin[known], self.end[known], size)), axis=1, return_inverse=True)
        window, member = _ranges(windows[0], windows[1])  # a window that several items have counts once
        place = self.places[member]
        step = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(step, place, 1)
        np.add.at(step, place + windows[2][window], -1)
        pairs = np.unique(np.stack((self.row(place), window)), axis=1) if len(place) else np.zeros((2, 0), dtype=np.int64)
        order = np.argsort(which.ravel(), kind="stable")
        first = np.searchsorted(which.ravel()[order], np.arange(windows.shape[1] + 1))
        owner = self.items.item[known][order]
        out: list[list[int]] = [[] for _ in self.sizes]
        at, member = _ranges(first[pairs[1]], first[pairs[1] + 1])
        if len(at):
            for r, i in np.unique(np.stack((pairs[0][at], owner[member])), axis=1).T.tolist():
                out[r].append(i)
        return np.cumsum(step[:-1]) > 0, out


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Items]:
    """The benchmark's items with words, in blocks of bounded size, one at a time."""
    rows = stored(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("octet_length(text) > 0").distinct(), "benchmark")
    size = F.octet_length("text").cast("long")
    total, longest = rows.agg(F.sum(size), F.max(size)).first()
    n = 1 if not total or total <= BLOCK_BYTES else 2 * -(-total // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while n > 1 and rows.groupBy(block).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] > max(BLOCK_BYTES, longest):
        n *= 2
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        own = rows if n == 1 else rows.filter(block == k)
        found = [(r["item_id"], r["text"].encode()) for r in own.collect()]  # at most a block
        if found:
            yield Items(found, window)


def _shards(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list[pa.RecordBatch]]]:
    held, numbered, size = [], [], 0
    for batch in batches:
        own = [items.numbered(t.as_py()) for t in batch.column("_text").cast(pa.binary())]
        if held and size + sum(map(len, own)) > SHARD_WORDS:
            yield Shard(items, numbered), held
            held, numbered, size = [], [], 0
        held.append(batch)
        numbered += own
        size += sum(map(len, own))
    if held:
        yield Shard(items, numbered), held


_FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW) -> DataFrame:
    """carried (a struct of the named columns), n_words, spans and items, for every document.

    spans are the stretches of words (numbered from 0, stop excluded) that lie in an occurrence of a window, `window` consecutive words of an
    item of the benchmark (item_id, text), or all words of a shorter one; items are the ids, as strings and in order, of the items with such a window.
    """
    rows = docs.select(F.struct(*quoted(carry)).alias("carried"), F.col("text").cast("string").alias("_text"))
    rows = rows.selectExpr("*", "0L AS n_words", "CAST(array() AS array<struct<start:long,stop:long>>) AS spans", "CAST(array() AS array<string>) AS items")
    blocks = _blocks(benchmark, window)
    items = next(blocks, Items([], window))
    while items is not None:
        after = next(blocks, None)
        rows = _searched(rows, items, after is not None)
        if after is not None:
            rows = stored(rows, "leaks")
        items = after
    return rows


def _searched(rows: DataFrame, items: Items, again: bool) -> DataFrame:
    """rows with what one block of the benchmark finds beside what they have; with their texts, if they are to be searched again."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for shard, held in _shards(items, batches):
            hit, listed = shard.hits()
            r = 0
            for batch in held:
                spans, names = [], []
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                for r, (old_spans, old_items) in enumerate(before, r):
                    mask = hit[shard.starts[r] : shard.starts[r] + shard.sizes[r]]
                    if old_spans:
                        mask = mask.copy()
                        for s in old_spans:
                            mask[s["start"] : s["stop"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist() if mask.any() else []
                    spans.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
                    names.append(sorted({*old_items, *(items.ids[i] for i in listed[r] if items.ids[i] is not None)}) if listed[r] or old_items else [])
                r += 1
                sizes = pa.array(shard.sizes[r - batch.num_rows : r], pa.int64())
                out = {"carried": batch.column("carried"), "n_words": sizes, "spans": pa.array(spans, pa.list_(_SPAN)), "items": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(out | ({"_text": batch.column("_text")} if again else {}))

    return rows.mapInArrow(frugal(run), carrying(rows, _FOUND + ", _text string" * again))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    clean = find_leaks(docs, benchmark, docs.columns, window).filter(F.size("spans") == 0)
    return clean.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_start, length, doc_id, start: for each suffix of each item that matches a document in its item's window or more, the longest verbatim match of all shards and a place of it.

    Of places of equal length, the smallest doc_id's and there the first of its shard's array. Each task reports at most one row a suffix and shard.
    """
    found = None
    for items in _blocks(benchmark, window):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for shard, held in _shards(items, batches):
                some = np.flatnonzero(shard.begin < shard.end)
                place = shard.where[some]
                r = shard.row(place)
                ids = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks().take(pa.array(r))
                names = pa.array([items.ids[i] for i in items.item[some].tolist()], pa.string())
                ints = [pa.array(x, pa.int64()) for x in (items.offset[some], shard.longest[some], place - shard.starts[r])]
                yield pa.RecordBatch.from_arrays([names, ints[0], ints[1], ids, ints[2]], names=["item_id", "item_start", "length", "doc_id", "start"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
        own = rows.mapInArrow(frugal(run), "item_id string, item_start long, length long, doc_id long, start long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id string, item_start long, length long, doc_id long, start long")
    best = F.struct("length", F.negate("doc_id").alias("d"), F.negate("start").alias("s"))
    top = found.groupBy("item_id", "item_start").agg(F.max(best).alias("best"))
    return top.select("item_id", "item_start", "best.length", F.negate("best.d").alias("doc_id"), F.negate("best.s").alias("start"))
