"""Runs of repeated words: maximal stretches that a short period fills several times, found from Lyndon words.

The alphabet is only ordered: words are compared as they are, without numbers, hashes or suffix structures. One pass from
left to right keeps the suffixes that are still candidates for the next smaller one on a stack. When suffix j comes,
every larger suffix i on top finds in j its next smaller suffix, so that words i..j-1 are the longest Lyndon word from i
(the Lyndon array is j - i); the first smaller one that stays is the previous smaller suffix of j, which is the same
relation under the reversed order. Two neighbouring Lyndon roots of a run that holds its period three times or more are such a pair,
whichever way the run breaks off, so one pass is enough.

Extensions (words that suffixes i and j share) are reused and not matched again: along the stack they follow from
those of neighbours (unequal ones decide, equal ones go on from there), and at each distance j - i the last stretch that
matched is kept, so that no word is found equal twice to the one at the same distance. A run is extended to the left by less than a period, once.

Edge cases: null and empty texts have no words and no runs; texts of any length are taken whole, in memory that grows
with their words; rows may repeat; further columns are carried along; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import carrying, frugal, quoted

#: A run holds its period so many times, and so many words.
TIMES, LEAST = 4, 6
RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_of(words: list, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of times periods and least words or more, by start, then period; times is 3 or more.

    words are of any ordered type; the list gets an end mark for the time of the call, so they must be bytes or str.
    """
    n, enough = len(words), times - 2
    if n < least:
        return []
    words.append(words[0][:0])  # smaller than every word and equal to none
    stack, shared = [0], [0]  # suffixes whose next smaller one is still to come; what each shares with the one below it
    reach = [0] * n  # by distance: where the stretch that last matched ends
    found, ends = [], {}
    for j in range(1, n):
        word, common = words[j], 0
        while stack:
            i = stack[-1]
            if common == 0:
                above = words[i]
                if above < word:
                    break
                if above > word:
                    stack.pop()
                    while shared.pop():  # the one below begins with the same word, so it is larger, too
                        stack.pop()
                    continue
            distance = j - i
            at = i + common
            if at < reach[distance]:
                at = reach[distance]
            else:
                while words[at] == words[at + distance]:
                    at += 1
                reach[distance] = at
            common = at - i
            if common > enough * distance:
                found.append((i, distance, at))
            if words[at] < words[at + distance]:
                break
            stack.pop()
            below = shared.pop()
            while below > common:
                i = stack.pop()
                if common > enough * (j - i):
                    found.append((i, j - i, i + common))
                below = shared.pop()
            if below < common and stack:
                common = below
                if common > enough * (j - stack[-1]):
                    found.append((stack[-1], j - stack[-1], stack[-1] + common))
                break
        stack.append(j)
        shared.append(common if len(stack) > 1 else 0)
    out = []
    for i, period, end in found:
        if ends.get(period) == end:  # a further pair of roots of the same run
            continue
        ends[period] = end
        start = i
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        length = end + period - start
        if length >= least and length >= times * period:
            out.append((start, length, period))
    words.pop()
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    out, done = [], 0
    gone = sorted((s + p, s + n) for s, n, p in runs)
    for a, b in gone:
        if a > done:
            out += words[done:a]
        done = max(done, b)
    return out + words[done:]


def find_runs(docs: DataFrame, carry: list[str], text: Column | None = None, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """carried (a struct of the named columns), n_words, runs (by start, then period) and collapsed, the text with one period of each run, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for value in batch.column("_text").cast(pa.binary()):
                words = (value.as_py() or b"").split()  # at space and \t to \r, as bytes do
                sizes.append(len(words))
                own = runs_of(words, times, least)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                collapsed.append(b" ".join(kept_words(words, own)))
            arrays = [batch.column("carried"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["carried", "n_words", "runs", "collapsed"])

    rows = docs.select(F.struct(*quoted(carry)).alias("carried"), (F.col("text") if text is None else text).alias("_text"))
    return rows.mapInArrow(frugal(run), carrying(rows, f"n_words long, runs array<{RUN}>, collapsed string"))
