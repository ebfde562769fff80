"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once per document and keeps its measurements and one
bit per failed rule. A policy is a named set of bits, so a verdict under another policy
version, and the documents that a single rule alone removes, need no second look at the
texts: they are bitwise operations over the ledger.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Edge cases: null and empty texts have no words
and fail the length rule; one word or two have no 3-word window; a repeated row gets a
row of its own; no rows give no rows; further columns are ignored. Capitals and small letters are counted character by
character: one whose case mapping has several characters (ﬁ, ŉ) is neither, ß is small and ǅ both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules by bit. The first two are the base rules.
RULES = (
    "short",  # under 50 words
    "repeats",  # over half of the words are in 3-word windows found twice or more
    "symbols",  # a symbol for every 5 words or more
    "dup_lines",  # over 60 % of the lines that have words repeat an earlier one
    "word_length",  # mean word length outside 2 to 15 characters
    "shouting",  # over 70 % of the cased letters are capitals
    "bangs",  # an exclamation mark for every 3 words or more
)
#: Versions of the policy, as sets of rules; a version is never changed once used.
POLICIES = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols", "word_length"),
    "v2": RULES,
}
SYMBOLS = "#*$%&|<>"
LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_bangs long, fail_bits long"
_SPACE = b" \t\n\r\x0b\x0c"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more; all occurrences count."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    base = np.int64(len(ids))
    pair = np.unique(w[:-1] * base + w[1:], return_inverse=True)[1]  # ids of pairs, so that triples fit 64 bits
    triple = pair[:-1].astype(np.int64) * base + w[2:]
    _, which, times = np.unique(triple, return_inverse=True, return_counts=True)
    start = (times[which] > 1).astype(np.int32)
    hit = np.zeros(n, dtype=np.int32)
    hit[: n - 2] += start
    hit[1 : n - 1] += start
    hit[2:] += start
    return int((hit > 0).sum())


@lru_cache(maxsize=1)
def _cases() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a capital (it has a small letter of its own), and is it small (it has a capital of its own, or is a capital's small letter)."""
    capitals, small = (np.zeros(0x110000, dtype=bool) for _ in range(2))
    for i in range(0x110000):
        low, up = chr(i).lower(), chr(i).upper()
        if low != chr(i):
            capitals[i] = True
            if len(low) == 1:
                small[ord(low)] = True
        if up != chr(i) and len(up) == 1:
            small[i] = True
    return capitals, small


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_lower, n_bangs."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly the six ASCII spaces
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            dups += line in seen
            seen.add(line)
    capitals, small = _cases()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    upper, lower = int(capitals[points].sum()), int(small[points].sum())
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), dups, repeated_words(words), lines, upper, lower, text.count("!")


def failures(m: tuple[int, ...]) -> int:
    n, chars, symbols, dups, repeats, lines, upper, lower, bangs = m
    failed = (
        n < 50,
        100 * repeats > 50 * n,
        n > 0 and 5 * symbols >= n,
        lines > 0 and 10 * dups > 6 * lines,
        n > 0 and not 2 * n <= chars <= 15 * n,
        10 * upper > 7 * (upper + lower),
        n > 0 and 3 * bangs >= n,
    )
    return sum(1 << i for i, x in enumerate(failed) if x)


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LEDGER.split(", ")]
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column("text")]
        cols = [list(c) for c in zip(*found)] if found else [[] for _ in range(9)]
        cols.append([failures(m) for m in found])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, type=pa.int64()) for c in cols]], names=names)


def ledger(docs: DataFrame) -> DataFrame:
    """Every rule once over every document: measurements and fail_bits."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_ledger, LEDGER)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """Add base_failed and kept under a policy; kept is false wherever the base rules fail."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0))


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_alone (documents that come back if only this rule goes) under a policy.

    Documents are first counted by their masked bits (at most 2^rules rows), then each rule reads those counts.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    counts = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    one = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counts.select("bits", "n", F.inline(one))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"))
