"""Token counts of fields or sections by offset mapping.

A whole document is encoded once. The byte lengths of its tokens give every token's
span; the spans are interval-joined to the sections (sorted starts, binary search), and
a token that crosses a boundary goes to one section by an explicit rule:

- ``most`` (the default): the section with most of its characters, the first on a tie;
- ``first``: the section of its first byte;
- ``last``: the section of its last byte.

So sections' counts add up to the document's count, which separate encoding of sections
does not give. Sections are lines (with their line feed) or sentences (up to the spaces
after ``.``, ``!`` or ``?``, or a line feed), unless ``section_starts`` is given:
ascending code-point offsets of which the first is 0.

Edge cases: null and empty texts have no tokens and no sections (with section_starts, as
many as given, all 0); runs of any length, of white space too, take time in proportion; empty sections get 0; starts past the end give empty sections; a
repeated row gets a row of its own; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import worker_cache

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "first", "last")
#: The characters that \\s stands for there (fixed values), and runs of them from which on the pattern would run out of stack.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
SECTIONS = {"lines": re.compile(rb"\n"), "sentences": re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n")}
OUT = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>"


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
        self.long_run = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")

    def ids(self, text: str) -> np.ndarray:
        """The text's token ids.

        The pattern makes one piece of a run of white space but its last character, which
        goes with what follows; long runs are cut there before the pattern sees them.
        """
        parts, at = [], 0
        for m in self.long_run.finditer(text):
            stop = m.end() - (m.end() < len(text))
            parts.append(self.encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()))
            parts.append(np.array(self.encoding._encode_single_piece(text[m.start() : stop]), dtype=np.uint32))
            at = stop
        parts.append(self.encoding.encode_to_numpy(text[at:] if at else text, disallowed_special=()))
        return np.concatenate(parts) if at else parts[0]

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the text's tokens end."""
        return np.cumsum(self.lengths[self.ids(text)])


def attribute(ends: np.ndarray, raw: bytes, starts: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens of each section and the number of tokens that cross a boundary; starts in bytes."""
    counts = np.zeros(len(starts), dtype=np.int64)
    if not len(ends) or not len(starts):
        return counts, 0
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = np.flatnonzero(last > first)
    chosen = last.copy() if rule == "last" else first.copy()
    if rule == "most" and len(crossing):
        heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
        near = crossing[last[crossing] == first[crossing] + 1]
        cut = heads[starts[last[near]]]
        chosen[near] += (heads[ends[near]] - cut) > (cut - heads[begins[near]])
        for k in crossing[last[crossing] > first[crossing] + 1]:
            cuts = np.concatenate(([begins[k]], starts[first[k] + 1 : last[k] + 1], [ends[k]]))
            chosen[k] = first[k] + int(np.argmax(np.diff(heads[cuts])))
    return np.bincount(chosen, minlength=len(starts)), len(crossing)


def section_starts(raw: bytes, sections: str = "lines") -> np.ndarray:
    """Byte offsets at which lines or sentences begin; a boundary at the end begins none."""
    if not raw:
        return np.zeros(0, dtype=np.int64)
    cuts = np.array([m.end() for m in SECTIONS[sections].finditer(raw)], dtype=np.int64)
    return np.concatenate((np.zeros(1, dtype=np.int64), cuts[cuts < len(raw)]))


def byte_starts(raw: bytes, points: list[int]) -> np.ndarray:
    """Code-point offsets as byte offsets; those past the end become the end."""
    heads = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    heads = np.concatenate((heads, [len(raw)]))
    return heads[np.minimum(np.array(points, dtype=np.int64), len(heads) - 1)]


def attribute_tokens(docs: DataFrame, ranks_file: str = RANKS, rule: str = "most", sections: str = "lines") -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens of docs(doc_id, text[, section_starts])."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = "section_starts" in docs.columns
    loaded = load_ranks(ranks_file)
    key = hashlib.sha256(repr(sorted(loaded.items())).encode()).hexdigest()
    ranks = docs.sparkSession.sparkContext.broadcast(loaded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("tokens")
        if key not in held:
            held.clear()
            held[key] = Encoder(ranks.value)
        encoder = held[key]
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                own = batch.column("section_starts")[k].as_py() if given else None
                starts = section_starts(raw, sections) if own is None else byte_starts(raw, own)
                ends = encoder.ends(text)
                counts, crossing = attribute(ends, raw, starts, rule)
                rows.append((len(ends), len(starts), crossing, counts))
            cols = list(zip(*rows)) if rows else [()] * 4
            out = [pa.array([int(x) for x in c], type=pa.int64()) for c in cols[:3]] + [pa.array(list(cols[3]), type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=[x.split()[0] for x in OUT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col("section_starts").cast("array<long>").alias("section_starts")] if given else []))
    return rows.mapInArrow(run, OUT)


def fields_as_sections(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """doc_id, text, section_starts: the fields one after another, each a section; null fields are empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, starts = F.lit(0), []
    for p in parts:
        starts.append(at.cast("long"))
        at = at + F.length(p)
    return df.select(F.col(key).alias("doc_id"), F.concat(*parts).alias("text"), F.array(*starts).alias("section_starts"))
