"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reports, at each position, every piece that ends there (it
follows the output links), and each report relaxes the best score of its end. Scores of
the pieces add up; the segmentation with the largest sum wins. On a tie the longest last piece wins.
The model at hand was trained by merges, so its scores are negated merge ranks and no log-probabilities,
whose sums would punish long pieces. Each piece gets log p = -log(RANK_OFFSET + rank), up to a
constant, as if pieces were as frequent as Zipf's law says by rank (``log_probabilities``).
A character that is no piece of its own may also be spelled in byte pieces, at UNKNOWN_PENALTY below the lowest
score. Text that comes as chunks between spaces is cached by chunk, which gives
the same answer, since no piece holds a space after another character or a line feed;
a model with such pieces is encoded in one piece.

This is the vocabulary's unigram reading: some words are cut differently than when merges are
replayed, into about 1 % fewer pieces.

Decoding inverts encoding for every text: a space in front is added and removed, and a
literal U+2581 is spelled in bytes. Edge cases: null and empty texts have no pieces and
decode to the empty text; words of any length take time in proportion; no rows give no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.llm.common import frugal, worker_cache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Added to a merge rank before its logarithm, so that the first merges aren't taken for all of the language.
RANK_OFFSET = 100.0
#: Chunks kept in each of two generations, and the longest of them: a full generation becomes
#: the older one, and chunks that are met again move to the newer.
CACHE, CACHE_CHARS = 80_000, 48
#: Documents encoded before their ids are sent on.
PART = 200
_CHUNK = re.compile(" *[^ \n]+| +|\n")


def load_pieces(model_file: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is piece, byte or other (control and unknown)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def kind(i: int) -> str:
        return "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"

    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def log_probabilities(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """The pieces of a model trained by merges, whose scores are negated ranks, with log-probabilities (up to a constant) as scores."""
    return [(p, -math.log(RANK_OFFSET + max(0.0, -s)) if k == "piece" else s, k) for p, s, k in pieces]


def by_merges(pieces: list[tuple[str, float, str]]) -> bool:
    """Whether all scores of pieces are whole numbers below 1, as negated merge ranks are and log-probabilities aren't."""
    return all(s <= 0 and s == int(s) for _, s, k in pieces if k == "piece")


def scored_pieces(model_file: str = MODEL) -> list[tuple[str, float, str]]:
    """load_pieces with scores that can be added up."""
    pieces = load_pieces(model_file)
    return log_probabilities(pieces) if by_merges(pieces) else pieces


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "piece" else b"" for p, _, k in pieces]
        own = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == "piece"]
        for p, s, i in own:
            self.auto.add_word(p, (i, len(p), s))
            if len(p) == 1:
                self.single.add(p)
        self.auto.make_automaton()
        self.unknown = min((s for _, s, _ in own), default=0.0) - UNKNOWN_PENALTY
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in own)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _viterbi(self, s: str) -> list[int]:
        """Ids of the best segmentation of s, in which spaces are U+2581."""
        n, low = len(s), float("-inf")
        best, back = [low] * (n + 1), [(-1, 0)] * (n + 1)
        best[0], done = 0.0, 0
        single, unknown = self.single, self.unknown
        plain = single.issuperset(s)  # then no character needs spelling

        def spell(upto: int) -> None:
            for p in range(done, upto):
                if s[p] not in single and best[p] + unknown > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + unknown, (-1, 1)

        for end, (i, length, score) in self.auto.iter(s):
            if not plain and done < end:
                spell(end)
                done = end
            new = best[end + 1 - length] + score
            if new > best[end + 1]:
                best[end + 1], back[end + 1] = new, (i, length)
        if not plain:
            spell(n)
        out: list[int] = []
        while n:
            i, length = back[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass")))
            n -= length
        out.reverse()
        return out

    def _part(self, text: str, out: list[int]) -> None:
        cache = self.cache
        for chunk in [text] if self.whole else _CHUNK.findall(text):
            got = cache.get(chunk)
            if got is None:
                got = self.older.get(chunk) or tuple(self._viterbi(chunk.replace(" ", SPACE)))
                if len(chunk) <= CACHE_CHARS:
                    if len(cache) >= CACHE:
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    cache[chunk] = got
            out.extend(got)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate((" " + text).split(SPACE)):
            if k:
                out.extend(self.byte[b] for b in SPACE.encode())
            self._part(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


class _Shipped:
    """The vocabulary as a broadcast, made into a codec once in each worker."""

    def __init__(self, spark: SparkSession, pieces: list[tuple[str, float, str]]) -> None:
        self.key = hashlib.sha256(repr(pieces).encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast(pieces)

    def codec(self) -> Codec:
        held = worker_cache("pieces")
        if self.key not in held:
            held.clear()
            held[self.key] = Codec(self.sent.value)
        return held[self.key]


def encode_documents(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, ids (array of piece ids), n_pieces, n_bytes (byte pieces), ids_sha256 (of the ids as 4-byte little-endian), round_trip (decoding gives the text)."""
    ship = _Shipped(docs.sparkSession, scored_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ship.codec()
        spelled = np.zeros(len(codec.raw), dtype=bool)
        spelled[list(codec.byte.values())] = True
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, max(batch.num_rows, 1), PART):
                part = texts.slice(at, PART)
                ids, n_bytes, digest, same = [], [], [], []
                for t in part:
                    text = t.as_py() or ""
                    got = codec.encode(text)
                    a = np.array(got, dtype="<i4")
                    ids.append(a)
                    n_bytes.append(int(spelled[a].sum()))
                    digest.append(hashlib.sha256(a.tobytes()).hexdigest())
                    same.append(codec.decode(got) == text)
                offsets = np.concatenate(([0], np.cumsum([len(a) for a in ids]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, dtype="<i4"), *ids])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, PART), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(n_bytes, type=pa.int64()), pa.array(digest, type=pa.string()), pa.array(same, type=pa.bool_())], names=["doc_id", "ids", "n_pieces", "n_bytes", "ids_sha256", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, ids array<int>, n_pieces long, n_bytes long, ids_sha256 string, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to the empty text."""
    ship = _Shipped(encoded.sparkSession, scored_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ship.codec()
        for batch in batches:
            texts = [codec.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
