"""Count-only Viterbi: tokens of each text under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces ending at each character; dynamic programming carries
the best score and its number of pieces.  Ties go to the piece that starts first, characters without a
piece cost the lowest score less ten and count as their UTF-8 bytes where the vocabulary has byte pieces,
as unigram tokenizers do.  Texts are cut where no piece of the vocabulary can cross, and the counts of
units already seen are reused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import ship_package

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0
#: Units whose counts a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000


def read_pieces(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Viterbi:
    """Best-path piece counts of units; ``byte_fallback`` if all byte pieces are there."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = {p for p, _ in pieces}
        self.byte_fallback = all(f"<0x{b:02X}>" in known for b in range(256))
        self.between = next(chr(c) for c in range(0xE000, 0xF8FF) if not any(chr(c) in p for p in known))
        inner = {a + b for p in known for a, b in zip(p, p[1:])}
        # A cut lies before a mark that follows another character, and around line ends, if no piece spans it.
        open_marks = MARK not in known or any(ab[1] == MARK and ab[0] != MARK for ab in inner)
        ends = "" if not self.byte_fallback or any("\n" in p and len(p) > 1 for p in known) else "\n"
        if open_marks:
            self.units = re.compile(r"[^\n]+|\n" if ends else r"[\s\S]+")
        else:
            self.units = re.compile(f"{MARK}*[^{MARK}{ends}]+|{MARK}+" + ("|\n" if ends else ""))

    def many(self, units: list[str]) -> tuple[list[int], list[float]]:
        """Pieces and score of the best path of each unit; one pass of the automaton over all of them.

        Units are joined by a character that no piece holds, so no match crosses; there the path goes on at no cost.
        """
        text = self.between.join(units)
        ends = {}  # place of each joint
        at = 0
        for u in units[:-1]:
            at += len(u)
            ends[at] = True
            at += 1
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        fused = [False] * (n + 1)  # the best path here ends with an unknown character
        unknown, fallback, nothing = self.unknown, self.byte_fallback, float("-inf")

        def unknown_at(e: int, top: float, pieces: int) -> None:
            if e in ends:
                top, pieces = best[e], count[e]
            elif best[e] + unknown > top:
                top = best[e] + unknown
                pieces = count[e] + (len(text[e].encode()) if fallback else 0 if fused[e] else 1)
                fused[e + 1] = True
            best[e + 1], count[e + 1] = top, pieces

        # Matches come by their end, the longest (which starts first) before the others: on a tie it stays.
        cur, top, pieces, single = 0, nothing, 0, False
        for end, (length, score) in self.automaton.iter(text):
            if end != cur:
                if single:
                    best[cur + 1], count[cur + 1] = top, pieces
                else:
                    unknown_at(cur, top, pieces)
                for cur in range(cur + 1, end):
                    unknown_at(cur, nothing, 0)
                cur, top, single = end, nothing, False
            start = end + 1 - length
            got = best[start] + score
            if got > top:
                top, pieces = got, count[start] + 1
            if length == 1:
                single = True
        for cur in range(cur, n):
            if single:
                best[cur + 1], count[cur + 1] = top, pieces
            else:
                unknown_at(cur, top, pieces)
            top, single = nothing, False
        counts, scores, at = [], [], 0
        for u in units:
            counts.append(count[at + len(u)] - count[at])
            scores.append(best[at + len(u)] - best[at])
            at += len(u) + 1
        return counts, scores

    def prepare(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""


class Counter:
    """Counts of texts; a worker keeps one for all its tasks."""

    def __init__(self, viterbi: Viterbi):
        self.viterbi = viterbi
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def count(self, texts: list[str | None]) -> tuple[list[int], list[float]]:
        find, prepare = self.viterbi.units.findall, self.viterbi.prepare
        tokens, scores = [], []
        for at in range(0, len(texts), 256):
            units = [find(prepare(t)) if t else [] for t in texts[at : at + 256]]
            if len(self.counts) > REMEMBERED:
                self.counts.clear()
                self.scores.clear()
            fresh = list({u for own in units for u in own}.difference(self.counts))
            for a in range(0, len(fresh), 20_000):
                part = fresh[a : a + 20_000]
                n, s = self.viterbi.many(part)
                self.counts.update(zip(part, n))
                self.scores.update(zip(part, s))
            tokens += [sum(map(self.counts.__getitem__, own)) for own in units]
            scores += [float(sum(map(self.scores.__getitem__, own))) for own in units]
        return tokens, scores


_COUNTERS: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    """The worker's counter for a vocabulary file sent with the job."""
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(Viterbi(read_pieces(SparkFiles.get(name))))
    return _COUNTERS[name]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, score`` of every row; null and empty texts have no tokens and score 0.

    The vocabulary is a file of fixed size sent with the job.  Rows are independent: repeated rows repeat,
    an empty table gives none, other columns are left behind.
    """
    spark = docs.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(name)
        for batch in batches:
            tokens, scores = own.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                names=["id", "n_tokens", "score"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(
        count, f"id {kind.simpleString()}, n_tokens long, score double"
    )
    return out.withColumnRenamed("id", id_col)
