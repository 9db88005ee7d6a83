"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from scene_qa.llm.common import column, utf8

#: Subtracted from the least score of the vocabulary for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words kept, twice at most: those met of late and those before them.
_CACHED = 250_000


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece unigram model with its own scores."""
    return [(piece, score) for piece, score, _ in _pieces(model_path)]


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model of another kind, such as BPE, whose scores are no log-probabilities: those of Zipf's
    law over the rank, 1 / (rank ln n)."""
    found = _pieces(model_path)
    n = max((rank for *_, rank in found), default=0) + 1
    return [(piece, -math.log((rank + 1) * math.log(max(n, 3)))) for piece, _, rank in found]


def _pieces(model_path: str) -> list[tuple[str, float, int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class _Known(dict):
    """Words counted before. When it is full it becomes the older half, in which words are still looked up, so that
    common words stay."""

    def __init__(self, count) -> None:
        super().__init__()
        self.count, self.older = count, {}

    def __missing__(self, word: bytes) -> tuple[float, int]:
        found = self.older.get(word)
        if found is None:
            found = self.count(SPACE + word.decode("utf-8", "replace").replace(" ", SPACE))
        if len(word) <= 48:
            if len(self) >= _CACHED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Counter:
    """Best score and piece count of a word. An Aho-Corasick automaton lists the pieces that end at each character,
    longest first; a candidate replaces the best so far only if its score is greater, so of equal ways to a
    character the longest last piece stays. A character that no piece of its own covers may be unknown: it counts its
    UTF-8 bytes if the vocabulary has all byte pieces, else a run of them counts one."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        scores = dict(vocabulary)
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.single = {piece for piece in scores if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = _Known(self.word)

    def word(self, text: str) -> tuple[float, int]:
        # score and pieces up to each character; the start stands last, at -1
        n = len(text)
        best, count = [-math.inf] * n + [0.0], [0] * (n + 1)
        if self.single.issuperset(text):
            for end, (size, s) in self.automaton.iter(text):
                score = best[end - size] + s
                if score > best[end]:
                    best[end], count[end] = score, count[end - size] + 1
            return best[n - 1], count[n - 1]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            ends[end].append(piece)
        unknown = -2  # the last unknown character
        for end in range(n):
            for size, s in ends[end]:
                score = best[end - size] + s
                if score > best[end]:
                    best[end], count[end] = score, count[end - size] + 1
            if text[end] not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end] = best[end - 1] + self.unknown
                count[end] = count[end - 1] + (len(text[end].encode("utf-8", "replace")) if self.bytes else unknown != end - 1)
                unknown = end
        return best[n - 1], count[n - 1]

    def text(self, data: bytes) -> tuple[int, float]:
        """Pieces and score of a whole text: ASCII white space parts words, each led by the space mark."""
        pieces, score = 0, 0.0
        for s, n in map(self.known.__getitem__, data.split()):
            score += s
            pieces += n
        return pieces, score


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, score, n_bytes, over its whole text.

    Null and blank texts have no tokens and score 0; a very long text is counted word by word. Ids may repeat or be null; rows
    that repeat are counted each; other columns are not read, whatever they are called; an empty table gives no rows. Of equally
    good ways to cut a word, the tokenizer's rule decides (see Counter). The vocabulary is a tokenizer's file, of fixed size,
    and goes to every task; words once counted are kept, up to a bound."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(column(doc_id).alias("doc_id"), utf8(column(text)).alias("data"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in batches:
            n, score, size = zip(*[(*counter.text(data), len(data)) for x in batch.column(1) if (data := x.as_py()) is not None], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "score", "n_bytes"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double, n_bytes long")
