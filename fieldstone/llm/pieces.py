"""SentencePiece encoding and decoding: Viterbi over an Aho-Corasick automaton of the pieces.

The automaton reads a text once.  At each position it reports, along its output links, every piece
that ends there; each such piece relaxes the best score of its end from that of its start.  Following
the best predecessors back from the end gives the segmentation of the highest total score; of equal ones
that with the longest last piece, and so on to the front.  A character that no piece covers costs more than any
piece and becomes its UTF-8 bytes' pieces.  The model file's normalisation rules are not applied, since decoding must
give back the text, and its user-defined pieces compete by their scores like all others.

Spaces are written as U+2581 and one is put in front, as the model expects.  A U+2581 in the text
itself is written by byte pieces, so decoding gives back every text exactly.  Where no piece goes on
over the start of a run of U+2581, texts are cut there and equal parts are segmented once per task;
the result is that of one pass over the whole text.

Vocabularies are read from a model file on the driver and broadcast (some tens of thousands of
pieces; at most ``MAX_PIECES``).  Defined results: a null text has null pieces, an empty text none; very long
texts are encoded whole; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
MAX_PIECES = 2_000_000


class Vocabulary:
    """Pieces with scores, byte pieces, and the text of each id."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        if size > MAX_PIECES:
            raise ValueError(f"a vocabulary of {size} pieces is too large to broadcast")
        self.pieces, self.byte_ids, self.size = pieces, byte_ids, size
        self.unknown = min((s for _, _, s in pieces), default=0.0) - 10.0
        self.cuts = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for _, p, _ in pieces)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file; control and unknown pieces never match text."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte_ids = [i for i in range(n) if m.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        usable = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls([(i, m.id_to_piece(i), m.get_score(i)) for i in usable], byte_ids, n)


class Coder:
    """Encodes and decodes on one worker."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 300_000):
        import ahocorasick

        self.v, self.most, self.seen = vocabulary, remembered, {}
        self.automaton = ahocorasick.Automaton()
        for i, piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (i, len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.single = {p for _, p, _ in vocabulary.pieces if len(p) == 1}
        self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        text = [b""] * vocabulary.size
        for i, piece, _ in vocabulary.pieces:
            text[i] = piece.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(vocabulary.byte_ids):
            text[i] = bytes((b,))
        self.text = text

    def best(self, part: str) -> tuple[int, ...]:
        """The ids of the best segmentation of ``part``; '\\0' stands for a literal U+2581."""
        n, unknown, none = len(part), self.v.unknown, (-1, 1, 0.0)
        score, back, done = [0.0] + [float("-inf")] * n, [none] * (n + 1), 0
        if self.single.issuperset(part):  # a character's own piece is better than unknown, so nothing is
            for end, found in self.automaton.iter(part):
                end += 1
                s = score[end - found[1]] + found[2]
                if s > score[end]:
                    score[end], back[end] = s, found
            out = []
            while n:
                i, size, _ = back[n]
                out.append(i)
                n -= size
            return tuple(reversed(out))
        for end, found in self.automaton.iter(part) if self.v.pieces else ():
            # The automaton has passed all positions up to ``end``: they are final but for an unknown.
            while done < end:
                s = score[done] + unknown
                done += 1
                if s > score[done]:
                    score[done], back[done] = s, none
            s = score[end + 1 - found[1]] + found[2]
            if s > score[end + 1]:
                score[end + 1], back[end + 1] = s, found
        while done < n:
            s = score[done] + unknown
            done += 1
            if s > score[done]:
                score[done], back[done] = s, none
        out, at = [], n
        while at:
            i, size, _ = back[at]
            if i < 0:
                c = part[at - 1]
                raw = MARK if c == "\0" else c
                out.extend(self.v.byte_ids[b] for b in reversed(raw.encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
            at -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.v.cuts and "  " not in text and text[0] != " " and text[-1] != " " and "\0" not in text and MARK not in text:
            return self._words(text.split(" "))
        # '\0' can't be both: texts that hold one are encoded by parts around it.
        if "\0" in text:
            pieces = text.split("\0")
            out = self.encode(pieces[0]) if pieces[0] else [*self.best(MARK)]
            for p in pieces[1:]:
                out.append(self.v.byte_ids[0])
                out.extend(self._marked(p.replace(MARK, "\0").replace(" ", MARK)))
            return out
        return self._marked(MARK + text.replace(MARK, "\0").replace(" ", MARK))

    def _words(self, words: list[str]) -> list[int]:
        """The pieces of words that one space each sets off: what ``_marked`` gives for them."""
        seen = self.seen
        found = list(map(seen.get, words))
        if None in found:
            for j, ids in enumerate(found):
                if ids is None:
                    if len(seen) >= self.most:
                        seen.clear()
                    word = words[j]
                    found[j] = ids = self.best(MARK + word)
                    if len(word) <= 64:
                        seen[word] = ids
        return list(chain.from_iterable(found))

    def _marked(self, text: str) -> list[int]:
        if not self.v.cuts:
            return [*self.best(text)]
        out: list[int] = []
        for part in self.part.findall(text):
            out += self._words([part[1:]]) if part[0] == MARK != part[1:2] else self.best(part)
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw.decode("utf-8", "surrogatepass")[1:]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, n_pieces long, pieces array<int>, round_trip boolean (the pieces decode to
    exactly the text; null for a null text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_ids, vocabulary.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(*shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(1).to_pylist()
                ids = [None if t is None else coder.encode(t) for t in texts]
                whole = [None if t is None else coder.decode(i) == t for t, i in zip(texts, ids)]
                sizes = [0 if i is None else len(i) for i in ids]
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(i for i in ids if i), np.int32, int(ends[-1]))
                missing = pa.array([i is None for i in ids])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=missing)
                counts = pa.array([None if i is None else len(i) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), counts, lists, pa.array(whole, pa.bool_())], ["key", "n_pieces", "pieces", "round_trip"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_pieces long, pieces array<int>, round_trip boolean").withColumnRenamed("key", key)


def decode_documents(coded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", key: str = "doc_id") -> DataFrame:
    """One row per row: key and the text of its pieces (null for null)."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_ids, vocabulary.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(*shared.value))
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = coded.select(F.col(key).alias("key"), F.col(pieces).alias("pieces"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
