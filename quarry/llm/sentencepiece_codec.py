"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A word is marked by the spaces before it, and no piece reaches over a word's end, so each distinct
marked word is solved once: the words are sorted, which is the depth-first order of their trie, and
the forward states of the characters that a word shares with the one before it are kept. A forward
state is the best segmentation of a prefix: its score, its last piece and where that starts.

For a unigram model the best is the largest sum of piece scores. A byte-pair model's segmentation is
not that of the largest sum: there the lattice is constrained to pairs of pieces that merging
leaves as they are (found once a pair, by merging their text), and a sequence is the model's own if all
its neighbours are such pairs, so one path to each prefix is left and the result is that of
the public library. Characters outside the vocabulary become byte pieces, so decoding gives back
every text exactly, the mark character U+2581 included.

Defined results: a null or empty text has no pieces and decodes to the empty text; repeated rows
and ties get equal pieces; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: stands for a literal U+2581 of a text; no valid text has a lone surrogate
_LITERAL = "\ud800"
_WORD = re.compile(r" *[^ \n]+| +|\n")
MODEL = "piece_bpe_32k.model"
KEPT_WORDS = 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def is_byte_pair(model: bytes) -> bool:
    """Whether the model file's trainer section (field 2) names its type (field 3) as byte pairs (2)."""
    return any(n == 3 and v == 2 for number, part in _fields(model) if number == 2 for n, v in _fields(part))


class Codec:
    """A model file's pieces and scores, for encoding and decoding."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        import sentencepiece

        model = model or open(path, "rb").read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_pair = is_byte_pair(model)
        self.scores: dict[str, float] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [-1] * 256
        self.raw: list[bytes] = []
        self.trie: dict = {}  # of the pieces read backwards; "" has (score, id)
        least = 0.0
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.raw.append(bytes([int(p[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(p.replace(MARK, " ").encode())
                least = min(least, sp.get_score(i))
                if MARK in p.lstrip(MARK) or "\n" in p or " " in p:
                    raise ValueError(f"piece {p!r} reaches over a word's end")
                node = self.trie
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = (sp.get_score(i), i)
                self.scores[p] = sp.get_score(i)
        if -1 in self.bytes:
            raise ValueError("the model has no byte pieces")
        self.unknown = least - 10
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging: of neighbours that join to a piece, those with the best score, the leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = max(((scores[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores), default=(0, 1))
            if at > 0:
                break
            parts[-at : -at + 2] = [parts[-at] + parts[-at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves piece b after piece a as they are; -1 is the start or a foreign character."""
        if a < 0:
            if (found := self.follows.get((-1, b))) is None:
                found = self.follows[-1, b] = self.merged(self.pieces[b]) == [self.pieces[b]]
            return found
        if (found := self.follows.get((a, b))) is None:
            if len(self.follows) > KEPT_WORDS * 5:
                self.follows.clear()
            found = self.follows[a, b] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return found

    def _solve(self, words: list[str]) -> None:
        """Adds the ids of sorted distinct marked words; forward scores of a shared prefix stay."""
        best, back = [0.0], [(0, -1)]  # of each prefix: its score; where its last piece starts, and the piece
        before, trie, unknown, solved, pairs = "", self.trie, self.unknown, self.words, self.byte_pair
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, start = trie, end
                top, place = best[end - 1] + unknown, (end - 1, -1)
                while start:
                    node = node.get(word[start - 1])
                    if node is None:
                        break
                    start -= 1
                    if piece := node.get(""):
                        if pairs:
                            if self._may_follow(back[start][1], piece[1]):
                                place = (start, piece[1])
                                break
                            continue
                        score = best[start] + piece[0]
                        if score >= top or start == end - 1:
                            top, place = score, (start, piece[1])
                best.append(top)
                back.append(place)
            ids, end = [], len(word)
            while end:
                start, piece = back[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    c = word[start:end]
                    ids += [self.bytes[b] for b in reversed((MARK if c == _LITERAL else c).encode())]
                end = start
            solved[word] = np.array(ids[::-1], np.int32).tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, int32 in native order."""
        split = [[w.replace(" ", MARK) for w in _WORD.findall(" " + t.replace(MARK, _LITERAL))] if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        new = {w for words in split for w in words}
        new.difference_update(self.words)
        self._solve(sorted(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text; the mark that every text starts with goes."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>)."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                found = [np.frombuffer(x, np.int32) for x in codec(path).encode([t or "" for t in part.column(1).to_pylist()])]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(found))], names=["doc_id", "ids"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, text); a null array is the empty text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(np.array(x, np.int64)) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, n_pieces, ids_sha256 (int32, little-endian), decoded_sha256, exact."""
    path = path or default_model()
    names = ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "exact"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in common.slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = []
                for doc_id, text, ids in zip(part.column(0).to_pylist(), texts, c.encode(texts)):
                    back = c.decode(np.frombuffer(ids, np.int32))
                    out.append((doc_id, len(text), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.texts(common.table(spark, sf_dir, "documents")))
