"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives a single pass over each text.

For a unigram model the pass is a Viterbi: output links relax the best score at
each position. For a BPE model it relaxes the same way, but what decides at a
position is not a sum: exactly one of the pieces that end there can follow the
segmentation of what is before it, the one whose merges leave the boundary
standing. Both give the ids of the sentencepiece library.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .gathered import Runs, ends_of
from .text import pieces

# Fixed values of the model file's format: field numbers, piece types, the space mark, the unknown piece's penalty.
FIELD_PIECE, FIELD_TRAINER, FIELD_NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

MEMO_ENTRIES, MEMO_PAIRS = 800_000, 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces and scores of a model file, its automaton, and the texts it has met.

    By the kind of model, the best segmentation of a text has the highest sum
    of piece scores (on ties, at each position, the longest last piece), or is
    what merging the best scored neighbours leaves. A character without a
    piece costs the least score minus UNKNOWN_PENALTY and becomes its UTF-8
    bytes' pieces where the model has them. Only ASCII space is normalised (to
    the space mark, one put in front if the model says so).
    """

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.prefix, self.kind = True, UNIGRAM
        for field, value in _fields(data):
            if field == FIELD_PIECE:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == FIELD_TRAINER:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == FIELD_NORMALIZER:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        if self.kind not in (UNIGRAM, BPE) or self.kind == BPE and {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only unigram models, and BPE models without user-defined and unused pieces, are known")
        usable = [k for k, kind in enumerate(self.kinds) if kind in (NORMAL, USER_DEFINED)]
        self.unknown_score = min((scores[k] for k in usable), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE}
        self._scores = {self.pieces[k]: scores[k] for k in usable}
        self._follows: dict[tuple[str, str], bool] = {}
        self._build([(self.pieces[k], k, scores[k]) for k in usable])
        # Where no piece holds a space mark after another character, texts can be cut before each run of marks.
        self.cuts = not any(a != SPACE and b == SPACE for k in usable for a, b in zip(self.pieces[k], self.pieces[k][1:], strict=False))
        self._forget()
        # Of each id the bytes that it stands for.
        means = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for byte, k in self.byte_ids.items():
            means[k] = bytes([byte])
        for k, kind in enumerate(self.kinds):
            if kind in (CONTROL, UNUSED):
                means[k] = b""
        self._bytes = Runs("u1")
        self._means = self._bytes.append(np.frombuffer(b"".join(means), np.uint8), np.array([len(m) for m in means]))

    def _forget(self) -> None:
        self._memo: dict[str, int] = {}
        self._runs = Runs()

    def _build(self, entries: list[tuple[str, int, float]]) -> None:
        """Goto arcs, failure links, and per state its own piece and the next state with one (output link)."""
        self._goto: list[dict[str, int]] = [{}]
        self._own: list[tuple[int, int, float] | None] = [None]
        for text, k, score in entries:
            state = 0
            for c in text:
                if (after := self._goto[state].get(c)) is None:
                    after = len(self._goto)
                    self._goto[state][c] = after
                    self._goto.append({})
                    self._own.append(None)
                state = after
            self._own[state] = (len(text), k, score)
        self._fail = [0] * len(self._goto)
        outputs: list[tuple] = [()] * len(self._goto)
        queue = deque(self._goto[0].values())
        while queue:
            state = queue.popleft()
            own = self._own[state]
            # Output links, already followed: this state's piece, then its failure state's.
            outputs[state] = ((own,) if own else ()) + outputs[self._fail[state]]
            for c, after in self._goto[state].items():
                back = self._fail[state]
                while back and c not in self._goto[back]:
                    back = self._fail[back]
                self._fail[after] = self._goto[back].get(c, 0)
                queue.append(after)
        self._outputs = outputs

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of already normalised ``text``."""
        return self._merged(text) if self.kind == BPE else self._viterbi(text)

    def _merged(self, text: str) -> list[int]:
        """The segmentation that merging leaves: at each position the one piece that can follow what is before it."""
        goto, fail, outputs, follows, pieces_of = self._goto, self._fail, self._outputs, self._follows, self.pieces
        last: list[str] = [""] * (len(text) + 1)
        ids = [self.unknown] * (len(text) + 1)
        state = 0
        for end, c in enumerate(text, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            last[end] = c
            for length, piece, _ in outputs[state]:
                pair = last[end - length], pieces_of[piece]
                if (stands := follows.get(pair)) is None:
                    if len(follows) > MEMO_PAIRS:
                        follows.clear()
                    follows[pair] = stands = self._stands(*pair)
                if stands:
                    last[end], ids[end] = pair[1], piece
                    break
        found, end = [], len(text)
        while end:
            found += [ids[end]] if ids[end] != self.unknown or not self.byte_ids else [self.byte_ids[b] for b in reversed(last[end].encode("utf-8", "replace"))]
            end -= len(last[end])
        found.reverse()
        return found

    def _stands(self, before: str, piece: str) -> bool:
        """Whether merging the two pieces' characters together gives just these two."""
        parts, score, none = list(before + piece), self._scores.get, -math.inf
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (top := max(gains)) > none:
            at = gains.index(top)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], none)
        return parts == ([before, piece] if before else [piece])

    def _viterbi(self, text: str) -> list[int]:
        """The segmentation of the highest sum of scores."""
        goto, fail, outputs = self._goto, self._fail, self._outputs
        best = [0.0] * (len(text) + 1)
        last: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
        state = 0
        for end, c in enumerate(text, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            top, how, single = -float("inf"), None, False
            for length, piece, score in outputs[state]:
                total = best[end - length] + score
                if total > top:
                    top, how = total, (length, piece)
                single |= length == 1
            if not single and (total := best[end - 1] + self.unknown_score) > top:
                top, how = total, (1, self.unknown)
            best[end], last[end] = top, how
        ids, end = [], len(text)
        while end:
            length, piece = last[end]
            if piece == self.unknown and self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[end - 1].encode("utf-8", "replace"))]
            else:
                ids.append(piece)
            end -= length
        ids.reverse()
        return ids

    def normalised(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def parts(self, text: str) -> list[str]:
        """The normalised text cut before each run of space marks, without the first mark of each part."""
        text = self.normalised(text)
        cut = text.split(SPACE)[1:]
        if "" not in cut[:-1]:
            return cut
        # An empty part is one mark more before the next.
        out, held = [], ""
        for chunk in cut[:-1]:
            held, done = (held + SPACE, None) if not chunk else ("", held + chunk)
            if done is not None:
                out.append(done)
        return [*out, held + cut[-1]]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's end."""
        if not (self.cuts and self.prefix):
            found = [self.best(self.normalised(t)) for t in texts]
            return np.fromiter(chain.from_iterable(found), "<u4"), np.cumsum([len(f) for f in found])
        if len(self._memo) > MEMO_ENTRIES:
            self._forget()
        cut = pc.split_pattern(pa.array([t if SPACE not in t else t.replace(SPACE, " ") for t in texts], pa.string()), " ")
        counts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        # Texts with runs of spaces, or with one in front, are cut by parts(); so are empty ones, which have none.
        odd = [k for k, t in enumerate(texts) if not t or t[0] == " " or "  " in t or SPACE in t]
        if odd:
            own = {k: self.parts(texts[k]) for k in odd}
            listed = pa.array([own[k] if k in own else None for k in range(len(texts))], pa.list_(pa.string()))
            cut = pc.coalesce(listed, cut)
            counts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return self._runs.gather(places), ends_of(places, counts)

    def _places(self, parts: list[str]) -> np.ndarray:
        memo = self._memo
        if new := [p for p in parts if p not in memo]:
            found = [self.best(SPACE + p) for p in new]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            memo.update(zip(new, self._runs.append(np.fromiter(chain.from_iterable(found), "<u4"), lengths).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, parts), np.int64, len(parts))

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        return self.encode_all([text])[0].astype("<u4").tobytes()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of ids in UTF-8: bytes joined, space marks as spaces, the one put in front taken off."""
        places = self._means[ids]
        data = self._bytes.gather(places).tobytes()
        stops = ends_of(places, np.diff(ends, prepend=0)).tolist()
        return [data[a + (self.prefix and data[a : a + 1] == b" " and a < b) : b] for a, b in zip([0, *stops], stops, strict=False)]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian uint32 ids."""
        own = np.frombuffer(ids, "<u4")
        return self.decode_all(own, np.array([len(own)]))[0].decode("utf-8", "replace")


_models: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = zlib.crc32(data)
    return _models.get(key) or _models.setdefault(key, PieceModel(data))


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, model_path: str, column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: little-endian uint32 ids of each whole text as binary; null texts are empty."""
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in pieces(batches, "text"):
            ids, ends = model.encode_all(batch["text"].to_pylist())
            data = [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(column, F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; null ids give the empty text."""
    shared = _shared(coded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in pieces(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([model.decode(v or b"") for v in batch["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def audit(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, n_chars, restored)`` of every whole text, encoded and decoded again.

    restored says whether decoding gives the text back (a text with the space
    mark itself comes back with spaces). Null texts are empty; null ids,
    repeated rows and extra columns are passed by; an empty table stays empty.
    """
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in pieces(batches, "text"):
            texts = batch["text"].to_pylist()
            ids, ends = model.encode_all(texts)
            view = memoryview(ids)
            crc = [zlib.crc32(view[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            same = [a == b.replace(SPACE, " ").encode("utf-8", "replace") for a, b in zip(model.decode_all(ids, ends), texts, strict=True)]
            columns = [pa.array(np.diff(ends, prepend=0)), pa.array(crc, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_ids", "ids_crc32", "n_chars", "restored"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, restored boolean")
