"""SentencePiece encoding and decoding.

An Aho-Corasick automaton holds the pieces of a model. One pass over a text
follows its output links: every piece that ends at a position may better that
position's score, and the best path gives the ids (Viterbi). A character that
is no piece costs the least piece score less ten and becomes its UTF-8 bytes.

The model file that is public here was trained as BPE, so its scores are minus
the ranks of merges. The path is the one of the greatest sum of scores, as a
unigram model of the same file has it; the tests compare it with the
sentencepiece library reading the same pieces as a unigram model. Sums are
exact integers, while the library adds in single precision; ties take the
longer last piece, as in the library.

No piece of the model goes on from another character to the space mark, so a
text falls into chunks (spaces, then others) that are encoded by themselves,
and a bounded cache keeps the ids of short ones. Loading checks this and else
takes whole texts.

Decoding joins the pieces' bytes. It gives the text back exactly: a literal
U+2581 is written in bytes, apart from the space mark.

Models whose normaliser changes texts, or with pieces of kinds that this does
not handle (defined by the user, unused), are refused; control pieces are no
text. Characters that are no pieces, in a row, are one unknown where a model
has no bytes for them.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows are encoded each; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import flat, ragged, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks that the cache of a task holds, and their greatest length.
CACHE, CACHED = 1 << 18, 48
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_CHUNK = re.compile(" *[^ ]+| +")


class Pieces:
    """A model's pieces: encodes texts to ids and decodes ids."""

    def __init__(self, model: bytes):
        proto = model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's normaliser changes texts")
        self.dummy = spec.add_dummy_prefix
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.unknown = 0
        exact = all(float(p.score).is_integer() for p in proto.pieces)
        least = 0
        split = True
        for k, p in enumerate(proto.pieces):
            self.bytes_of.append(b"")
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(p.piece[3:5], 16)])
            elif p.type == _UNKNOWN:
                self.unknown = k
                self.bytes_of[k] = " ⁇ ".encode()
            elif p.type == _NORMAL:
                score = int(p.score) if exact else p.score
                least = min(least, score)
                self.automaton.add_word(p.piece, (len(p.piece), score, k))
                self.bytes_of[k] = p.piece.replace(MARK, " ").encode()
                split &= MARK not in p.piece.lstrip(MARK)
                if len(p.piece) == 1:
                    self.single.add(p.piece)
            elif p.type != _CONTROL:
                raise ValueError(f"piece {k} is of a kind that is not handled")
        self.automaton.make_automaton()
        self.unknown_score = least - 10
        self.fallback = proto.trainer_spec.byte_fallback
        self.split = split
        self.cache: dict[str, bytes] = {}

    def path(self, chunk: str) -> list[int]:
        """The ids of a chunk, in which spaces stand for the mark."""
        text = chunk.replace(MARK, "￿").replace(" ", MARK) if MARK in chunk else chunk.replace(" ", MARK)
        n, single, unknown = len(text), self.single, self.unknown_score
        best, back = [0] * (n + 1), [(0, 0)] * (n + 1)
        at = 0

        def pass_on(to: int) -> None:
            """Opens the positions up to ``to``: by an unknown character, or not yet reached."""
            nonlocal at
            while at < to:
                known = text[at] in single
                best[at + 1] = None if known else best[at] + unknown
                back[at + 1] = (1, -1)
                at += 1

        for end, (length, score, k) in self.automaton.iter(text):
            if end >= at:
                pass_on(end + 1)
            new, old = best[end + 1 - length] + score, best[end + 1]
            if old is None or new > old or (new == old and length > back[end + 1][0]):
                best[end + 1] = new
                back[end + 1] = (length, k)
        pass_on(n)
        out, at = [], n
        while at:
            length, k = back[at]
            if k >= 0:
                out.append(k)
            elif self.fallback:
                out.extend(self.byte_ids[b] for b in reversed(chunk[at - 1].encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at -= length
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = " " + text if self.dummy else text
        if not self.split:
            return np.array(self.path(text), np.int32)
        cache, out = self.cache, []
        for chunk in _CHUNK.findall(text):
            ids = cache.get(chunk)
            if ids is None:
                ids = array("i", self.path(chunk)).tobytes()
                if len(chunk) <= CACHED:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[chunk] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids stand for."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return out[1:] if self.dummy and out[:1] == b" " else out


def _model(spark: SparkSession, path: str) -> object:
    """The model's bytes, read by the driver and sent to the tasks; a vocabulary does not grow with the data."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    else:
        with open(path, "rb") as f:
            data = f.read()
    return spark.sparkContext.broadcast(data)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id_col, n_chars, n_tokens, ids, and whether the ids decode to the text exactly."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(rows)
    kind, sent = dict(rows.dtypes)["id"], _model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            raw = data.tobytes()
            texts = batch.column(1).to_pylist()
            ids = [pieces.encode(t or "") for t in texts]
            same = [pieces.decode(x) == raw[offsets[i] : offsets[i + 1]] for i, x in enumerate(ids)]
            counts = np.array([len(x) for x in ids], np.int64)
            columns = [
                pa.array([len(t or "") for t in texts], pa.int64()), pa.array(counts),
                ragged(np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_chars", "n_tokens", "ids", "exact"])

    return rows.mapInArrow(run, f"id {kind}, n_chars long, n_tokens long, ids array<int>, exact boolean").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id_col and the text that an array of ids stands for; null ids are an empty text, invalid UTF-8 is replaced."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    small_batches(rows)
    kind, sent = dict(rows.dtypes)["id"], _model(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and checked by decoding."""
    return encoded(table(spark, sf_dir, "documents"))
