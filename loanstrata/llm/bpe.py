"""Byte-level BPE through sentencepiece: the model is serialised straight from a rank file.

Each byte becomes one printable character, each token one piece scored by its negative rank, so that sentencepiece's
best-score merges are the lowest-rank merges of a byte-level tokenizer. Normalisation is the identity, and no piece
is added but the obligatory unknown.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanstrata.llm import memory

CACHE_TOKENS = 200_000
PIECE_ROWS = 64
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> list[str]:
    """A printable character per byte: itself where it is one, else the next free code point from 256 on."""
    kept, free, out = set(PRINTABLE), 256, []
    for byte in range(256):
        out.append(chr(byte if byte in kept else free))
        free += byte not in kept
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: an int as varint, a float as fixed32, bytes with their length."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece i + 1 is the token of the i-th rank; piece 0 is the unknown."""
    letters = byte_characters()
    unknown, normal = 2, 1
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        text = "".join(letters[b] for b in token).encode()
        pieces.append(_field(1, text) + _field(2, -float(rank)) + _field(3, normal))
    bpe, off = 2, 0
    # Trainer: model type, vocabulary size, unknown 0 and no begin, end or padding piece (-1 as a 64-bit varint).
    absent = (1 << 64) - 1
    trainer = (_field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, absent) + _field(42, absent)
               + _field(43, absent))
    # Normaliser: identity, no dummy prefix, no removal and no escaping of white space.
    normaliser = _field(1, b"identity") + _field(3, off) + _field(4, off) + _field(5, off)
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts; remembers the ids of recent pre-tokens, up to a fixed number of them."""

    def __init__(self, model: bytes, pattern: str, ids: list[int]):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        letters = byte_characters()
        self.letter_of = dict(enumerate(letters))
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.ids = ids
        self.piece_of = {rank: piece + 1 for piece, rank in enumerate(ids)}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.tokens: dict[int, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Encodes new pre-tokens together; a pre-token that is a token itself is that token."""
        mapped = [part.encode().decode("latin-1").translate(self.letter_of) for part in new]
        ids = self.ids
        for part, whole, found in zip(new, self.processor.piece_to_id(mapped), self.processor.encode(mapped, num_threads=1)):
            out = (ids[whole - 1],) if whole else tuple([ids[piece - 1] for piece in found])
            self.known[part] = (out, ",".join(map(str, out)))

    def encode_parts(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """For every pre-token of each text, its ids and the same as digits with commas."""
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        split = [self.split(text) for text in texts]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        unseen = [part for part in new if part not in known]
        if unseen:
            self.learn(unseen)
        return [[known[part] for part in parts] for parts in split]

    def encode(self, text: str) -> list[int]:
        return [i for part, _ in self.encode_parts([text])[0] for i in part]

    def token(self, rank: int) -> bytes:
        """The bytes of one id: its piece, each character mapped back."""
        token = self.tokens.get(rank)
        if token is None:
            piece = self.processor.id_to_piece(self.piece_of[rank])
            token = self.tokens[rank] = bytes([self.byte_of[c] for c in piece])
        return token

    def decode(self, ids: list[int]) -> bytes:
        tokens, token = self.tokens, self.token
        try:
            return b"".join([tokens[i] for i in ids])
        except KeyError:
            return b"".join([token(i) for i in ids])


def codec(model: bytes, pattern: str, ids: list[int]) -> Codec:
    return memory.held(hashlib.sha256(model + pattern.encode()).digest(), lambda: Codec(model, pattern, ids))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = True) -> DataFrame:
    """Ids of every whole text and the bytes they decode to; `ids` (array of int) only on request.

    Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, and ids. Null and empty texts
    have no ids. Rows are independent: repeated rows give repeated results, other columns are not read. The model
    travels to the executors as one broadcast value, whose size is that of the vocabulary.
    """
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast((serialise(ranks), pattern, sorted(ranks.values())))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>"
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()),
              pa.field("decoded_sha256", pa.string())]
    if keep_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
    target = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                rows = []
                for parts in coder.encode_parts([text or "" for text in piece.column(1).to_pylist()]):
                    ids = [i for part, _ in parts for i in part]
                    listed = ",".join([digits for _, digits in parts])
                    row = (len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                           hashlib.sha256(coder.decode(ids)).hexdigest())
                    rows.append((*row, ids) if keep_ids else row)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), *columns], schema=target)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(memory.trimmed(run), schema)
