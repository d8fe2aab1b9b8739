"""Byte-level BPE encoding and decoding through a SentencePiece model.

The model is serialised here directly from the vocabulary: each token's bytes
are mapped to printable characters, the score is the negative rank, and the
normaliser is the identity, so that SentencePiece merges exactly as the ranks
ask. Ids equal ranks because the pieces are written in rank order; the
unknown piece comes last and never occurs, as all 256 bytes are pieces.

Each document is one row of a map without a shuffle. Defined results: a null
text is empty and has no tokens; texts of any length are encoded whole; each
repeated row gets its own result; an empty table gives an empty one; columns
beyond key and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Entries that a worker's table of known pre-tokens may hold; when full it keeps the last batch's, which changes speed only.
KNOWN = 400_000

#: Longer pre-tokens are rare and not worth keeping.
KNOWN_CHARS = 32


def vocabulary(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A printable character for each byte, other than white space, so that no piece holds a blank."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, an integer or a 32-bit float by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A SentencePiece BPE ModelProto with one piece for each token."""
    chars = byte_characters()
    unknown = len(tokens)
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, float(-unknown)) + _field(3, 2)))
    # trainer: model type BPE, vocabulary size, ids of <unk> and, absent, of the sentence marks and padding
    absent = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + b"".join(_field(n, absent) for n in (41, 42, 43))
    # normaliser: identity, no leading blank, white space kept and not escaped
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


def latin_splitter(pattern: str):
    """``findall`` of the same pattern for texts of Latin-1 characters only, its classes written out for the faster ``re``."""
    import regex

    every = [chr(i) for i in range(256)]
    classes = {c: "".join(re.escape(x) for x in every if regex.match(c, x)) for c in (r"\s", r"\p{L}", r"\p{N}")}
    out = pattern.replace(r"\S", f"[^{classes[r'\s']}]")
    out = re.sub(r"\[\^[^\]]*\]", lambda m: reduce(lambda t, c: t.replace(c, classes[c]), classes, m[0]) if m[0] != f"[^{classes[r'\s']}]" else m[0], out)
    return re.compile(reduce(lambda t, c: t.replace(c, f"[{classes[c]}]"), classes, out)).findall


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = vocabulary(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.split, self.latin_split = regex.compile(pattern).findall, latin_splitter(pattern)
        self.chars = byte_characters()
        # the way back: each piece's characters are looked up in the model and mapped to their bytes
        back = {c: b for b, c in enumerate(self.chars)}
        self.bytes = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.known: dict[str, tuple[str, bytes]] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.latin_split(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by blanks, and the bytes that the ids decode to.

        Pre-tokens new to this worker are encoded and decoded together, once; a text's result is put together from its pre-tokens'.
        """
        split = [self.words(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        ids = self.model.encode([w.encode("utf-8").decode("latin-1").translate(self.chars) for w in new], num_threads=1)
        fresh = {w: (" ".join(map(str, x)), self.decode(x)) for w, x in zip(new, ids)}
        if len(self.known) + len(fresh) > KNOWN:
            fresh |= {w: self.known[w] for w in set().union(*split).difference(fresh)}
            self.known = {w: x for w, x in fresh.items() if len(w) <= KNOWN_CHARS} if len(fresh) <= KNOWN else {}
            known = fresh
        else:
            self.known |= fresh
            known = self.known
        for words in split:
            parts = [known[w] for w in words]
            yield " ".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.encode_all([text]))[0].split()]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_table(docs: DataFrame, vocab: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: the key, ids (array<int>, unless left out), n_tokens and digests of ids and decoded bytes."""
    path, pattern = vocab or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, a, b, ids = [], [], [], []
            for joined, decoded in c.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(joined.count(" ") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append(np.array(joined.split(" ") if joined else [], dtype=np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def decode_table(tokens: DataFrame, vocab: tuple[str, str] | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per document: the key and the decoded bytes; null ids are none."""
    path, pattern = vocab or default_vocabulary()
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "bytes"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: each remaining document as token ids."""
    return encode_table(docs)
