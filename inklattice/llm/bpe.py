"""Byte-level BPE encoding and decoding (operator 4).

The ``tokenizers`` library merges; a bounded cache keeps the ids of pieces already seen, since words
recur.  Texts are cut by the public pattern, each match is encoded on its own, and special-token
strings in a text are ordinary text.  Decoding maps ids to byte strings through the reversed
byte-to-character table and joins bytes before reading UTF-8, so characters split over tokens are whole.

Nulls: a null text is an empty text (0 tokens, the digests of nothing).  Bytes that are not UTF-8 are encoded byte by
byte as characters that are neither letters, numbers nor spaces, and come back unchanged.  Empty tables give empty
results; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Pieces kept in the cache of one Python worker before it starts anew.
CACHE_PIECES = 500_000
#: Pieces of more characters are encoded but not kept.
CACHE_CHARS = 64

# Letters, numbers and white space below U+02B0, where the classes of the public pattern are short lists.
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_FIRST_OTHER = re.compile("[\u02b0-\U0010ffff]").search


def splitter(pattern: str):
    """A function that gives a text's matches.  For the public pattern, texts of low code points take the faster engine."""
    import public_tokenizers

    whole = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return whole
    low = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    ).findall
    return lambda text: low(text) if _FIRST_OTHER(text) is None else whole(text)


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token with its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, in rank order: the last pair left when lower ranks have merged."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A byte-level ``tokenizers`` model with exactly these ranks as ids."""
    from tokenizers import Tokenizer, decoders, models

    chars = byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    vocab = {shown(token): rank for token, rank in ranks.items()}
    made = Tokenizer(models.BPE(vocab=vocab, merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)], fuse_unk=False))
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def read_text(data: bytes) -> str:
    """A text from its bytes; those that are not UTF-8 become lone surrogates, which stand for themselves."""
    return data.decode("utf-8", "surrogateescape")


class Codec:
    """Encodes and decodes whole texts.  Built from ``tokenizer_json`` in each Python worker."""

    def __init__(self, model: str, pattern: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model).model
        self.find = splitter(pattern)
        self.chars = byte_chars()
        self.to_chars = {b: ord(c) for b, c in enumerate(self.chars)}
        back = {c: b for b, c in enumerate(self.chars)}
        vocab = Tokenizer.from_str(model).get_vocab()
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.cache: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode("utf-8", "surrogateescape").decode("latin-1").translate(self.to_chars)
        ids = np.fromiter((t.id for t in self.model.tokenize(shown)), "<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, piece = self.cache.get, self._piece
        return b"".join([known(p) or piece(p) for p in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, character after the last) of each token; tokens inside one character share its span."""
        data = text.encode("utf-8", "surrogateescape")
        starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
        char_at = np.searchsorted(starts, np.arange(len(data)), "right") - 1
        out, at = [], 0
        for i in self.encode(text):
            size = len(self.bytes_of[i])
            out.append((i, int(char_at[at]), int(char_at[at + size - 1]) + 1))
            at += size
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode(self, ids: list[int]) -> str:
        """Text of any run of ids; bytes that end inside a character become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def _codec(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    model = spark.sparkContext.broadcast(tokenizer_json(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))))  # a fixed vocabulary of a few MB
    made: list[Codec] = []

    def get() -> Codec:
        if not made:
            made.append(Codec(model.value, pattern))
        return made[0]

    return get


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).
    """
    get = _codec(docs.sparkSession, path, pattern)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            counts, digests, decoded, ids = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                data = codec.encode_bytes(read_text(text.as_py() or b""))
                counts.append(len(data) // 4)
                digests.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(codec.decode_bytes(data)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(data, "<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of arrays of ids; null ids give an empty text."""
    get = _codec(encoded.sparkSession, path, None)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            texts = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")
