"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary maps every byte to a character: printable Latin-1 bytes to themselves, the rest to code points from 256 on.
Each match of the vocabulary's pattern is encoded by itself, without special tokens; their strings are ordinary text. Decoding
maps the characters of each id back to bytes; a character that was split between ids is whole again once its bytes are joined.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import arrow_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BATCH_CHARS = 1 << 19
LONG_CHARS = 1 << 20
#: Before such a space a match of the pattern always begins, so a long text can be encoded in pieces.
BREAK = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The character of each byte, reversed."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = byte_characters()
        vocabulary = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        self.bytes = [b""] * (vocabulary[-1][1] + 1)
        for token, i in vocabulary:
            if all(c in back for c in token):
                self.bytes[i] = bytes(back[c] for c in token)
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG_CHARS:
            cut = next((m.start() for m in BREAK.finditer(text, at + LONG_CHARS)), len(text))
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode_batch(self, texts: list[str], offsets: bool = False) -> Iterator[tuple[list[int], list[tuple[int, int]] | None]]:
        """ids of each text, and with offsets the first and last character (exclusive) that each id stands for."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            if end == at + 1 and chars > LONG_CHARS:
                ids, spans, shift = [], [], 0
                for piece in self.pieces(texts[at]):
                    found = self.tokenizer.encode_batch([piece], add_special_tokens=False)[0]
                    ids += found.ids
                    spans += [(a + shift, b + shift) for a, b in found.offsets] if offsets else []
                    shift += len(piece)
                yield ids, spans if offsets else None
            elif offsets:
                for found in self.tokenizer.encode_batch(texts[at:end], add_special_tokens=False):
                    yield found.ids, found.offsets
            else:
                for found in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
                    yield found.ids, None
            at = end

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of chunks of ids; a character split between chunks comes with the later one."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for ids in chunks:
            yield decoder.decode(self.decode(ids))
        yield decoder.decode(b"", final=True)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with token_ids and the characters token_starts, token_ends of each; a null text has none."""
    path = path or vocabulary_path()
    arrow_batches(docs.sparkSession, 256)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = list(codec(path).encode_batch(_texts(batch.column(at)), offsets=True))
            spans = [pa.array([[s[k] for s in x[1]] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.list_(pa.int32())), *spans], [*batch.schema.names, "token_ids", "token_starts", "token_ends"])

    more = ", ".join(f"{c} array<int>" for c in ("token_ids", "token_starts", "token_ends"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {more}")


def decode(tokens: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """tokens with decoded, the text of the ids (null: null); bytes that are no UTF-8 become U+FFFD."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def text(ids):
        own = codec(path)
        return ids.map(lambda x: None if x is None else own.decode(x).decode("utf-8", "replace"))

    return tokens.withColumn("decoded", text(F.col(ids_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them, for every row.

    Null and empty texts have no ids. Repeated rows give repeated results; other columns are ignored.
    """
    path = path or vocabulary_path()
    arrow_batches(docs.sparkSession, 256)

    def run(batches):
        for batch in batches:
            own, n, ids_sha, text_sha = codec(path), [], [], []
            for ids, _ in own.encode_batch(_texts(batch.column(1))):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
