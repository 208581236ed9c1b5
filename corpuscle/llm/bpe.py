"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut before they reach the tokenizer, only at places where the
split pattern always starts a new match. Such places belong to a pattern: texts
for a pattern whose places are not listed here are encoded whole. For the listed
one they are before white space that follows other text, between letters and
digits, and before the last blank of a blank run; each piece then gives the same
matches alone as in its text.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_view, map_texts, small_batches

#: Longest piece in code points that is looked for before the tokenizer runs.
PIECE = 1 << 16
#: A split pattern, and the places at which none of its matches can reach across.
SAFE = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[\p{N}])|(?<=\p{N})(?=\p{L})|(?<=\s)(?=\s\S)"),
}

_loaded: dict[tuple[str, str], object] = {}


def load(path: str, pattern: str):
    """The tokenizer of a rank file (base64 token, rank per line); one copy in each worker."""
    import tiktoken

    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def pieces(text: str, pattern: str, size: int = PIECE) -> list[str]:
    """The text cut at safe places into pieces of at least ``size`` code points, but for the last.

    A run that has no safe place (one endless word) stays whole.
    """
    out, start, safe = [], 0, SAFE.get(pattern)
    while safe and len(text) - start > size:
        m = safe.search(text, start + size)
        if not m or m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def encode_text(tokenizer, text: str | None, pattern: str, size: int = PIECE) -> list[int]:
    text = text or ""
    if len(text) <= size:
        return tokenizer.encode_ordinary(text)
    return [i for piece in pieces(text, pattern, size) for i in tokenizer.encode_ordinary(piece)]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row for each input row, repeated rows included.

    A null text counts as the empty text and has no ids; null ids stay null. Other columns are not
    carried, whatever their names. Every executor needs the rank file at ``rank_path``.
    """

    def work(texts):
        tokenizer = load(rank_path, pattern)
        return {"ids": [encode_text(tokenizer, t, pattern) for t in texts]}

    return map_texts(doc_view(docs, id_col, text_col), work, [T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: both directions in one pass, so that a task keeps one tokenizer, not two."""

    def work(texts):
        tokenizer = load(rank_path, pattern)
        ids = [encode_text(tokenizer, t, pattern) for t in texts]
        return {"ids": ids, "decoded": [tokenizer.decode_bytes(i) for i in ids]}

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    return map_texts(doc_view(docs, id_col, text_col), work, fields)


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``; bytes that are no valid UTF-8 stay as they are. Null ids give null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    small_batches(encoded.sparkSession)

    def run(batches):
        tokenizer = load(rank_path, pattern)
        for batch in batches:
            made = [None if ids is None else tokenizer.decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ids and decoded."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
