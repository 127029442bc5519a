"""Byte-level BPE encoding and decoding: tiktoken with a local rank file, long texts split at safe boundaries first."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

#: Longest text, in code points, that is given to the library whole, and longest run of white space: its pattern engine keeps a stack entry for each
#: code point of such a run.
LONG, RUN = 1 << 16, 1 << 14
_RUN = re.compile(r"\s{%d}" % RUN)
#: A space between two characters that aren't white space: no match of the pre-split pattern goes past its left side, and the match on its right
#: begins with it, as only its start can be a space before other characters.
SAFE = re.compile(r"(?<=\S)(?= \S)")


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text in pieces of about `size`, cut at safe boundaries only; a stretch without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _piece_ids(piece: str, rank_file: str, pattern: str) -> np.ndarray:
    """A piece's ids. One with a long run of white space is cut into the pattern's matches by an engine without such a stack, each then merged by the library."""
    enc = encoding(rank_file, pattern)
    if len(piece) < RUN or not _RUN.search(piece):
        return np.array(enc.encode_ordinary(piece), "<u4")
    import regex

    return np.concatenate([np.array(enc._encode_single_piece(m[0].encode("utf-8", "replace")), "<u4") for m in regex.finditer(pattern, piece)])


def encode(text: str | None, rank_file: str, pattern: str) -> np.ndarray:
    """The ids of the text's UTF-8 bytes, without special tokens; null is empty."""
    parts = [_piece_ids(piece, rank_file, pattern) for piece in safe_pieces(text or "")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of the ids, which need not be UTF-8."""
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep: tuple[str, ...] = (), with_bytes: bool | None = None) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, unless with_ids is off ids (array<int>), unless with_bytes (by default as with_ids)
    is off decoded (binary), and the columns in keep as strings.

    Whole texts in any number of pieces, white space in runs of any length; null texts have no ids; null and repeated ids pass through; an empty
    table gives no rows; other columns are ignored. A narrow plan: no shuffle, one Arrow batch in memory.
    """
    with_bytes = with_ids if with_bytes is None else with_bytes
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_bytes + list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [encode(t, rank_file, pattern) for t in part.column(1).to_pylist()]
                back = [decode(x, rank_file, pattern) for x in ids]
                cols = [part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                if with_ids:
                    cols.append(pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32())))
                if with_bytes:
                    cols.append(pa.array(back, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols + [part.column(2 + i) for i in range(len(keep))], names)

    kinds = ["bigint", "bigint", "string", "string"] + ["array<int>"] * with_ids + ["binary"] * with_bytes + ["string"] * len(keep)
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), *(F.col(f"`{c}`").cast("string") for c in keep))
    return in_arrow(rows, run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *vocabulary(), with_ids=False)
