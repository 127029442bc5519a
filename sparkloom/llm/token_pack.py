"""Token ids as fixed-width bit packs: files with block offsets, for numpy and random access.

A shard file, all integers little-endian:
  blocks   ids, each in `bits` bits from the lowest bit up; BLOCK ids a block (the last may have fewer), each block from a new byte
  index    int64 id of each document; uint64 place of its first id in this file, and the end; uint64 byte offset of each block, and the end
  trailer  uint32 bits, uint32 ids in a block, uint64 documents, uint64 ids, uint64 blocks, 8 bytes of magic
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_back, id_key, few_tasks, in_arrow, materialize, partitions_for, scratch_path, table

BLOCK, MAGIC, TRAILER = 1 << 16, b"SLBITS01", struct.Struct("<IIQQQ8s")
#: Bytes of the input, as files have them, for each shard.
SHARD = 1 << 26
#: Tables of fewer bytes a core are dealt to all cores before they are encoded, in so many tasks a core.
SPREAD, TASKS = 16 << 20, 4
#: Most pieces whose ids a worker remembers.
MEMORY = 1_000_000
#: Texts, and their code points at most (but for one text), that are cut into words at once.
BATCH, AT_ONCE = 4096, 1 << 23
_MEMORIES: dict[str, "_Memory"] = {}
_TOKENIZERS: dict[str, object] = {}
_ADDED: dict[str, list[str]] = {}
_BY_SPACES: dict[str, bool] = {}
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_ASCII_SPACES = [c for c in _OTHER_SPACES if c.isascii()]


def _unsafe(text: str) -> bool:
    """Whether a space isn't between two characters other than white space."""
    others = _ASCII_SPACES if text.isascii() else _OTHER_SPACES
    return text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in others)


def bits_for(largest: int) -> int:
    """Bits that hold all ids up to the largest one: a vocabulary may have gaps, so that its size doesn't tell."""
    return max(1, largest.bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """n ids of a block as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    rows = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(np.pad(rows, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4")[:, 0]


class ShardWriter:
    """Streams ids into one shard; holds a block and the index."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.rest, self.n, self.at = sink, bits, [], 0, 0
        self.ids, self.starts, self.offsets, self.held = [], [0], [0], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.rest)
            for at in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.rest = [whole[len(whole) // BLOCK * BLOCK :]]
            self.held = len(self.rest[0])

    def _block(self, ids: np.ndarray) -> None:
        self.sink.write(data := pack(ids, self.bits))
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        for values, kind in ((self.ids, "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(TRAILER.pack(self.bits, BLOCK, len(self.ids), self.n, len(self.offsets) - 1, MAGIC))


class ShardReader:
    """Random access: reads the index, then only the blocks that a document lies in. Keeps the last block."""

    def __init__(self, source):
        self.source = source
        source.seek(-TRAILER.size, 2)
        self.bits, self.block, docs, self.n, blocks, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        source.seek(-TRAILER.size - 8 * (docs + docs + 1 + blocks + 1), 2)
        index = source.read(8 * (docs + docs + 1 + blocks + 1))
        self.ids = np.frombuffer(index, "<i8", docs)
        self.starts = np.frombuffer(index, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)
        self._at, self._ids = -1, None

    def __len__(self) -> int:
        return len(self.ids)

    def _load(self, block: int) -> np.ndarray:
        if block != self._at:
            self.source.seek(int(self.offsets[block]))
            data = self.source.read(int(self.offsets[block + 1] - self.offsets[block]))
            self._at, self._ids = block, unpack(data, min(self.block, self.n - block * self.block), self.bits)
        return self._ids

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        parts = [self._load(k)[max(0, a - k * self.block) : b - k * self.block] for k in range(a // self.block, -(-b // self.block))] if b > a else []
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        model = _TOKENIZERS[path].model
        getattr(model, "_resize_cache", lambda _: None)(0)  # words are remembered here
        _TOKENIZERS[path].model = model
    return _TOKENIZERS[path]


def _added(path: str) -> list[str]:
    """The strings that the library takes for added tokens wherever they are in a text."""
    if path not in _ADDED:
        _ADDED[path] = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return _ADDED[path]


def largest_id(path: str) -> int:
    return max(tokenizer(path).get_vocab().values())


def _splits_at_spaces(path: str) -> bool:
    """Whether the file says what the memory of words relies on: byte-level pre-splitting by its usual pattern, without a normaliser, a prefix or drop-out."""
    if path not in _BY_SPACES:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        _BY_SPACES[path] = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and model.get("type", "BPE") == "BPE" and not model.get("dropout")
    return _BY_SPACES[path]


def _whole(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.array(e.ids, "<u4") for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of flat one behind the other."""
    ends = np.cumsum(sizes)
    place = np.repeat(starts - ends + sizes, sizes)
    place += np.arange(len(place))
    return flat[place]


class _Memory:
    """The ids of " " + word of the words seen: numbers by word, and the ids of all of them in one array."""

    def __init__(self, path: str):
        self.path = path
        vocab = tokenizer(path).get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space in the byte-level alphabet
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.stops = {c: _whole([c], path)[0] for c in ".,"}
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.bounds = np.empty(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self.numbers), int(self.bounds[len(self.numbers)])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(words) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        self.numbers.update(zip(words, range(n, n + len(words)), strict=True))

    def _encode(self, words: list[str], each: int = 2000) -> None:
        """Many words from one text: a token that begins with a space begins a word."""
        texts = [" " + " ".join(words[i : i + each]) for i in range(0, len(words), each)]
        ids = np.concatenate(_whole(texts, self.path))
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words):
            raise ValueError("words and tokens don't agree")
        self._add(words, ids, np.diff(starts, append=len(ids)))

    def pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each number start in flat, and how many they are."""
        return self.bounds[numbers], self.bounds[numbers + 1] - self.bounds[numbers]

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of some different words; new ones are encoded."""
        if len(self.numbers) > MEMORY:
            self.clear()
        out = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            # A stop or comma after a letter at a word's end is a match of its own.
            ended = [w for w in new if w[-1] in ".," and w[-2:-1].isalpha()]
            stems = {w[:-1] for w in ended}.difference(self.numbers)
            if plain := list(set(new).difference(ended) | stems):
                self._encode(plain)
            for c, stop in self.stops.items():
                if own := [w for w in ended if w[-1] == c]:
                    starts, sizes = self.pieces(np.fromiter((self.numbers[w[:-1]] for w in own), np.int64, len(own)))
                    ends = np.cumsum(sizes + len(stop))
                    ids = np.empty(int(ends[-1]), "<u4")
                    tail = (ends[:, None] - np.arange(len(stop), 0, -1)).ravel()
                    body = np.ones(len(ids), bool)
                    body[tail] = False
                    ids[tail], ids[body] = np.tile(stop, len(own)), _gathered(self.flat, starts, sizes)
                    self._add(own, ids, sizes + len(stop))
            out[missing] = np.fromiter(map(self.numbers.__getitem__, new), np.int64, len(new))
        return out


def _regular(texts: list[str], path: str) -> list[bytes]:
    """Texts in which each space is between two characters other than white space. Arrow cuts them into words and numbers the different
    ones; only those meet Python, and the ids are gathered by their numbers."""
    if sum(map(len, texts)) > AT_ONCE and len(texts) > 1:
        half = len(texts) // 2
        return _regular(texts[:half], path) + _regular(texts[half:], path)
    if not texts:
        return []
    if path not in _MEMORIES:
        _MEMORIES[path] = _Memory(path)
    memory = _MEMORIES[path]
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    offsets = split.offsets.to_numpy()
    numbered = split.values.dictionary_encode()
    at, words = numbered.indices.to_numpy(), numbered.dictionary.to_pylist()
    numbers = memory.of(words)
    starts, sizes = (x[at] for x in memory.pieces(numbers))
    # What a text begins with has no space: its ids stand behind the remembered ones.
    heads = _whole([words[i] for i in at[offsets[:-1]].tolist()], path)
    own = np.fromiter(map(len, heads), np.int64, len(heads))
    sizes[offsets[:-1]], starts[offsets[:-1]] = own, len(memory.flat) + np.cumsum(own) - own
    ids = _gathered(np.concatenate([memory.flat, *heads]), starts, sizes)
    cuts = [0, *np.cumsum(sizes)[offsets[1:] - 1].tolist()]
    return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian uint32, by the tokenizers library.

    Byte-level pre-splitting never joins characters across a space between two that aren't white space, so what follows such a space is
    encoded once and remembered: a word stands for the space and itself. Texts with other spaces or an added token's string are encoded as they are, and so
    are all texts where the file names another way of splitting.
    """
    added, whole = _added(path), not _splits_at_spaces(path)
    odd = [bool(t) and (whole or _unsafe(t) or any(a in t for a in added)) for t in texts]
    regular = iter(_regular([t for t, o in zip(texts, odd, strict=True) if t and not o], path))
    whole = (x.tobytes() for x in _whole([t for t, o in zip(texts, odd, strict=True) if o], path))
    return [b"" if not t else next(whole) if o else next(regular) for t, o in zip(texts, odd, strict=True)]


def open_folder(uri: str):
    """The file system and path of a shared folder, by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else f"file://{uri}")


def _encoder(path: str, end_id: int, bits: int, cuts: np.ndarray) -> Callable:
    """(id, text) to (shard, id, n, packed): ids below the first cut go to shard 0, and so on."""

    end = np.array([end_id], "<u4").tobytes()

    def made(keys: list[int], texts: list[str | None]) -> pa.RecordBatch:
        ids = [x + end for x in token_bytes(texts, path)]
        shard = np.searchsorted(cuts, np.array(keys, np.int64), "right").astype(np.int32)
        packed = pa.array([pack(np.frombuffer(x, "<u4"), bits) for x in ids], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), packed], ["shard", "id", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                held += len(text or "")
                if held >= AT_ONCE or len(keys) == BATCH:
                    yield made(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield made(keys, texts)

    return run


def _writer(folder: str, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = open_folder(folder)
        name, own = f"{root}/part-{part:06d}.bits", f"{root}/_{part:06d}-{uuid.uuid4().hex}"
        writer, sink = None, None
        for b in batches:
            if writer is None and b.num_rows:
                files.create_dir(root, recursive=True)
                writer = ShardWriter(sink := files.open_output_stream(own), bits)
            for key, n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                writer.add(key, unpack(packed, n, bits))
        if writer is not None:
            writer.close()
            sink.close()
            files.move(own, name)  # an attempt that is run again replaces the file by an equal one
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.n], pa.int64())], ["shard", "n_docs", "n_ids"])

    return run


def _reader(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{root}/part-{shard:06d}.bits") as source:
                    reader = ShardReader(source)
                    for at in range(0, len(reader), 4096):
                        sums = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(at, min(len(reader), at + 4096))]
                        starts = reader.starts[at : at + 4097]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.ids[at : at + 4096]), pa.array(starts[: len(sums)] + base), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return run


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes them as shards in ascending id order; returns the manifest: shard, n_docs, n_ids.

    Ids' quantiles set the shards' ranges. Texts are encoded where they are read, once (small tables, which may be a single row group, are dealt to all cores first); what is shuffled are the packed ids, in the bits that the largest id
    takes. Each task streams its range into a file of its own. Files are written under names of their own and moved, so that lost or repeated tasks leave whole
    files. Null texts are empty (the end id alone); null ids come first; rows that repeat an id come in the order of their lengths and packed ids. An empty table
    writes nothing; other columns are ignored.
    """
    bits = bits_for(max(largest_id(tokenizer_path), end_id))
    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = partitions_for(docs, SHARD)
    found = rows.agg(F.percentile_approx("id", [i / shards for i in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else None
    cuts = np.unique(np.array(found or [], np.int64))
    if cores := few_tasks(docs, SPREAD):
        rows = rows.repartition(TASKS * cores)
    encoded = in_arrow(rows, _encoder(tokenizer_path, end_id, bits, cuts), "shard int, id bigint, n bigint, packed binary")
    ordered = encoded.repartitionById(shards, F.col("shard")).select("id", "n", "packed").sortWithinPartitions("id", "n", "packed")
    return materialize(in_arrow(ordered, _writer(folder, bits), "shard bigint, n_docs bigint, n_ids bigint"), "manifest")


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32. The window runs over one row a shard."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = materialize(manifest.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shards")
    # As many tasks as files, however small their list is.
    return in_arrow(shards.repartition(max(1, shards.count())), _reader(folder), "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "packed-ids")
    manifest = write_packed(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_packed(manifest, folder).select(id_back("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
