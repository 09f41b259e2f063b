"""Token-ID files: texts are tokenized, sorted by document and written as range-coded shards.

A shard holds the blocks of range_coder, then a document table (ids and lengths, zlib) and a trailer; it is
written and read a batch of blocks at a time. Its path is of the form shard-<partition>-<attempt>.tok;
the manifest, a Parquet table, names the shards that count. A task that runs twice, or dies half
way, leaves at most a file that no manifest names.

Nulls, empties and repeats: a null or empty text has no ids but the end id; a null doc_id is kept and
sorts first; rows that share a doc_id are all kept, in the order of their texts' hashes.
An empty table gives no shards and no rows. Further columns of the input are not stored.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.llm import range_coder
from threadloom.llm.common import lean, open_fs, scratch, table
from threadloom.llm.word_table import WordTable

MAGIC = b"TLTOK2\0\0"
TAIL = struct.Struct("<IIQQ8s")  # bytes of the document table, documents, ids, bytes of the blocks, magic
CHUNK = 1 << 18
MANIFEST = "shard long, path string, documents long, n_tokens long, n_bytes long"
DEFAULT_TOKENIZER = "word_bpe_49k.json"
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: No contractions, special tokens, controls, inner white space, or letters whose lower case depends on their place.
_PLAIN = regex.compile(r"[^'<\p{C}\p{Z}\u03a3\u0130]*")


def _byte_characters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a printable character: its own where that is one, else 256 and on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in own else next(others) for b in range(256)}


_BYTE_CHARACTERS = _byte_characters()


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Maps pieces of text between ASCII white space to their ids, as little-endian bytes.

    The tokenizer cuts a text into runs of letters, single digits and runs of other characters, none of
    which holds white space, so pieces can be encoded one by one, and their parts too. A part of letters goes
    straight to the library's BPE model; whatever might depend on more than its own characters
    (apostrophes, special tokens, text that isn't in normal form) goes to the whole tokenizer.
    At most `most` parts, and as many older ones, are kept.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.packed = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            got = self.old_parts.get(text)
            if got is None:
                if text.isalpha():
                    letters = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
                    packed = self.packed
                    got = b"".join([packed[t.id] for t in self.model.tokenize(letters)])
                else:
                    got = self.whole(text)
            if len(self.parts) >= self.most:
                self.old_parts, self.parts = self.parts, {}
            self.parts[text] = got
        return got

    def pieces(self, pieces: list[bytes]):
        tokenize, packed = self.model.tokenize, self.packed
        for piece in pieces:
            if piece.isalpha():  # a-z, most pieces by far, and each of them comes once
                yield b"".join([packed[t.id] for t in tokenize(piece.lower().decode())])
            else:
                yield self.piece(piece)

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode(errors="replace")
        head = text.rstrip(".,")
        if head.isalpha() and "\u03a3" not in head and "\u0130" not in head and (head.isascii() or unicodedata.is_normalized("NFC", head)):
            return self.part(head.lower()) + (self.part(text[len(head) :]) if len(head) < len(text) else b"")
        if not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return self.whole(text)
        return b"".join(map(self.part, _PARTS.findall(text.lower())))


#: Of each byte: white space 0, a-z and A-Z 2, full stop and comma 4, else 1.
_KINDS = np.ones(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[65:91] = _KINDS[97:123] = 2
_KINDS[[44, 46]] = 4


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as the tokenizer lower-cases them, so that fewer words differ. Letters that a mark may follow keep their case, as the
    tokenizer composes them first; so do chunks that may hold special tokens, which are found before anything is lower-cased."""
    if (data == 60).any():
        return data
    upper = data - np.uint8(65) < 26
    upper[:-1] &= data[1:] < 128
    return data | upper.view(np.uint8) << np.uint8(5)


def bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of data, which also end at cuts, and between a-z and a full stop or comma, where the tokenizer always cuts."""
    kinds = np.zeros(len(data) + 2, np.uint8)
    kinds[1:-1] = _KINDS[data]
    cut = (kinds[1:] ^ kinds[:-1]) == 6
    cut[cuts] = True
    inside = kinds != 0
    return np.flatnonzero(inside[1:] & (cut | ~inside[:-1])), np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """Kept between the tasks of a worker."""
    if path not in _tables:
        _tables[path] = WordTable(WordIds(path).pieces, 2_000_000, bounds)
    return _tables[path]


def texts_in(column: pa.Array, chunk: int = CHUNK):
    """A column of texts without nulls in chunks of about `chunk` bytes and whole texts: (bytes, bounds of the texts)."""
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()  # never copied
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def encode_texts(texts: list[bytes], path: str, end: bytes = b"") -> list[np.ndarray]:
    """The ids of each text, exactly the library's, and the ids `end`."""
    out = []
    for data, cuts in texts_in(pa.array(texts, pa.binary())):
        ids, n = word_table(path).encode(lowered(data), cuts, end)
        out += np.split(ids, np.cumsum(n)[:-1])
    return out


def _write_shards(out: str, tokenizer: str, end_id: int, batches):
    words, end, batch_ids = word_table(tokenizer), np.array([end_id], "<u4").tobytes(), range_coder.LANES * range_coder.BLOCK
    keys, lengths, waiting, n_waiting, n_ids, f = [], [], [], 0, 0, None
    shard = TaskContext.get().partitionId()
    path = f"{out}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"

    def coded(final: bool):
        """What waits, in whole batches of blocks unless it is the end."""
        nonlocal waiting, n_waiting
        if n_waiting >= batch_ids or final and n_waiting:
            ids = np.concatenate(waiting)
            cut = len(ids) if final else len(ids) // batch_ids * batch_ids
            waiting, n_waiting = [ids[cut:]], len(ids) - cut
            for k in range(0, cut, batch_ids):
                yield from range_coder.encode(ids[k : min(cut, k + batch_ids)])

    n_bytes = 0
    for batch in batches:
        if f is None and batch.num_rows:
            fs, local = open_fs(path)
            fs.create_dir(local.rpartition("/")[0], recursive=True)
            f = fs.open_output_stream(local, compression=None)
        keys.append(batch.column(0))
        for data, cuts in texts_in(batch.column(1)):
            ids, n = words.encode(lowered(data), cuts, end)
            lengths.append(n)
            waiting.append(ids)
            n_waiting += len(ids)
            n_ids += len(ids)
            for b in coded(False):
                f.write(b)
                n_bytes += len(b)
    if f is None:
        return
    for b in coded(True):
        f.write(b)
        n_bytes += len(b)
    keys = pa.chunked_array(keys)
    heads = zlib.compress(keys.is_valid().to_numpy().astype(np.uint8).tobytes() + keys.fill_null(0).to_numpy().astype("<i8").tobytes() + np.concatenate(lengths).astype("<u4").tobytes(), 6)
    f.write(heads)
    f.write(TAIL.pack(len(heads), len(keys), n_ids, n_bytes, MAGIC))
    f.close()
    yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "documents": [len(keys)], "n_tokens": [n_ids], "n_bytes": [n_bytes + len(heads) + TAIL.size]})


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 1, shards: int | None = None, shard_bytes: int = 24 << 20) -> DataFrame:
    """Writes the texts of docs (doc_id, text) below `out` in ascending doc_id order; returns the manifest.

    The texts cross one range shuffle. A shard is one task's share of about `shard_bytes` of text, however large
    the table is; a task holds a batch of blocks at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    if shards is None:
        shards = max(1, -(-int(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // shard_bytes))
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    done = rows.mapInArrow(functools.partial(lean, _write_shards, f"{out}/data", tokenizer or tokenizer_path(), end_id), MANIFEST)
    done.write.mode("errorifexists").parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def open_shard(path: str):
    """(known, doc_ids, lengths, batches of ids) of one shard, in order of the documents."""
    fs, local = open_fs(path)
    f = fs.open_input_file(local)
    f.seek(f.size() - TAIL.size)
    size, n, total, block_bytes, magic = TAIL.unpack(f.read(TAIL.size))
    if magic != MAGIC:
        raise ValueError(f"{path} is no token file")
    f.seek(block_bytes)
    heads = zlib.decompress(f.read(size))
    lengths = np.frombuffer(heads, "<u4", n, 9 * n).astype(np.int64)
    if lengths.sum() != total:
        raise ValueError(f"{path}: the document table doesn't fit {total} ids")
    f.seek(0)
    return np.frombuffer(heads, np.uint8, n), np.frombuffer(heads, "<i8", n, n), lengths, range_coder.decode_file(pa.BufferedInputStream(f, CHUNK), block_bytes)


def _read_rows(with_ids: bool, batches):
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            known, docs, lengths, parts = open_shard(path)
            ends = np.cumsum(lengths)
            done, held, n_held = 0, [], 0  # documents returned, ids of those after them
            for part in parts:
                held.append(part)
                n_held += len(part)
                first = int(ends[done - 1]) if done else 0
                to = int(np.searchsorted(ends, first + n_held, "right"))
                if to == done:
                    continue
                ids = np.concatenate(held)
                held, n_held = [ids[ends[to - 1] - first :]], n_held - int(ends[to - 1] - first)
                for k in range(done, to, 4096):
                    stop = min(to, k + 4096)
                    yield _rows(ids, first, known[k:stop], docs[k:stop], lengths[k:stop], ends[k:stop], base, with_ids)
                done = to
            if done < len(docs):
                raise ValueError(f"{path} ends before its last document")


def _rows(ids: np.ndarray, first: int, known, docs, lengths, ends, base: int, with_ids: bool) -> pa.RecordBatch:
    """Rows of some documents; ids[0] is the shard's id number `first`."""
    raw, starts = memoryview(ids.astype("<u4", copy=False)).cast("B"), ends - lengths
    rows = {"doc_id": pa.array(docs, mask=known == 0), "start": starts + base, "n_tokens": lengths}
    rows["ids_crc32"] = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((starts - first).tolist(), (ends - first).tolist(), strict=True)], np.int64)
    if with_ids:
        offsets = np.concatenate([starts[:1], ends]) - starts[0]
        rows["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[starts[0] - first : ends[-1] - first].astype(np.int64)))
    return pa.RecordBatch.from_pydict(rows)


def read_token_files(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of the shards that the manifest names.

    start counts the ids of all documents before; only the manifest, a row a shard, is summed for it.
    Without a manifest the files aren't finished, and Spark says that the path doesn't exist.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    # a task reads a shard at a time
    dealt = shards.repartition(max(1, min(shards.count(), 100_000)), "shard").select("path", "base")
    return dealt.mapInArrow(functools.partial(lean, _read_rows, with_ids), kinds)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out, with_ids=False)
