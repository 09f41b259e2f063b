"""SentencePiece BPE encoding by backtracking, and decoding.

A merge-type encoding is the one in which any two neighbours, joined and merged anew, fall apart into just
themselves. So the encoder takes the longest piece at each place (Aho-Corasick finds all pieces of a
word in one pass), checks it against the piece before by re-merging the two, and steps back to a
shorter piece where they don't fit; a bitfield marks the places from which no encoding can follow.

Texts are cut where no piece of the vocabulary can reach across: between two characters that no piece holds
side by side. The parts of a chunk of texts meet their ids in an exact array-wise table (`word_table.py`), so
that only parts which it doesn't hold are encoded, each distinct one once a chunk. The table is bounded.

Nulls, empties and repeats: a null text counts as empty, and an empty text has no ids and decodes to
''. All rows are kept, repeated ones too; an empty table gives an empty one. Texts are never cut short.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import column, fields, fresh, mapped, table
from threadloom.llm.token_output import texts_in
from threadloom.llm.word_table import LONGEST, WordTable

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 18


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut_table(pieces) -> np.ndarray:
    """At a + 256 * b: whether no piece reaches from a byte a to a byte b after it; a space stands for SPACE.

    Bytes beyond ASCII stand for all characters beyond it, and are never parted from each other.
    """
    cut = np.ones((256, 256), bool)
    cut[128:, 128:] = False
    for piece in pieces:
        for a, b in itertools.pairwise(min(ord(c), 128) for c in piece.replace(SPACE, " ")):
            cut[b, a] = False
    cut[128:, :128], cut[:128, 128:] = cut[128, :128], cut[:128, 128:129]
    return cut.ravel()


class Encoder:
    def __init__(self, path: str, most: int = 50_000):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, self.most = self.model, most
        ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in ordinary}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in ordinary}
        self.decimal = [str(i) for i in range(sp.get_piece_size())]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # a piece that merging never makes is no candidate
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.cuts = _cut_table(self.ids)
        self.fits = functools.lru_cache(1 << 16)(self._fits)
        #: Parts too long for the table that were met lately, and those met before them: at most `most` each.
        self.inner: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging from single characters gives: best score first, then leftmost. For short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def pieces(self, text: str) -> list[str]:
        """The exact pieces of a text, with SPACE for spaces, by backtracking."""
        n = len(text)
        #: For each place, a bit for each size of a piece that starts there.
        at = [0] * n + [0]
        for end, size in self.automaton.iter(text):
            at[end - size + 1] |= 1 << size
        if at[0] >> n:
            return [text]
        fits, dead = self.fits, None  # a bit for each place; most words need none
        out: list[str] = []
        #: For each piece taken: the sizes at its place that are left to try.
        left: list[int] = []
        pos, sizes, last = 0, at[0] or 2, None
        while pos < n:
            while sizes:
                size = sizes.bit_length() - 1
                sizes ^= 1 << size
                end = pos + size
                if dead is not None and dead[end >> 3] >> (end & 7) & 1:
                    continue
                piece = text[pos:end]
                if last is None or fits(last, piece):
                    out.append(piece)
                    left.append(sizes)
                    pos, last, sizes = end, piece, at[end] or 2  # a character that no piece holds stands for itself
                    break
            else:
                if not out:
                    raise ValueError("no encoding: the vocabulary isn't of the merge type")
                if dead is None:
                    dead = bytearray((n >> 3) + 1)
                dead[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                sizes = left.pop()
                last = out[-1] if out else None
        return out

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.pieces(text) if text else ():
            i = self.ids.get(piece)
            if i is None:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}I", *out)

    def bounds(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the parts of data, which also end at cuts."""
        at = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            at[1:-1] = self.cuts.take(np.ndarray((len(data) - 1,), "<u2", data, strides=(1,)))
        at[cuts] = True
        edges = np.flatnonzero(at)
        return edges[:-1], edges[1:]

    def parts(self, parts: list[bytes]):
        """Ids, as bytes, of each part in UTF-8."""
        for part in parts:
            got = self.inner.get(part)
            if got is None:
                got = self.older.get(part)
                if got is None:
                    got = self._ids(part.decode(errors="replace").replace(" ", SPACE))
                if LONGEST < len(part) < 200:
                    if len(self.inner) >= self.most:
                        self.older, self.inner = self.inner, {}
                    self.inner[part] = got
            yield got


_encoders: dict[str, tuple[Encoder, WordTable]] = {}


def encoder(path: str) -> tuple[Encoder, WordTable]:
    """Kept between the tasks of a worker."""
    if path not in _encoders:
        e = Encoder(path)
        _encoders[path] = e, WordTable(e.parts, 1_000_000, e.bounds)
    return _encoders[path]


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with plain spaces for SPACE, and one in front of those that aren't empty."""
    texts = pc.replace_substring(texts.cast(pa.large_binary()), SPACE.encode(), b" ")
    return pc.if_else(pc.equal(texts, b""), texts, pc.binary_join_element_wise(pa.scalar(b" ", texts.type), texts, pa.scalar(b"", texts.type)))


def encode_column(texts: pa.Array, path: str):
    """The ids of texts in UTF-8, exactly the library's, in chunks of whole texts: (ids, how many of each text).

    Whatever the size of the column, copies are made of a chunk at a time.
    """
    _, words = encoder(path)
    at = 0
    for _, given in texts_in(texts, CHUNK):
        data, cuts = next(texts_in(_spaced(texts.slice(at, len(given) - 1)), 1 << 62))
        at += len(given) - 1
        yield words.encode(data, cuts, b"")


def encode_text(text: bytes, path: str) -> np.ndarray:
    return next(encode_column(pa.array([text], pa.binary()), path))[0]


def _encode_rows(path: str, digests: bool, with_ids: bool, names: list[str], batches):
    """The kept columns and the new ones; the text comes last."""
    e, _ = encoder(path)
    for batch in batches:
        at = 0
        for ids, counts in encode_column(batch.columns[-1], path):
            columns = [c.slice(at, len(counts)) for c in batch.columns[:-1]]
            at += len(counts)
            flat, ends = ids.tolist(), np.cumsum(counts)
            plain = [flat[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]
            decoded = [e.model.decode(i) for i in plain]
            if digests:
                columns.append(pa.array(counts, pa.int64()))
                columns.append(pa.array([hashlib.sha256(",".join(map(e.decimal.__getitem__, i)).encode()).hexdigest() for i in plain], pa.string()))
                columns.append(pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()))
            else:
                columns.append(pa.array(decoded, pa.string()))
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None, digests: bool = False, with_ids: bool = True) -> DataFrame:
    """Adds decoded (string) and piece_ids (array<int>) to the columns `keep` (all, unless given).

    With digests, n_tokens, ids_sha256 and decoded_sha256 come instead of decoded; without with_ids, the
    ids don't leave their task.
    A narrow job: no row moves to another machine. Columns of docs with the names of new ones give way.
    """
    new = (["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["decoded"]) + ["piece_ids"] * with_ids
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*map(column, kept), F.coalesce(column(text).cast("binary"), F.lit(b"")).alias(fresh(docs, "text")[0]))
    kinds = {"n_tokens": "long", "piece_ids": "array<int>"}
    schema = fields(docs, kept, **{c: kinds.get(c, "string") for c in new})
    return mapped(rows, schema, _encode_rows, model or model_path(), digests, with_ids)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"], digests=True, with_ids=False)
