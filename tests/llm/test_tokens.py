from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import range_coder, sentencepiece_bpe, token_output, word_table
from threadloom.llm.common import scratch

TEXTS = ["it's <|endoftext|> don't", "J̌ x", "ΑΣ ΣΑΣ ñ İ", "a  b ", " a\n\n  b", "▁a ▁ b", "<s>hi</s><0x41>", "日本🙂", "ﬁ①\x00", "a.b,c ² x².", "x" * 5000]


def _random_texts(n):
    rng = random.Random(3)
    return TEXTS + ["".join(rng.choice("aeiouthnSR .,\n'é²Éßσς日🙂-12½İ\xa0\x85\x1c\u0107▁") for _ in range(rng.randint(1, 50))) for _ in range(n)]


@pytest.mark.parametrize("ids", [[], [5], [5] * 9000, [4_000_000_000, 1, 2] * 700, list(range(5000))])
def test_range_coder_round_trip(ids):
    a = np.array(ids, "<u4")
    assert (range_coder.decode(b"".join(range_coder.encode(a))) == a).all()


def test_range_coder_learns_and_checks():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3000, (200, 5))
    a = words[rng.zipf(1.5, 20_000) % 200].ravel().astype("<u4")
    coded = b"".join(range_coder.encode(a, 2048))
    assert len(coded) < len(a) * 0.8  # of two bytes an id as they are
    bad = bytearray(coded)
    bad[len(bad) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        range_coder.decode(bytes(bad))


def test_the_coder_writes_what_it_wrote():
    k = np.arange(60_000, dtype=np.uint64)
    ids = ((k * k // np.uint64(7)) % np.uint64(997) * (k % np.uint64(5) + np.uint64(1))).astype("<u4")
    ids[50_000:50_300] *= np.uint32(70_001)
    ids[55_000:] = ids[5_000:10_000]
    assert hashlib.sha256(b"".join(range_coder.encode(ids))).hexdigest() == "2bea1e347a1a9049405c9647d47dfea30f9917b6f4e08a6b587261b369eb451a"


def test_shards_are_read_in_large_pieces(monkeypatch):
    ids = np.arange(300 * range_coder.BLOCK, dtype="<u4") % 5000
    blocks = b"".join(range_coder.encode(ids))
    heads = zlib.compress(np.ones(1, np.uint8).tobytes() + np.array([8], "<i8").tobytes() + np.array([len(ids)], "<u4").tobytes())
    reads = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    class Files:
        def open_input_file(self, path):
            return pa.PythonFile(Counted(blocks + heads + token_output.TAIL.pack(len(heads), 1, len(ids), len(blocks), token_output.MAGIC)), mode="r")

    monkeypatch.setattr(token_output, "open_fs", lambda path: (Files(), path))
    known, docs, lengths, parts = token_output.open_shard("shard")
    assert known.tolist() == [1] and docs.tolist() == [8] and lengths.tolist() == [len(ids)]
    assert np.array_equal(np.concatenate(list(parts)), ids)
    assert len(reads) < 20  # of 300 blocks


def test_words_encode_as_the_library_does():
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path()
    plain, texts = Tokenizer.from_file(path), _random_texts(1500)
    for _ in range(2):  # with an empty and with a filled table
        for t, ids in zip(texts, token_output.encode_texts([t.encode() for t in texts], path), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_that_differ_in_case_or_stops_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path()
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(token_output, "_tables", {})
    calls, ids_of = [], token_output.word_table(path).ids_of
    monkeypatch.setattr(token_output.word_table(path), "ids_of", lambda pieces: calls.extend(pieces) or ids_of(pieces))
    texts = ["Quorvex, quorvex QUORVEX. quorvex.,Quorvex"]
    assert token_output.encode_texts([t.encode() for t in texts], path)[0].tolist() == plain.encode(texts[0], add_special_tokens=False).ids
    assert sorted(calls) == [b",", b".", b".,", b"quorvex"]
    # marks that compose with small letters only, special tokens in other cases, stops beside other signs, texts without white space between
    odd = ["H\u0331 h\u0331 J\u030c A\u0301", "<|EndOfText|> <|endoftext|> ABC", "Don'T. IT'S, a.'s .,! A.B,c1.2", "Z", "\u0301Z", "\u212aK K.\u0301 .\u0338", "X", "", ".", "y"]
    for some in (odd, [t for t in odd if "<" not in t], ["<", *odd]):
        for t, ids in zip(some, token_output.encode_texts([t.encode() for t in some], path), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_intervals_known_at_once_are_those_of_the_model():
    rng = np.random.default_rng(3)
    for steps, most in ((1, 1), (5, 3), (128, 9), (300, 40), (1024, 700)):
        symbols = np.minimum(rng.zipf(1.4, (7, steps)) - 1, most - 1).astype(np.uint16)
        symbols[1] = 0
        sizes = np.array([int(row.max()) + 1 for row in symbols])
        starts, widths = range_coder._intervals(symbols, sizes)
        model = range_coder._Model(sizes, steps)
        for t in range(steps):
            sym = symbols[:, t].astype(np.int64)
            model.predict()
            start, width = model.interval(sym, symbols[:, t])
            model.learn(sym, symbols[:, t])
            assert (start == starts[:, t]).all() and (width == widths[:, t]).all()


def test_a_full_word_table_starts_anew():
    calls = []
    table = word_table.WordTable(lambda words: [calls.append(w) or np.array([len(w), w[0]], "<u4").tobytes() for w in words], most=50)
    rng = random.Random(5)
    for _ in range(40):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 18))).encode() for _ in range(60)]
        data = np.frombuffer(b" ".join(words), np.uint8)
        ids, n = table.encode(data, np.array([0, len(data)]), b"\1\0\0\0")
        assert n.tolist() == [121] and ids.tolist() == [x for w in words for x in (len(w), w[0])] + [1]
    assert len(calls) < 40 * 60


def test_backtracking_encodes_as_the_library_does():
    path = sentencepiece_bpe.model_path()
    model = sentencepiece_bpe.encoder(path)[0].model
    for t in _random_texts(1500):
        assert sentencepiece_bpe.encode_text(t.encode(), path).tolist() == model.encode(t), repr(t)


def test_long_words_without_a_break():
    path = sentencepiece_bpe.model_path()
    model, rng = sentencepiece_bpe.encoder(path)[0].model, random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600_000))
    assert sentencepiece_bpe.encode_text(word.encode(), path).tolist() == model.encode(word)
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path()
    assert token_output.encode_texts([word.encode()], path)[0].tolist() == Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids


def test_parts_are_encoded_once(monkeypatch):
    path, calls = sentencepiece_bpe.model_path(), []
    e = sentencepiece_bpe.encoder(path)[0]
    plain = e._ids
    monkeypatch.setattr(e, "_ids", lambda part: calls.append(part) or plain(part))
    rng = random.Random(11)
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(470_000)})
    texts = [" ".join(words[k : k + 50_000]).encode() for k in range(0, len(words), 50_000)]
    first = [sentencepiece_bpe.encode_text(t, path).tolist() for t in texts]
    calls.clear()
    assert [sentencepiece_bpe.encode_text(t, path).tolist() for t in texts] == first
    assert not calls
    assert e.model.encode([t.decode() for t in texts]) == first


def test_a_large_batch_is_copied_a_chunk_at_a_time():
    some = ["", "plain words", "\u2581 and ", "x" * 300, None, "caf\u00e9 \u0417\u0434"]
    plain = [t or "" for t in some] * 3 + ["of one batch of texts " * 300] * 1500  # 10 MB
    path, sp = sentencepiece_bpe.model_path(), sentencepiece_bpe.encoder(sentencepiece_bpe.model_path())[0].model
    texts = pa.array([b"before", *(t.encode() for t in plain)], pa.binary()).slice(1)
    before, most, at = pa.total_allocated_bytes(), 0, 0
    for ids, counts in sentencepiece_bpe.encode_column(texts, path):
        most = max(most, pa.total_allocated_bytes() - before)
        for got, text in zip(np.split(ids, np.cumsum(counts)[:-1]), plain[at : at + len(counts)], strict=True):
            assert got.tolist() == sp.encode(text)
        at += len(counts)
    assert at == len(plain)
    assert most < 2 << 20


def test_cuts_where_no_piece_reaches(monkeypatch):
    path = sentencepiece_bpe.model_path()
    e, table = sentencepiece_bpe.encoder(path)
    rng, pieces = random.Random(13), sorted(e.ids)
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(4000)] + ["".join(rng.choice(pieces)[-1] + rng.choice(pieces)[0] for _ in range(9)) for _ in range(4000)]
    want = e.model.encode(texts)
    for small in (False, True):  # with a table that is emptied again and again, too
        if small:
            monkeypatch.setitem(sentencepiece_bpe._encoders, path, (e, word_table.WordTable(e.parts, 50, e.bounds)))
        assert [sentencepiece_bpe.encode_text(t.encode(), path).tolist() for t in texts] == want
    whole = [i.tolist() for ids, n in sentencepiece_bpe.encode_column(pa.array(["", *texts, "", ""]).cast(pa.binary()), path) for i in np.split(ids, np.cumsum(n)[:-1])]
    assert whole == [[], *want, [], []]
    for bad in (b"a\xe3\x81 b\xff,c", b"\xc3", b"\x81\x82 \xe2\x96"):
        assert sentencepiece_bpe.encode_text(bad, path).tolist() == e.model.encode(bad.decode(errors="replace"))


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    out = scratch(spark, "t")
    token_output.write_token_files(odd_docs, out, shards=3)
    rows = sorted(token_output.read_token_files(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 2, *range(3, 12)]
    plain, at = Tokenizer.from_file(token_output.tokenizer_path()), 0
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], []).append([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in texts[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    empty = scratch(spark, "t")
    token_output.write_token_files(no_docs, empty)
    assert token_output.read_token_files(spark, empty).count() == 0


def test_sentencepiece_rows(spark, odd_docs, no_docs):
    model = sentencepiece_bpe.encoder(sentencepiece_bpe.model_path())[0].model
    for r in sentencepiece_bpe.encode(odd_docs).collect():
        assert r["piece_ids"] == model.encode(r["text"] or "") and r["decoded"] == model.decode(r["piece_ids"]) and r["node"] == "x"
    digests = sentencepiece_bpe.encode(odd_docs, keep=["doc_id"], digests=True, with_ids=False)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = [r for r in digests.collect() if r["doc_id"] == 5][0]
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == empty["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sentencepiece_bpe.encode(no_docs).count() == 0
