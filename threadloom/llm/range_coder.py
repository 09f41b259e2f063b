"""Adaptive context-mixing range coder for blocks of token ids, coded in lockstep over many blocks.

A block holds its own alphabet (the distinct ids, as gaps) and a range-coded stream. Each id is
coded by one mixed distribution of three predictions: the id last seen after the two ids before
(order 2), the id last seen after the one before (order 1), and adaptive counts (order 0). The weights of
the first two follow how often predictions of the same confidence have been right so far in the block.
All state starts afresh in each block, and each block carries the CRC-32 of its ids.

All blocks of a batch advance together, one id a step, so that a step is a few dozen numpy calls over
all blocks. The encoder knows all ids, so it finds what the model predicts at each step from sorted contexts,
for whole blocks at once, and only the range coder itself goes step by step.
Only integers decide (divisions of doubles and floats are ones that round down to the integer), so any machine decodes what any other wrote.
"""

from __future__ import annotations

import io
import itertools
import struct
import zlib

import numpy as np

MAGIC = b"TLR2"
HEAD = struct.Struct("<4sIIIII")  # magic, ids, alphabet size, alphabet bytes, stream words, crc32
LANES = 2048
BLOCK = 1024

_TOTAL = 20  # bits of a step's total frequency
_ALL = 1 << _TOTAL
_PLAIN = 12  # bits of the order-0 table
_SLOTS = 1024  # order-2 contexts of a block
_REBUILD = 128  # steps between two rebuilds of the weights, of which every fourth one rebuilds the order-0 table
_GAIN = 32  # what a symbol met adds to its count
_CONF = 4  # confidences of a prediction: hits in a row, up to _CONF - 1
_U = np.uint64
_LEAST, _LOW32 = _U(1 << 32), _U((1 << 32) - 1)
_S4, _S16, _S32, _ST = _U(4), _U(16), _U(32), _U(_TOTAL)
#: What tries and hits begin with, for order 1 and 2 and each confidence.
_START = np.full((2, 1, _CONF), 16), np.array([[[1, 3, 5, 8]], [[2, 6, 10, 14]]])
_GROUP = 128  # blocks whose intervals are found together
_place = np.zeros(1 << 18, np.uint16)


def _alphabets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct ids of each row, ascending and row after row; how many each has; the place of each id among those of its row)."""
    found = np.sort(rows, axis=1)
    new = np.ones(found.shape, bool)
    np.not_equal(found[:, 1:], found[:, :-1], out=new[:, 1:])
    sizes = np.count_nonzero(new, axis=1)
    found, ends = found[new], np.cumsum(sizes)
    symbols, places, known = np.empty(rows.shape, np.uint16), np.arange(rows.shape[1], dtype=np.uint16), found.max() < len(_place)
    for row, out, a, b in zip(rows, symbols, (ends - sizes).tolist(), ends.tolist(), strict=True):
        if known:
            _place[found[a:b]] = places[: b - a]
            out[:] = _place[row]
        else:
            out[:] = np.searchsorted(found[a:b], row)
    return found, sizes, symbols


def _pack_gaps(alphabets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each row, a byte for each gap; larger gaps follow in 16 bits, and those that don't fit there in 32."""
    ends = np.cumsum(sizes)
    firsts, ids = ends - sizes, alphabets.astype(np.int64)
    gaps = np.diff(ids, prepend=0)
    gaps[firsts] = ids[firsts]
    large = np.flatnonzero(gaps >= 255)
    huge = large[gaps[large] >= 65535]
    kinds = []
    for places, kind in ((np.arange(len(gaps)), "u1"), (large, "<u2"), (huge, "<u4")):
        most, width = (255, 65535, (1 << 32) - 1)[len(kinds)], np.dtype(kind).itemsize
        cuts = (np.searchsorted(places, np.append(firsts, len(gaps))) * width).tolist()
        kinds.append((np.minimum(gaps[places], most).astype(kind).tobytes(), cuts))
    return [b"".join(data[cuts[k] : cuts[k + 1]] for data, cuts in kinds) for k in range(len(sizes))]


def _unpack_gaps(data: bytes, n: int) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8, n).astype(np.int64)
    escaped = np.flatnonzero(gaps == 255)
    large = np.frombuffer(data, "<u2", len(escaped), n).astype(np.int64)
    huge = large == 65535
    large[huge] = np.frombuffer(data, "<u4", int(huge.sum()), n + 2 * len(escaped))
    gaps[escaped] = large
    return np.cumsum(gaps)


def _counts_at(step: int) -> bool:
    """Whether the order-0 table is made anew before this step."""
    return step % (4 * _REBUILD) == 0 or step in (32, 128)


def _weights(tries: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Weights of each pair of confidences, packed: order 1, units of order 0; the rest is order 2's."""
    (t1, t2), (h1, h2) = tries, hits
    w2 = np.clip(h2 * _ALL // t2, 64, _ALL - (3 << _PLAIN))[..., :, None]
    w1 = np.clip((_ALL - w2) * h1[..., None, :] // t1[..., None, :], 64, _ALL - w2 - (2 << _PLAIN))
    return (w1 << 8 | _ALL - w2 - w1 >> _PLAIN).astype(np.int32)


def _spans(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency of each symbol, flat: the sum of those before it << 16 | frequency) of the order-0 table."""
    # all below 2 ** 31, so that a division of doubles rounds down to just the integer
    room, total = ((1 << _PLAIN) - sizes).astype(np.float64), counts.sum(axis=1).astype(np.float64)
    share = counts * room[:, None]
    share /= total[:, None]
    freq = share.astype(np.int32)
    freq += np.arange(counts.shape[1])[None, :] < sizes[:, None]
    freq[:, 0] += (1 << _PLAIN) - freq.sum(axis=1, dtype=np.int32)
    cum = freq.cumsum(axis=1, dtype=np.int32)
    cum -= freq
    cum <<= 16
    cum |= freq
    return freq, cum.reshape(-1)


def _foreseen(keys: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each row (confidence of the symbol last seen after the same key, whether it is the symbol here)."""
    n, steps = keys.shape
    order = keys.astype(np.uint32)
    order <<= 16
    order |= np.arange(steps, dtype=np.uint32)
    order.sort(axis=1)
    key = order >> 16
    order &= 0xFFFF
    order = (order + np.arange(n, dtype=np.int64)[:, None] * steps).ravel()
    seen = symbols.reshape(-1).take(order).reshape(n, steps)
    same, guess = key[:, 1:] == key[:, :-1], np.zeros_like(seen)
    np.multiply(seen[:, :-1], same, out=guess[:, 1:])
    hit = seen == guess
    rows = np.zeros((_CONF - 1, n, steps), bool)  # hits in a row before this place: one, two, three
    np.logical_and(hit[:, :-1], same, out=rows[0, :, 1:])
    for k in range(1, _CONF - 1):
        np.logical_and(rows[k - 1, :, :-1], rows[0, :, 1:], out=rows[k, :, 1:])
    found, out = np.add.reduce(rows.view(np.uint8), 0, np.uint8), np.empty(n * steps, np.uint8)
    found <<= 1
    found |= hit.view(np.uint8)
    out[order] = found.ravel()
    out = out.reshape(n, steps)
    return out >> 1, (out & 1).view(bool)


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many flags of each row are set in each run of _REBUILD steps."""
    eights = flags.view(np.uint64).reshape(len(flags), -1, _REBUILD // 8).sum(axis=2)  # bytes of at most 16
    return eights.view(np.uint8).reshape(*eights.shape, 8).sum(axis=2)


def _intervals(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, width) of each symbol in the mixed distribution that _Model has there. symbols: blocks x steps, all known, so no step waits for another."""
    n, steps = symbols.shape
    width, rounds, base = int(sizes.max()), -(-steps // _REBUILD), np.arange(n, dtype=np.int64)[:, None]
    past = np.zeros((n, steps + 2), np.uint16)
    past[:, 2:] = symbols
    one, two = past[:, 1:-1], past[:, :-2]
    hashed = one * np.uint16(2557)
    hashed += two * np.uint16(1259)
    hashed &= np.uint16(_SLOTS - 1)
    (conf1, h1), (conf2, h2) = _foreseen(one, symbols), _foreseen(hashed, symbols)
    tries, hits = np.empty((2, n, rounds, _CONF), np.int64), np.empty((2, n, rounds, _CONF), np.int64)
    full = (rounds - 1) * _REBUILD
    for k, (conf, hit) in enumerate(((conf1, h1), (conf2, h2))):
        sums = np.zeros((2, n, rounds, _CONF), np.int64)
        for c in range(_CONF if full else 0):
            at = conf[:, :full] == c
            sums[0, :, 1:, c] = _sums(at)
            at &= hit[:, :full]
            sums[1, :, 1:, c] = _sums(at)
        sums = sums.cumsum(axis=2)
        tries[k], hits[k] = sums[0] + _START[0][k], sums[1] + _START[1][k]
    index = (base * rounds + np.arange(steps) // _REBUILD) * (_CONF * _CONF)
    conf2 <<= 2
    conf2 |= conf1
    index += conf2
    w1 = _weights(tries, hits).reshape(-1).take(index)
    w0 = w1 & 0xFF
    w1 >>= 8
    w12 = _ALL - (w0 << _PLAIN)
    packed, places = np.empty((n, steps), np.int32), symbols + base * width
    counts = (np.arange(width)[None, :] < sizes[:, None]).astype(np.int32)
    turns = [t for t in range(steps) if _counts_at(t)]
    for k, (a, b) in enumerate(zip(turns, [*turns[1:], steps], strict=True)):
        if k:
            counts += (_GAIN * np.bincount(places[:, turns[k - 1] : a].ravel(), minlength=n * width)).astype(np.int32).reshape(n, width)
        packed[:, a:b] = _spans(counts, sizes)[1].take(places[:, a:b])
    miss, w2 = ~(h1 | h2), w12 - w1
    packed *= miss
    start = packed >> 16
    start *= w0
    start += w1 * miss
    start += w2
    w2 *= h2
    start -= w2
    packed &= 0xFFFF
    packed *= w0
    packed += w1 * (h1 > h2)
    packed += w2
    return start, packed


class _Model:
    """The adaptive state of all blocks of a batch, as the decoder goes through it; _intervals has the same for known symbols."""

    def __init__(self, sizes: np.ndarray, steps: int):
        n, width = len(sizes), int(sizes.max())
        self.n, self.width, self.sizes = n, width, sizes.astype(np.int64)
        lane = np.arange(n, dtype=np.int64)
        self.base0 = lane * width
        # one table for both orders: a context's slot holds symbol * _CONF + hits in a row
        self.slots = np.zeros(n * (width + _SLOTS), np.uint16)
        self.base2 = n * width + lane * _SLOTS
        self.index = np.empty((2, n), np.int64)
        self.base_w = lane * _CONF * _CONF
        self.counts = (np.arange(width)[None, :] < sizes[:, None]).astype(np.int32)
        self.history = np.empty((steps, n), np.uint16)
        self.tries, self.hits = _START[0] + np.zeros((2, n, 1), np.int64), _START[1] + np.zeros((2, n, 1), np.int64)
        #: confidences and hits of the steps since the last rebuild
        self.trusted, self.met = np.empty((_REBUILD, 2, n), np.uint8), np.empty((_REBUILD, 2, n), bool)
        self.weighed = 0
        self.prev, self.hash2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.part = np.zeros(n, np.uint16)
        self.step = self.counted = 0

    def _weigh(self):
        fresh = self.step - self.weighed
        for k in range(_CONF):
            tried = self.trusted[:fresh] == k
            self.tries[:, :, k] += np.add.reduce(tried.view(np.uint8), 0, np.uint8)  # at most _REBUILD
            tried &= self.met[:fresh]
            self.hits[:, :, k] += np.add.reduce(tried.view(np.uint8), 0, np.uint8)
        self.weighed = self.step
        self.weights = _weights(self.tries, self.hits).reshape(-1)

    def _count(self):
        """The order-0 table from all symbols so far."""
        fresh = self.history[self.counted : self.step]
        if len(fresh):
            self.counts += (_GAIN * np.bincount((fresh + self.base0).ravel(), minlength=self.n * self.width)).astype(np.int32).reshape(self.n, self.width)
            self.counted = self.step
        freq, self.spans = _spans(self.counts, self.sizes)
        self.symbols = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), self.n), freq.ravel())

    def predict(self):
        step = self.step
        if step % _REBUILD == 0:
            self._weigh()
        if _counts_at(step):
            self._count()
        np.add(self.base0, self.prev, out=self.index[0])
        np.add(self.base2, self.hash2, out=self.index[1])
        self.slot = self.slots.take(self.index, mode="clip")
        self.conf = self.slot & np.uint16(_CONF - 1)
        k = self.conf[1] << np.uint16(2)
        k += self.conf[0]
        self.w1 = self.weights.take(self.base_w + k, mode="clip")
        self.w0 = self.w1 & 0xFF
        self.w1 >>= 8
        self.w12 = _ALL - (self.w0 << _PLAIN)
        self.w2 = self.w12 - self.w1

    def interval(self, sym: np.ndarray, narrow: np.ndarray):
        """(start, width) of the symbol (64 and 16 bits wide) in the mixed distribution; the order-2 prediction comes first, then order 1."""
        self.packed = narrow << np.uint16(2)
        self.hit = (self.slot ^ self.packed) < np.uint16(_CONF)
        h1, h2 = self.hit
        # masks are multiplied: which blocks hit is no pattern, and a branch for each of them costs more
        miss, w2 = ~(h1 | h2), self.w2 * h2
        freq = self.spans.take(self.base0 + sym, mode="clip")
        freq *= miss
        start = freq >> 16
        start *= self.w0
        start += self.w1 * miss
        start += self.w2
        start -= w2
        freq &= 0xFFFF
        freq *= self.w0
        freq += self.w1 * (h1 > h2)
        freq += w2
        return start.astype(np.uint64), freq.astype(np.uint64)

    def learn(self, sym: np.ndarray, narrow: np.ndarray):
        """Must follow interval() of the same symbols."""
        conf, k = self.conf, self.step - self.weighed
        self.trusted[k] = conf
        self.met[k] = self.hit
        conf += np.uint16(1)
        np.minimum(conf, np.uint16(_CONF - 1), out=conf)
        conf *= self.hit
        conf += self.packed
        self.slots[self.index] = conf
        self.history[self.step] = narrow
        self.step += 1
        h = narrow * np.uint16(2557)  # modulo 2 ** 16, of which the low bits count
        h += self.part
        h &= np.uint16(_SLOTS - 1)
        self.hash2 = h
        self.part = narrow * np.uint16(1259)
        self.prev = sym


def _encode_batch(symbols: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """symbols: blocks x steps, local ids. Returns each block's stream of 16-bit words."""
    n, steps = symbols.shape
    starts, freqs = np.empty((steps, n), np.uint32), np.empty((steps, n), np.uint32)
    for k in range(0, n, _GROUP):
        for all_, some in zip((starts, freqs), _intervals(symbols[k : k + _GROUP], sizes[k : k + _GROUP]), strict=True):
            all_[:, k : k + _GROUP] = some.T
    low, rng = np.zeros(n, np.uint64), np.full(n, 1 << 48, np.uint64)
    # blocks x words: the line that a block writes to stays in the cache
    width = steps * 2 + 16
    out, first = np.zeros(n * width, np.uint32), np.arange(n, dtype=np.int64) * width
    at = first.copy()
    for start, freq in zip(starts, freqs, strict=True):
        rng >>= _ST
        start = start * rng
        low += start
        rng *= freq
        small = (rng < _LEAST).astype(np.uint64)
        high = low >> _S32
        out[at] = high.astype(np.uint32)  # with the carry, which goes up at the end; overwritten unless the place moves on
        high *= small
        high <<= _S32
        low -= high
        at += small.view(np.int64)
        small <<= _S4
        low <<= small
        rng <<= small
        few = np.flatnonzero(rng < _LEAST)
        while len(few):  # a second word is rare
            out[at[few]] = low[few] >> _S32
            low[few] = (low[few] & _LOW32) << _S16
            rng[few] <<= _S16
            at[few] += 1
            few = few[rng[few] < _LEAST]
    for _ in range(3):
        out[at] = low >> _S32
        low = (low & _LOW32) << _S16
        at += 1
    counts = at - first
    words, carry = np.ascontiguousarray(out.reshape(n, width)[:, : counts.max()].T), np.zeros(n, np.uint32)
    words[np.arange(len(words))[:, None] >= counts] = 0
    for row in words[::-1]:
        row += carry
        carry = row >> np.uint32(16)
    words = np.ascontiguousarray(words.T.astype("<u2"))
    return [w[:k] for w, k in zip(words, counts.tolist(), strict=True)]


def _decode_batch(streams: list[np.ndarray], sizes: np.ndarray, steps: int) -> np.ndarray:
    n = len(streams)
    m = _Model(sizes, steps)
    data = np.zeros((n, max(map(len, streams)) + 8), np.uint16)
    for row, s in zip(data, streams, strict=True):
        row[: len(s)] = s
    data, at = data.ravel(), np.arange(n, dtype=np.int64) * data.shape[1]
    rng, code = np.full(n, 1 << 48, np.uint64), np.zeros(n, np.uint64)
    for _ in range(3):
        code = code << _S16 | data[at]
        at += 1
    base = np.arange(n, dtype=np.int64) << _PLAIN
    for _ in range(steps):
        m.predict()
        rng >>= _ST
        # below 2 ** 53, so that a division of doubles rounds down to just the integer; below 2 ** 24 one of floats does
        v = code / rng
        v = np.minimum(v, 2 * _ALL, out=v).astype(np.int32)
        goal = v - m.w12
        np.maximum(goal, 0, out=goal)
        goal = (goal.astype(np.float32) / m.w0.astype(np.float32)).astype(np.int64)
        goal += base
        guess = m.slot >> np.uint16(2)
        narrow = np.where(v < m.w12, guess[0], m.symbols.take(goal, mode="clip"))
        narrow = np.where(v < m.w2, guess[1], narrow)
        sym = narrow.astype(np.int64)
        start, freq = m.interval(sym, narrow)
        start *= rng
        code -= start
        rng *= freq
        small = (rng < _LEAST).astype(np.uint64)
        word = data.take(at, mode="clip") * small
        at += small.view(np.int64)
        small <<= _S4
        code <<= small
        code |= word
        rng <<= small
        few = np.flatnonzero(rng < _LEAST)
        while len(few):  # a second word is rare
            code[few] = code[few] << _S16 | data[at[few]]
            rng[few] <<= _S16
            at[few] += 1
            few = few[rng[few] < _LEAST]
        m.learn(sym, narrow)
    return m.history


def encode(ids: np.ndarray, length: int = BLOCK) -> list[bytes]:
    """ids (unsigned 32-bit) as self-contained blocks of `length` ids (at most BLOCK), the last one shorter."""
    out: list[bytes] = []
    for k in range(0, len(ids), LANES * length):
        part = np.ascontiguousarray(ids[k : k + LANES * length], "<u4")
        steps = min(length, len(part))
        blocks, last = -(-len(part) // steps), (len(part) - 1) % steps + 1
        rows = np.empty((blocks, steps), np.uint32)
        rows.reshape(-1)[: len(part)] = part
        rows[-1, last:] = rows[-1, :last].min()
        alphabets, sizes, symbols = _alphabets(rows)
        streams = _encode_batch(symbols, sizes)
        raw, step = memoryview(part).cast("B"), 4 * steps
        for b, (gaps, size, s) in enumerate(zip(_pack_gaps(alphabets, sizes), sizes.tolist(), streams, strict=True)):
            n = last if b == blocks - 1 else steps
            out.append(HEAD.pack(MAGIC, n, size, len(gaps), len(s), zlib.crc32(raw[b * step : b * step + 4 * n])) + gaps + s.tobytes())
    return out


def read_blocks(f, n_bytes: int):
    """(ids, alphabet, stream, checksum) of each block in the next n_bytes of an open file."""
    while n_bytes > 0:
        magic, n, size, gap_bytes, words, crc = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("no block where one should begin")
        body = f.read(gap_bytes + 2 * words)
        yield n, _unpack_gaps(body[:gap_bytes], size), np.frombuffer(body, "<u2", words, gap_bytes), crc
        n_bytes -= HEAD.size + len(body)


def decode_blocks(blocks: list[tuple]) -> np.ndarray:
    """The ids of some blocks, at most LANES of them. Raises ValueError where a checksum doesn't hold."""
    out = []
    symbols = _decode_batch([b[2] for b in blocks], np.array([len(b[1]) for b in blocks]), max(b[0] for b in blocks))
    for (n, alphabet, _, crc), local in zip(blocks, np.ascontiguousarray(symbols.T), strict=True):
        ids = alphabet.take(local[:n], mode="clip").astype("<u4")
        if zlib.crc32(ids) != crc:
            raise ValueError("checksum of a block doesn't hold")
        out.append(ids)
    return np.concatenate(out)


def decode_file(f, n_bytes: int):
    """The ids of the next n_bytes of an open file, a batch of blocks at a time."""
    blocks = read_blocks(f, n_bytes)
    while batch := list(itertools.islice(blocks, LANES)):
        yield decode_blocks(batch)


def decode(data: bytes) -> np.ndarray:
    """The ids of a run of blocks."""
    return np.concatenate([np.empty(0, "<u4"), *decode_file(io.BytesIO(data), len(data))])
