"""A context-mixing range coder for token ids, run over many blocks at once.

A segment begins with its model, learnt from all of its ids; a block of up to ``BLOCK`` ids is coded from nothing but that
model, so it can be read alone. Orders 1 and 2 each predict one id, by the last id and by a hash of the last two, with a
confidence by how often that prediction came true in the segment; order 0 gives each id its share among the ids that neither
foretold. How much weight the predictions get against order 0 depends on both confidences, on whether they agree, and
on which of the last ``PAST`` ids of the block were foretold; the weights are what came true in the segment in each
such state. Ids that are met once are an escape and 16 plain bits.

The interval so found drives a range coder with 62-bit state that puts out 32-bit words; carries are settled when the block
ends. Shares add up to powers of two, so coding takes shifts and products only. The model and the intervals of all ids are
worked out at once; only the coder's state, and in decoding the look-up of the next id, goes from id to id, for the t-th id
of ``LANES`` blocks in one step of numpy.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
#: Blocks that are coded in step.
LANES = 2048
#: Bits of a weight, of a share of order 0, and of the hash of two ids.
WEIGHT, SHARE, HASH = 16, 15, 16
CONF = 4
PAST = 3
#: A prediction is kept if it came true so often, and so often among this many cases.
OFTEN, LIKELY = 4, (1 / 16, 1 / 4, 5 / 8)
_STATES = CONF * CONF * 2 << PAST
#: No weight is less, nor what is left beside the weights.
_LEAST = 64
_MOST = 1 << 14
_RUN = 32 * BLOCK
_TOP, _LOW = 62, 30
_LITTLE, _MASK = np.uint64(1 << _LOW), np.uint64((1 << _LOW) - 1)


def _hash(before, last):
    return (before * 40503 + last) & ((1 << HASH) - 1)


def _foretold(at: np.ndarray, slot: np.ndarray, places: int, escape: int) -> np.ndarray:
    """For each place the slot that is met there most, times CONF, plus its confidence; 0 if it is not worth keeping."""
    pairs = np.sort(at << np.uint32(16) | slot)
    ends = np.append(np.flatnonzero(pairs[1:] != pairs[:-1]), len(pairs) - 1)
    n = np.diff(ends, prepend=-1)
    often = n >= OFTEN
    pairs, n = pairs[ends[often]].astype(np.int64), n[often]
    n[pairs & 0xFFFF == escape] = 0
    out = np.zeros(places, np.int64)
    if len(pairs):
        first = np.flatnonzero(np.diff(pairs >> 16, prepend=-1))
        best, of = np.maximum.reduceat(n << 16 | (pairs & 0xFFFF), first), pairs[first] >> 16
        conf = np.searchsorted(LIKELY, (best >> 16) / np.bincount(at, minlength=places)[of])
        out[of] = np.where(conf > 0, (best & 0xFFFF) * CONF + conf, 0)
    return out


def _state(past, one, two):
    """Number of the state that the weights depend on: predictions are the same if only their confidences differ."""
    return ((past << 4 | (one & 3) << 2 | (two & 3)) << 1) + ((one ^ two) < CONF)


class _Model:
    """Distinct ids in ascending order (a slot is a place there; then come the escape and the begin of a block), shares of
    order 0, predictions of orders 1 and 2, and the weights of each state: order 1's, and both together."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, one: np.ndarray, two: np.ndarray, weights: np.ndarray):
        self.ids, self.shares, self.one, self.two, self.weights = ids, shares, one, two, weights
        # A last place stands for what was foretold
        self.starts = np.append(np.cumsum(shares) - shares, 0).astype(np.uint64)
        self.widths = np.append(shares, 1 << SHARE).astype(np.uint64)
        # By three times the state, and 0 if neither came true, 1 if order 1's did, 2 if order 2's alone did
        first, both = weights.astype(np.uint64)
        self.by_starts = np.stack([both, 0 * both, first], 1).ravel()
        self.by_widths = np.stack([(1 << WEIGHT) - both, first, both - first], 1).ravel()

    def pack(self) -> bytes:
        two = np.flatnonzero(self.two)
        part = lambda x, t: np.ascontiguousarray(x).astype(t).tobytes()
        raw = b"".join(
            [
                struct.pack("<II", len(self.ids), len(two)),
                part(np.diff(self.ids, prepend=0), "<u2"),
                part(self.shares, "<u2"),
                part(self.one % CONF, "u1"),
                part(self.one // CONF, "<u2"),
                part(np.diff(two, prepend=0), "<u2"),
                part(self.two[two] % CONF, "u1"),
                part(self.two[two] // CONF, "<u2"),
                part(self.weights, "<u2"),
            ]
        )
        return zlib.compress(raw, 6)

    @staticmethod
    def unpack(data: bytes) -> _Model:
        raw = zlib.decompress(data)
        m, k = struct.unpack_from("<II", raw)
        at = 8

        def part(n: int, t: str) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, t, n, at).astype(np.int64)
            at += x.size * np.dtype(t).itemsize
            return x

        ids, shares, conf = np.cumsum(part(m, "<u2")), part(m + 1, "<u2"), part(m + 2, "u1")
        one = part(m + 2, "<u2") * CONF + conf
        places, conf = np.cumsum(part(k, "<u2")), part(k, "u1")
        two = np.zeros(1 << HASH, np.int64)
        two[places] = part(k, "<u2") * CONF + conf
        return _Model(ids, shares, one, two, part(2 * _STATES, "<u2").reshape(2, -1))


def _learn(ids: np.ndarray) -> tuple[_Model, np.ndarray, np.ndarray]:
    """The model of a segment, and for each id the numbers of its intervals, by weight and by share."""
    total = len(ids)
    n = np.bincount(ids, minlength=1 << 16)
    some = np.flatnonzero(n > 1)
    if len(some) > _MOST:
        some = np.sort(some[np.argsort(-n[some], kind="stable")[:_MOST]])
    m = len(some)
    number = np.full(1 << 16, m, np.uint32)
    number[some] = np.arange(m)
    slots = number[ids]
    last, before = np.empty((2, total), np.uint32)
    last[1:], before[2:] = slots[:-1], slots[:-2]
    last[::BLOCK] = before[::BLOCK] = before[1::BLOCK] = m + 1
    at = _hash(before, last)
    one, two = _foretold(last, slots, m + 2, m), _foretold(at, slots, 1 << HASH, m)
    by_weight, by_share = np.empty((2, total), np.uint16)
    met, left = np.zeros(3 * _STATES, np.int64), np.zeros(m + 2, np.int64)
    for a in range(0, total, _RUN):  # parts that stay in the processor's cache
        run = slice(a, a + _RUN)
        slot, said, also = slots[run].astype(np.int64), one.take(last[run]), two.take(at[run])
        right = (said > 0) & (said >> 2 == slot)
        right2 = (also > 0) & (also >> 2 == slot) & ~right
        hit = (right | right2).astype(np.int64)
        past, place = np.zeros(len(slot), np.int64), np.arange(len(slot)) % BLOCK
        for k in range(PAST):  # which of the last ids of the block were foretold
            past[k + 1 :] |= (hit[: -k - 1] << k) * (place[k + 1 :] > k)
        of = 3 * _state(past, said, also) + right + 2 * right2
        share = np.where(hit > 0, m + 1, slot)
        met += np.bincount(of, minlength=3 * _STATES)
        left += np.bincount(share, minlength=m + 2)
        by_weight[run], by_share[run] = of, share
    met, left = met.reshape(_STATES, 3), left[:-1]
    state = np.arange(_STATES)
    won = np.clip(np.rint((met[:, 1:] + 0.4) / (met.sum(axis=1, keepdims=True) + 1.2) * (1 << WEIGHT)), _LEAST, (1 << WEIGHT) - 3 * _LEAST).astype(np.int64)
    there, there2 = state // (2 * CONF) % CONF > 0, state // 2 % CONF > 0
    first = won[:, 0] * there
    both = np.minimum(first + won[:, 1] * (there2 & ~(there & (state & 1 > 0))), (1 << WEIGHT) - _LEAST)
    shares = np.where(left > 0, np.maximum(left * ((1 << SHARE) - m - 1) // max(1, int(left.sum())), 1), 0)
    shares[np.argmax(left) if left.any() else m] += (1 << SHARE) - shares.sum()
    return _Model(some, shares, one, two, np.stack([first, both])), by_weight, by_share


def _steps(x: np.ndarray, pad: int, n: int) -> np.ndarray:
    """A row for each step, with a place for each of n blocks."""
    if len(x) < n * BLOCK:
        x = np.append(x, np.full(n * BLOCK - len(x), pad, x.dtype))
    return np.ascontiguousarray(x.reshape(n, BLOCK).T)


def _code(ids: np.ndarray, model: _Model, by_weight: np.ndarray, by_share: np.ndarray) -> list[bytes]:
    """The words of each block."""
    n, escape = -(-len(ids) // BLOCK), len(model.ids)
    # Padding has the whole of the interval
    by_starts, by_widths = np.append(model.by_starts, 0).astype(np.uint64), np.append(model.by_widths, 1 << WEIGHT).astype(np.uint64)
    by_weight, by_share, plain = _steps(by_weight, 3 * _STATES, n), _steps(by_share, escape + 1, n), _steps(ids, 0, n)
    escapes = (by_share == escape).any(axis=1).tolist()
    low, wide = np.zeros(n, np.uint64), np.full(n, 1 << _TOP, np.uint64)
    out, used = np.zeros((BLOCK + BLOCK // 2 + 8, n), np.uint64), np.zeros(n, np.int64)

    def settle(rows: np.ndarray) -> None:
        now = low[rows]
        out[used[rows], rows] = now >> _LOW
        used[rows] += 1
        low[rows] = (now & _MASK) << 32
        wide[rows] <<= 32

    for t in range(min(BLOCK, len(ids))):
        of, share = by_weight[t].astype(np.int64), by_share[t].astype(np.int64)
        unit = wide >> WEIGHT
        low += unit * by_starts.take(of)
        unit *= by_widths.take(of)
        unit >>= SHARE
        low += unit * model.starts.take(share)
        np.multiply(unit, model.widths.take(share), out=wide)
        settle(np.flatnonzero(wide <= _LITTLE))
        if escapes[t]:
            rows = np.flatnonzero(share == escape)
            unit = wide[rows] >> 16
            low[rows] += unit * plain[t, rows]
            wide[rows] = unit
            settle(rows[unit <= _LITTLE])
    every = np.arange(n)
    settle(every), settle(every)
    for at in range(int(used.max()) - 1, 0, -1):  # carries, from the last word to the first
        out[at - 1] += out[at] >> 32
    words = np.ascontiguousarray(out[: used.max()].astype("<u4").T)
    return [words[i, :k].tobytes() for i, k in enumerate(used.tolist())]


def encode(ids: np.ndarray) -> bytes:
    """A run of ids below 65,536 as a segment: header, model, block table, words of all blocks."""
    total = len(ids)
    if total and int(ids.max()) > 0xFFFF:
        raise ValueError("an id is written in 16 bits; this vocabulary has larger ones")
    if not total:
        return struct.pack("<4sIQI", b"CMR2", 0, 0, 0)
    model, by_weight, by_share = _learn(ids)
    packed, words = model.pack(), []
    for a in range(0, total, LANES * BLOCK):
        part = slice(a, a + LANES * BLOCK)
        words += _code(ids[part], model, by_weight[part], by_share[part])
    begin = zlib.crc32(packed)
    sizes, sums = np.array([len(w) // 4 for w in words], "<u4"), np.array([zlib.crc32(w, begin) for w in words], "<u4")
    return struct.pack("<4sIQI", b"CMR2", len(words), total, len(packed)) + packed + sizes.tobytes() + sums.tobytes() + b"".join(words)


def _decode(model: _Model, words: np.ndarray, edges: np.ndarray, steps: int) -> np.ndarray:
    """The ids of blocks whose words begin at ``edges``, a row each."""
    n, m = len(edges), len(model.ids)
    words = np.concatenate([words, np.zeros(2 * BLOCK, np.uint32)]).astype(np.uint64)
    code = (words[edges] << _LOW) + (words[edges + 1] >> 2)
    # The state holds 62 bits, so what follows it begins two bits before a word
    words[:-1] = ((words[:-1] & 3) << _LOW) + (words[1:] >> 2)
    at, wide = edges + 1, np.full(n, 1 << _TOP, np.uint64)
    find = np.repeat(np.arange(m + 1), model.shares)
    first, both = model.weights.astype(np.uint64)
    value, one, two = np.append(model.ids, [0, 0]), model.one, model.two
    out = np.empty((BLOCK, n), np.uint32)
    last, before, past = np.full(n, m + 1), np.full(n, m + 1), np.zeros(n, np.int64)

    def settle(rows: np.ndarray) -> None:
        code[rows] = (code[rows] << 32) + words[at[rows]]
        at[rows] += 1
        wide[rows] <<= 32

    for t in range(steps):
        said, also = one.take(last), two.take(_hash(before, last))
        state = _state(past, said, also)
        unit = wide >> WEIGHT
        hit, miss = code < unit * first.take(state), code >= unit * both.take(state)
        of = 3 * state + 2
        of -= hit
        of -= 2 * miss
        code -= unit * model.by_starts.take(of)
        unit *= model.by_widths.take(of)
        unit >>= SHARE
        slot = find.take((code // unit).view(np.int64), mode="clip")
        share = np.where(miss, slot, m + 1)
        code -= unit * model.starts.take(share)
        np.multiply(unit, model.widths.take(share), out=wide)
        slot = np.where(miss, slot, np.where(hit, said, also) >> 2)
        settle(np.flatnonzero(wide <= _LITTLE))
        ids = value.take(slot)
        rows = np.flatnonzero(slot == m)
        if len(rows):
            unit = wide[rows] >> 16
            plain = np.minimum(code[rows] // unit, 0xFFFF)
            code[rows] -= unit * plain
            wide[rows] = unit
            ids[rows] = plain
            settle(rows[unit <= _LITTLE])
        out[t] = ids
        past = (past << 1 | ~miss) & ((1 << PAST) - 1)
        before, last = last, slot
    return np.ascontiguousarray(out.T)


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; a block that differs from its checksum, which takes in the model, is an error."""
    magic, n, total, held = struct.unpack_from("<4sIQI", data)
    if magic != b"CMR2":
        raise ValueError("not a segment of ids")
    if not n:
        return np.empty(0, np.uint32)
    packed = data[20 : 20 + held]
    sizes, sums = (np.frombuffer(data, "<u4", n, 20 + held + 4 * n * i) for i in (0, 1))
    first, begin = 20 + held + 8 * n, zlib.crc32(packed)
    edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for i, (a, z) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        if zlib.crc32(data[first + 4 * a : first + 4 * z], begin) != sums[i]:
            raise ValueError(f"block {i} differs from its checksum")
    model, out = _Model.unpack(packed), []
    for a in range(0, n, LANES):
        z = min(a + LANES, n)
        words = np.frombuffer(data, "<u4", int(edges[z] - edges[a]), first + 4 * int(edges[a]))
        out.append(_decode(model, words, edges[a:z] - edges[a], min(BLOCK, total)).ravel())
    return np.concatenate(out)[:total]
