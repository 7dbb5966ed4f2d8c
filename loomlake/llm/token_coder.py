"""An adaptive context-mixing range coder for token ids, by range variants of asymmetric numeral systems.

Each block is coded by itself from a fresh state, so that it can be read alone. For each id the
order-2 and order-1 contexts name the id that last followed them, with a confidence. What either
confidence and both together say of the outcomes (order 2 right, else order 1 right, neither) is mixed
by weights that move to what foretold better. If neither is right, the id is coded by an order-0 law of
whole ids; what that does not hold goes by its 16 bits. Laws and weights are learnt anew after each
window of steps, from all that was coded before.

The lanes of a block are stretches of it, coded side by side as numpy arrays: one step codes an id of
each. The first windows have few lanes, so that a model stands before there are many. Everything that
a law depends on is integer or single IEEE operations and exact sums, the same on each machine.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Ids of a block, and the least number that is no id.
BLOCK, ID_LIMIT = 1 << 20, 1 << 16
MAGIC = b"LTB3"
_HEADER = struct.Struct("<4sIIII")  # magic, ids, crc32 of the ids, bytes of the states and of the words
#: States are from 2**16 to below 2**32 and move by 16-bit words; laws are shares of 2**16.
_BITS = 16
_TOTAL = 1 << _BITS
_MASK = _TOTAL - 1
#: Lanes of the first windows and the most of any; steps of a window.
_FIRST, _LANES, _STEPS = (1, 8, 64, 512), 4096, 64
_SLOTS = 1 << 18
#: Confidences: 0 before a context was seen, then one more than its hits in a row.
_CONF = 8
_KINDS = 4  # outcomes, and room for a fourth: rows of four
_NEXT = np.array([[1, min(c + 1, _CONF - 1)] for c in range(_CONF)], np.int64).ravel() << 16


def _windows(n: int):
    """(first id, lanes, ids of a lane, steps from, steps to): the same for writer and reader."""
    at = 0
    for lanes in _FIRST:
        if at < n:
            lanes = min(lanes, -(-(n - at) // _STEPS))
            size = min(lanes * _STEPS, n - at)
            yield at, lanes, -(-size // lanes), 0, -(-size // lanes), size
            at += size
    if at < n:
        size = n - at
        lanes = min(_LANES, -(-size // _STEPS))
        each = -(-size // lanes)
        for t in range(0, each, _STEPS):
            yield at, lanes, each, t, min(t + _STEPS, each), size


class _Model:
    """What has been learnt of a block. Writer and reader do the same with it."""

    def __init__(self):
        self.last = np.zeros(ID_LIMIT, np.int64), np.zeros(_SLOTS, np.int64)
        self.kinds = np.zeros((2, _CONF, _CONF, 3), np.int64)  # agree, order 2's, order 1's confidence
        self.weights = [1 / 3, 1 / 3, 1 / 3]
        self.counts = np.zeros(ID_LIMIT, np.int64)
        self.escapes = 0
        self.learn(None, None, 0)

    def learn(self, kinds: np.ndarray | None, ids: np.ndarray | None, escapes: int) -> None:
        """Takes outcomes (context * 4 + kind) and ids of order 0 in, and makes the laws anew."""
        if kinds is not None:
            new = np.bincount(kinds, minlength=2 * _CONF * _CONF * _KINDS).reshape(2, _CONF, _CONF, _KINDS)[..., :3]
            self._weigh(new)
            self.kinds += new
            self.counts += np.bincount(ids, minlength=ID_LIMIT)
            self.escapes += escapes
        laws = self._laws()
        mix = sum(w * p for w, p in zip(self.weights, laws, strict=True))
        size = np.maximum((mix * (_TOTAL - 8)).astype(np.int64), 1)
        size[..., 2] = _TOTAL - size[..., 0] - size[..., 1]
        sizes = np.concatenate((size, np.zeros_like(size[..., :1])), axis=-1)
        starts = np.cumsum(sizes, axis=-1) - sizes
        self.kind_start, self.kind_size = starts.ravel(), sizes.ravel()
        self.end_0, self.end_1 = starts[..., 1].ravel().copy(), starts[..., 2].ravel().copy()
        # Order 0: whole ids of a 2**16th at least; the rest, and what is new, is the escape's.
        total = int(self.counts.sum())
        room = _TOTAL - max(1, min(_TOTAL // 2, (self.escapes + 1) * _TOTAL // (total + 2)))
        freq = self.counts * room // max(total, 1)
        self.held = np.flatnonzero(freq)
        freq = freq[self.held]
        freq = np.append(freq, _TOTAL - freq.sum())
        self.freq, self.start = freq, np.cumsum(freq) - freq
        self.held = np.append(self.held, ID_LIMIT)
        self.place = np.full(ID_LIMIT, len(freq) - 1, np.int64)
        self.place[self.held[:-1]] = np.arange(len(freq) - 1)
        self.slot = np.repeat(np.arange(len(freq)), freq)

    def _laws(self) -> list[np.ndarray]:
        """Of each confidence alone and of both: shares of the outcomes."""
        n = self.kinds
        seen = (n.sum(axis=2, keepdims=True), n.sum(axis=1, keepdims=True), n)
        can = np.ones((2, 1, 1, 3)) * 0.4
        can[1, :, :, 1] = 0  # where both name one id, order 1 is not right alone
        out = []
        for k in seen:
            k = k + can
            out.append(np.broadcast_to(k / (k[..., 0:1] + k[..., 1:2] + k[..., 2:3]), n.shape))
        return out

    def _weigh(self, new: np.ndarray) -> None:
        laws = self._laws()
        at = np.nonzero(new)
        total = int(new.sum())
        if not total:
            return
        parts = [w * p[at] for w, p in zip(self.weights, laws, strict=True)]
        mix = parts[0] + parts[1] + parts[2]
        ok = mix > 0
        share = [math.fsum((new[at][ok] * (p[ok] / mix[ok])).tolist()) / total for p in parts]
        self.weights = [(w + s + 0.01) / 2.03 for w, s in zip(self.weights, share, strict=True)]

    def look(self, one: np.ndarray, before: np.ndarray):
        slot = (one * 40503 + before * 60493) >> 3 & (_SLOTS - 1)
        first, second = self.last[0].take(one), self.last[1].take(slot)
        context = (second >> _BITS) * _CONF + (first >> _BITS)
        context += (((first ^ second) & _MASK) == 0) * (_CONF * _CONF)
        return slot, first, second, context

    def see(self, one, slot, first, second, x, right_1, right_2) -> None:
        self.last[0][one] = x | _NEXT.take((first >> _BITS) * 2 + right_1)
        self.last[1][slot] = x | _NEXT.take((second >> _BITS) * 2 + right_2)


def _lanes_at(lanes: int, each: int, size: int, t: int) -> int:
    """Lanes that have a t-th id: all but those behind the end."""
    return min(lanes, max(0, -(-(size - t) // each)))


def _encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    model = _Model()
    plan = []  # what each step puts, in order: (lanes, starts, sizes)
    most = 0
    wide, one, before = None, None, None
    for at, lanes, each, a, b, size in _windows(len(ids)):
        most = max(most, lanes)
        if a == 0:
            grid = np.zeros(lanes * each, np.int64)
            grid[:size] = ids[at : at + size]
            wide = np.ascontiguousarray(grid.reshape(lanes, each).T)
            one, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        kinds, missed, escapes = [], [], 0
        for t in range(a, b):
            n = _lanes_at(lanes, each, size, t)
            x, one, before = wide[t, :n], one[:n], before[:n]
            slot, first, second, context = model.look(one, before)
            right_1, right_2 = (first & _MASK) == x, (second & _MASK) == x
            kind = context * _KINDS
            neither = ~(right_1 | right_2)
            kind += neither * 2 + (right_1 > right_2)
            kinds.append(kind)
            miss = np.flatnonzero(neither)
            plan.append((slice(0, n), model.kind_start.take(kind), model.kind_size.take(kind)))
            if len(miss):
                own = x.take(miss)
                place = model.place.take(own)
                missed.append(own)
                plan.append((miss, model.start.take(place), model.freq.take(place)))
                escaped = np.flatnonzero(place == len(model.freq) - 1)
                if len(escaped):
                    escapes += len(escaped)
                    plan.append((miss[escaped], own[escaped], None))
            model.see(one, slot, first, second, x, right_1, right_2)
            one, before = x, one
        model.learn(np.concatenate(kinds), np.concatenate(missed or [np.zeros(0, np.int64)]), escapes)
    states = np.full(most, _TOTAL, np.int64)
    words: list[np.ndarray] = []
    for lane, start, freq in reversed(plan):
        x = states[lane]
        if freq is None:
            freq = np.ones(len(start), np.int64)
        go = np.flatnonzero((x >> _BITS) >= freq)
        if len(go):
            out = x.take(go)
            words.append((out & _MASK).astype("<u2"))
            x[go] = out >> _BITS
        whole = (x / freq).astype(np.int64)  # exact: below 2**32
        states[lane] = (whole << _BITS) + (x - whole * freq) + start
    return states.astype("<u4").tobytes(), np.concatenate(words[::-1] or [np.zeros(0, "<u2")]).tobytes()


def _decode(n_ids: int, states: bytes, coded: bytes) -> np.ndarray:
    """Damage gives wrong ids, or ValueError where words run out."""
    model = _Model()
    state = np.frombuffer(states, "<u4").astype(np.int64)
    words = np.frombuffer(coded, "<u2").astype(np.int64)
    pos = 0
    out = np.zeros(n_ids, "<u4")

    def take(x: np.ndarray) -> None:
        nonlocal pos
        low = np.flatnonzero(x < _TOTAL)
        if len(low):
            new = words[pos : pos + len(low)]
            if len(new) < len(low):
                raise ValueError("block is cut off")
            x[low] = x.take(low) << _BITS | new
            pos += len(low)

    wide, one, before = None, None, None
    for at, lanes, each, a, b, size in _windows(n_ids):
        if len(state) < lanes:
            raise ValueError("block is cut off")
        if a == 0:
            wide = np.zeros((each, lanes), np.int64)
            one, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        kinds, missed, escapes = [], [], 0
        for t in range(a, b):
            n = _lanes_at(lanes, each, size, t)
            one, before = one[:n], before[:n]
            slot, first, second, context = model.look(one, before)
            s = state[:n]
            value = s & _MASK
            end_1 = value >= model.end_1.take(context)
            kind = context * _KINDS
            kind += end_1
            kind += value >= model.end_0.take(context)
            kinds.append(kind)
            s >>= _BITS
            s *= model.kind_size.take(kind)
            s += value
            s -= model.kind_start.take(kind)
            take(s)
            x = np.where(kind & 3, first, second) & _MASK
            miss = np.flatnonzero(end_1)
            if len(miss):
                m = s.take(miss)
                value = m & _MASK
                place = model.slot.take(value)
                own = model.held.take(place)
                m = (m >> _BITS) * model.freq.take(place) + value - model.start.take(place)
                take(m)
                escaped = np.flatnonzero(own == ID_LIMIT)
                if len(escaped):
                    escapes += len(escaped)
                    own[escaped] = m[escaped] & _MASK
                    e = m[escaped] >> _BITS
                    take(e)
                    m[escaped] = e
                s[miss] = m
                x[miss] = own
                missed.append(own)
            model.see(one, slot, first, second, x, (first & _MASK) == x, (second & _MASK) == x)
            wide[t, :n] = x
            one, before = x, one
        model.learn(np.concatenate(kinds), np.concatenate(missed or [np.zeros(0, np.int64)]), escapes)
        if b == each:
            out[at : at + size] = wide.T.ravel()[:size]
    if pos != len(words) or (state != _TOTAL).any():
        raise ValueError("code of a block is wrong")
    return out


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes with header and checksum.

    Raises ValueError for an id that 16 bits do not hold, and for a block of more than ``BLOCK`` ids.
    """
    out = []
    for b in blocks:
        if len(b) > BLOCK:
            raise ValueError(f"a block holds {BLOCK} ids at most")
        if len(b) and not 0 <= int(b.min()) <= int(b.max()) < ID_LIMIT:
            raise ValueError(f"ids must be from 0 to {ID_LIMIT - 1}")
        states, words = _encode(np.asarray(b))
        states = zlib.compress(states)
        crc = zlib.crc32(np.asarray(b).astype("<u4").tobytes())
        out.append(_HEADER.pack(MAGIC, len(b), crc, len(states), len(words)) + states + words)
    return out


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where magic, size or checksum is wrong."""
    out = []
    for c in coded:
        if len(c) < _HEADER.size:
            raise ValueError("block is cut off")
        magic, n, crc, n_states, n_words = _HEADER.unpack_from(c)
        if magic != MAGIC or len(c) != _HEADER.size + n_states + n_words or n > BLOCK or n_words % 2:
            raise ValueError("not a block of token ids")
        at = _HEADER.size + n_states
        try:
            states = zlib.decompress(c[_HEADER.size : at])
        except zlib.error as e:
            raise ValueError("states of a block are damaged") from e
        if len(states) % 4:
            raise ValueError("not a block of token ids")
        ids = _decode(n, states, c[at:])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("checksum of a block is wrong")
        out.append(ids)
    return out
