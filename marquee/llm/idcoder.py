"""Adaptive context-mixing range coder for token ids (numpy, many blocks in step).

A page of ids is cut into blocks of ``BLOCK`` ids.  Every block is coded on its
own: model and coder start from the same state in each, so any block can be
decoded alone with the page's header, and each carries a CRC-32 of its ids.  All
blocks of a page are advanced together, one id per step, so the work is numpy on
whole columns.

Three predictors are mixed for every id:

* order 2 and order 1: the id that last followed the two (one) ids before,
  with a confidence of 0 to 3 that counts how often in a row it was right;
* order 0: how often each id occurs in the page, in parts of ``WHOLE``; the
  page's header holds this table.

The pair of confidences, and whether both predict the same id, select a vector
of mixing weights (w2, w1, w0), which is re-estimated from the counts of the
block so far after every ``SPAN`` ids.  The range is cut by w2 and w1; what is
left of it is cut by the table of order 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
SPAN = 128
SLOTS = 512
STATES = 32
NONE = 0xFFFF
MAGIC = b"IDX2"
WHOLE_BITS = 17
WHOLE = 1 << WHOLE_BITS
#: Code words of 24 bits: a range stays above _LOW before an id is coded and never needs more than one word after it.
_LOW, _TOP = 1 << 24, (1 << 48) - 1
#: What a word laid down multiplies by, or not: faster than a shift by a varying number of bits.
_SHIFT = np.array([1, 1 << 24])
_ADD = 1 << 16  # one step of confidence in a cell, confidence << 16 | id
#: Mixing weights before any evidence, by confidence of order 2 and order 1, in pseudo counts.
_PRIOR = np.zeros((STATES, 3), np.int64)
for _s2 in range(4):
    for _s1 in range(4):
        for _same in range(2):
            _hit2, _hit1 = (0, 2, 5, 12)[_s2], (0, 1, 3, 6)[_s1]
            _PRIOR[_s2 * 8 + _s1 * 2 + _same] = (_hit2 + _hit1 * _same, _hit1 * (1 - _same), 8)


class _Weights:
    """Mixing weights of all lanes in parts of 65536: order 2, and 32 bits above it orders 2 and 1 together."""

    def __init__(self, lanes: int):
        # counts of the outcomes: order 2, order 1, order 0
        self.n = np.repeat((_PRIOR.T * 4).astype(np.int32)[:, None], lanes, 1)
        self.lane = np.arange(lanes, dtype=np.int32) * STATES
        self._set()

    def _set(self):
        # order 0 keeps at least 4500 parts of 65536, so that its range never gets empty
        n2, n1, n0 = self.n
        scale = 61000.0 / (n2 + n1 + n0)
        a = (n2 * scale).astype(np.int64) + 1
        self.both = (a + (n1 * scale).astype(np.int64) + 1 << 32 | a).ravel()

    def parts(self, at):
        """Of order 2, and of orders 2 and 1."""
        both = self.both.take(at, mode="clip")
        return both & 0xFFFFFFFF, both >> 32

    def learn(self, state, outcome):
        """Counts of one span: both arguments are (steps, lanes)."""
        at = outcome.astype(np.int32) * (len(self.lane) * STATES) + state + self.lane
        self.n += np.bincount(at.ravel(), minlength=self.n.size).reshape(self.n.shape).astype(np.int32) * 8
        self._set()


def _encode_lanes(x: np.ndarray, lens: np.ndarray, cum: np.ndarray) -> list[bytes]:
    """Code words of each lane; x: symbols (lanes, steps); cum: order 0, running sums from 0 to WHOLE."""
    lanes, steps = x.shape
    xt = np.ascontiguousarray(x.T).astype(np.int32)
    weights = _Weights(lanes)
    base = np.arange(lanes, dtype=np.int32) * SLOTS
    cell1, cell2 = np.full(lanes * SLOTS, NONE, np.int32), np.full(lanes * SLOTS, NONE, np.int32)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _TOP, np.int64)
    room = steps + 3
    out = np.zeros(lanes * room, np.uint32)
    pos = np.arange(lanes, dtype=np.int64) * room
    first = pos.copy()
    lane_state = np.arange(lanes, dtype=np.int32) * STATES
    freq = np.diff(cum)
    before = np.zeros((2, lanes), np.int32)  # the two ids before a span
    v1, v2 = np.empty((SPAN, lanes), np.int32), np.empty((SPAN, lanes), np.int32)
    for s in range(0, steps, SPAN):
        e = min(s + SPAN, steps)
        # what the tables are asked for and told is known beforehand; only their answers come one after the other
        sym = xt[s:e]
        seen = np.concatenate([before, sym])
        at1, at2 = _slots(seen[1:-1], seen[:-2], base)
        before = seen[-2:]
        once, most = sym | _ADD, sym | 3 * _ADD
        for t in range(e - s):
            x_t, once_t, most_t = sym[t], once[t], most[t]
            for cell, at, v in ((cell1, at1[t], v1[t]), (cell2, at2[t], v2[t])):
                cell.take(at, out=v, mode="clip")
                cell[at] = np.where((v & NONE) == x_t, np.minimum(v + _ADD, most_t), once_t)
        w1, w2 = v1[: e - s], v2[: e - s]
        c1, c2 = w1 & NONE, w2 & NONE
        state = (w2 >> 16) * 8 + (w1 >> 16) * 2 + (c1 == c2)
        hit2, hit1 = c2 == sym, c1 == sym
        hit = hit1 | hit2
        at = lane_state + state
        a, ab = weights.parts(at)
        # an id's part begins at start parts of the mixture; where order 0 codes it, at inner parts of what is left behind that
        start = np.where(hit2, 0, np.where(hit1, a, ab))
        part = np.where(hit2, a, np.where(hit1, ab - a, freq.take(sym, mode="clip")))
        inner = np.where(hit, 0, cum.take(sym, mode="clip"))
        live = np.arange(s, e)[:, None] < lens
        whole = bool(live.all())
        for t in range(e - s):
            r = rng >> 16
            skip = r * start[t]
            unit = np.where(hit[t], r, rng - skip >> WHOLE_BITS)
            if whole:
                low += skip
                low += unit * inner[t]
                rng = unit * part[t]
            else:
                low = np.where(live[t], low + skip + unit * inner[t], low)
                rng = np.where(live[t], unit * part[t], rng)
            over = np.flatnonzero(low > _TOP)
            if len(over):
                low[over] &= _TOP
                at = pos[over] - 1
                while len(at):
                    out[at] += np.uint32(1)
                    at = at[out[at] == _LOW]
                    out[at] = 0
                    at -= 1
            # the next word is laid down in every lane, and counts where the range has become small
            out[pos] = low >> 24
            small = rng < _LOW
            pos += small
            factor = _SHIFT.take(small, mode="clip")
            low *= factor
            low &= _TOP
            rng *= factor
        outcome = np.where(hit2, 0, 2 - hit1)
        weights.learn(state, outcome if whole else np.where(live, outcome, 2))
    out[pos], out[pos + 1] = low >> 24, low & 0xFFFFFF
    raw = out.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [raw[a : b + 2, :3].tobytes() for a, b in zip(first.tolist(), pos.tolist())]


def _slots(one, two, base):
    """Places of the order-1 and order-2 cells, by the id before and the one before that."""
    return base + (one & (SLOTS - 1)), base + ((one * 40503 ^ two * 30011) >> 5 & (SLOTS - 1))


def _decode_lanes(coded: list[bytes], lens: np.ndarray, cum: np.ndarray) -> np.ndarray:
    lanes, steps = len(coded), int(lens.max(initial=0))
    weights = _Weights(lanes)
    base = np.arange(lanes) * SLOTS
    cell1, cell2 = np.full(lanes * SLOTS, NONE, np.int32), np.full(lanes * SLOTS, NONE, np.int32)
    sizes = np.array([len(c) // 3 for c in coded])
    raw = np.frombuffer(b"".join([*coded, bytes(6)]), np.uint8).reshape(-1, 3).astype(np.int64)
    words = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    pos = np.cumsum(sizes) - sizes
    code = words.take(pos, mode="clip") << 24 | words.take(pos + 1, mode="clip")
    pos += 2
    rng = np.full(lanes, _TOP, np.int64)
    freq = np.diff(cum)
    which = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
    res = np.zeros((steps, lanes), np.int32)
    lane_state = np.arange(lanes, dtype=np.int32) * STATES
    one, two = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for s in range(0, steps, SPAN):
        e = min(s + SPAN, steps)
        state, outcome = np.empty((e - s, lanes), np.int32), np.empty((e - s, lanes), np.int32)
        whole = int(lens.min()) >= e
        for t in range(e - s):
            at1, at2 = _slots(one, two, base)
            v1, v2 = cell1.take(at1, mode="clip"), cell2.take(at2, mode="clip")
            c1, c2 = v1 & NONE, v2 & NONE
            j = (v2 >> 16) * 8 + (v1 >> 16) * 2 + (c1 == c2)
            at = lane_state + j
            r = rng >> 16
            a, ab = weights.parts(at)
            ra, rab = r * a, r * ab
            h2, h1 = code < ra, code < rab
            unit = rng - rab >> WHOLE_BITS
            sym = which.take(((code - rab) / unit).astype(np.int64), mode="clip")
            inner, part = cum.take(sym, mode="clip"), freq.take(sym, mode="clip")
            code -= np.where(h1, np.where(h2, 0, ra), rab + unit * inner)
            rng = np.where(h1, np.where(h2, ra, rab - ra), unit * part)
            x = np.where(h1, np.where(h2, c2, c1), sym)
            if not whole:
                ok = s + t < lens
                x[~ok] = code[~ok] = 0
                rng[~ok] = _TOP
                outcome[t] = np.where(h2 & ok, 0, 2 - (h1 & ok))
            else:
                outcome[t] = np.where(h2, 0, 2 - h1)
            small = rng < _LOW
            factor = _SHIFT.take(small, mode="clip")
            code = code * factor | words.take(pos, mode="clip") & factor - 1
            rng *= factor
            pos += small
            res[s + t], state[t] = x, j
            once, most = x | _ADD, x | 3 * _ADD
            cell1[at1] = np.where(c1 == x, np.minimum(v1 + _ADD, most), once)
            cell2[at2] = np.where(c2 == x, np.minimum(v2 + _ADD, most), once)
            one, two = x, one
        weights.learn(state, outcome)
    return np.ascontiguousarray(res.T)


def _parts(count: np.ndarray) -> np.ndarray:
    """Counts to parts of WHOLE, 1 at least; the first takes what rounding leaves."""
    parts = 1 + count.astype(np.int64) * (WHOLE - len(count)) // int(count.sum())
    parts[0] += WHOLE - parts.sum()
    return parts


def encode_page(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """Ids below 65535 to (page header, blocks).  An empty page has no block."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFE):
        raise ValueError("ids must lie in 0..65534")
    n = len(ids)
    count = np.bincount(ids, minlength=1)
    order = np.lexsort((np.arange(len(count)), -count))[: int((count > 0).sum())]
    parts = _parts(count[order]) if n else np.zeros(0, np.int64)
    header = struct.pack("<4sIII", MAGIC, BLOCK, n, len(order)) + zlib.compress(order.astype("<u2").tobytes() + parts.astype("<u4").tobytes())
    if not n:
        return header, []
    rank = np.zeros(len(count), np.uint16)
    rank[order] = np.arange(len(order))
    lanes = -(-n // BLOCK)
    padded = np.zeros(lanes * BLOCK, np.uint16)
    padded[:n] = rank[ids]
    lens = np.minimum(n - np.arange(lanes) * BLOCK, BLOCK)
    coded = _encode_lanes(padded.reshape(lanes, BLOCK)[:, : int(lens.max())], lens, np.concatenate([[0], np.cumsum(parts)]))
    raw = ids.astype("<u4")
    return header, [struct.pack("<II", int(lens[i]), zlib.crc32(raw[i * BLOCK : i * BLOCK + lens[i]])) + c for i, c in enumerate(coded)]


def decode_blocks(header: bytes, blocks: list[bytes]) -> np.ndarray:
    """Ids of the given blocks of a page, in order; any subset of a page's blocks will do.

    Raises ValueError when a block's checksum does not fit.
    """
    magic, _, _, distinct = struct.unpack_from("<4sIII", header)
    if magic != MAGIC:
        raise ValueError("not a page of coded ids")
    if not blocks:
        return np.zeros(0, np.uint32)
    table = zlib.decompress(header[16:])
    order = np.frombuffer(table, "<u2", distinct)
    cum = np.concatenate([[0], np.cumsum(np.frombuffer(table, "<u4", distinct, 2 * distinct), dtype=np.int64)])
    heads = [struct.unpack_from("<II", b) for b in blocks]
    lens = np.array([h[0] for h in heads])
    ranks = _decode_lanes([b[8:] for b in blocks], lens, cum)
    parts = []
    for i, (m, crc) in enumerate(heads):
        got = order[np.minimum(ranks[i, :m], distinct - 1)].astype("<u4")
        if zlib.crc32(got) != crc:
            raise ValueError(f"block {i}: checksum does not fit")
        parts.append(got)
    return np.concatenate(parts)
