"""A static range asymmetric numeral system over arrays of token ids, in numpy.

Ids map to symbols of one shared table (ids that are too rare for it, if any, to an escape whose
ids follow the block as plain numbers). Ids are cut into blocks; each block has LANES interleaved
states with 32 bits that emit 16-bit words. Blocks are independent: all blocks of a call go through
the same vector steps. A block's bytes hold a header with counts, checksums of ids and words, its
final states, checkpoints (states and word position every CHECKPOINT steps, from which a decoder can
start amid the block), words and escapes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS, LANES, BLOCK, CHECKPOINT = 16, 64, 32768, 256
_LOW = np.uint32(1 << 16)
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, words, escapes, checkpoints, crc32 of ids, crc32 of the rest
_MAGIC = b"RNS1"


@dataclass
class Table:
    """symbols: ids in ascending order, the escape (if any) last as -1; frequencies: sum is 2 ** BITS."""

    symbols: np.ndarray
    frequencies: np.ndarray

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint32)
        self.escape = len(self.symbols) - 1 if len(self.symbols) and self.symbols[-1] < 0 else -1
        known = self.symbols[: len(self.symbols) - (self.escape >= 0)]
        self.of_id = np.full(int(known[-1]) + 2 if len(known) else 1, self.escape, np.int64)
        self.of_id[known] = np.arange(len(known))
        self.of_slot = np.repeat(np.arange(len(self.symbols)), self.frequencies)
        self.slot_frequency = self.frequencies.astype(np.uint32)[self.of_slot]
        self.slot_bias = (np.arange(1 << BITS, dtype=np.uint32) - self.starts[self.of_slot]).astype(np.uint32)
        self.slot_id = self.symbols[self.of_slot]

    @classmethod
    def from_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        """Frequencies for counts; every id keeps at least 1 of 2 ** BITS, beyond half of it the rarest escape."""
        order = np.lexsort((ids, -counts))
        most = 1 << (BITS - 1)
        kept, rest = order[:most], order[most:]
        kept = kept[np.argsort(ids[kept])]
        symbols, weights = ids[kept].astype(np.int64), counts[kept].astype(float)
        if len(rest) or not len(kept):
            symbols, weights = np.append(symbols, -1), np.append(weights, max(1, counts[rest].sum()))
        spare = (1 << BITS) - len(symbols)
        share = weights / weights.sum() * spare
        f = np.floor(share).astype(np.int64)
        f[np.argsort(-(share - f), kind="stable")[: spare - f.sum()]] += 1
        return cls(symbols, f + 1)


def encode(ids: np.ndarray, table: Table, block: int = BLOCK) -> list[bytes]:
    """The ids as blocks. An id that is missing from a table without escape is an error."""
    out = []
    whole = len(ids) // block * block
    if whole:
        out += _encode(ids[:whole].reshape(-1, block), table)
    if len(ids) > whole:
        out += _encode(ids[whole:].reshape(1, -1), table)
    return out


def _encode(rows: np.ndarray, table: Table) -> list[bytes]:
    n_blocks, n = rows.shape
    steps = -(-n // LANES)
    known = rows < len(table.of_id)
    symbols = np.where(known, table.of_id[np.where(known, rows, 0)], table.escape)
    if (symbols < 0).any():
        raise ValueError("an id is not in the table")
    grid = np.zeros((n_blocks, steps * LANES), np.int64)
    grid[:, :n] = symbols
    grid = np.ascontiguousarray(grid.reshape(n_blocks, steps, LANES).transpose(1, 0, 2))
    f, start = table.frequencies.astype(np.uint32), table.starts
    x = np.full((n_blocks, LANES), _LOW, np.uint32)
    words = np.zeros((steps, n_blocks, LANES), np.uint16)
    emits = np.zeros((steps, n_blocks, LANES), bool)
    kept_at = list(range(CHECKPOINT, steps, CHECKPOINT))
    kept = {}
    last = n - (steps - 1) * LANES
    for t in range(steps - 1, -1, -1):
        fs = f[grid[t]]
        over = (x >> np.uint32(16)) >= fs  # the state would leave 32 bits
        live = slice(0, last) if t == steps - 1 else slice(None)
        if t == steps - 1:
            over[:, last:] = False
        words[t] = x  # the low 16 bits
        emits[t] = over
        y = np.where(over, x >> np.uint32(16), x)
        q = (y / fs).astype(np.uint32)
        y = (q << np.uint32(16)) + (y - q * fs) + start[grid[t]]
        x[:, live] = y[:, live]
        if t in kept_at:
            kept[t] = x.copy()
    taken = np.concatenate([np.zeros((1, n_blocks), np.int64), np.cumsum(emits.sum(axis=2), axis=0)])
    out = []
    for b in range(n_blocks):
        w = words[:, b, :][emits[:, b, :]].astype("<u2").tobytes()
        escaped = rows[b][symbols[b] == table.escape].astype("<u4").tobytes() if table.escape >= 0 else b""
        marks = b"".join(np.uint32(t).tobytes() + np.uint32(taken[t, b]).tobytes() + kept[t][b].astype("<u4").tobytes() for t in kept_at)
        body = x[b].astype("<u4").tobytes() + marks + w + escaped
        out.append(_HEAD.pack(_MAGIC, n, len(w) // 2, len(escaped) // 4, len(kept_at), zlib.crc32(rows[b].astype("<u4").tobytes()), zlib.crc32(body)) + body)
    return out


def _parts(data: bytes) -> tuple:
    magic, n, n_words, n_escapes, n_marks, ids_crc, body_crc = _HEAD.unpack_from(data)
    if magic != _MAGIC or zlib.crc32(data[_HEAD.size :]) != body_crc:
        raise ValueError("a block is damaged")
    at = _HEAD.size
    states = np.frombuffer(data, "<u4", LANES, at)
    at += 4 * LANES
    marks = np.frombuffer(data, "<u4", n_marks * (LANES + 2), at).reshape(n_marks, LANES + 2)
    at += 4 * n_marks * (LANES + 2)
    words = np.frombuffer(data, "<u2", n_words, at)
    return n, states, marks, words, np.frombuffer(data, "<u4", n_escapes, at + 2 * n_words), ids_crc


def decode(blocks: list[bytes], table: Table) -> np.ndarray:
    """The ids of blocks, in order; blocks of equal length are decoded in the same vector steps."""
    parts = [_parts(b) for b in blocks]
    out: list = [None] * len(parts)
    for n in {p[0] for p in parts}:
        at = [i for i, p in enumerate(parts) if p[0] == n]
        symbols = _decode(n, np.stack([parts[i][1] for i in at]), [parts[i][3] for i in at], np.zeros(len(at), np.int64), table, final=True)
        for i, s in zip(at, symbols):
            out[i] = _finish(s, parts[i][4], parts[i][5], table)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def decode_from(data: bytes, table: Table, step: int) -> np.ndarray:
    """The ids of a block from the last checkpoint at or before ``step`` on (escapes stay as -1)."""
    n, states, marks, words, _, _ = _parts(data)
    mark = next((m for m in marks[::-1] if m[0] <= step), None)
    t, taken, x = (0, 0, states) if mark is None else (int(mark[0]), int(mark[1]), mark[2:])
    return table.slot_id[_decode(n - t * LANES, x[None, :], [words], np.array([taken]), table, final=True)[0]]


def _decode(n: int, x: np.ndarray, words: list[np.ndarray], taken: np.ndarray, table: Table, final: bool) -> np.ndarray:
    """The slots of n ids of each block."""
    steps = -(-n // LANES)
    x = x.astype(np.uint32)
    base = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    stream = np.concatenate([*words, [0]]).astype(np.uint32)
    at = base + taken
    out = np.zeros((steps, len(words), LANES), np.uint16)
    last = n - (steps - 1) * LANES
    for t in range(steps):
        slot = x & np.uint32(0xFFFF)
        out[t] = slot
        y = table.slot_frequency[slot] * (x >> np.uint32(16)) + table.slot_bias[slot]
        low = y < _LOW
        if t == steps - 1:
            low[:, last:] = False
        order = np.cumsum(low, axis=1)
        source = np.where(low, at[:, None] + order - 1, len(stream) - 1)
        x = np.where(low, (y << np.uint32(16)) | stream[source], y)
        at = at + order[:, -1]
    if final and (x[:, :last] != _LOW).any():
        raise ValueError("a block doesn't end where it began")
    return out.transpose(1, 0, 2).reshape(len(words), -1)[:, :n]


def _finish(slots: np.ndarray, escaped: np.ndarray, crc: int, table: Table) -> np.ndarray:
    ids = table.slot_id[slots]
    if table.escape >= 0:
        ids[ids < 0] = escaped
    ids = ids.astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the ids of a block don't match their checksum")
    return ids
