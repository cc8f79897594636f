"""SimHash near duplicates, found by anchors of a covering code.

Two fingerprints of at most 3 differing bits differ in at most one bit in one of their two 32-bit
halves. Each half is covered by the words of a perfect Hamming code on 31 bits times one plain bit:
covering radius 1. A half is copied to every anchor within radius plus threshold, 1 + 1; then any
linked pair meets at the anchor nearest to either. Distinct fingerprints are compared per anchor;
what links there is reduced to stars before it leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common
from .components import connected

SHINGLE, SEED, NEAR = 3, 42, 3
_GATHER = 400_000  #: rows of anchors that are compared at a time
_DIRECT = 24  #: groups up to this size are compared by shifting the whole gathered block
_SPLIT = 8192  #: groups beyond this size are split again
_SAMPLED = 64  #: one of so many fingerprints tells which anchors are hot
_HOT = 100_000  #: hot anchors that are split before the shuffle; others are split in their task


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of the whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, white space 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(SHINGLE, len(words))
    begin, end = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    total, n = np.zeros(64, np.int64), len(begin)
    for at in range(0, n, 8192):
        h = np.array([xxh64_intdigest(joined[a:z], SEED) for a, z in zip(begin[at : at + 8192], end[at : at + 8192])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


#: Bit j of the syndrome is the parity of the positions 1 .. 31 whose number has bit j.
_CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
#: The pairs of positions whose flip has syndrome s, and the single position s.
_FLIPS = np.array([[0] * 16] + [[1 << (s - 1), *[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]] for s in range(1, 32)], np.uint64)


def _syndrome(word: np.ndarray) -> np.ndarray:
    s = np.zeros(len(word), np.int64)
    for j, mask in enumerate(_CHECKS):
        s |= (np.bitwise_count(word & np.uint64(mask)).astype(np.int64) & 1) << j
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of anchors, index of the fingerprint copied there): up to 17 anchors a half."""
    keys, owners = [], []
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        low, plain = word & np.uint64(0x7FFFFFFF), word & np.uint64(0x80000000)
        s = _syndrome(low)
        near = low[:, None] ^ _FLIPS[s]  # the nearest first; for a code word only itself
        tag = np.uint64(half << 32)
        home = near[:, 0]
        own = np.arange(len(fps))
        keys += [(home | plain) | tag, (home | (plain ^ np.uint64(0x80000000))) | tag]
        owners += [own, own]
        off = np.flatnonzero(s)
        keys.append(((near[off, 1:] | plain[off, None]) | tag).ravel())
        owners.append(np.repeat(off, 15))
    return np.concatenate(keys), np.concatenate(owners)


def split_anchors(keys: np.ndarray, fps: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies at hot (sorted) anchors go to four keys each: the anchor and one byte of the other half.

    Of four bytes at least one agrees in any linked pair. Keys that fall together do no harm, as all
    that meets is compared.
    """
    if not len(hot):
        return keys, fps
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    split = hot[at] == keys
    own, mine = keys[split], fps[split]
    other = np.where((own >> np.uint64(32)) & np.uint64(1), mine, mine >> np.uint64(32)) & np.uint64(0xFFFFFFFF)
    parts = [(own * np.uint64(4) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) ^ ((other >> np.uint64(8 * k)) & np.uint64(0xFF)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1 << 63) for k in range(4)]
    return np.concatenate([keys[~split], *parts]), np.concatenate([fps[~split], *[mine] * 4])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges as (node, smallest node of its component), without the roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new != (far := new[new])).any():
            new = far
        if (new == root).all():
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= NEAR


def _links_within(fps: np.ndarray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the linked pairs among distinct fingerprints, in blocks; large groups are split first
    by 16-bit parts: of four, at least one agrees in any linked pair."""
    found: list = []
    if split and len(fps) > _SPLIT:
        for k in range(4):
            part = (fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    found.append(_links_within(fps[group], split=False))
    else:
        for i in range(0, len(fps), 512):
            rows = fps[i : i + 512]
            r, c = np.nonzero(_close(rows[:, None], fps[None, i:]))
            keep = c > r
            if keep.any():
                found.append(stars(rows[r[keep]], fps[i:][c[keep]]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = (np.concatenate(x) for x in zip(*found))
    return stars(u, v)


def _compare(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the linked pairs within equal keys (sorted)."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(bounds)
    big = sizes > _DIRECT
    small = np.repeat(~big, sizes)
    k, f = keys[small], fps[small]
    found = []
    for shift in range(1, _DIRECT):
        same = k[shift:] == k[:-shift] if len(k) > shift else np.zeros(0, bool)
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[_close(f[i], f[i + shift]) & (f[i] != f[i + shift])]
        found.append((f[i], f[i + shift]))
    for g in np.flatnonzero(big):
        found.append(_links_within(np.unique(fps[bounds[g] : bounds[g + 1]])))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = (np.concatenate(x) for x in zip(*found))
    return stars(u, v) if len(u) else (u, v)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) of ``distinct`` (fp long) whose components are those of all linked pairs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                keys, own = anchors(part)
                keys, own = split_anchors(keys, part[own], hot)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own.view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, n = [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, fps, n
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = len(k) if last else int(np.searchsorted(k, k[-1], "left"))  # the last anchor may go on
            if cut:
                u, v = _compare(k[:cut], f[:cut])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
            keys, fps = [k[cut:]], [f[cut:]]
            n = 0

        for b in batches:
            keys.append(b.column("anchor").to_numpy(zero_copy_only=False))
            fps.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            n += b.num_rows
            if n >= _GATHER and keys[0][0] != keys[-1][-1]:
                yield from flush(False)
        if keys:
            yield from flush(True)

    # Which anchors are hot, by a sample: this divides the work and decides nothing.
    hot = np.zeros(0, np.uint64)
    sample = distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLED)) == 0).mapInArrow(spread, "anchor long, fp long")
    crowded = sample.groupBy("anchor").count().where(F.col("count") > _SPLIT / _SAMPLED).orderBy(F.desc("count")).limit(_HOT).select("anchor").collect()
    hot = np.sort(np.array([r["anchor"] for r in crowded], np.int64).view(np.uint64))
    # Fingerprints are few bytes beside texts: spread them before each makes up to 34 rows.
    copies = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links of at most NEAR differing bits reach. Null,
    empty and wordless texts have fingerprint zero; rows of a null doc_id take part but never name
    a component (null if it has no other row); repeated rows stay; an empty table gives an empty
    one; further columns are ignored.
    """
    _common.ship(docs.sparkSession)
    marked = _common.written(fingerprints(docs), "fingerprints")
    classes = _common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected(links(classes))
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of = labelled.join(firsts, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_common.documents(spark, sf_dir))


QUERIES = {"op3_simhash": op3_simhash}
