"""Near duplicates, fingerprints and media against brute force."""

import hashlib
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridloom.llm import components, fingerprints, media, simhash

from .helpers import corpus, empty, texts


def brute_simhash(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_brute_force():
    for t in texts():
        if t is None or len(t) < 20_000:
            assert simhash.fingerprint(t) == brute_simhash(t)


def near_prints():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 60).astype(np.uint64)
    out = [base, np.zeros(1, np.uint64), np.full(1, 2**64 - 1, np.uint64)]
    for k in range(1, 6):
        x = base.copy()
        for _ in range(k):
            x = x ^ (np.uint64(1) << r.integers(0, 64, len(base)).astype(np.uint64))
        out.append(x)
    return np.unique(np.concatenate(out))


def test_anchors_lose_no_link():
    fps = near_prints()
    keys, own = simhash.anchors(fps)
    meet = {}
    for k, o in zip(keys.tolist(), own.tolist()):
        meet.setdefault(k, set()).add(o)
    together = {(a, b) for s in meet.values() for a in s for b in s}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.NEAR)
    assert all((a, b) in together for a, b in zip(i.tolist(), j.tolist()))


def test_split_anchors_lose_no_link():
    fps = near_prints()
    keys, own = simhash.anchors(fps)
    hot = np.unique(keys)[::2]
    split, mine = simhash.split_anchors(keys, fps[own], hot)
    assert len(split) > len(keys)
    meet = {}
    for k, f in zip(split.tolist(), mine.tolist()):
        meet.setdefault(k, set()).add(f)
    together = {(a, b) for s in meet.values() for a in s for b in s}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.NEAR)
    assert all((int(fps[a]), int(fps[b])) in together for a, b in zip(i, j))


def test_links_with_hot_anchors(spark, monkeypatch):
    """Every anchor that the sample shows is split before the shuffle; the components stay the same."""
    monkeypatch.setattr(simhash, "_SPLIT", 1)
    monkeypatch.setattr(simhash, "_SAMPLED", 2)
    fps = near_prints()
    wanted = brute_components(fps.view(np.int64).tolist(), lambda a, b: (a ^ b & (1 << 64) - 1).bit_count() <= 3 if (a < 0) == (b < 0) else ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")).collect()
    root = {x: x for x in fps.view(np.int64).tolist()}
    found = {x: x for x in root} | {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    same = lambda of: {frozenset(k for k in of if of[k] == v) for v in set(of.values())}
    assert same(found) == same(wanted)


@pytest.mark.parametrize("split", [10, 8192])
def test_links_within_large_groups(split, monkeypatch):
    monkeypatch.setattr(simhash, "_SPLIT", split)
    fps = near_prints()
    wanted = brute_components(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= simhash.NEAR)
    found = {int(x): int(x) for x in fps}
    found |= dict(zip(*(x.tolist() for x in simhash._links_within(fps))))
    assert found == wanted


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [*texts(), long, long + " end", long.upper(), long.replace("word7 ", "word8 ")]
    docs = corpus(spark, rows)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {int(r["fingerprint"], 16) for r in found}
    assert prints == {brute_simhash(t) for t in rows}
    root = brute_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r in found:
        if r["doc_id"] is not None:
            k = root[int(r["fingerprint"], 16)]
            least[k] = min(least.get(k, 1 << 60), r["doc_id"])
    assert all(r["component_id"] == least.get(root[int(r["fingerprint"], 16)]) for r in found)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 103), (103, 101), (7, 7), (100, 103)]
    out = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_span_hashes():
    text = "abcabcabdabcabc" * 3
    p = fingerprints.Prefixes(fingerprints.code_points(text))
    for i in range(0, len(text), 4):
        for j in range(0, len(text), 3):
            n = 0
            while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            assert fingerprints.common_extension(p, i, p, j) == n
    assert len({int(h) for h in p.windows(5)}) == len({text[i : i + 5] for i in range(len(text) - 4)})


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints(spark, partitions):
    docs = corpus(spark)
    rows = sorted(docs.collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -1), r["text"] is not None, r["text"] or ""))
    found = fingerprints.fingerprint_documents(docs, partitions).collect()
    wanted = []
    for k, r in enumerate(rows):
        t, nxt = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        wanted.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=key) == sorted(wanted, key=key)
    shared = lambda a, b: len(os.path.commonprefix([a, b]))
    prefixes = Counter()
    for k, r in enumerate(rows):
        t, nxt = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        prefixes[r["doc_id"], shared(t, t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]), shared(t, nxt)] += 1
    assert Counter((r["doc_id"], r["prefix_edited"], r["prefix_next"]) for r in found) == prefixes
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    long = next(r for r in found if r["n_chars"] > 100_000)
    assert 0.3 < long["near_edited"] < 0.8
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
    alone = fingerprints.fingerprint_documents(corpus(spark, ["some text"])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_likeness_of_small_sketches_is_exact():
    texts_ = ["the quick brown fox jumps ok", "the quick brown fox jumped up", "nothing alike in here", "", "ab"]
    windows = lambda t: {(w, t[i : i + w]) for w in (fingerprints.WINDOW, fingerprints.SHORT) for i in range(max(1, len(t) - w + 1))}
    whole = lambda t: {x for _, x in windows(t)}
    marks = [fingerprints.sketch(fingerprints.Prefixes(fingerprints.code_points(t))) for t in texts_]
    for a, m in zip(texts_, marks):
        for b, n in zip(texts_, marks):
            both = whole(a) | whole(b)
            assert len(both) <= fingerprints.KEPT
            assert fingerprints.likeness(m, n) == pytest.approx(len(whole(a) & whole(b)) / len(both))


def test_many_null_ids(spark):
    """Rows without doc_id follow one another, and only the first of them follows the lowest doc_id."""
    rows = [(None, f"text {k % 40}") for k in range(200)] + [(k, f"own {k}") for k in range(30)]
    found = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert len(found) == 230
    ordered = [f"own {k}" for k in range(29, -1, -1)] + sorted(t for i, t in rows if i is None)
    wanted = Counter()
    for a, b in zip(ordered, [*ordered[1:], ordered[0]]):
        wanted[hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()] += 1
    assert Counter(r["edited_sha256"] for r in found) == wanted


def test_cosine_hash_by_hand():
    samples = np.random.default_rng(4).integers(0, 256, (40, 192)).astype(np.uint8)
    cuts = [k * 40 // 32 for k in range(32)] + [40]
    small = [[np.mean([samples[y, 6 * x : 6 * x + 6].sum() for y in range(cuts[r], cuts[r + 1])]) for x in range(32)] for r in range(32)]
    waves = [sum(small[y][x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(1, 9) for v in range(1, 9)]
    bits = "".join("1" if w > np.median(waves) else "0" for w in waves)
    assert media.cosine_hash(samples) == f"{int(bits, 2):016x}"


def test_png_round_trip_and_damage():
    for t in texts():
        payload, n = media.pad(t)
        assert len(payload) % 192 == 0 and payload and n == len((t or "").encode())
        image = media.write_png(payload)
        assert media.read_png(image).tobytes() == payload
        for at in (9, 20, len(image) // 2, len(image) - 3):
            broken = bytearray(image)
            broken[at] ^= 255
            with pytest.raises((ValueError, zlib.error)):
                media.read_png(bytes(broken))
    assert media.cosine_hash(media.read_png(media.write_png(b" " * 192))) == media.cosine_hash(media.read_png(media.write_png(b" " * 192)))


def test_all_row_filters():
    r = np.random.default_rng(1)
    rows = r.integers(0, 256, (10, 12)).astype(np.int64)
    coded = np.zeros((10, 13), np.uint8)
    for y in range(10):
        kind = y % 5
        coded[y, 0] = kind
        for x in range(12):
            a = rows[y, x - 3] if x >= 3 else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded[y, x + 1] = (rows[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255
    assert (media.unfilter(coded, 3) == rows).all()


def test_media_columns(spark, tmp_path):
    docs = corpus(spark)
    media.store_media(docs, str(tmp_path / "m"))
    found = media.media_features(spark, str(tmp_path / "m")).collect()
    wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), hashlib.sha256(media.pad(r["text"])[0]).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["payload_sha256"]) for r in found) == wanted
    assert len({r["payload_sha256"] for r in found}) == len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in found})
    media.store_media(empty(spark), str(tmp_path / "e"))
    assert media.media_features(spark, str(tmp_path / "e")).count() == 0
    assert struct.calcsize(">I") == 4
