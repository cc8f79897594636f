"""Token ids, packing, counts and pieces against the libraries themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import packing, rans, sentencepieces, token_counts, token_ids, wordpieces
from gridloom.llm._common import crc32_combine

from .helpers import WORD, corpus, empty, texts


def library(text):
    from tokenizers import Tokenizer

    if not hasattr(library, "t"):
        library.t = Tokenizer.from_file(WORD)
    return library.t.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_words_match_the_library():
    t, r = wordpieces.WordPieces(WORD, max_cached=50), random.Random(1)
    parts = [*"abzABZ'sStT019%$.,!|<>éÉßẞœŒÿŸ÷×Ωσς\t\n  ́e 日İ", "<|", "<|endoftext|>", "'re", "'S"]
    for text in [*texts(), *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000))]:
        assert t.encode(text) == as_bytes(library(text))
        assert t.count(text) == len(library(text))


def test_slices_lose_nothing():
    text = " ".join(f"ab{k}" for k in range(500))
    assert " ".join(wordpieces.slices(text, 37)) == text
    assert list(wordpieces.slices("x" * 100, 7)) == ["x" * 100]


def test_counts(spark):
    docs = corpus(spark)
    found = Counter(tuple(r) for r in token_counts.count_tokens(docs, WORD, limit=30).collect())
    wanted = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library(r["text"])), len(library(r["text"])) > 30) for r in docs.collect())
    assert found == wanted
    assert token_counts.count_tokens(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 3), (1, 1), (63, 5), (64, 5), (65, 1), (40_000, 900)])
def test_codec_round_trip(n, kinds):
    ids = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint32)
    u, c = np.unique(ids, return_counts=True)
    table = rans.Table.from_counts(u, c)
    blocks = rans.encode(ids, table)
    assert (rans.decode(blocks, table) == ids).all()
    if blocks:
        part = rans.decode_from(blocks[0], table, 300)
        assert (part == ids[: rans.BLOCK][len(ids[: rans.BLOCK]) - len(part) :]).all()
        damaged = bytearray(blocks[0])
        damaged[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode([bytes(damaged)], table)


def test_codec_escapes_rare_ids():
    ids = np.random.default_rng(3).integers(0, 200_000, 60_000).astype(np.uint32)
    u, c = np.unique(ids, return_counts=True)
    table = rans.Table.from_counts(u, c)
    assert table.escape >= 0 and (rans.decode(rans.encode(ids, table), table) == ids).all()


def test_token_id_files(spark, tmp_path):
    docs = corpus(spark)
    path = str(tmp_path / "ids")
    token_ids.write_token_ids(docs, WORD, path, segment=1000)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start, wanted = 0, []
    for r in rows:
        ids = as_bytes([*library(r["text"]), 1])
        wanted.append((r["doc_id"], start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, token_ids.digests(spark, path).collect()), key=lambda x: x[1]) == wanted
    runs = sorted(token_ids.read_token_ids(spark, path).collect(), key=lambda r: (r["start"], r["at"]))
    assert b"".join(r["ids"] for r in runs) == b"".join(as_bytes([*library(r["text"]), 1]) for r in rows)
    none = str(tmp_path / "none")
    token_ids.write_token_ids(empty(spark), WORD, none)
    assert token_ids.digests(spark, none).count() == 0


def test_crc_of_parts():
    a, b = b"some bytes", b"and others" * 50
    assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert crc32_combine(5, 0, 0) == 5


def test_patterns_cover_demand():
    r = np.random.default_rng(0)
    for demand in (np.zeros(16, np.int64), r.integers(0, 50, 16), r.integers(0, 3, 64), np.eye(32, dtype=np.int64)[31] * 9):
        places = Counter()
        for pattern, times in packing.solve_patterns(demand):
            assert sum(c * k for c, k in pattern.items()) <= len(demand)
            for c, k in pattern.items():
                places[c] += k * times
        assert all(places[c + 1] >= n for c, n in enumerate(demand))


def test_packing(spark):
    docs = corpus(spark)
    packed = packing.pack_documents(docs, WORD, capacity=256, grid=8)
    rows = packed.collect()
    of = {}
    for r in docs.collect():
        of.setdefault(r["doc_id"], []).append([*library(r["text"]), 1])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in of.values() for x in v)
    for r in rows:
        assert any(zlib.crc32(as_bytes(x[r["start"] : r["start"] + r["length"]])) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in of[r["doc_id"]])
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 256 and set(by) == set(range(len(by)))
    assert packing.pack_documents(empty(spark), WORD).count() == 0
    single = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack_documents(single, WORD, capacity=256, grid=8)
    whole = packing.sequences(packed, single, WORD).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in packed.collect())


def test_pieces_match_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own, r = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.load(path), random.Random(2)
    parts = [*"aaabehnst  \n\t.▁1", "é", "日", "😀", "ing", "the", "tion"]
    for text in [*texts(), *("".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(3000))]:
        ids = own.encode(text)
        assert ids == as_bytes(model.encode(text or ""))
        assert own.decode(ids) == model.decode(model.encode(text or ""))
    docs = corpus(spark)
    encoded = sentencepieces.encode_documents(docs, path)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((r["doc_id"], tuple(model.encode(r["text"] or ""))) for r in docs.collect())
    assert Counter(tuple(r) for r in sentencepieces.decode_documents(encoded, path).collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert all(r["exact"] for r in sentencepieces.digest_documents(docs, path).collect())
    assert sentencepieces.digest_documents(empty(spark), path).count() == 0


def test_relational_lattice(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepieces.load(path)
    words = sorted({u for t in texts()[:26] if t and len(t) < 3000 for u in sentencepieces._UNIT.findall(sentencepieces.SPACE + t.replace(" ", sentencepieces.SPACE))} | {"日", "aaaaaaaaaaaaaaaa", "▁▁▁"})
    found = {r["word"]: r["ids"] for r in sentencepieces.relational_lattice(spark.createDataFrame([(w,) for w in [*words, "", words[0]]], "word string"), path).collect()}
    assert found == {w: [own.id.get(p, -1) for p in own.lattice(w)] for w in words}
