"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library, one distinct word at a time.

The file's normaliser works on single characters and white space, and its pre-tokens never cross
white space; so the ids of a text are the ids of its space-separated chunks, one after the other.
``tokenised`` joins the blocks of a corpus to the ids of its distinct chunks, each of which is tokenised
once; a text that comes alone is split here, with a bounded cache chunk -> ids.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common, blocks
from .blocks import gathered, groups

MAX_CACHED = 800_000  #: chunks and words a worker remembers, in two generations; about 150 MB

LONGEST_CACHED = 64  #: characters of a chunk that is worth remembering
SLICE = 1 << 20  #: characters split at a time, so that a huge text needs no huge list

# Characters whose lower case is one character, that NFC keeps, and that need no Unicode tables.
_LETTERS = "a-zà-öø-ÿœ"
_PLAIN = re.compile("[A-ZÀ-ÖØ-ÞŒ%s]+" % _LETTERS)
_SAFE = re.compile("[!-~À-ÖØ-ÞŒ%s]+" % _LETTERS)
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[0-9]|[^%s0-9]+" % (_LETTERS, _LETTERS))


def _byte_level() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in keep}
    for n, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + n)
    return table


class WordPieces:
    """encode(text): ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.max_cached, self.ids, self.old, self.words, self.sizes = max_cached // 2, {}, {}, {}, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.separable, self.fast = self._shape(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        stand_in = _byte_level()
        self.letters = {ord(c): "".join(stand_in[b] for b in c.encode()) for c in map(chr, range(128, 0x180))}

    @staticmethod
    def _shape(spec: dict) -> tuple[bool, bool]:
        """Whether spaces separate chunks, and whether plain words may go straight to the merges."""
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        drops = bool(pre) and pre[0]["type"] == "Split" and pre[0].get("invert") and pre[0]["behavior"] == "Removed" and "\\s" in json.dumps(pre[0]["pattern"])
        special = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and " " not in x["content"] and "\n" not in x["content"] for x in spec["added_tokens"])
        separable = steps == ["NFC", "Replace", "Lowercase"] and drops and special and not spec.get("post_processor")
        return separable, separable and "'s|'t" in json.dumps(pre[0]["pattern"]) and [x["type"] for x in pre] == ["Split", "ByteLevel"]

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token of plain characters in lower case."""
        if (ids := self.words.get(word)) is None:
            seen = word if word.isascii() else word.translate(self.letters)
            self.words[word] = ids = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if self.fast and len(chunk) <= LONGEST_CACHED:
            if _PLAIN.fullmatch(chunk):
                return self._word(chunk.lower())
            if _PLAIN.fullmatch(chunk, 0, len(chunk) - 1) and chunk[-1] in ".,":
                return self._word(chunk[:-1].lower()) + self._word(chunk[-1])
            if _SAFE.fullmatch(chunk) and "<|" not in chunk:
                return b"".join(map(self._word, _PRE.findall(chunk.lower())))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        known = self.ids
        found = list(map(known.get, chunks))
        if None in found:
            if len(known) + len(self.words) > self.max_cached:
                # What is still in use comes back from the old generation at its next occurrence.
                self.old, self.ids, self.words = known, {}, {}
                known = self.ids
            old = self.old
            for k, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[k]
                    if (ids := old.get(chunk)) is None:
                        ids = self._chunk(chunk)
                    if len(chunk) <= LONGEST_CACHED:
                        known[chunk] = ids
                    found[k] = ids
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        if not text:
            return b""
        if not self.separable:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(b"".join(self.of_chunks(part.replace("\n", " ").split(" "))) for part in slices(text))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, where each ends)."""
        own = [self.encode(t) for t in texts.to_pylist()]
        return np.frombuffer(b"".join(own), np.uint32), np.cumsum([len(x) // 4 for x in own])

    def of_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each distinct chunk has, the ids one after the other)."""
        own = list(map(self._chunk, chunks))
        self.words.clear()
        return np.fromiter(map(len, own), np.int32, len(own)) // 4, np.frombuffer(b"".join(own), np.int32)

    def size(self, chunk: str) -> int:
        """The number of ids of a chunk."""
        if self.fast and len(chunk) <= LONGEST_CACHED and _SAFE.fullmatch(chunk) and "<|" not in chunk:
            words = [chunk.lower()] if _PLAIN.fullmatch(chunk) else _PRE.findall(chunk.lower())
            return sum(len(self.model.tokenize(w if w.isascii() else w.translate(self.letters))) for w in words)
        return len(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        """The number of ids of one text, from the frequencies of its chunks."""
        if not text:
            return 0
        if not self.separable:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(n * self.size(chunk) for part in slices(text) for chunk, n in Counter(part.replace("\n", " ").split(" ")).items())


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bounds of each text's chunks, the number of each chunk, the distinct chunks by number)."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    encoded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy()
    return bounds - bounds[0], encoded.indices.to_numpy(), encoded.dictionary


def slices(text: str, most: int = SLICE):
    """The text cut at spaces into parts of about ``most`` characters; the spaces at the cuts go."""
    at = 0
    while len(text) - at > most and (cut := text.find(" ", at + most)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


_loaded: dict[str, WordPieces] = {}


def load(path: str) -> WordPieces:
    """The worker's tokenizer of that file; its cache lives as long as the worker."""
    if path not in _loaded:
        gc.set_threshold(200_000, 50, 1000)  # the caches hold no cycles; scanning them again and again is waste
        _loaded[path] = WordPieces(path)
    return _loaded[path]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, finish: Callable, schema: str, histogram: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(what finish(doc_ids, heads, ids, ends) makes of each block of ``docs`` (doc_id long, text, perhaps
    head), a table id, n of all ids if asked for); each document's ids are followed by end_id, ends says where.

    Each distinct chunk of the corpus is tokenised once. A tokenizer whose pre-tokens may cross white
    space takes each text by itself. With a histogram the rows are a written table, and what led to
    them is deleted.
    """
    spark = docs.sparkSession
    if load(tokenizer).separable:
        def whole(doc_ids: pa.Array, heads: list | None, arrays: list[np.ndarray], sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
            bounds, numbers = arrays
            numbers = np.insert(numbers, bounds[1:], len(sizes))
            ids, ends = gathered(np.append(flat, np.int32(end_id)), np.append(sizes, np.int32(1)), numbers)
            return finish(doc_ids, heads, ids, ends[bounds[1:] + np.arange(len(bounds) - 1)])

        table = blocks.staged(docs, numbered)
        answers = blocks.answered(table, lambda chunks: load(tokenizer).of_words(chunks), histogram)
        if not histogram:
            return blocks.joined(table, answers, whole, schema), None
        answers = _common.written(answers, "answers")
        _common.delete(table, "asks=true")  # answered
        _common.release(spark)
        counts = _common.written(_histogram(answers, end_id, docs), "histogram")
        rows = _common.written(blocks.joined(table, answers, whole, schema), "rows")
        _common.delete(table)
        _common.delete(answers)
        _common.release(spark)
        return rows, counts

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in groups(b.column("text"), blocks.BLOCK_BYTES):
                ids, ends = load(tokenizer).encode_batch(texts)
                own = b.slice(first, len(texts))
                yield finish(own.column("doc_id"), own.column("head").to_pylist() if "head" in b.schema.names else None, np.insert(ids, ends, end_id).astype(np.int64), ends + np.arange(1, len(ends) + 1))

    made = docs.mapInArrow(alone, schema)
    if not histogram:
        return made, None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in groups(b.column("text"), blocks.BLOCK_BYTES):
                symbols, n = np.unique(load(tokenizer).encode_batch(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(symbols.astype(np.int64)), pa.array(n)], ["id", "n"])

    return made, _summed(docs.mapInArrow(counted, "id long, n long"), end_id, docs)


def _summed(counts: DataFrame, end_id: int, docs: DataFrame) -> DataFrame:
    ends = docs.agg(F.lit(end_id).cast("long").alias("id"), F.count("*").alias("n")).where("n > 0")
    return counts.unionByName(ends).groupBy("id").agg(F.sum("n").alias("n"))


def _histogram(answers: DataFrame, end_id: int, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for symbols, n in zip(b.column("sizes").to_pylist(), b.column("flat").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(symbols, "<u4").astype(np.int64)), pa.array(np.frombuffer(n, "<u8").astype(np.int64))], ["id", "n"])

    counts = answers.where(F.col("block") == blocks.HISTOGRAM).select("sizes", "flat").mapInArrow(run, "id long, n long")
    return _summed(counts, end_id, docs)
