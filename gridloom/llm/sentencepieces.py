"""SentencePiece encoding and decoding by a lattice over distinct words.

The edges of a word are its bounded-length substrings that the piece table holds. The public file
is a BPE model, whose result is not the path of best total score (they differ on more than half of
the distinct words). ``relational_lattice`` explodes the substrings, joins them to the pieces, groups
the edges by word and folds them with Spark's higher-order functions, merge by merge: exact, but
several times beyond what whole tables may cost (README). The main path folds a word's edges in a
worker, from left to right: each position keeps the one piece that ends there, admitted by a pair
test, as two neighbours stand side by side in a BPE result exactly if no merge crosses their seam at
any time. Each worker encodes a distinct word once and joins blocks of documents to these.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common, blocks

SPACE = "▁"
MAX_WORDS = 800_000
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


class Pieces:
    """The piece table of a model file; identity normalisation, a leading space, byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.rank, self.id = {}, {}, {}
        self.byte_ids, self.bytes_of = [0] * 256, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = int(piece[1:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i], self.id[piece], self.rank[piece] = piece, i, -model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id):
            raise ValueError("pieces cross words")
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        #: Every ending of a piece: whether it is itself a piece that merges can make.
        self.table = {p[k:]: False for p in self.id for k in range(len(p))}
        self.table |= {p: self._split(p) is not None for p in self.id}

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; ("", "") for a character, None if no merges make it."""
        if piece not in self.halves:
            parts, last = list(piece), ("", "")
            while len(parts) > 1:
                ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
                if not ranked:
                    break
                i = min(ranked)[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def _time(self, piece: str) -> float:
        return self.rank[piece] if len(piece) > 1 else -1.0

    def fit(self, a: str, b: str) -> bool:
        """Whether no merge crosses the seam of a and b: their states there, back through time."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        x, y, limit, ok = a, b, float("inf"), True
        while True:
            if (joined := self.rank.get(x + y)) is not None and joined < limit:
                ok = False
                break
            tx, ty = self._time(x), self._time(y)
            if tx < 0 and ty < 0:
                break
            if tx > ty:
                limit, x = tx, self._split(x)[1]
            else:
                limit, y = ty + 0.5, self._split(y)[0]  # of equal merges the left one comes first
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def lattice(self, word: str) -> list[str]:
        """The pieces of a word; characters without a piece stand alone."""
        n, table, fits = len(word), self.table, self.fits
        ends: list[str] = [""] * (n + 1)
        for e in range(1, n + 1):
            s = e - 1
            while s >= 0 and (whole := table.get(piece := word[s:e])) is not None:
                if whole:
                    if s == 0:
                        ends[e] = piece
                        break
                    before = ends[s]
                    if (ok := fits.get((before, piece))) is None:
                        ok = before not in self.id or self.fit(before, piece)
                    if ok:
                        ends[e] = piece
                        break
                s -= 1
            if not ends[e]:
                ends[e] = word[e - 1]
        out, e = [], n
        while e:
            out.append(ends[e])
            e -= len(ends[e])
        return out[::-1]

    def _word(self, word: str) -> bytes:
        ids = array("I")
        for p in self.lattice(word):
            if p in self.id:
                ids.append(self.id[p])
            else:
                ids.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        units = _UNIT.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.words.get, units))
        if None in found:
            if len(self.words) > MAX_WORDS:
                self.words.clear()
            for k, ids in enumerate(found):
                if ids is None:
                    unit = units[k]
                    if (ids := self.words.get(unit)) is None:
                        ids = self._word(unit)
                        if len(unit) <= 64:
                            self.words[unit] = ids
                    found[k] = ids
        return b"".join(found)

    def of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each distinct unit has, the ids one after the other)."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        own = []
        for u in units:
            if (ids := self.words.get(u)) is None:
                ids = self._word("\n" if u == _NEWLINE else u)
                if len(u) <= 64:
                    self.words[u] = ids
            own.append(ids)
        return np.fromiter(map(len, own), np.int32, len(own)) // 4, np.frombuffer(b"".join(own), np.int32)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces, runs of bytes as UTF-8, without the leading space."""
        out = bytearray()
        for i in memoryview(ids).cast("I"):
            if (b := self.bytes_of.get(i)) is not None:
                out.append(b)
            else:
                out += self._utf8(i)
        text = out.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 of the texts whose ids lie between the bounds."""
        if not hasattr(self, "_table"):
            own = [bytes([self.bytes_of[i]]) if i in self.bytes_of else self._utf8(i) if i in self.text else b"" for i in range(max([*self.text, *self.bytes_of]) + 1)]
            self._table = np.frombuffer(b"".join(own), np.uint8), np.array(list(map(len, own)), np.int32)
        data, ends = blocks.gathered(*self._table, ids)
        data, cuts = data.tobytes(), np.concatenate([[0], ends])[bounds].tolist()
        texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:])]
        return [(t[1:] if t[:1] == " " else t).encode() for t in texts]

    def _utf8(self, i: int) -> bytes:
        if not hasattr(self, "_encoded"):
            self._encoded = {k: p.replace(SPACE, " ").encode() for k, p in self.text.items()}
        return self._encoded[i]


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def relational_lattice(words: DataFrame, model: str) -> DataFrame:
    """word, ids of each distinct word (column word, below 2 ** 15 characters); -1 for a character without a piece.

    The fold keeps the parts of a word and joins, as often as it has characters, the two neighbours
    whose joint substring is the edge of best rank, the left ones first.
    """
    pieces, spark = load(model), words.sparkSession
    table = spark.createDataFrame([(p, pieces.rank[p], i) for p, i in pieces.id.items()], "piece string, rank double, id int")  # the model file's size
    longest, n, m = max(map(len, pieces.id)), F.length("word"), F.col("edges")
    begins = words.where("word <> ''").select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = begins.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, n))).alias("e"))
    edges = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(F.broadcast(table), "piece")
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct((F.col("s") * 32768 + F.col("e")).alias("k"), F.struct("rank", "id").alias("v")))).alias("edges"))
    grouped = words.where("word <> ''").distinct().join(grouped, "word", "left").withColumn("edges", F.coalesce(m, F.create_map().cast("map<int,struct<rank:double,id:int>>")))
    edge = lambda a, z: F.try_element_at(m, a["s"] * 32768 + z["e"])

    def merge(parts: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(edge(F.get(parts, i), F.get(parts, i + 1))["rank"].alias("rank"), i.alias("i")))
        i = F.array_min(F.filter(ranked, lambda x: x["rank"].isNotNull()))["i"]
        joint = F.struct(F.get(parts, i)["s"].alias("s"), F.get(parts, i + 1)["e"].alias("e"))
        merged = F.concat(F.slice(parts, F.lit(1), i), F.array(joint), F.slice(parts, i + 3, F.greatest(F.lit(0), F.size(parts) - i - 2)))
        return F.when((F.size(parts) < 2) | i.isNull(), parts).otherwise(merged)

    characters = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    parts = F.aggregate(F.sequence(F.lit(1), n), characters, merge)
    return grouped.select("word", F.transform(parts, lambda x: F.coalesce(edge(x, x)["id"], F.lit(-1))).alias("ids"))


_NEWLINE = "n" + SPACE  #: stands for the unit of a newline, and can't be another one


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bounds of each text's units, the number of each unit, the distinct units by number)."""
    flat: list[str] = []
    bounds = [0]
    for text in texts.to_pylist():
        if text:
            units = _UNIT.findall(SPACE + text.replace(" ", SPACE))
            flat += [_NEWLINE if u == "\n" else u for u in units] if "\n" in text else units
        bounds.append(len(flat))
    encoded = pa.array(flat, pa.string()).dictionary_encode()
    return np.array(bounds), encoded.indices.to_numpy(), encoded.dictionary


def _encoded(docs: DataFrame, model: str, finish: Callable, schema: str) -> DataFrame:
    """What finish(doc_ids, heads, ids, ends) makes of each block of ``docs`` (doc_id long, text, perhaps head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in batches:
            for first, texts in blocks.groups(b.column("text"), blocks.BLOCK_BYTES):
                bounds, numbers, units = _units(texts)
                sizes, flat = pieces.of_units(units.to_pylist())
                ids, ends = blocks.gathered(flat, sizes, numbers)
                own = b.slice(first, len(texts))
                heads = own.column("head").to_pylist() if "head" in b.schema.names else None
                yield finish(own.column("doc_id"), heads, ids, np.concatenate([[0], ends])[bounds])

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array) of each row of ``docs`` (doc_id, text), as the model's own encoder gives them.

    Null and empty texts have no ids; repeated rows stay; an empty table gives an empty one;
    further columns are ignored; a null doc_id is kept.
    """
    _common.ship(docs.sparkSession)

    def finish(doc_ids: pa.Array, _: None, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return _encoded(docs.select(F.col("doc_id").cast("long"), "text"), model, finish, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of each row of ``encoded`` (doc_id, ids); null ids give null."""
    _common.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in batches:
            texts = [None if x is None else pieces.decode(array("I", x).tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, exact (decoding gives the text again)."""
    _common.ship(docs.sparkSession)
    names = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean"

    def finish(doc_ids: pa.Array, heads: list[str], ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        data, texts = memoryview(ids.astype("<u4").tobytes()), load(model).decode_batch(ids, bounds)
        crcs = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
        hashes = [hashlib.sha256(t).hexdigest() for t in texts]
        columns = [doc_ids, pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64()), pa.array(hashes), pa.array([h == w for h, w in zip(hashes, heads)], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in names.split(", ")])

    own = docs.select(F.col("doc_id").cast("long"), "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("head"))
    return _encoded(own, model, finish, names)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(_common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
