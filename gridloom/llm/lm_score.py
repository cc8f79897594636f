"""Language-model scores by prediction by partial matching, and a smoothed unigram base.

The model is a byte-context trie of depth ORDER with escapes by the number of distinct symbols
(method C) and symbol exclusion, pretrained on the rows that may be learned from. Documents are read
in blocks; a block asks for its distinct words and its distinct grams (context and symbol) only,
packed by hash bucket. Counts are merged there first, so what goes on is one entry a gram of the
whole corpus. Merged grams meet by their last three context bytes, where the trie below is worked
out; the grams of order 2, at most 2 ** 24 numbers, stand beside. Logarithms go back to the hash
buckets, and from there by block to the compressed texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common
from .blocks import groups

ORDER = 5
BLOCK_BYTES, PART_BYTES, PART_ROWS, BUCKET_BYTES = 10 << 20, 2 << 20, 1 << 16, 12 << 20
CONTEXTS = 1024  #: buckets of contexts at most
START, END = 0xFE, 0xFF  #: bytes that UTF-8 never holds: before a text, and its last symbol
ALPHABET = 257


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(the text of each word, its number, the distinct words by number) of texts without nulls."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    encoded = lists.flatten().dictionary_encode()
    rows, numbers, words = pc.list_parent_indices(lists).to_numpy(), encoded.indices.to_numpy(), encoded.dictionary
    blank = pc.index(words, "").as_py() if len(words) else -1  # what white space at either end leaves
    if blank >= 0:
        keep = numbers != blank
        rows, numbers = rows[keep], numbers[keep]
        numbers = numbers - (numbers > blank)
        words = pa.concat_arrays([words.slice(0, blank), words.slice(blank + 1)])
    return rows.astype(np.int64), numbers.astype(np.int64), words


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, how many texts hold each, these texts gram by gram, how often each does) of up to
    PART_ROWS lower-cased texts. A gram is order bytes of context, then a byte of the text or its end."""
    data = np.frombuffer(b"".join(bytes([START]) * order + t + bytes([END]) for t in texts), np.uint8)
    n = max(0, len(data) - order)
    keys = np.zeros(n, np.uint64)
    for k in range(order + 1):
        keys <<= np.uint64(8)
        keys |= data[k : k + n]
    keys = keys[data[order:] != START]
    keys <<= np.uint64(16)
    keys |= np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) + 1 for t in texts])
    keys.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    own, holders = np.unique(keys >> np.uint64(16), return_counts=True)
    return own, holders.astype(np.int32), (keys & np.uint64(0xFFFF)).astype(np.uint16), times.astype(np.int32)


def logs(keys: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 probability of each gram by the trie whose counts are n (keys sorted and distinct, all
    grams of each last three context bytes present); pairs: all grams of order 2 and their counts."""
    low = np.bincount((pairs[0] & np.uint64(0xFFFF)).astype(np.int64), pairs[1], 1 << 16).astype(np.int64).reshape(256, 256)
    seen = n > 0
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)  # not yet predicted
    symbol = (keys & np.uint64(0xFF)).astype(np.int64)
    upper_distinct = np.zeros(len(keys), np.int64)  # distinct symbols of the context above: excluded now
    upper = None
    for k in range(order, 1, -1):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        # Grams of order k in the trie; those of order 2 also stand beside other third bytes.
        g, at = np.unique(keys[seen] & mask, return_inverse=True) if k > 2 else (pairs[0], None)
        c = np.bincount(at, n[seen], len(g)).astype(np.int64) if k > 2 else pairs[1]
        context, first = np.unique(g >> np.uint64(8), return_index=True)
        total = np.add.reduceat(c, first) if len(g) else np.zeros(0, np.int64)
        distinct = np.diff(np.append(first, len(g)))
        # Counts here of symbols that the context above excludes, by that context.
        if upper is not None:
            above_g, above_context = upper
            excluded = np.bincount(np.searchsorted(above_context, above_g >> np.uint64(8)), c[np.searchsorted(g, above_g & mask)], len(above_context)).astype(np.int64) if len(above_g) else np.zeros(0, np.int64)
        own = (keys & mask) >> np.uint64(8)
        place = np.searchsorted(context, own)
        there = (place < len(context)) & (context[np.minimum(place, len(context) - 1)] == own) if len(context) else np.zeros(len(keys), bool)
        place = np.where(there, place, 0)
        t = np.where(there, total[place], 0) if len(total) else np.zeros(len(keys), np.int64)
        d = np.where(there, distinct[place], 0) if len(total) else np.zeros(len(keys), np.int64)
        if upper is not None and len(upper[1]):
            above_own = (keys & np.uint64((1 << (8 * (k + 2))) - 1)) >> np.uint64(8)
            q = np.searchsorted(upper[1], above_own)
            hit = (q < len(upper[1])) & (upper[1][np.minimum(q, len(upper[1]) - 1)] == above_own)
            t = t - np.where(hit, excluded[np.where(hit, q, 0)], 0)
        fresh = d - upper_distinct
        spot = np.searchsorted(g, keys & mask)
        mine = np.where((spot < len(g)) & (g[np.minimum(spot, len(g) - 1)] == (keys & mask)), c[np.minimum(spot, len(g) - 1)], 0) if len(g) else np.zeros(len(keys), np.int64)
        live = open_ & (fresh > 0)
        found = live & (mine > 0)
        out[found] += np.log10(mine[found] / (t[found] + fresh[found]))
        escaped = live & (mine == 0)
        out[escaped] += np.log10(fresh[escaped] / (t[escaped] + fresh[escaped]))
        open_ &= ~found
        upper_distinct = d
        upper = (g, context)
    last = ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
    # Order 1 under the exclusion of the order-2 context's symbols, then order 0, then any symbol.
    zero = low.sum(axis=0)
    e1, e0 = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    if upper is not None and len(upper[0]):
        s2, c1 = (upper[0] & np.uint64(0xFF)).astype(np.int64), ((upper[0] >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
        index = np.searchsorted(upper[1], upper[0] >> np.uint64(8))
        sums = np.bincount(index, low[c1, s2], len(upper[1])).astype(np.int64)
        own = (keys & np.uint64(0xFFFFFF)) >> np.uint64(8)
        q = np.searchsorted(upper[1], own)
        hit = (q < len(upper[1])) & (upper[1][np.minimum(q, len(upper[1]) - 1)] == own)
        e1 = np.where(hit, sums[np.where(hit, q, 0)], 0)
    d1 = (low > 0).sum(axis=1)
    e0 = ((low > 0) * zero[None, :]).sum(axis=1)
    for t, fresh, mine in ((low.sum(axis=1)[last] - e1, d1[last] - upper_distinct, low[last, symbol]), (zero.sum() - e0[last], (zero > 0).sum() - d1[last], zero[symbol])):
        live = open_ & (fresh > 0)
        found = live & (mine > 0)
        out[found] += np.log10(mine[found] / (t[found] + fresh[found]))
        escaped = live & (mine == 0)
        out[escaped] += np.log10(fresh[escaped] / (t[escaped] + fresh[escaped]))
        open_ &= ~found
    out[open_] -= np.log10(max(1, ALPHABET - int((zero > 0).sum())))
    return out


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte, compressed."""
    return _common.squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8).T).tobytes())


def _unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(_common.unsqueezed(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _word_buckets(words: pa.Array, n: int) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.fromiter(map(xxh32_intdigest, words.cast(pa.binary()).to_pylist()), np.int64, len(words)) % n


def _gram_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _context_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """By the last three context bytes."""
    return _gram_buckets((keys >> np.uint64(8)) & np.uint64(0xFFFFFF), n)


def _split(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by bucket, (bucket, its begin and end in that order))."""
    order = np.argsort(buckets, kind="stable")
    kinds, first = np.unique(buckets[order], return_index=True)
    return order, list(zip(kinds.tolist(), first.tolist(), np.append(first[1:], len(order)).tolist()))


def _restored(answers: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    """Answers, bucket by bucket, in the order of what was asked."""
    out = np.zeros(len(buckets))
    out[np.argsort(buckets, kind="stable")] = np.concatenate([np.zeros(0), *answers])
    return out


WORDS, GRAMS = 0, 1
STAGED = "kind int, bucket int, block long, keys binary, n binary, doc_ids array<long>, texts array<binary>"
MERGED = "context int, bucket int, keys binary, n binary"
ANSWERS = "kind int, bucket int, block long, answers binary, distinct long, total long"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({f: pa.array(c, _KINDS[k]) for (f, k), c in zip(fields, zip(*rows) if rows else [[]] * len(fields))})


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, lower-cased texts) of a block, a bounded part at a time."""
    for first, part in groups(texts, PART_BYTES):
        data = [t.lower() for t in part.cast(pa.binary()).to_pylist()]
        for at in range(0, len(data), PART_ROWS):
            yield first + at, data[at : at + PART_ROWS]


def _stage(own: DataFrame, order: int | None, buckets: int) -> DataFrame:
    """Each block's requests, and a row of its texts (kind is null); no order, no grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for first, texts in groups(b.column("text"), BLOCK_BYTES):
                learn = b.column("learn").slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                rows, numbers, words = words_of(texts)
                n = np.bincount(numbers[learn[rows]], minlength=len(words))
                at, spans = _split(_word_buckets(words, buckets))
                lists = pa.ListArray.from_arrays(pa.array([*[x for _, x, _ in spans], len(at)], pa.int32()), words.take(pa.array(at)))
                out = [(WORDS, k, block, _common.squeezed(w), _squeezed(n[at[x:y]]), None, None) for (k, x, y), w in zip(spans, pc.binary_join(lists, "\n").cast(pa.binary()).to_pylist())]
                found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                kept = []
                for start, part in _parts(texts) if order else ():
                    keys, holders, docs, times = grams_of(part, order)
                    found.append((keys, np.add.reduceat(times * learn[start + docs.astype(np.int64)], np.cumsum(holders) - holders)))
                for _, part in groups(texts, PART_BYTES):
                    data = part.cast(pa.binary()).to_pylist()
                    kept += [_common.squeezed(b"".join(data)), _squeezed(np.array(list(map(len, data)), np.int64))]
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                at, spans = _split(_gram_buckets(keys, buckets))
                out += [(GRAMS, k, block, _squeezed(np.diff(keys[at[x:y]], prepend=np.uint64(0))), _squeezed(n[at[x:y]]), None, None) for k, x, y in spans]
                out.append((None, None, block, None, None, b.column("doc_id").slice(first, len(texts)).to_pylist(), kept))
                block += 1
                yield from _table(STAGED, out).to_batches()

    return _common.written(own.mapInArrow(run, STAGED), "blocks", compression="zstd")


def _asked(row: dict) -> np.ndarray:
    return np.cumsum(_unsqueezed(row["keys"], "<u8"), dtype=np.uint64)


def _count_words(requests: pa.Table) -> pa.Table:
    """The learned count of each requested word; how many there are and their sum stand once a bucket."""
    rows = requests.to_pylist()
    lists = pc.split_pattern(pa.array([_common.unsqueezed(r["keys"]) for r in rows], pa.binary()).cast(pa.string()), "\n")
    encoded = lists.flatten().dictionary_encode()
    at, bounds = encoded.indices.to_numpy(), lists.offsets.to_numpy()
    total = np.bincount(at, np.concatenate([_unsqueezed(r["n"], "<i8") for r in rows]), len(encoded.dictionary)).astype(np.int64)
    own = [(WORDS, r["bucket"], r["block"], _squeezed(total[at[x:y]]), 0, 0) for r, x, y in zip(rows, bounds, bounds[1:])]
    own[0] = (*own[0][:4], int((total > 0).sum()), int(total.sum()))
    return _table(ANSWERS, own)


def _merge(contexts: int):
    def merge(requests: pa.Table) -> pa.Table:
        rows = requests.to_pylist()
        keys, at = np.unique(np.concatenate([_asked(r) for r in rows]), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unsqueezed(r["n"], "<i8") for r in rows]), len(keys)).astype(np.int64)
        at, spans = _split(_context_buckets(keys, contexts))
        return _table(MERGED, [(k, rows[0]["bucket"], _squeezed(keys[at[x:y]]), _squeezed(n[at[x:y]])) for k, x, y in spans])

    return merge


def _second_order(merged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The grams of order 2 in the trie and their counts: at most 2 ** 24 numbers, as many as byte triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("n").to_pylist()):
                keys, at = np.unique(np.concatenate([keys, _unsqueezed(k, "<u8") & np.uint64(0xFFFFFF)]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, _unsqueezed(c, "<i8")]), len(keys)).astype(np.int64)
        seen = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen].astype(np.int64)), pa.array(n[seen])], ["k", "n"])

    rows = merged.select("keys", "n").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toPandas()
    return rows["k"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)


def _work_out(pairs: tuple[np.ndarray, np.ndarray], order: int, buckets: int):
    def work_out(merged: pa.Table) -> pa.Table:
        rows = merged.to_pylist()
        keys, n = np.concatenate([_unsqueezed(r["keys"], "<u8") for r in rows]), np.concatenate([_unsqueezed(r["n"], "<i8") for r in rows])
        at = np.argsort(keys)
        keys = keys[at]
        values = logs(keys, n[at], pairs, order)
        at, spans = _split(_gram_buckets(keys, buckets))
        return _table("bucket int, keys binary, n binary", [(k, _squeezed(keys[at[x:y]]), _squeezed(values[at[x:y]])) for k, x, y in spans])

    return work_out


def _look_up(requests: pa.Table, given: pa.Table) -> pa.Table:
    rows = given.to_pylist()
    keys, values = np.concatenate([_unsqueezed(r["keys"], "<u8") for r in rows]), np.concatenate([_unsqueezed(r["n"], "<f8") for r in rows])
    at = np.argsort(keys)
    keys, values = keys[at], values[at]
    return _table(ANSWERS, [(GRAMS, r["bucket"], r["block"], _squeezed(values[np.searchsorted(keys, _asked(r))]), 0, 0) for r in requests.to_pylist()])


def _score(order: int | None, buckets: int, n_all: int, v: int, ends: int):
    floor = np.log10(n_all + 0.5 * (v + 1))
    end_log = float(np.log10(ends + 0.5) - floor)

    def score(own: pa.Table, given: pa.Table) -> pa.Table:
        answers = sorted((r["kind"], r["bucket"], r["answers"]) for r in given.to_pylist())
        out = []
        for r in own.to_pylist():
            data: list[bytes] = []
            for text, sizes in zip(r["texts"][::2], r["texts"][1::2]):
                text, cuts = _common.unsqueezed(text), np.cumsum(_unsqueezed(sizes, "<i8")).tolist()
                data += [text[x:y] for x, y in zip([0, *cuts], cuts)]
            texts = pa.array(data, pa.binary()).cast(pa.string())
            rows, numbers, words = words_of(texts)
            counts = _restored([_unsqueezed(a, "<i8") for k, _, a in answers if k == WORDS], _word_buckets(words, buckets))
            word_logs = np.log10(counts + 0.5) - floor
            n_tokens = np.bincount(rows, minlength=len(texts)) + 1
            known = np.bincount(rows, counts[numbers] > 0, len(texts)).astype(np.int64) + (ends > 0)
            base = np.bincount(rows, word_logs[numbers], len(texts)) + end_log
            scores = pa.nulls(len(texts), pa.float64())
            if order:
                parts = [(start, len(part), grams_of(part, order)) for start, part in _parts(texts)]
                keys = np.unique(np.concatenate([g[0] for _, _, g in parts]))
                values = _restored([_unsqueezed(a, "<f8") for k, _, a in answers if k == GRAMS], _gram_buckets(keys, buckets))
                sums = [np.bincount(docs, np.repeat(values[np.searchsorted(keys, g)], holders) * times, n) for _, n, (g, holders, docs, times) in parts]
                scores = pa.array(np.concatenate(sums))
            out.append(pa.table([pa.array(r["doc_ids"], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(known), pa.array(np.full(len(texts), n_all)), pa.array(base), scores], [x.split()[0] for x in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return score


def score_documents(docs: DataFrame, may_learn: Column, order: int | None = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    score is the log10 probability of the row's bytes, A-Z lower-cased and white space as it stands,
    and the end. Null and empty texts are the end alone. Where nothing may be learned, all counts are
    zero and every symbol is equally likely. Repeated rows get equal results and count as often as they
    stand; a null doc_id is never learned from; further columns are ignored. Order None leaves the trie
    out: the other columns are the same, score is null.
    """
    if order is not None and not 2 <= order <= 5:
        raise ValueError("the order is 2 to 5: a gram fits six bytes")
    spark = docs.sparkSession
    _common.ship(spark)
    own = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(may_learn, F.lit(False)).alias("learn"))
    size, ends = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("learn")).first()
    buckets = max(1, -(-size // BUCKET_BYTES))
    staged = _stage(own, order, buckets)
    asks = {kind: staged.where(F.col("kind") == kind).select("bucket", "block", "keys", "n") for kind in (WORDS, GRAMS)}
    words = _common.written(asks[WORDS].groupBy("bucket").applyInArrow(_count_words, ANSWERS), "words")
    v, n_words = words.agg(F.sum("distinct"), F.sum("total")).first()
    answers = words
    if order:
        merged = _common.written(asks[GRAMS].groupBy("bucket").applyInArrow(_merge(min(CONTEXTS, buckets)), MERGED), "merged")
        pairs = _second_order(merged)
        values = merged.groupBy("context").applyInArrow(_work_out(pairs, order, buckets), "bucket int, keys binary, n binary")
        answers = words.unionByName(asks[GRAMS].groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(_look_up, ANSWERS))
    texts = staged.where("kind is null").select("block", "doc_ids", "texts").groupBy("block")
    return texts.cogroup(answers.groupBy("block")).applyInArrow(_score(order, buckets, (n_words or 0) + ends, (v or 0) + (ends > 0), ends), SCORES)


def _scored(spark: SparkSession, sf_dir: str, order: int | None) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    held = _common.id_remainder(F.col("doc_id"), 5) == 1
    return score_documents(docs, ~held, order).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, ORDER)


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the operator's rows: all but the trie's score, so without the trie."""
    return _scored(spark, sf_dir, None).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {"op6_lm_score": op6_lm_score, "base_scores": base_scores}

_BIT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
#: crc32 of a document's number as text, a byte and a bit at a time.
_CRC = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda c, i: {_BIT})))"

ORACLES = {
    "base_scores": f"""WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
 t AS (SELECT doc_id, held_out, unnest(words) AS w FROM d UNION ALL SELECT doc_id, held_out, NULL FROM d),
 c AS (SELECT w, count(*) FILTER (NOT held_out) AS n FROM t GROUP BY w), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS v FROM c)
 SELECT t.doc_id, any_value(t.held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c.n > 0) AS n_known, any_value(s.n) AS train_tokens, round(sum(log10((c.n + 0.5) / (s.n + 0.5 * (s.v + 1)))), 4) AS base_score
 FROM t JOIN c ON t.w IS NOT DISTINCT FROM c.w CROSS JOIN s GROUP BY t.doc_id"""
}
