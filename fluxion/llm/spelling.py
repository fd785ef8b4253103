"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped around the most frequent.

1. Words are counted over whole texts: in tasks by a 64-bit hash, then by themselves.
2. `deletion_keys`: with polynomial hashes of all prefixes, a word's hash without its letter i is pre[i] + (all - pre[i + 1]) / base,
   a few NumPy operations on 64-bit integers for all letters of all words of a batch. Two words differ by a replaced letter if
   they agree without their letters i for one i; by an inserted one if one of them is the other without a letter.
3. Keys are dealt out by their leading bits and sorted in their bucket; those that occur once go (`_shared`). Keys carry the
   word's number and the letter's place only, so a long word costs as many keys as it has letters, not their square.
4. What is left is joined with the words and put together by the remaining letters themselves, so that equal keys of
   different strings part again. A group holds one word for each letter of the alphabet at most; of a group each word gets
   the number of the others and the best of them, never all pairs.
5. Forms at least double the number of occurrences, so chains of them are short; roots follow by pointer doubling.

Defined cases: null text has no words, null doc_id is the empty text in front of the colon. Documents that share a doc_id count
each. Words shorter than `least_letters` or rarer than `least` are no words. Very long words are kept whole. Extra columns are
ignored. An empty table gives an empty result. Ties go to the smallest word in code-point order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .support import fields, map_arrow, materialise

LETTERS, LEAST, EVERY, FACTOR = 5, 3, 97, 2
#: Keys of a radix bucket, about; code points of which keys are made at once.
BUCKET, PIECE = 1 << 18, 1 << 18
_U = np.uint64
_ASCII = K.byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_CUT = K.byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)])
#: Words longer than this many bytes get their checksum one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crc32_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes, going on from the checksum `before` of what stands in front of it."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    first = int(np.count_nonzero(size > _LONG))
    out = np.empty(len(start), np.uint32)
    for i in order[:first].tolist():
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(before[i]))
    order = order[first:]
    register, at, left = ~before[order], start[order], size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k stand in front
        register[:n] = _CRC[(register[:n] ^ low[at[:n] + k]) & np.uint32(0xFF)] ^ (register[:n] >> np.uint32(8))
    out[order] = ~register
    return out


def word_counts(docs: DataFrame, letters: int = LETTERS, every: int = EVERY) -> DataFrame:
    """word, n of each task: lower-cased runs of letters, of which a run whose checksum with its document is divisible by `every` loses a letter."""
    schema = fields(("word", "binary"), ("n", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        names: dict[int, bytes] = {}
        cut: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = [pa.array([*(names[k] for k in counts), *cut], pa.binary()), pa.array([*counts.values(), *cut.values()], pa.int64())]
            for d in (counts, names, cut):
                d.clear()
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            ids = batch.column(0).fill_null("").to_pylist()
            before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
            data, offsets = K.buffers(batch.column(1))
            for i, j, lo, hi in K._cuts(data, offsets, _CUT):
                low = K.LOWER[data[lo:hi]]
                lead = low == 0xC3
                flag = np.zeros(len(low) + 2, bool)
                flag[1:-1] = _ASCII[low] | lead
                flag[2:-1] |= lead[:-1]
                edge = np.flatnonzero(flag[1:] != flag[:-1])
                start, end = edge[0::2], edge[1::2]
                inner = offsets[i + 1 : j] - lo
                start, end = K.split_at(start, end, inner)
                two = np.concatenate([[0], np.cumsum(lead)])
                size = end - start - (two[end] - two[start])
                keep = size >= letters  # what loses a letter and is shorter is no word either
                start, end, size = start[keep], end[keep], size[keep]
                if not len(start):
                    continue
                crc = crc32_spans(low, start, end, before[i + np.searchsorted(inner, start, "right")])
                loses = crc % np.uint32(every) == 0
                for k in np.flatnonzero(loses & (size > letters)).tolist():
                    word, at = low[start[k] : end[k]].tobytes().decode(), int(crc[k]) % int(size[k])
                    word = (word[:at] + word[at + 1 :]).encode()
                    cut[word] = cut.get(word, 0) + 1
                start, end = start[~loses], end[~loses]
                found, first, n = np.unique(K.hash_spans(low, start, end), return_index=True, return_counts=True)
                for k, f, c in zip(found.tolist(), first.tolist(), n.tolist(), strict=True):
                    if k in counts:
                        counts[k] += c
                    else:
                        counts[k], names[k] = c, low[start[f] : end[f]].tobytes()
                if len(counts) + len(cut) > 500_000:
                    yield flush()
        if counts or cut:
            yield flush()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, schema)


def deletion_keys(words: DataFrame) -> DataFrame:
    """key, id, kind, at of words (id, word): kind 0, the whole word (at -1) and the word without a letter; kind 1, the same with the letter's place."""
    schema = fields(("key", "long"), ("id", "long"), ("kind", "byte"), ("at", "int"))
    odd = _U(0x9E3779B97F4A7C15)

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        size = np.array([len(w) for w in texts])
        ends = np.cumsum(size)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
            points = np.frombuffer("".join(texts[i:j]).encode("utf-32-le"), np.uint32)
            n = size[i:j]
            first = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(len(points)) - np.repeat(first[:-1], n)
            up, down = K._Powers.to(int(n.max()) + 1)
            pre = np.zeros(len(points) + 1, _U)
            np.cumsum(K.mix(points.astype(_U) * odd) * up[at], out=pre[1:])
            begin, whole = np.repeat(pre[first[:-1]], n), pre[first[1:]] - pre[first[:-1]]
            rest = (pre[:-1] - begin) + (np.repeat(pre[first[1:]], n) - pre[1:]) * down[1]
            rest = K.mix(rest + np.repeat((n - 1).astype(_U) * odd, n))
            once = np.ones(len(points), bool)  # of equal letters in a row, deleting the first is enough
            once[1:] = (points[1:] != points[:-1]) | (at[1:] == 0)
            of = np.repeat(ids[i:j], n)
            key = np.concatenate([K.mix(whole + n.astype(_U) * odd), rest[once], K.mix(rest ^ K.mix(at.astype(_U) + _U(1)))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(np.concatenate([ids[i:j], of[once], of])),
                    pa.array(np.concatenate([np.zeros(len(n) + int(once.sum()), np.int8), np.ones(len(points), np.int8)])),
                    pa.array(np.concatenate([np.full(len(n), -1), at[once], at]).astype(np.int32)),
                ],
                names=schema.names,
            )
            i = j

    return map_arrow(words.select("id", "word"), keys, schema)


def _shared(keys: DataFrame, bits: int) -> DataFrame:
    """id, kind, at of the keys that occur more than once: dealt out by their `bits` leading bits, sorted in their bucket."""
    schema = fields(("id", "long"), ("kind", "byte"), ("at", "int"))

    def sort(group: pa.Table) -> pa.Table:
        key = group["key"].to_numpy()
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return group.select(["id", "kind", "at"]).take(pa.array(np.sort(order[keep])))

    return keys.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")).groupBy("bucket").applyInArrow(sort, schema)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word of the most frequent near word) of words (word, n) that have near ones."""
    words = materialise(words.select("word", "n", F.xxhash64("word").alias("id")))
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    shared = _shared(deletion_keys(words), max(0, (total // BUCKET).bit_length()))
    rest = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.expr("substr(word, 1, at)"), F.expr("substr(word, at + 2)")))
    found = materialise(shared.join(words, "id").where("at < length(word)").select("kind", "at", "word", "n", rest.alias("rest")).distinct())
    # replaced letters: each of a group counts the others; the best other is the group's first, or its second for the first
    group = Window.partitionBy("at", "rest")
    ranked = group.orderBy(F.desc("n"), F.asc("word")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = lambda k: F.struct((-F.nth_value("n", k).over(ranked)).alias("n"), F.nth_value("word", k).over(ranked).alias("word"))
    replaced = (
        found.where("kind = 1")
        .select("word", (F.count("*").over(group) - 1).alias("near"), best(1).alias("a"), best(2).alias("b"))
        .where("near > 0")
        .select("word", "near", F.when(F.col("a.word") == F.col("word"), F.col("b")).otherwise(F.col("a")).alias("best"))
    )
    # an inserted letter: one of the two words is the other without it
    whole = found.where("kind = 0 and at < 0").select("rest", F.struct((-F.col("n")).alias("n"), "word").alias("short"))
    pairs = found.where("kind = 0 and at >= 0").select("rest", F.struct((-F.col("n")).alias("n"), "word").alias("long")).join(whole, "rest")
    inserted = pairs.select(F.explode(F.array(F.struct(F.col("long.word").alias("word"), F.col("short").alias("best")), F.struct(F.col("short.word").alias("word"), F.col("long").alias("best")))).alias("e")).select("e.word", F.lit(1).cast("long").alias("near"), "e.best")
    return replaced.unionByName(inserted).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words (word, form): the end of the chain of forms."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:  # doubling: the length of the chains behind a step doubles, and forms double their numbers
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = after.where("moved").isEmpty()
        at = after.drop("moved")
        if done:
            return at


def spelling_variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, every: int = EVERY, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = word_counts(docs, letters, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = materialise(counted.select(F.col("word").cast("string").alias("word"), "n"))
    near = near_words(words)
    formed = materialise(
        words.join(near, "word", "left")
        .withColumn("best", F.when(-F.col("best.n") >= factor * F.col("n"), F.col("best")))
        .select("word", F.col("best.word").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.n")).alias("form_n"))
    )
    return formed.join(roots(formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same with deletions as strings; the checksum is a fold over bytes with its table.
ORACLE_SQL = r"""
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT run, c, hex(encode(concat(doc_id, ':', run))) AS x FROM r),
h AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM x, k),
w AS (
  SELECT w, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w FROM h)
  WHERE length(w) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
d AS (SELECT w, n, i, substr(w, 1, i::INT) || substr(w, i::INT + 2) AS r FROM (SELECT w, n, unnest(range(length(w))) AS i FROM w)),
p AS (
  SELECT a.w AS a, b.w AS b FROM d a JOIN d b ON a.i = b.i AND a.r = b.r AND a.w <> b.w
  UNION SELECT d.w, w.w FROM d JOIN w ON d.r = w.w UNION SELECT w.w, d.w FROM d JOIN w ON d.r = w.w),
q AS (SELECT p.a, count(*) AS n_near, arg_min(w.w, (-w.n, w.w)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.w = p.b GROUP BY 1),
f AS (SELECT w.w AS word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN q ON q.a = w.w),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
z AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""
