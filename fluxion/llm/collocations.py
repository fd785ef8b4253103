"""Phrase collocations by contiguous pattern growth: occurrence pointers projected by prefix, grown to the right depth-first.

1. Words of every language are counted; a word's id is a 64-bit hash of language and word. A frequent word that shares its id
   with another word makes the whole count start again with another seed, so ids are exact for what follows.
2. Pairs of frequent words that follow one another in a piece are counted. Every place of a frequent pair that goes on is a
   pointer: its words and the one or two after them, as long as each next pair is frequent. Bitmaps of bounded size answer
   "frequent"; false answers only let more through.
3. A pointer goes to the task of its prefix: its first two words, if no more than `most` places begin with them; else its first
   three. Counts of prefixes so split are plain sums made before (`_extensions`), by as many passes as there are levels with
   such a prefix. So no task gets a whole hot prefix, and what a task gets is complete for it.
   Pointers are sorted and counted within tasks before they are sent, as one block for each task and bucket of prefixes.
4. In its task a prefix is grown (`_grow`): sort its pointers by the next word, count, and go down into frequent ones only.
5. Phrases and words join by their ids for the counts of both parts of every cut and for the longer phrases around them.

Defined cases: null text is empty, null language is `und`. Documents that share a doc_id count each. Words are compared byte
for byte after A-Z are lower-cased; there is no limit on their length. Extra columns are ignored. An empty table gives an
empty result. Equal scores and counts are ordered by phrase, so ranks are the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .support import fields, map_arrow, materialise

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
#: Pointers that a task takes of one prefix, and about as many as a bucket of prefixes holds; tokens that a task gathers before it sends; rows of an Arrow batch.
MOST, BUCKET, FLUSH, ROWS = 1 << 18, 1 << 18, 1 << 20, 1 << 16
_BREAK = b".,;:!?\n\x0b\x0c\r"
_WORD = K.byte_table([b for b in range(256) if b not in b" \t" and b not in _BREAK])
_STOP = K.byte_table(list(_BREAK))
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Bits of a filter of ids, by their number: 16 for each, within these.
_FILTER_BITS = (1 << 20, 1 << 26)


def _language(values: list, seed: int) -> np.ndarray:
    """A 64-bit value for each language."""
    out = []
    for v in values:
        data = np.frombuffer(b"\x01" + v.encode(), np.uint8)
        out.append(K.hash_spans(data, np.array([0]), np.array([len(data)]))[0])
    return K.mix(np.array(out, _U) + K.mix(np.array([seed + 1], _U)))


def _tokens(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """(document, ids of words, True where a word begins a piece, what is needed to read the words) for each cut of lang, text."""
    lang = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
    salt, of = _language(lang.dictionary.to_pylist(), seed), lang.indices.to_numpy()
    names = lang.dictionary.to_pylist()
    data, offsets = K.buffers(batch.column(1))
    last, stopped = -1, True
    for i, j, lo, hi in K._cuts(data, offsets, _WORD):
        low, start, end = K.spans(data[lo:hi], _WORD)
        inner = offsets[i + 1 : j] - lo
        start, end = K.split_at(start, end, inner)
        stops = np.concatenate([[0], np.cumsum(_STOP[low])])
        doc = i + np.searchsorted(inner, start, "right")
        begins = np.ones(len(start), bool)
        begins[1:] = (stops[start[1:]] > stops[end[:-1]]) | (doc[1:] != doc[:-1])
        if j - i == 1:  # a long document goes on from cut to cut
            if len(start):
                begins[0] = i != last or stopped or stops[start[0]] > 0
                stopped = bool(stops[-1] > stops[end[-1]])
            else:
                stopped = i != last or stopped or bool(stops[-1])
            last = i
        ids = K.mix(K.hash_spans(low, start, end) ^ salt[of[doc]])
        ids[ids == 0] = 1
        yield j - 1, ids, begins, (low, start, end, names, of, doc)


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n: counts of each task's words."""
    schema = fields(("id", "long"), ("lang", "string"), ("word", "binary"), ("n", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        names: dict = {}

        def flush() -> pa.RecordBatch:
            ids = np.fromiter(counts, _U, len(counts)).view(np.int64)
            out = [pa.array(ids), pa.array([names[k][0] for k in counts], pa.string()), pa.array([names[k][1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            names.clear()
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            for _, ids, _, (low, start, end, langs, of, doc) in _tokens(batch, seed):
                found, at, n = np.unique(ids, return_index=True, return_counts=True)
                for k, i, c in zip(found.tolist(), at.tolist(), n.tolist(), strict=True):
                    word = (langs[of[doc[i]]], low[start[i] : end[i]].tobytes()) if k not in counts else None
                    if word is None:
                        counts[k] += c
                    else:
                        counts[k], names[k] = c, word
                if len(counts) > 500_000:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, schema)


def _clash(batch_ids: DataFrame, least: int) -> bool:
    return not batch_ids.groupBy("id").agg(F.count("*").alias("k"), F.max("n").alias("m")).where(f"k > 1 and m >= {least}").isEmpty()


class _Bits:
    """Membership in a set of 64-bit keys by a bitmap of bounded size: never a false no."""

    def __init__(self, keys: DataFrame):
        """keys: distinct column key."""
        count = keys.count()
        self.size = min(_FILTER_BITS[1], max(_FILTER_BITS[0], 1 << (16 * count).bit_length()))
        slot = F.col("key").bitwiseAND(F.lit(self.size - 1))
        found = keys.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toPandas()
        words = np.zeros(self.size // 64, np.int64)
        words[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
        self.words, self.any = keys.sparkSession.sparkContext.broadcast(words.view(_U)), count > 0

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & _U(self.size - 1)
        return (self.words.value[slot >> _U(6)] >> (slot & _U(63))) & _U(1) != 0


def _prefix(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit value of each sequence of ids."""
    out = parts[0]
    for p in parts[1:]:
        out = K.mix(out * _ODD + p)
    return out


def _pointers(docs: DataFrame, seed: int, frequent: _Bits, pairs: _Bits | None, send, schema) -> DataFrame:
    """send(dictionary of ids, windows [n, LONGEST] of places in it, -1 where they end) for every FLUSH tokens of a task, at ends of documents."""

    def windows(ids: np.ndarray, begins: np.ndarray):
        known, local = np.unique(ids, return_inverse=True)
        local = local.astype(np.int32)
        often = frequent.has(known)[local]
        goes_on = np.zeros(len(ids) + LONGEST, bool)  # a frequent word after a frequent word of its piece
        goes_on[1 : len(ids)] = often[1:] & often[:-1] & ~begins[1:]
        if pairs is not None:
            at = np.flatnonzero(goes_on)
            goes_on[at] = pairs.has(_prefix([ids[at - 1], ids[at]]))
        at = np.flatnonzero(goes_on[1 : len(ids) + 1])
        out = np.full((len(at), LONGEST), -1, np.int32)
        out[:, 0] = local[at]
        on = np.ones(len(at), bool)
        for k in range(1, LONGEST):
            on &= goes_on[at + k]
            out[on, k] = local[np.minimum(at + k, len(ids) - 1)][on]
        return send(known, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        last = (None, None)
        for b, batch in enumerate(batches):
            for doc, ids, begins, _ in _tokens(batch, seed):
                if n > FLUSH and last != (b, doc):
                    yield from windows(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, n = [], 0
                if len(ids):
                    held.append((ids, begins))
                    n += len(ids)
                last = (b, doc)
        if n:
            yield from windows(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, schema)


def _counted(known: np.ndarray, of: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by bucket, equal ones put together; their buckets and numbers."""
    key = _prefix([*(np.where(of[:, k] >= 0, known[of[:, k]], _U(0)) for k in range(of.shape[1]))])
    order = np.lexsort((key, bucket))
    of, bucket, key = of[order], bucket[order], key[order]
    new = np.ones(len(of), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]) | (of[1:] != of[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return of[at], bucket[at], np.diff(np.append(at, len(of)))


_W = [f"w{k}" for k in range(1, LONGEST + 1)]


def _extensions(docs: DataFrame, seed: int, frequent: _Bits, pairs: _Bits | None, hot: list[_Bits], least: int) -> DataFrame:
    """w1 to w4 (0: none) and a: the counts of at least `least` of phrases that extend a hot prefix by one word."""
    d = len(hot)
    schema = fields(*((w, "long") for w in _W), ("a", "long"))

    def send(known: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = of[of[:, d] >= 0]
        for k in range(d):
            of = of[hot[k].has(_prefix([known[of[:, i]] for i in range(k + 1)]))]
        of, _, n = _counted(known, of[:, : d + 1], np.zeros(len(of), np.int8))
        for s in range(0, len(of), ROWS):
            part = of[s : s + ROWS]
            words = [known[part[:, k]].view(np.int64) if k <= d else np.zeros(len(part), np.int64) for k in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(n[s : s + ROWS])], names=schema.names)

    return _pointers(docs, seed, frequent, pairs, send, schema).groupBy(*_W).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _grow(words: np.ndarray, n: np.ndarray, depth: int, least: int, out: list) -> None:
    """Grows one prefix, the first `depth` columns of the pointers `words`: appends (phrase, count) of every frequent extension, depth-first."""
    keep = words[:, depth] != 0
    words, n = words[keep], n[keep]
    if not len(n) or n.sum() < least:
        return
    order = np.argsort(words[:, depth])
    words, n = words[order], n[order]
    next_ = words[:, depth]
    at = np.concatenate([[0], 1 + np.flatnonzero(next_[1:] != next_[:-1]), [len(n)]])
    total = np.add.reduceat(n, at[:-1])
    for g in np.flatnonzero(total >= least).tolist():
        s, e = at[g], at[g + 1]
        out.append((*words[s, : depth + 1].tolist(), *[0] * (LONGEST - depth - 1), int(total[g])))
        if depth + 1 < LONGEST:
            _grow(words[s:e], n[s:e], depth + 1, least, out)


def _grown(docs: DataFrame, seed: int, frequent: _Bits, pairs: _Bits, hot: list[_Bits], buckets: int, least: int) -> DataFrame:
    """w1 to w4 (0: none) and a of the phrases that grow from prefixes that aren't hot."""
    sent = fields(("bucket", "long"), ("known", "binary"), ("of", "binary"), ("depth", "binary"), ("n", "binary"))
    schema = fields(*((w, "long") for w in _W), ("a", "long"))

    def send(known: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        depth, still = np.zeros(len(of), np.int8), np.ones(len(of), bool)
        key = known[of[:, 0]]
        for k in range(len(hot) + 1):  # the first prefix that isn't hot
            if k:
                key = np.where(still, _prefix([key, np.where(of[:, k] >= 0, known[of[:, k]], _U(0))]), key)
            depth[still] = k + 1
            if k < len(hot):
                still &= (of[:, k] >= 0) & hot[k].has(key)
        # whole phrases of hot prefixes have been counted; so has what ends with its prefix
        more = (depth < LONGEST) & (of[np.arange(len(of)), np.minimum(depth, LONGEST - 1)] >= 0)
        of, depth, key = of[more], depth[more], key[more]
        of, at, n = _counted(known, of, (K.mix(key) % _U(buckets) * _U(LONGEST) + depth.astype(_U)).astype(np.int64))
        depth, bucket = (at % LONGEST).astype(np.int8), at // LONGEST
        ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], len(bucket) > 0))
        rows: list = [[], [], [], [], []]
        for s, e in zip(np.concatenate([[0], ends[:-1] + 1]).tolist() if len(ends) else [], (ends + 1).tolist(), strict=True):
            used, places = np.unique(of[s:e], return_inverse=True)
            places = places.reshape(-1, LONGEST).astype(np.uint16 if len(used) < 65_536 else np.uint32)
            ids = np.where(used >= 0, known[used], _U(0))
            for r, v in zip(rows, (int(bucket[s]), ids.tobytes(), places.T.tobytes(), depth[s:e].tobytes(), n[s:e].astype(np.uint32).tobytes()), strict=True):
                r.append(v)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=sent.names)

    def grow(group: pa.Table) -> pa.Table:
        parts, depths, numbers = [], [], []
        for known, of, depth, n in zip(*(group[c].to_pylist() for c in ("known", "of", "depth", "n")), strict=True):
            ids, count = np.frombuffer(known, _U), len(depth)
            places = np.frombuffer(of, np.uint16 if len(of) == 2 * LONGEST * count else np.uint32).reshape(LONGEST, count)
            parts.append(ids[places].T)
            depths.append(np.frombuffer(depth, np.int8))
            numbers.append(np.frombuffer(n, np.uint32).astype(np.int64))
        words, depth, n = np.concatenate(parts), np.concatenate(depths), np.concatenate(numbers)
        out: list = []
        for d in range(1, LONGEST):
            mine = np.flatnonzero(depth == d)
            if not len(mine):
                continue
            order = mine[np.lexsort(words[mine, :d].T)]
            part, count = words[order], n[order]
            new = np.flatnonzero((part[1:, :d] != part[:-1, :d]).any(axis=1)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(part)], strict=True):
                _grow(part[s:e], count[s:e], d, least, out)
        columns = list(zip(*out, strict=True)) if out else [[]] * (LONGEST + 1)
        return pa.table([pa.array(np.array(c, _U).view(np.int64)) for c in columns[:LONGEST]] + [pa.array(columns[LONGEST], pa.int64())], names=schema.names)

    return _pointers(docs, seed, frequent, pairs, send, sent).groupBy("bucket").applyInArrow(grow, schema)


def frequent_phrases(docs: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases of 1 to LONGEST words: w1 to w4, a; vocabulary of frequent words: id, lang, word, n; totals: lang, n). Counts are exact."""
    for seed in range(20):
        counted = _words(docs, seed)
        words = materialise(counted.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")))
        if not _clash(words, least):
            break
    else:
        raise RuntimeError("no seed gives frequent words ids of their own")
    vocabulary = materialise(words.where(F.col("n") >= least).select("id", "lang", F.col("word").cast("string").alias("word"), "n"))
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = _Bits(vocabulary.select(F.col("id").alias("key")))
    places = vocabulary.agg(F.sum("n")).first()[0] or 0
    singles = vocabulary.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in _W[1:]), F.col("n").alias("a"))
    # pairs of frequent words, then what follows prefixes with more places than a task takes
    hot = [frequent]
    level = materialise(_extensions(docs, seed, frequent, None, hot, least))
    pairs, found = _Bits(_keys(level, 2)), [singles, level]
    for d in range(2, LONGEST):
        bits = _Bits(_keys(level.where(F.col("a") > most), d))
        if not bits.any:
            break
        hot.append(bits)
        level = materialise(_extensions(docs, seed, frequent, pairs, hot, least))
        found.append(level)
    buckets = max(1, -(-places // BUCKET))
    found.append(materialise(_grown(docs, seed, frequent, pairs, hot, buckets, least)))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, vocabulary, totals


def _keys(phrases: DataFrame, d: int) -> DataFrame:
    """key: the value of the first d words, as `_prefix` has it."""

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [batch.column(k).to_numpy().view(_U) for k in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(_prefix(parts).view(np.int64))], names=["key"])

    return map_arrow(phrases.select(*_W[:d]), keys, fields(("key", "long")))


def _slices(which: list[tuple[int, int]]) -> list[F.Column]:
    """The ids of words from..to (1-based, inclusive) of a phrase, filled up with 0, as a struct of v1 to v4."""
    return [F.struct(*(F.col(_W[s - 1 + k]).alias(f"v{k + 1}") if s + k <= e else F.lit(0).cast("long").alias(f"v{k + 1}") for k in range(LONGEST))) for s, e in which]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, most: int = MOST) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score. docs: text, lang."""
    phrases, vocabulary, totals = frequent_phrases(docs, least, most)
    lookup = phrases.select(F.struct(*(F.col(w).alias(f"v{k + 1}") for k, w in enumerate(_W))).alias("v"), F.col("a").alias("f"))
    length = sum((F.col(w) != 0).cast("int") for w in _W)
    longer = phrases.where("w2 <> 0").withColumn("len", length)
    cuts = F.when(F.col("len") == 2, F.array(*(F.struct(F.lit(k).alias("k"), *[c.alias(n) for n, c in zip("vr", _slices([(1, k), (k + 1, 2)]), strict=True)]) for k in (1,))))
    for size in (3, 4):
        cuts = cuts.when(F.col("len") == size, F.array(*(F.struct(F.lit(k).alias("k"), *[c.alias(n) for n, c in zip("vr", _slices([(1, k), (k + 1, size)]), strict=True)]) for k in range(1, size))))
    # candidates inside longer ones that are nearly as frequent go
    around = (
        longer.where("len > 2")
        .select("a", F.explode(F.when(F.col("len") == 3, F.array(*_slices([(1, 2), (2, 3)]))).otherwise(F.array(*_slices([(1, 3), (2, 4), (1, 2), (2, 3), (3, 4)])))).alias("v"))
        .groupBy("v")
        .agg(F.max("a").alias("longer"))
    )
    kept = (
        longer.withColumn("v", F.struct(*(F.col(w).alias(f"v{k + 1}") for k, w in enumerate(_W))))
        .join(materialise(around), "v", "left")
        .where(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {inside}")
        .drop("v", "longer")
    )
    # the lowest-scoring cut
    parts = kept.select(*_W, "len", "a", F.explode(cuts).alias("c")).select(*_W, "len", "a", "c.*")
    parts = parts.join(lookup.withColumnRenamed("f", "l"), "v").drop("v").withColumnRenamed("r", "v").join(lookup.withColumnRenamed("f", "r"), "v").drop("v")
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = parts.withColumn("score", score).groupBy(*_W, "len", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # words of the phrases by their ids
    named = (
        best.select("*", F.posexplode(F.slice(F.array(*_W), 1, F.col("len"))).alias("at", "id"))
        .join(vocabulary.select("id", "lang", "word"), "id")
        .groupBy(*_W)
        .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"), F.first("a").alias("a"), F.first("b").alias("b"))
        .select("lang", F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("phrase"), "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = salted.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, len(v) AS k, array_to_string(v, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, unnest(list_concat(
          list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
          list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]), list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]))) AS v FROM p)
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
s AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
t AS (
  SELECT s.lang, s.phrase, s.a, s.cut, g1.f AS l, g2.f AS r, (2000000::HUGEINT * s.a // (g1.f::HUGEINT + g2.f::HUGEINT))::BIGINT AS score
  FROM s JOIN g g1 ON g1.lang = s.lang AND g1.phrase = s.x JOIN g g2 ON g2.lang = s.lang AND g2.phrase = s.y),
b AS (SELECT lang, phrase, a, l, r, score FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[x:x + y - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - y + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS y FROM c WHERE k > 2)))
  GROUP BY 1, 2),
d AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT d.lang, rank, phrase, a, l, r, n, score FROM d JOIN n ON n.lang = d.lang WHERE rank <= 2000
"""
