"""Lessons from earlier sessions: word sets, deduplication, retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import written

ALIKE = 0.6
#: Keys of rare words in a block of sets.
BLOCK = 1 << 23
#: Values of a hash by which words are ordered, and about how many texts this order is counted on.
BUCKETS, ORDERED = 1 << 20, 8_000


def words(text: str) -> Column:
    """Distinct words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z_]{3,}"), F.lit(0)))


def hashes(words: str) -> Column:
    return F.transform(F.col(words), lambda x: F.xxhash64(x))


def jaccard(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def fingerprint(kind: str, variables: int, noise: float | None, dims: int = 0, boundary: str | None = None) -> dict:
    return {"kind": kind, "n_vars": variables, "noise": noise, "dims": dims, "boundary": boundary}


def add_lessons(kept: list[str], new: Iterable[str], alike: float = ALIKE) -> list[str]:
    """Lessons kept so far and those of the new that resemble none before them (greedy: the first of alike ones stays)."""
    bag = lambda s: set(re.findall(r"[a-z_]{3,}", s.lower()))
    out, bags = list(kept), [bag(s) for s in kept]
    for text in new:
        own = bag(text)
        if not any(len(own & b) > alike * len(own | b) for b in bags):
            out.append(text.strip())
            bags.append(own)
    return out


def _least(a: np.ndarray, b: np.ndarray | int, percent: int) -> np.ndarray:
    """Words that alike sets of sizes a and b share at least."""
    return percent * (a + b) // (100 + percent) + 1


def _count(n: np.ndarray) -> np.ndarray:
    """Rarest words that a smaller set of n words has to share with an alike one before the pair is written."""
    return 2 + n // 96


def _asked(n: np.ndarray, other: np.ndarray | int, percent: int) -> np.ndarray:
    """Of a smaller set's rarest words, how many hold _count(n) words of any alike set of `other` words or more (all of them where it shares fewer)."""
    return np.minimum(n, n - _least(n, other, percent) + _count(n))


def _held(n: np.ndarray, percent: int) -> np.ndarray:
    """Of a larger set's rarest words, how many hold those that it shares with the rarest ones of any smaller alike set."""
    return _asked(n, percent * n // 100 + 1, percent)


def rarity(sets: DataFrame) -> np.ndarray:
    """For each of 2**20 values of a word's hash, how common it is in sets (x: hashes of words), in steps of a 16th of an octave. Orders words, decides nothing."""
    at = sets.select(F.explode("x").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("at")).count().toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[at["at"].to_numpy()] = np.minimum(255, np.ceil(16 * np.log2(1 + at["count"].to_numpy())))
    return out


def sketched(sets: DataFrame, percent: int = 60, rare: np.ndarray | None = None) -> DataFrame:
    """sets (n: size, x: hashes of words) with `p` and `s` in place of x.

    p: keys of the rarest words, ascending, as many as `_held` says. A key has 8 bits of rarity and 24 of the hash: words that share a key are taken for
    one another, which may add pairs and loses none. s: for each of B bits whether an odd number of words falls on it, B being a power of 2 and
    some times the size. Words that two sets don't share are at least as many as the bits in which their sketches differ."""
    keep = [c for c in sets.columns if c != "x"]
    wide = 300 / max(percent, 10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat, size = x.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = flat >> np.uint64(40)
            if rare is not None:
                key |= rare[(flat & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(24)
            row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            key = np.sort((row << np.uint64(32)) | key).astype(np.uint32)
            many = np.clip(_held(size, percent), 0, size)
            ends = np.cumsum(size)
            key = key[np.arange(len(key)) - np.repeat(ends - size, size) < np.repeat(many, size)]
            p = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(key.view(np.int32)))
            bits = np.int64(64) << np.ceil(np.log2(np.maximum(1, wide * size / 64))).astype(np.int64)
            to = np.cumsum(bits)
            odd = np.bincount(((flat & (np.repeat(bits, size) - 1).astype(np.uint64)).astype(np.int64) + np.repeat(to - bits, size)), minlength=int(to[-1]) if len(to) else 0) & 1
            raw = np.packbits(odd.astype(np.uint8), bitorder="little")
            s = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], to // 8]).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], p, s], names=[*keep, "p", "s"])

    more = [T.StructField("p", T.ArrayType(T.IntegerType())), T.StructField("s", T.BinaryType())]
    return sets.mapInArrow(run, T.StructType([*[sets.schema[c] for c in keep], *more]))


def _blocks(sizes: list[tuple[int, int]], percent: int, block: int) -> list[tuple]:
    """Who meets whom. sizes: (n, sets of n words). Rows: n, j, part, parts, slices, side, most: of the sets of n words those of one part in `parts` are held by block j
    (side 1, in all its slices), or all of them ask in it (side 0, each in one slice), with `most` of their rarest words.

    A block has neighbouring sizes, or a part of the sets of one size, and `block` keys at most; a slice has about twice as many of those that ask."""
    n, many = (np.array(c, np.int64) for c in zip(*sorted(sizes), strict=True)) if sizes else (np.zeros(0, np.int64),) * 2
    held = np.maximum(1, _held(n, percent))
    most = int(min(block, max(1 << 12, (many * held).sum() // 32)))
    blocks, room = [], 0  # first and last place in n, part, parts
    for i, keys in enumerate((many * held).tolist()):
        if keys > most:
            blocks += [(i, i, g, -(-keys // most)) for g in range(-(-keys // most))]
            room = 0
        elif keys > room:
            blocks.append((i, i, 0, 1))
            room = most - keys
        else:
            blocks[-1] = (blocks[-1][0], i, 0, 1)
            room -= keys
    out = []
    for j, (first, last, part, parts) in enumerate(blocks):
        asks = np.flatnonzero((n <= n[last]) & (_least(n, np.maximum(n, n[first]), percent) <= n))
        words = _asked(n[asks], np.maximum(n[asks], n[first]), percent)
        slices = int(max(1, -(-((words + n[asks] // 4) * many[asks]).sum() // (2 * most))))  # sketches count as well
        out += [(int(n[i]), j, part, parts, slices, 1, int(held[i])) for i in range(first, last + 1)]
        out += [(int(n[i]), j, 0, 1, slices, 0, int(m)) for i, m in zip(asks, words, strict=True)]
    return out


def _lists(p: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys one after another, and how many each row has."""
    return p.flatten().to_numpy(zero_copy_only=False).view(np.uint32), pc.list_value_length(p).to_numpy(zero_copy_only=False).astype(np.int64)


def _index(p: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Distinct keys, where the rows of each begin and how many they are, and the rows."""
    key, size = _lists(p)
    rows = key.astype(np.uint64)
    rows <<= np.uint64(32)
    rows |= np.repeat(np.arange(len(size), dtype=np.uint32), size)
    rows.sort()
    key, rows = rows.view(np.uint32)[1::2].copy(), rows.view(np.uint32)[::2].copy()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)
    return key[first], first, np.diff(first, append=np.int32(len(rows))), rows


def _sharing(n_a: np.ndarray, p: pa.ListArray, n_b: np.ndarray, index: tuple, percent: int, room: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Asking and holding rows that share enough keys. n_a, n_b: their sizes, ascending; p: keys of those that ask. Room: about how many meetings are followed at once."""
    key_a, len_a = _lists(p)
    keys, first, size, row_b = index
    # looked up in the order of the keys, then back to that of the rows
    key = np.sort((key_a.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(n_a), dtype=np.uint64), len_a))
    row_a, key_a = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(keys, key_a), len(keys) - 1)
    met = np.flatnonzero(keys[at] == key_a)
    met = np.sort((row_a[met].astype(np.uint64) << np.uint64(32)) | at[met].astype(np.uint64))
    row_a, at = (met >> np.uint64(32)).astype(np.uint32), met.astype(np.uint32)
    begin, many = first[at], size[at]
    low = np.searchsorted(n_b, n_a, "left").astype(np.uint32)
    high = np.searchsorted(percent * n_b, 100 * n_a, "left").astype(np.uint32)
    need = len_a - n_a + np.minimum(n_a, _least(n_a, np.maximum(n_a, n_b[0]), percent))
    ends = np.searchsorted(row_a, np.arange(len(n_a)), "right")  # of each asking row in the keys that met
    total = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    # places in row_b of the meetings of some keys
    meetings = lambda lo, hi: np.arange(total[hi] - total[lo], dtype=np.int32) + np.repeat(begin[lo:hi] - (total[lo:hi] - total[lo]).astype(np.int32), many[lo:hi])
    one, most = 0, max(1, ((1 << 32) - 1) // len(n_b))
    while one < len(n_a):
        start = ends[one - 1] if one else 0
        upto = max(one + 1, min(int(np.searchsorted(total[ends], total[start] + room, "right")), one + most))
        stop = ends[upto - 1]
        if total[stop] - total[start] > room:  # one row that meets more: a counter for each row of the other
            counts, lo = np.zeros(len(n_b), np.int64), start
            while lo < stop:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + room, "right")) - 1)
                counts += np.bincount(row_b[meetings(lo, min(hi, stop))], minlength=len(n_b))
                lo = hi
            b = np.flatnonzero(counts[low[one] : high[one]] >= need[one]) + low[one]
            yield np.full(len(b), one), b
            one = upto
            continue
        a, b = np.repeat(row_a[start:stop] - np.uint32(one), many[start:stop]), row_b[meetings(start, stop)]
        if low[one:upto].any() or (high[one:upto] < len(n_b)).any():
            ok = (b >= low[one:upto][a]) & (b < high[one:upto][a])
            a, b = a[ok], b[ok]
        pairs = np.sort(a * np.uint32(len(n_b)) + b)
        # what is there as often as the least needed, then how often
        few = max(1, int(need[one:upto].min()))
        often = np.unique(pairs[few - 1 :][pairs[few - 1 :] == pairs[: max(0, len(pairs) - few + 1)]])
        if len(often):
            a, b = np.divmod(often.astype(np.int64), len(n_b))
            enough = np.searchsorted(pairs, often, "right") - np.searchsorted(pairs, often, "left") >= need[one + a]
            yield one + a[enough], b[enough]
        one = upto


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    while s.shape[1] > words:
        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
    return s


class _Sketches:
    """Sketches by their widths, in 64-bit words."""

    def __init__(self, s: pa.BinaryArray) -> None:
        self.wide = pc.binary_length(s).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        self.place, self.by = np.zeros(len(s), np.int64), {}
        for w in np.unique(self.wide).tolist():
            rows = np.flatnonzero(self.wide == w)
            self.place[rows] = np.arange(len(rows))
            self.by[w] = np.frombuffer(b"".join(s.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), w)

    def differ(self, other: _Sketches, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits rows i differ from rows j of other, the wider of two brought to fewer bits by adding halves up."""
        out = np.zeros(len(i), np.int64)
        wide = self.wide[i] << 32 | other.wide[j]
        for both in np.unique(wide).tolist():
            w, v = both >> 32, both & 0xFFFFFFFF
            rows = np.flatnonzero(wide == both)
            step = max(1, (1 << 19) // max(w, v))
            for at in range(0, len(rows), step):
                k = rows[at : at + step]
                one, two = self.by[w][self.place[i[k]]], other.by[v][other.place[j[k]]]
                out[k] = np.bitwise_count(_folded(one, min(w, v)) ^ _folded(two, min(w, v))).sum(1, dtype=np.int64)
        return out


def possible_pairs(sets: DataFrame, percent: int = 60, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of ids (a < b) that rarest words and sketches leave possible; all that are alike are among them. sets: id, n, p, s.

    Of two alike sets the smaller one misses so few of its words in the other that several of its rarest are among the rarest of the other. Sets are
    held in blocks of neighbouring sizes with an index of their rarest words, and each set asks in the blocks of its own size and of larger ones, the
    fewer words the larger they are. A task holds one block, and a slice of those that ask there passes by, whatever the words' frequencies."""
    spark, kind = sets.sparkSession, sets.schema["id"].dataType
    meets = _blocks([(r["n"], r["count"]) for r in sets.groupBy("n").count().collect()], percent, block)  # a row for each size
    plan = spark.createDataFrame(meets, "n int, j int, part int, parts int, slices int, side int, most int")
    h = F.xxhash64("id")
    dealt = sets.join(F.broadcast(plan), "n").where(F.pmod(h, "parts") == F.col("part"))
    slices = F.when(F.col("side") == 1, F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.shiftright(h, 20), "slices").cast("int")))
    dealt = dealt.select("j", F.explode(slices).alias("slice"), "side", "id", "n", F.slice("p", 1, F.col("most")).alias("p"), "s")
    tasks = len({(m[1], k) for m in meets for k in range(m[4])})
    # so many partitions that few get rows of several tasks; those that are held come before those that ask
    dealt = dealt.repartition(min(4096, 4 * max(1, tasks)), "j", "slice").sortWithinPartitions("j", "slice", F.desc("side"), "n")

    def test(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            side = batch.column("side").to_numpy()
            if block is not None and side.any():
                raise RuntimeError("a set that is held came after those that ask")
            held.append(batch.filter(pa.array(side == 1)))
            one = batch.filter(pa.array(side == 0))
            if not len(one):
                continue
            if block is None:
                two = pa.Table.from_batches(held).combine_chunks()
                n_b, ids, p, s = two["n"].to_numpy().astype(np.int64), *(two[c].combine_chunks() for c in "id p s".split())
                held = two = None
                if not len(n_b):
                    return
                block, s, p = _index(p), _Sketches(s), None
            n_a, own = one.column("n").to_numpy().astype(np.int64), _Sketches(one.column("s"))
            for i, j in _sharing(n_a, one.column("p"), n_b, block, percent):
                left = own.differ(s, i, j) <= ((100 - percent) * (n_a[i] + n_b[j]) - 1) // (100 + percent)
                i, j = i[left], j[left]
                a, b = one.column("id").take(pa.array(i)), ids.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pc.or_(pa.array(n_a[i] < n_b[j]), pc.less(a, b)))
            held = []

    pairs = dealt.groupBy("j", "slice").applyInArrow(test, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _confirmed(met: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those that are alike. held: id, w."""
    w = lambda s: held.select(F.col("id").alias(s), F.col("w").alias(f"w_{s}"))
    both = met.join(w("a"), "a").join(w("b"), "b").withColumn("shared", F.size(F.array_intersect("w_a", "w_b")))
    return both.where((100 + percent) * F.col("shared") > percent * (F.size("w_a") + F.size("w_b"))).select("a", "b")


def alike_pairs(sets: DataFrame, percent: int = 60, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of ids (a < b) whose word sets have a Jaccard similarity over percent / 100. sets: id, w (distinct words, no two sets equal)."""
    of = sets.select("id", F.size("w").alias("n"), hashes("w").alias("x")).where("n > 0")
    met = written(possible_pairs(written(sketched(of, percent, rarity(of))), percent, block))
    return _confirmed(met, sets.select("id", "w"), percent)


def first_of_alike(texts: DataFrame, id: str, text: str, percent: int = 60, block: int = BLOCK) -> DataFrame:
    """id, n_words, kept, resembles: texts in the order of their ids, of which one stays if it resembles none that stayed before.

    `resembles` is the smallest id that stayed and that a dropped text resembles (similarity of word sets over percent / 100). Equal sets are one class,
    its smallest id speaks for it, so that copies are never paired; what is paired are different sets that may be alike. Which stay is settled in
    rounds: a text without undecided alike ones before it stays, and all that it resembles go; rounds are as many as the longest chain of such
    decisions. Pairs are confirmed on whole sets where the first stays in any case, or neither has gone in the first round: most pairs within a group
    of near copies never are.
    Texts that are null or have no words stay and resemble nothing. Rows of equal id and text get equal results; null ids are left out.
    """
    own = texts.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    w = F.coalesce(F.sort_array(words("text")), F.array().cast("array<string>"))
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit((ORDERED << 20) // max(1, own.count()) + 1)
    rare = rarity(own.where(part).select(w.alias("w")).select(hashes("w").alias("x")))
    of = own.select("id", w.alias("w")).select("id", F.size("w").alias("n"), F.xxhash64("w").alias("h"), F.xxhash64("w", F.lit(1)).alias("k"), hashes("w").alias("x"))
    sets = written(sketched(of, percent, rare))
    reps = written(sets.where("n > 0").groupBy("h", "k").agg(F.min("id").alias("id"), F.min_by(F.struct("n", "p", "s"), "id").alias("of")).select("h", "k", "id", "of.*"))
    met = written(possible_pairs(reps, percent, block).distinct())
    ids = written(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = written(own.join(ids, "id", "left_semi").select("id", w.alias("w")).dropDuplicates(["id"]))
    # those before which nothing is: most of what goes resembles one of them
    stays = met.select("a").distinct().join(met.select(F.col("b").alias("a")), "a", "left_anti")
    links = written(_confirmed(met.join(stays, "a", "left_semi"), held, percent))
    gone = written(links.select(F.col("b").alias("gone")).distinct())
    rest = lambda pairs, out: pairs.join(out, F.col("a") == F.col("gone"), "left_anti").join(out, F.col("b") == F.col("gone"), "left_anti")
    open_ = written(_confirmed(rest(met.join(stays, "a", "left_anti"), gone), held, percent))
    while not open_.isEmpty():
        first = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        goes = written(open_.join(first, "a", "left_semi").select(F.col("b").alias("gone")).distinct())
        open_ = written(rest(open_, goes))
        gone = gone.union(goes)
    late = met.join(stays, "a", "left_anti").join(gone, F.col("a") == F.col("gone"), "left_anti")
    to = links.union(_confirmed(late, held, percent)).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
    classed = written(reps.select("h", "k", F.col("id").alias("rep"), "id").join(to, "id", "left").select("h", "k", "rep", "to"))
    out = sets.select("id", F.col("n").alias("n_words"), "h", "k").join(classed, ["h", "k"], "left")
    kept = F.coalesce(F.col("to").isNull() & (F.col("id") == F.col("rep")), F.lit(True))
    return out.select(F.col("id").alias(id), "n_words", kept.alias("kept"), F.when(~kept, F.coalesce("to", "rep")).alias("resembles"))


def retrieve(lessons: DataFrame, like: Mapping[str, object], k: int = 8) -> DataFrame:
    """The k lessons whose fingerprint (columns kind, n_vars, noise, dims, boundary, good) is most like: lesson, score."""
    same = lambda c, w: F.when(F.col(c).eqNullSafe(F.lit(like[c])), F.lit(w)).otherwise(F.lit(0.0))
    score = same("kind", 2.0) + same("n_vars", 0.5) + same("dims", 0.5) + same("boundary", 0.3) + F.when(F.col("good"), 0.3).otherwise(0.0)
    if like.get("noise") is not None:
        score = score + F.coalesce(1 / (1 + F.abs(F.col("noise") - F.lit(like["noise"])) * 20), F.lit(0.0))
    return lessons.select("lesson", score.alias("score")).orderBy(F.desc("score"), "lesson").limit(k)
