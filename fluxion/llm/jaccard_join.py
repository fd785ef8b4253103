"""Similarity join of shingle sets by partition of the universe: pigeonhole over segments, deletions of one, costs, exact check.

Sets of one size band are cut at the same `segments` equal ranges of the 64-bit hash of a shingle. Two sets that overlap by
`percent` differ in at most H shingles, so in at most H segments; of values v[i] from -1, 0, 1 with a sum of v[i] + 1 over H,
one segment differs by v[i] shingles at most (-1: not asked). Bands are as wide as the similarity allows, so a set meets
partners of its own band and the next lower one only, and asks in those two (`Plan`).

1. Every whole text becomes its set of distinct shingles; its size, a fingerprint and the keys of its segments in both bands
   leave the scan. Equal sets form classes; the smallest doc_id stands for its class from here on.
2. Keys are counted, those of several sets go into a bitmap of bounded size. Similar sets differ in H segments at most, so all but H
   of a set's segments have shared keys (`_companions`): sets with fewer are done with, and only the full sets of the others are fetched.
   Index: the keys of all segments of a set in its own band, counted again among these sets.
3. Allocation (`_allocate`): a set asks with segments of cheap keys, 0 each, as many as H needs; costly and empty ones are
   left out (-1). Where cheap ones are too few, those of two shingles or more are asked with one deletion (1), and only then
   costly ones. A set's choice is its own: the index has everything that it may ask for.
4. One-deletion neighbourhoods: the keys asked with a deletion go into a bitmap; from full sets come, of sets in the index, the
   keys without one shingle that are asked for, and of sets that have such a key themselves its keys without one shingle: one key
   for each shingle and band at most, whatever a group's size.
5. In a bucket of equal keys the smallest set that asks is compared with all others; links contract to components. Buckets that
   still hold several components are dealt out in blocks of bounded size, and sets of different components are compared there
   (`_dealt`). Both times a bound comes first: two bitmaps of parities, two bits or more for a shingle, differ in no more bits than
   the sets do in shingles. Full sets decide on what passes it. So no group lands in one task, no copies are
   compared twice, and no link between components is lost.

Sets are sets of 64-bit hashes of whole shingles: two different shingles of a pair agree by chance once in 2**64.

Defined cases: null, empty or blank text has an empty set and links with nothing. Rows that share a doc_id are one document. A
row with null doc_id is never linked and its component_id is null. Extra columns are ignored. An empty table gives an empty
result. Very small sets (H = 0) link with equal sets only, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .graph import components
from .near_dup import _alike, _verify, full_sets
from .support import fields, id_type, lists, map_arrow, materialise

SHINGLE, PERCENT = 4, 85
#: Sets that may share a key before it counts as costly; spare segments for each that H needs; members and shingles of a block.
COSTLY, SPARE, BLOCK, BLOCK_SHINGLES = 32, 0.25, 1024, 500_000
#: Pairs, or words of bitmaps, that are compared at a time; rows of a slot.
CELLS, SLOT = 1 << 20, 20_000
_U = np.uint64
_ODD, _STEP, _SEED = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9
_FILTER_BITS = (1 << 20, 1 << 29)


class Plan:
    """Bands of set sizes, their numbers of segments and how many shingles similar sets may differ in."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def to(self, size: int) -> np.ndarray:
        """Smallest sizes of the bands, up to one beyond size."""
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, -(-100 * self.low[-1] // self.percent)))
        return np.array(self.low)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.to(int(sizes.max(initial=0)) + 1), sizes, "right") - 1

    def differ(self, a: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most shingles in which a set of size a and a similar one of the band differ: 100 i >= percent (a + b - i) for i in both."""
        low = self.to(int(a.max(initial=0)) * 100 // self.percent + 2)
        partner = np.minimum(low[band + 1] - 1, 100 * a // self.percent)
        return (100 - self.percent) * (a + partner) // (100 + self.percent)

    def segments(self, band: np.ndarray) -> np.ndarray:
        """Segments of a band: as many as any of its pairs need, and some to spare; one if all its pairs are equal sets."""
        low = self.to(int(self.low[int(band.max(initial=0)) + 1 if len(self.low) > int(band.max(initial=0)) + 1 else -1]))
        top = low[np.maximum(band, 0) + 1] - 1
        need = (100 - self.percent) * (top + 100 * top // self.percent) // (100 + self.percent)
        return np.where(need > 0, need + 1 + np.ceil(SPARE * (need + 1)).astype(np.int64), 1)


def _bitmaps(parts: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bitmap of each set: whether an odd number of shingles falls on a bit; as many bits as the power of two from twice its size on, 64 at least."""
    n = np.diff(offsets)
    bits = 1 << np.maximum(6, 1 + np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(n)), n)
    hits = np.bincount(base[doc] + (parts & (bits[doc] - 1).astype(_U)).astype(np.int64), minlength=base[-1])
    packed = np.packbits(hits.astype(np.uint8) & 1, bitorder="little")
    return [packed[s:e].tobytes() for s, e in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of the same set with `size` words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, _U).reshape(-1, size), axis=0)


def _near_by_bits(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) whose bitmaps a and b (of sets of na and nb shingles) differ in no more bits than similar sets do in shingles."""
    schema = fields(("src", id_type(pairs, "src")), ("dst", id_type(pairs, "src")))

    def test(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for a, b, na, nb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            size = min(len(a), len(b)) // 8
            keep.append((100 + percent) * int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()) <= (100 - percent) * (na + nb))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=schema.names).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.select("src", "dst", "a", "b", "na", "nb"), test, schema)


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, hashes sorted within documents and distinct, offsets) for runs of whole documents."""
    for i, j, hashed, offsets in K.words(column, K.NOT_SPACE):
        parts, at = K.shingles(hashed, offsets, shingle)
        doc = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((parts, doc))
        parts, doc = parts[order], doc[order]
        new = np.ones(len(parts), bool)
        new[1:] = (parts[1:] != parts[:-1]) | (doc[1:] != doc[:-1])
        yield i, j, parts[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=j - i))])


def _segments(parts: np.ndarray, offsets: np.ndarray, band: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document in the given band (-1: none): offsets of its segments, sums and numbers of shingles in them, and the segment of each shingle."""
    m = np.where(band >= 0, plan.segments(np.maximum(band, 0)), 0)
    base = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(m)), np.diff(offsets))
    cell = (base[doc].astype(_U) + ((parts >> _U(32)) * m[doc].astype(_U) >> _U(32))).astype(np.int64)
    inside = m[doc] > 0
    count = np.bincount(cell[inside], minlength=base[-1])
    total = np.concatenate([np.zeros(1, _U), np.cumsum(K.mix(parts[inside] + _ODD), dtype=_U)])
    ends = np.cumsum(count)
    return base, total[ends] - total[ends - count], count, np.where(inside, cell, -1)


def _keys(sums: np.ndarray, count: np.ndarray, base: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The key of each segment: of its band, its place and its shingles."""
    m = np.diff(base)
    place = np.arange(base[-1]) - np.repeat(base[:-1], m)
    return K.mix(sums + count.astype(_U) * _STEP + K.mix(np.repeat(band, m).astype(_U) << _U(40) | place.astype(_U)))


#: Where in a key the three slots of a filter are read.
_SHIFTS = (0, 17, 34)


class _Bits:
    """Membership in a set of keys by a Bloom filter of bounded size, 16 bits and three slots a key: never a false no."""

    def __init__(self, keys: DataFrame):
        count = keys.count()
        self.size = min(_FILTER_BITS[1], max(_FILTER_BITS[0], 1 << (16 * count).bit_length()))
        slots = keys.select(F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(self.size - 1)) for s in _SHIFTS])).alias("slot"))
        found = slots.select(F.shiftright("slot", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
        words = np.zeros(self.size // 64, np.int64)
        words[found["w"].to_numpy()] = found["b"].to_numpy()
        self.words, self.any = keys.sparkSession.sparkContext.broadcast(words.view(_U)), count > 0

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in _SHIFTS:
            slot = keys >> _U(s) & _U(self.size - 1)
            out &= (self.words.value[slot >> _U(6)] >> (slot & _U(63))) & _U(1) != 0
        return out


def _bands(sizes: np.ndarray, plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bands in which sets of these sizes have partners, own and next lower (-1: none), and how many shingles they may differ in there."""
    own = plan.band(np.maximum(sizes, 1))
    out = []
    for band in (own, own - 1):
        differ = plan.differ(sizes, np.maximum(band, 0))
        out.append((np.where((band >= 0) & (sizes > 0) & (differ > 0), band, -1), differ))
    return out


def set_sketches(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (fingerprint; null if empty), and for the own and the lower band keys and numbers of shingles of segments."""
    schema = fields(("doc_id", id_type(docs)), ("n_shingles", "long"), ("set_a", "long"), ("set_b", "long"), ("bits", "binary"), *((n, t) for k in "01" for n, t in ((f"key{k}", "array<long>"), (f"count{k}", "array<int>"))))

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        for i, j, parts, offsets in _sets(batch.column(1), shingle):
            n = np.diff(offsets)
            full = n > 0
            a, b = np.zeros(len(n), _U), np.zeros(len(n), _U)
            if len(parts):
                a[full] = np.bitwise_xor.reduceat(parts, offsets[:-1][full])
                b[full] = np.add.reduceat(K.mix(parts), offsets[:-1][full])
            out = [batch.column(0).slice(i, j - i), pa.array(n), pa.array(K.mix(a).view(np.int64), mask=~full), pa.array(b.view(np.int64), mask=~full)]
            out.append(pa.array(_bitmaps(parts, offsets), pa.binary()))
            for band, _ in _bands(n, plan):
                base, sums, count, _ = _segments(parts, offsets, band, plan)
                out += [lists(_keys(sums, count, base, band).view(np.int64), base), lists(count.astype(np.int32), base)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return map_arrow(docs.select("doc_id", "text"), sketch, schema)


def _allocate(key: np.ndarray, count: np.ndarray, costly: np.ndarray, differ: int) -> np.ndarray:
    """v of each segment, -1, 0 or 1, with a sum of v + 1 over `differ`: cheap segments first, then their deletions, then costly ones."""
    v = np.full(len(key), -1, np.int8)
    need = differ + 1
    order = np.lexsort((-count, costly | (count == 0)))  # large ones are rarer
    cheap = order[: int(np.count_nonzero(~costly & (count > 0)))]
    v[cheap[:need]] = 0
    need -= min(need, len(cheap))
    more = cheap[count[cheap] > 1][:need]
    v[more] = 1
    need -= len(more)
    if need:  # all segments are more than any pair can differ in
        v[order[len(cheap) : len(cheap) + need]] = 0
        need -= min(need, len(order) - len(cheap))
    if need:
        raise AssertionError("a band has too few segments")
    return v


def _nested(column: pa.Array) -> np.ndarray:
    """Offsets of the lists of a column, from 0."""
    return np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])


def _keyed(sketch: DataFrame) -> DataFrame:
    return sketch.where("doc_id is not null and (size(key0) > 0 or size(key1) > 0)")


def _all_keys(sketch: DataFrame, stand: _Bits | None = None) -> DataFrame:
    """key: every segment's key in both bands. `stand` passes over most documents that stand for no class."""

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch if stand is None else batch.filter(pa.array(stand.has(batch.column(2).to_numpy().view(_U))))
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([batch.column(k).flatten()], names=["key"])

    return map_arrow(_keyed(sketch).select("key0", "key1", F.xxhash64("doc_id").alias("h")), keys, fields(("key", "long")))


def _companions(sketch: DataFrame, stand: _Bits, shared: _Bits, percent: int) -> DataFrame:
    """The rows of sketch whose sets share as many segments with others as a similar pair shares.

    A pair that differs in D shingles has equal shingles in all but D segments at most, so of a set's segments with shingles all but
    D have shared keys. For partners that a set asks in the lower band D is at most `Plan.differ`; in its own, where larger ones ask
    too, the bound for the largest.
    """
    kept = [x.name for x in sketch.schema.fields]
    schema = fields(*((x.name, x.dataType) for x in sketch.schema.fields))

    def test(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        batch = batch.filter(pa.array(stand.has(batch.column("h").to_numpy().view(_U))))
        n, keep = batch.column("n_shingles").to_numpy(), np.zeros(batch.num_rows, bool)
        most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
        for k, (_, differ) in enumerate(_bands(n, plan)):
            column = batch.column(f"key{k}")
            key, count, at = column.flatten().to_numpy().view(_U), batch.column(f"count{k}").flatten().to_numpy(), _nested(column)
            full = np.concatenate([[0], np.cumsum(count > 0)])
            alone = np.concatenate([[0], np.cumsum((count > 0) & ~shared.has(key))])
            keep |= (full[at[1:]] > full[at[:-1]]) & (alone[at[1:]] - alone[at[:-1]] <= (differ if k else most))
        yield batch.filter(pa.array(keep)).select(kept)

    return map_arrow(_keyed(sketch).withColumn("h", F.xxhash64("doc_id")), test, schema)


def _allocated(sketch: DataFrame, costly: _Bits, percent: int, wanted: list[_Bits] | None) -> DataFrame:
    """key, doc_id, asks: of wanted keys, those that a set has in its own band, or asks for in either; without `wanted`, the keys asked with a deletion."""
    schema = fields(("key", "long"), ("doc_id", id_type(sketch)), ("asks", "boolean"))

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        for k, (_, differ) in enumerate(_bands(batch.column(1).to_numpy(), plan)):
            column, counts = batch.column(2 + 2 * k), batch.column(3 + 2 * k)
            key, count, at = column.flatten().to_numpy().view(_U), counts.flatten().to_numpy(), _nested(column)
            dear, v = costly.has(key), np.full(len(key), -1, np.int8)
            for d in np.flatnonzero(np.diff(at)).tolist():
                v[at[d] : at[d + 1]] = _allocate(key[at[d] : at[d + 1]], count[at[d] : at[d + 1]], dear[at[d] : at[d + 1]], int(differ[d]))
            if wanted is None:
                keep = v > 0
            else:
                keep = (v >= 0) if k else np.ones(len(key), bool)
                keep &= np.logical_or.reduce([w.has(key) for w in wanted])
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), batch.column(0).take(pa.array(np.searchsorted(at, keep, "right") - 1)), pa.array(v[keep] >= 0)], names=schema.names)

    return map_arrow(_keyed(sketch).select("doc_id", "n_shingles", "key0", "count0", "key1", "count1"), ask, schema)


def _neighbourhoods(sets: DataFrame, asked: _Bits, percent: int) -> DataFrame:
    """key, doc_id, asks: keys of sets (doc_id, shingles) without one shingle, as far as such keys are asked for or have the segment asked for itself."""
    schema = fields(("key", "long"), ("doc_id", id_type(sets)), ("asks", "boolean"))

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent)
        size = pc.binary_length(batch.column(1)).to_numpy() // 8
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_SHINGLES, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)], strict=True):
            ids, n = batch.column(0).slice(i, j - i), size[i:j]
            parts = np.frombuffer(b"".join(batch.column(1).slice(i, j - i).to_pylist()), _U)
            doc, offsets = np.repeat(np.arange(j - i), n), np.concatenate([[0], np.cumsum(n)])
            for k, (band, _) in enumerate(_bands(n, plan)):
                base, sums, count, cell = _segments(parts, offsets, band, plan)
                own = np.flatnonzero(cell >= 0)
                c = cell[own]
                m = np.diff(base)
                place = np.arange(base[-1]) - np.repeat(base[:-1], m)
                salt = K.mix(np.repeat(band, m).astype(_U) << _U(40) | place.astype(_U))
                less = K.mix(sums[c] - K.mix(parts[own] + _ODD) + (count[c] - 1).astype(_U) * _STEP + salt[c])
                asks = asked.has(_keys(sums, count, base, band))[c]
                for which, flag in ((asks, True), *([(asked.has(less), False)] if k == 0 else [])):
                    at = np.flatnonzero(which)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(less[at].view(np.int64)), ids.take(pa.array(doc[own[at]])), pa.array(np.full(len(at), flag))], names=schema.names)

    return map_arrow(sets.select("doc_id", "shingles"), emit, schema)


def _blocks(rest: DataFrame, block: int) -> DataFrame:
    """key, major (the largest component), n1 and n2 (blocks of it and of the others) of buckets of several components. rest: key, comp, n_shingles."""
    counted = materialise(rest.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")))
    majors = materialise(counted.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1").select("key", F.col("m.comp").alias("major")))
    blocks = [
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / block), F.ceil(F.sum(F.when(which, F.col("s")).otherwise(0)) / BLOCK_SHINGLES)).cast("int").alias(n)
        for n, which in (("n1", F.col("comp") == F.col("major")), ("n2", F.col("comp") != F.col("major")))
    ]
    return materialise(counted.join(majors, "key").groupBy("key", "major").agg(*blocks))


def _dealt(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of buckets, each in all the groups (key, kind, p, q) in which blocks of the largest component meet those of others (kind 0), or these one another."""
    return (
        rest.join(sizes, "key")
        .withColumn("mine", F.col("comp") == F.col("major"))
        .withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.greatest(F.lit(1), F.when(F.col("mine"), F.col("n1")).otherwise(F.col("n2")))).cast("int"))
        .select("key", "doc_id", "comp", "mine", F.expr("""explode(
            if(mine, transform(sequence(0, n2 - 1), x -> struct(0 as kind, own as p, x as q)),
               concat(transform(sequence(0, n1 - 1), x -> struct(0 as kind, x as p, own as q)),
                      transform(sequence(0, n2 - 1), x -> struct(1 as kind, least(own, x) as p, greatest(own, x) as q))))) as to"""))
        .select(F.xxhash64("key", "to.kind", "to.p", "to.q").alias("part"), F.col("to.kind").alias("kind"), "doc_id", "comp", "mine")
    )


def _met(part: np.ndarray, kind: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a part, some CELLS at a time: those outside the largest component with those in it (kind 0) or one another. Rows come sorted by (part, mine)."""
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    size = np.diff(np.append(new, len(part)))
    end, others = np.repeat(new + size, size), np.repeat(new + np.add.reduceat(~mine, new, dtype=np.int64), size)
    left = np.flatnonzero(~mine)
    low, high = np.where(kind[left] == 0, others[left], left + 1), end[left]
    total = np.concatenate([[0], np.cumsum(high - low)])
    s = 0
    while s < len(left):
        e = max(s + 1, int(np.searchsorted(total, total[s] + CELLS, "right")) - 1)
        n = high[s:e] - low[s:e]
        yield np.repeat(left[s:e], n), np.arange(total[e] - total[s]) + np.repeat(low[s:e] - (total[s:e] - total[s]), n)
        s = e


def _near_rows(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of different components that meet in a part and whose sizes and bitmaps allow a link; a pair that meets in several parts once. Rows come sorted by (part, mine)."""
    doc = group["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.unique(doc, return_index=True)[1]
    comp, size = group["comp"].combine_chunks().dictionary_encode().indices.to_numpy(), group["n"].to_numpy()
    bits = group["bits"].take(pa.array(first)).to_pylist()
    words = np.array([len(x) // 8 for x in bits])
    # sets of a pair are of like sizes: the bitmap of one has as many words as the other's, or twice as many
    folded, place = {}, {}
    for w in np.unique(words).tolist():
        of = np.flatnonzero((words == w) | (words == 2 * w))
        folded[w], place[w] = np.array([_folded(bits[k], w) for k in of.tolist()]), np.zeros(len(bits), np.int64)
        place[w][of] = np.arange(len(of))
    found = []
    for a, b in _met(group["part"].to_numpy(), group["kind"].to_numpy(), group["mine"].to_numpy()):
        may = (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        a, b = a[may], b[may]
        pair, at = np.unique(np.minimum(doc[a], doc[b]).astype(np.int64) * len(bits) + np.maximum(doc[a], doc[b]), return_index=True)
        a, b = a[at], b[at]
        x, y, bound = doc[a], doc[b], (100 - percent) * (size[a] + size[b])
        width = np.minimum(words[x], words[y])
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            for at in np.array_split(of, len(of) * w // CELLS + 1):
                apart = np.bitwise_count(folded[w][place[w][x[at]]] ^ folded[w][place[w][y[at]]]).sum(axis=1, dtype=np.int64)
                at = at[(100 + percent) * apart <= bound[at]]
                found.append((pair[at], a[at], b[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair, a, b = (np.concatenate(k) for k in zip(*found, strict=True))
    at = np.unique(pair, return_index=True)[1]
    return a[at], b[at]


_BY_PART = [("part", "ascending"), ("mine", "ascending")]


def _possible(dealt: DataFrame, sized: DataFrame, percent: int, slots: int) -> DataFrame:
    """The rows of dealt whose set may be similar to one of another component in its part. Slots of many parts come to a task together, and a pair counts in one part of a slot."""
    schema = fields(*((x.name, x.dataType) for x in dealt.schema.fields))

    def test(group: pa.Table) -> pa.Table:
        group = group.sort_by(_BY_PART)
        return group.select(schema.names).take(pa.array(np.unique(np.concatenate(_near_rows(group, percent)))))

    return dealt.withColumn("slot", F.pmod("part", F.lit(slots))).join(sized, "doc_id").groupBy("slot").applyInArrow(test, schema)


def _between(dealt: DataFrame, percent: int) -> DataFrame:
    """Links between components within the parts of _dealt, whose members come with sizes, bitmaps and full sets."""
    kind = id_type(dealt)
    schema = fields(("src", kind), ("dst", kind))

    def test(group: pa.Table) -> pa.Table:
        group = group.sort_by(_BY_PART)
        ids, comp, sets = (group[name].to_pylist() for name in ("doc_id", "comp", "shingles"))
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        src, dst = [], []
        for a, b in zip(*(k.tolist() for k in _near_rows(group, percent)), strict=True):
            x, y = root(comp[a]), root(comp[b])
            if x != y and _alike(np.frombuffer(sets[a], _U), np.frombuffer(sets[b], _U), percent):
                parent[max(x, y)] = min(x, y)
                src.append(ids[a])
                dst.append(ids[b])
        to = group.schema.field("doc_id").type
        return pa.table({"src": pa.array(src, to), "dst": pa.array(dst, to)})

    return dealt.groupBy("part").applyInArrow(test, schema)


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, costly: int = COSTLY, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links)."""
    sketch = materialise(set_sketches(docs, shingle, percent))
    classes = materialise(sketch.where("set_a is not null and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id"))
    # most keys are one set's alone, and most sets share fewer than a similar pair does: these go before anything is compared
    stand = _Bits(reps.select(F.xxhash64("doc_id").alias("key")))
    shared = _Bits(materialise(_all_keys(sketch, stand).groupBy("key").count().where("count > 1").select("key")))
    few = materialise(_companions(sketch, stand, shared, percent).join(reps, "doc_id", "left_semi"))
    stay = materialise(few.select("doc_id").distinct())
    sets = materialise(full_sets(docs, stay, shingle).dropDuplicates(["doc_id"]))
    several = materialise(_all_keys(few).groupBy("key").count().where("count > 1"))
    dear = _Bits(several.where(F.col("count") > costly))
    deletions = _Bits(materialise(_allocated(few, dear, percent, None).select("key").distinct()))
    wanted, near = [_Bits(several)], None
    if deletions.any:
        near = materialise(_neighbourhoods(sets, deletions, percent))
        wanted.append(_Bits(near.select("key").distinct()))
    entries = _allocated(few, dear, percent, wanted)
    entries = materialise(entries.unionByName(near) if near is not None else entries)
    # the smallest set that asks leads its bucket; buckets of one set, or where none asks, go
    buckets = materialise(
        entries.groupBy("key")
        .agg(F.min(F.when(F.col("asks"), F.col("doc_id"))).alias("leader"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo <> hi and leader is not null")
        .select("key", "leader")
    )
    members = materialise(entries.select("key", "doc_id").join(buckets, "key").where("doc_id <> leader"))
    pairs = members.select(F.least("leader", "doc_id").alias("src"), F.greatest("leader", "doc_id").alias("dst")).distinct()
    sized = few.select("doc_id", F.col("n_shingles").alias("n"), "bits")
    sized = materialise(sized.join(members.select("doc_id").union(members.select("leader")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    likely = materialise(
        _near_by_bits(
            pairs.join(sized.toDF("src", "na", "a"), "src").join(sized.toDF("dst", "nb", "b"), "dst").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")), percent
        )
    )
    links = materialise(_verify(likely, sets, percent))
    comp = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    rest = members.select("key", "doc_id").distinct().join(comp, "doc_id", "left").join(sized, "doc_id")
    rest = materialise(rest.select("key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("comp")))
    dealt = materialise(_dealt(rest, _blocks(rest, block)))
    possible = materialise(_possible(dealt, sized, percent, dealt.count() // SLOT + 1))
    more = materialise(_between(possible.join(sized, "doc_id").join(sets, "doc_id"), percent))
    comps = components(links.union(more))
    classed = materialise(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component")))
    return (
        sketch.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(classed, ["set_a", "set_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


#: The same result by comparing every pair that shares a shingle: exact, for tables of a few thousand documents.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, u.b FROM reach r JOIN u ON r.seen = u.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
