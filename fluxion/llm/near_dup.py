"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Every whole text becomes its set of distinct five-word shingles (64-bit hashes), a fingerprint of that set and the
   keys of `bands` bands of `rows` SuperMinHash values. Only these leave the scan.
2. Equal sets form classes; the smallest doc_id stands for its class from here on, so that exact copies cost nothing more.
3. Buckets are counted with map-side partial aggregates; those of one class go. In every other bucket, the smallest
   member is compared with all members on full sets: as many pairs as members, whatever the bucket's size.
4. Links found so are contracted to components. Buckets that still hold several components besides their leader are dealt
   out in blocks of some `block` members and BLOCK_SHINGLES shingles, and blocks of the leader's component meet blocks of the
   others, and these one another. Pairs across components whose signatures agree in `estimate` of their positions or more are
   compared on full sets; 0 compares all. LEAST_ESTIMATE lies five standard deviations below the similarity asked for: it
   passes over one pair in two million at 0.75, a fortieth of those that share no bucket. So no task gets a whole hot bucket.
5. Components of all links give component_id.

A pair at similarity s shares a bucket with probability 1 - (1 - s**rows)**bands: 0.99998 at 0.75, 0.9999999 at 0.8.
Full sets are sets of 64-bit hashes of whole shingles: two different shingles of a pair of documents agree by chance once in
2**64 pairs of shingles.

Defined cases: null, empty or blank text has an empty set and links with nothing. Rows that share a doc_id are one document.
A row with null doc_id can't be named by others: it is never linked, component_id is null and kept is true. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .graph import components
from .superminhash import signatures
from .support import fields, id_type, lists, map_arrow, materialise

ROWS, BANDS, SHINGLE, PERCENT, BLOCK = 5, 40, 5, 75, 1024
#: Shingles of a block, some 4 MB; and the share of equal signature values below which a pair is not compared.
BLOCK_SHINGLES, LEAST_ESTIMATE = 500_000, 0.6
_COEF = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    parts = signature[:, : rows * bands].reshape(len(signature), bands, rows)
    keys = (parts * _COEF[:rows]).sum(axis=2, dtype=np.uint64)
    return K.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each document."""
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = np.sort(hashes[s:e])
        out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if e > s else part)
    return out


def sketches(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (fingerprint of the set; null if empty), bands (array of keys)."""
    schema = fields(("doc_id", id_type(docs)), ("n_shingles", "long"), ("set_a", "long"), ("set_b", "long"), ("bands", "array<long>"))

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, hashed, offsets in K.words(batch.column(1), K.NOT_SPACE):
            parts, at = K.shingles(hashed, offsets, shingle)
            sets = distinct(parts, at)
            n = np.array([len(s) for s in sets])
            a = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            b = np.array([K.mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            keys = band_keys(signatures(parts, at, rows * bands), rows, bands)
            empty = n == 0
            per = np.where(empty, 0, bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(n),
                    pa.array(K.mix(a).view(np.int64), mask=empty),
                    pa.array(b.view(np.int64), mask=empty),
                    lists(keys[~empty].ravel().view(np.int64), np.concatenate([[0], np.cumsum(per)])),
                ],
                names=schema.names,
            )

    return map_arrow(docs.select("doc_id", "text"), sketch, schema)


#: Bits of the filter of ids, by their number: 16 for each, within these; more ids only let more rows through to the exact join.
_FILTER_BITS = (1 << 20, 1 << 26)


def _bits(count: int) -> int:
    return min(_FILTER_BITS[1], max(_FILTER_BITS[0], 1 << (16 * count).bit_length()))


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for hash(id) modulo `bits`, gathered as at most 2**20 words of 64 bits: 8 MB at most."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    found = (
        ids.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(b)").alias("b"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and shingles (sorted 64-bit hashes as bytes) of the documents whose ids are in wanted (distinct doc_id).

    A broadcast bitmap of bounded size keeps other texts out of the shuffle; the exact semi-join follows.
    """
    spark = docs.sparkSession
    size = _bits(wanted.count())
    bits = spark.sparkContext.broadcast(_bitmap(wanted, size))
    schema = fields(("doc_id", id_type(docs)), ("shingles", "binary"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    source = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("b")
    )

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = (bits.value[batch.column(2).to_numpy()] & batch.column(3).to_numpy()) != 0
        part = batch.filter(pa.array(hit))
        if not part.num_rows:
            return
        for i, j, hashed, offsets in K.words(part.column(1), K.NOT_SPACE):
            found = [s.tobytes() for s in distinct(*K.shingles(hashed, offsets, shingle))]
            yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(found, pa.binary())], names=schema.names)

    return map_arrow(source, sets, schema).join(wanted, "doc_id", "left_semi")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) whose full sets are alike."""
    kind = id_type(pairs, "src")
    schema = fields(("src", kind), ("dst", kind))
    joined = pairs.join(sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("b")), "dst").join(
        sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("a")), "src"
    )

    def test(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = [_alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=schema.names).filter(pa.array(keep))

    return map_arrow(joined.select("src", "dst", "a", "b"), test, schema)


def _across(entries: DataFrame, sets: DataFrame, percent: int, rows: int, bands: int, estimate: float) -> DataFrame:
    """Links between components within buckets.

    entries: key, doc_id, comp, major (the component of the bucket's leader), n1 and n2 (blocks of that and of the other
    components' members); the leader itself has been compared with all before. A pair is compared in the first bucket that it
    shares, and only until its two components are joined within the group.
    """
    kind = id_type(entries)
    schema = fields(("src", kind), ("dst", kind))
    dealt = (
        entries.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.greatest(F.lit(1), F.when(F.col("comp") == F.col("major"), F.col("n1")).otherwise(F.col("n2")))).cast("int"))
        .withColumn("to", F.expr("""
            if(comp = major,
               transform(sequence(0, n2 - 1), x -> struct(0 as kind, own as p, x as q, 0 as side)),
               concat(if(n1 > 0, transform(sequence(0, greatest(n1, 1) - 1), x -> struct(0 as kind, x as p, own as q, 1 as side)), array()),
                      transform(sequence(0, n2 - 1), x -> struct(1 as kind, least(own, x) as p, greatest(own, x) as q, own as side))))"""))
        .select("key", "doc_id", "comp", F.explode("to").alias("to"))
        .select("key", "doc_id", "comp", "to.*")
        .join(sets, "doc_id")
    )

    def test(key: tuple, group: pa.Table) -> pa.Table:
        band_key, kind, p, q = (k.as_py() for k in key)
        group = group.sort_by("doc_id")
        ids, comp, side = group["doc_id"].to_pylist(), group["comp"].to_pylist(), group["side"].to_numpy()
        members = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        size = np.array([len(s) for s in members])
        offsets = np.concatenate([[0], np.cumsum(size)])
        signature = signatures(np.concatenate(members), offsets, rows * bands)
        keys = band_keys(signature, rows, bands).view(np.int64)
        before = keys[:, : int((keys[0] == band_key).argmax())]
        short = (signature & np.uint64(0xFFFF)).astype(np.uint16)
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        src, dst = [], []
        # all of this group's pairs: those of two sides, or all if a block meets itself
        for a in np.flatnonzero(side == 1).tolist() if kind == 0 else range(len(ids)):
            with_ = np.flatnonzero(side == 0) if kind == 0 else a + 1 + np.flatnonzero(side[a + 1 :] != side[a]) if p != q else np.arange(a + 1, len(ids))
            with_ = with_[100 * np.minimum(size[with_], size[a]) >= percent * np.maximum(size[with_], size[a])]
            with_ = with_[(short[with_] == short[a]).mean(axis=1) >= estimate] if len(with_) else with_
            if before.shape[1] and len(with_):
                with_ = with_[~(before[with_] == before[a]).any(axis=1)]
            for b in with_.tolist():
                x, y = root(comp[a]), root(comp[b])
                if x != y and _alike(members[a], members[b], percent):
                    parent[max(x, y)] = min(x, y)
                    src.append(ids[a])
                    dst.append(ids[b])
        to = group.schema.field("doc_id").type
        return pa.table({"src": pa.array(src, to), "dst": pa.array(dst, to)})

    return dealt.groupBy("key", "kind", "p", "q").applyInArrow(test, schema)


def near_duplicates(
    docs: DataFrame, rows: int = ROWS, bands: int = BANDS, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, estimate: float = LEAST_ESTIMATE
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    sketch = materialise(sketches(docs, rows, bands, shingle))
    classes = (
        sketch.where("set_a is not null and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    entries = materialise(classes.select(F.explode("bands").alias("key"), F.col("rep").alias("doc_id"), "n_shingles"))
    buckets = materialise(
        entries.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    )
    members = materialise(entries.join(buckets, "key").where("doc_id <> leader"))
    pairs = members.select(F.col("leader").alias("src"), F.col("doc_id").alias("dst")).distinct()
    wanted = pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).distinct()
    sets = materialise(full_sets(docs, materialise(wanted), shingle))
    links = materialise(_verify(pairs, sets, percent))
    comps = components(links)
    comp = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    named = lambda column: F.coalesce("comp", column)
    rest = materialise(members.where("members > 2").join(comp, "doc_id", "left").select("key", "doc_id", "n_shingles", named("doc_id").alias("comp")))
    # counted within tasks by (bucket, component) before anything is put together by bucket
    counted = materialise(rest.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")))
    several = counted.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    leaders = buckets.where("members > 2").join(several, "key", "left_semi").select("key", F.col("leader").alias("doc_id"))
    majors = materialise(leaders.join(comp, "doc_id", "left").select("key", named("doc_id").alias("major")))
    sizes = counted.join(majors, "key").select("key", "major", (F.col("comp") == F.col("major")).alias("mine"), "n", "s")
    blocks = [
        F.greatest(F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / block), F.ceil(F.sum(F.when(which, F.col("s")).otherwise(0)) / BLOCK_SHINGLES)).cast("int").alias(n)
        for n, which in (("n1", F.col("mine")), ("n2", ~F.col("mine")))
    ]
    mixed = materialise(materialise(sizes).groupBy("key", "major").agg(*blocks))
    more = materialise(_across(rest.drop("n_shingles").join(mixed, "key"), sets, percent, rows, bands, estimate))
    comps = components(links.union(more))
    classed = classes.drop("bands").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    # written out first, so that both sides of the last join are plain exchanges and a hot class can be split
    classed = materialise(classed.select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component")))
    return (
        sketch.join(classed, ["set_a", "set_b", "n_shingles"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with one document of each group; rows with null doc_id stay."""
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias("fluxion_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("fluxion_id"), "left_semi").unionByName(docs.where("doc_id is null"))


#: The same result by comparing every pair that shares a shingle: exact, for tables of a few thousand documents.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, u.b FROM reach r JOIN u ON r.seen = u.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
