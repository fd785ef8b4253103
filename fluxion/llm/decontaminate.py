"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman scores the copies.

1. The corpus counts, for every n-gram of the test items, the documents that hold it (one row for each n-gram and task).
2. Of every `stretch` consecutive n-grams of an item, the one that fewest documents hold becomes a seed. Every stretch keeps
   a seed, however often it occurs, so that an item copied into a third of the corpus is still found.
3. Documents are joined with the seeds by hash. Hits of an item whose diagonals lie together mark a passage; the passage, with
   room at both ends, is aligned with the item word by word (match +2, mismatch -1, gap -1). The score is the alignment's
   share of the item's own 2 per word. `score` of `least` or more makes a copy, exact, edited or paraphrased in part.

Test items are the query set: they go in blocks whose texts have at most BLOCK_BYTES, so that what is broadcast is bounded;
documents never move, and a hot item costs its documents' alignments only, of which equal ones are done once in a task.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased; punctuation is skipped.

Defined cases: null or empty texts and items without a word match nothing; an item shorter than n words is its own seed.
Null item_id items are left out. Repeated items give repeated rows; repeated documents likewise. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel as K
from .support import fields, id_type

GRAM, STRETCH, LEAST, BLOCK_BYTES = 3, 2, 0.4, 32_000_000
MATCH, MISMATCH, GAP = 2, 1, 1


class Items:
    """The words and n-grams of a block of test items."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.ids, self.n = ids, n
        self.words = [np.concatenate([h for *_, h, _ in K.words(pa.array([t]), K.ALNUM)] or [np.zeros(0, np.uint64)]) for t in texts]
        self.grams = [K.shingles(w, np.array([0, len(w)]), n)[0] for w in self.words]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))
        self.short = {len(w) for w in self.words if 0 < len(w) < n}


class Lookup:
    """Places of 64-bit keys in a sorted array, behind a table of their low 20 bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << 20, bool)
        self.table[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.table[(values & np.uint64(0xFFFFF)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, values[at]), max(0, len(self.keys) - 1))
        good = self.keys[place] == values[at] if len(at) else np.zeros(0, bool)
        return at[good], place[good]


def _grams(hashed: np.ndarray, offsets: np.ndarray, n: int, short: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams, and the k-grams of every length k < n that some short item has, with their first words (global)."""
    out, at = [], []
    for k in (n, *sorted(short)):
        if len(hashed) < k:
            continue
        size = len(hashed) - k + 1
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = doc[:size] == doc[k - 1 :]
        # as one sequence; those that run over a document's end are dropped
        grams, _ = K.shingles(hashed, np.array([0, len(hashed)]), k)
        out.append(grams[inside])
        at.append(np.flatnonzero(inside))
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def document_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """For each n-gram of the items that occurs, the number of documents that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast((Lookup(items.known), items.n, items.short))
    schema = fields(("gram", "long"), ("n", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, n, short = sent.value
        total = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for _, _, hashed, offsets in K.words(batch.column(0), K.ALNUM):
                grams, at = _grams(hashed, offsets, n, short)
                where, place = lookup.find(grams)
                doc = np.searchsorted(offsets, at[where], "right") - 1
                total += np.bincount(np.unique(np.stack([doc, place]), axis=1)[1], minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most one for each n-gram of the block
    return {r["gram"]: r["n"] for r in rows}


def rare_seeds(items: Items, counts: dict[int, int], stretch: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Sorted seeds and, for each, its (item, first word)."""
    count = np.zeros(len(items.known), np.int64)
    for g, n in counts.items():
        count[g] = n
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for k, grams in enumerate(items.grams):
        place = np.searchsorted(items.known, grams)
        for lo in range(max(1, len(grams) - stretch + 1) if len(grams) else 0):
            own = place[lo : lo + stretch]
            pick = lo + int(count[own].argmin())
            found[int(place[pick])].add((k, pick))
    # every place of a seed within its items counts
    for k, grams in enumerate(items.grams):
        for p, g in enumerate(np.searchsorted(items.known, grams).tolist()):
            if g in found:
                found[g].add((k, p))
    order = sorted(found)
    return items.known[order] if order else np.zeros(0, np.uint64), [sorted(found[g]) for g in order]


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the first and last + 1 of the aligned words."""
    n = len(words)
    steps = GAP * np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(words == w, MATCH, -MISMATCH)
        up = row[1:] - GAP
        value = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(value == 0, np.arange(1, n + 1), np.where(value == diagonal, start[:-1], start[1:]))
        value, origin = np.concatenate([[0], value]), np.concatenate([[0], origin])
        lifted = value + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, start = top - steps, origin[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(start[at]), at)
    return best


class Aligner:
    def __init__(self, items: Items, seeds: np.ndarray, places: list[list[tuple[int, int]]], least: float):
        self.items, self.seeds, self.places, self.least = items, Lookup(seeds), places, least
        self.memo: dict[tuple, tuple[int, int, int]] = {}

    def passages(self, hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """(item, first, last + 1) of stretches of words to align, from (item, word, word in the item); overlaps are merged."""
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, at, to in hits:
            size = len(self.items.words[item])
            room = size // 2 + 2
            by_item[item].append((at - to - room, at - to + size + room))
        for item, own in by_item.items():
            most = 4 * len(self.items.words[item]) + 16
            lo, hi = None, None
            for a, b in sorted(own):
                if lo is None:
                    lo, hi = a, b
                elif a <= hi and b - lo <= most:
                    hi = max(hi, b)
                else:
                    yield item, lo, hi
                    lo, hi = a, max(b, hi) if a <= hi and b < hi else b
            yield item, lo, hi

    def score(self, words: np.ndarray, hits: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """For each item that the document copies: score, first and last + 1 word of the best passage."""
        out: dict[int, tuple[float, int, int]] = {}
        for item, lo, hi in self.passages(hits):
            lo, hi = max(0, lo), min(len(words), hi)
            own = words[lo:hi]
            key = (item, own.tobytes())
            if key not in self.memo:
                if len(self.memo) > 20_000:
                    self.memo.clear()
                self.memo[key] = smith_waterman(self.items.words[item], own)
            got, a, b = self.memo[key]
            share = got / (MATCH * len(self.items.words[item]))
            if share >= self.least and share > out.get(item, (0.0,))[0]:
                out[item] = (share, lo + a, lo + b)
        return out


def _copies(docs: DataFrame, items: Items, seeds: np.ndarray, places: list, least: float, item_type) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, seeds, places))
    schema = fields(("doc_id", id_type(docs)), ("item_id", item_type), ("score", "double"), ("first_word", "long"), ("last_word", "long"), ("n_words", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*sent.value, least)
        for batch in batches:
            for i, _, hashed, offsets in K.words(batch.column(1), K.ALNUM):
                grams, at = _grams(hashed, offsets, items_n, short)
                where, place = aligner.seeds.find(grams)
                hits: dict[int, list] = defaultdict(list)
                for d, a, p in zip((np.searchsorted(offsets, at[where], "right") - 1).tolist(), at[where].tolist(), place.tolist(), strict=True):
                    hits[d] += [(item, a - int(offsets[d]), to) for item, to in aligner.places[p]]
                rows = [
                    (i + d, aligner.items.ids[item], share, a, b, int(offsets[d + 1] - offsets[d]))
                    for d, own in sorted(hits.items())
                    for item, (share, a, b) in sorted(aligner.score(hashed[offsets[d] : offsets[d + 1]], own).items())
                ]
                if rows:
                    k, item, share, a, b, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(k, pa.int64())), pa.array(item, item_kind), pa.array(share), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                        names=schema.names,
                    )

    items_n, short, item_kind = items.n, items.short, to_arrow_type(item_type)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = GRAM, stretch: int = STRETCH, least: float = LEAST) -> DataFrame:
    """A row for each document and test item that it copies: doc_id, item_id, score, first_word, last_word (exclusive), n_words."""
    kind = id_type(benchmark, "item_id")
    asked = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-4 * size // BLOCK_BYTES))
    parts = []
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in own], [r["text"] for r in own], n)
        seeds, places = rare_seeds(items, document_counts(docs, items), stretch)
        parts.append(_copies(docs, items, seeds, places, least, kind))
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that copy no test item, with all their columns."""
    found = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("fluxion_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("fluxion_id"), "left_anti")
