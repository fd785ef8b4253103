"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its letters' vectors,
rotated by their places: rot(rot(a) * b) * c. A document's vector bundles (sums) the vectors of its trigrams, a language's
prototype bundles the unit vectors of its documents, and a document gets the language whose prototype has the largest cosine.
Letters are lower-cased, everything else is one blank, and texts are read whole.

Learning reads only text and lang of the rows given. Prototypes are sums over partitions (map-side partial sums), a row for
each language; languages number at most MAX_LANGUAGES, which is checked, so the broadcast is bounded.

Defined cases: text that is null or has no letter gives `und` and score 0. Without a learned language all texts give `und`.
Equal cosines go to the language first in order. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix
from .support import crc32_text, fields, id_type, map_arrow, sampled

DIMENSIONS, MAX_LANGUAGES, SLICE = 1024, 5000, 1_000_000
#: Rows to learn from, about: all if there are fewer, else a share of them by hash of doc_id.
SAMPLE = 20_000


@lru_cache(1)
def _folding() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 if it is no letter, over the whole code space."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low[0]) if low[0].isalpha() else c
    return out


@lru_cache(65536)
def letter(code: int, dimensions: int) -> np.ndarray:
    words = mix((np.arange(1, dimensions // 64 + 1, dtype=np.uint64) + np.uint64(code << 20)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """float32 (n, dimensions) of trigrams given as (n, 3) code points (0: blank)."""
    alphabet, place = np.unique(codes, return_inverse=True)
    place = place.reshape(codes.shape)
    base = np.stack([letter(int(c), dimensions) for c in alphabet])
    out = np.roll(base, 2, axis=1)[place[:, 0]]
    out = out * np.roll(base, 1, axis=1)[place[:, 1]]
    return (out * base[place[:, 2]]).astype(np.float32)


def profiles(texts: pa.Array, dimensions: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last + 1, vectors) of runs of documents; a vector of zeros has no letter. A long text is summed in slices."""
    n, i = len(texts), 0
    texts = [t or "" for t in texts.to_pylist()]
    size = [len(t) for t in texts]
    while i < n:
        j, held = i, 0
        while j < n and j - i < 256 and (j == i or held + size[j] <= SLICE):
            held += size[j]
            j += 1
        own = texts[i:j]
        total = np.zeros((j - i, dimensions), np.float32)
        for lo in range(0, max([1, *map(len, own)]), SLICE):
            part = [t[max(0, lo - 2) : lo + SLICE] if lo else t[:SLICE] for t in own]
            _bundle(part, total, opening=lo == 0)
        yield i, j, total
        i = j


def _distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (all below `size`) in order, and every key's place among them; sorts only where a table would be large beside the keys."""
    if size > 8 * len(keys):
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[keys] = True
    values = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[values] = np.arange(len(values), dtype=np.int32)
    return values, place[keys]


def _counted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (all below `size`) in order, and how often each occurs."""
    if size > 8 * len(keys):
        return np.unique(keys, return_counts=True)
    counts = np.bincount(keys, minlength=size)
    values = np.flatnonzero(counts)
    return values, counts[values]


def _bundle(own: list[str], total: np.ndarray, opening: bool) -> None:
    fold = _folding()
    flat = np.frombuffer(" ".join(own).encode("utf-32-le", "surrogatepass"), np.int32)
    folded = fold[flat]
    blank = folded == 0
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))  # one blank between words
    bounds = np.cumsum([0, *[len(t) + 1 for t in own]])[:-1]
    keep[bounds[1:] - 1] = True
    doc = np.searchsorted(bounds, np.flatnonzero(keep), "right") - 1
    codes = np.concatenate([[0], folded[keep], [0]])
    if len(codes) < 3:
        return
    alphabet, place = _distinct(codes, 0x110000)
    a, place = len(alphabet), place.astype(np.int64)
    key = (place[:-2] * a + place[1:-1]) * a + place[2:]
    middle = codes[1:-1] != 0
    owner = doc[: len(key)][middle]
    grams, gram = _distinct(key[middle], a**3)
    if not len(grams):
        return
    pairs, counts = _counted(owner * len(grams) + gram, len(own) * len(grams))
    triples = np.stack([alphabet[grams // (a * a)], alphabet[grams // a % a], alphabet[grams % a]], axis=1)
    row, column = np.divmod(pairs, len(grams))
    for lo in range(0, len(grams), 4096):
        vectors = gram_vectors(triples[lo : lo + 4096], total.shape[1])
        inside = (column >= lo) & (column < lo + 4096)
        table = np.zeros((total.shape[0], len(vectors)), np.float32)
        table[row[inside], column[inside] - lo] = counts[inside]
        total += table @ vectors


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit vectors). labelled: text, lang."""
    schema = fields(("lang", "string"), ("i", "int"), ("x", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, vectors in profiles(batch.column(0), dimensions):
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
                for k in range(i, j):
                    sums.setdefault(langs[k], np.zeros(dimensions))
                    sums[langs[k]] += unit[k - i]
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(x)], names=["lang", "i", "x"])

    rows = labelled.where("lang is not null").select("text", "lang").mapInArrow(run, schema).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    packed = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    packed = sorted(packed, key=lambda r: r["lang"])
    matrix = np.array([[x["x"] for x in r["v"]] for r in packed]).reshape(len(packed), dimensions)
    matrix = np.round(matrix, 6)  # sums in any order of partitions agree
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["lang"] for r in packed], np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score ((1 + cosine) / 2), cosine."""
    sent = docs.sparkSession.sparkContext.broadcast((languages, prototypes.astype(np.float32)))
    schema = fields(("doc_id", id_type(docs)), ("lang_pred", "string"), ("score", "double"), ("cosine", "double"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for i, j, vectors in profiles(batch.column(1), table.shape[1]):
            norm = np.linalg.norm(vectors, axis=1)
            known = (norm > 0) & bool(len(names))
            cosine = (vectors @ table.T) / np.maximum(norm, 1e-9)[:, None] if len(names) else np.zeros((j - i, 1))
            best = np.round(cosine.astype(float), 6)
            at = best.argmax(axis=1)
            top = np.clip(best[np.arange(j - i), at], -1, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([names[a] if k else "und" for a, k in zip(at.tolist(), known.tolist(), strict=True)]),
                    pa.array(np.where(known, (1 + top) / 2, 0.0)),
                    pa.array(np.where(known, top, 0.0)),
                ],
                names=schema.names,
            )

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) modulo 4 isn't 2, and returns doc_id, held_out, lang_pred, score, cosine of all rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.where(sampled("doc_id", 29, sample, rows.count()))
    names, prototypes = learn(rows, dimensions)
    return identify(docs, names, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cosine")
