"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features of every token of a text: its word (letters and digits, lower-cased), the word's first PREFIX bytes, and the pair of
its own and the previous token's shape (runs of small letters, capitals, digits and other signs; a repeated token has a
shape of its own). Words go to two hash tables and the less crowded bucket counts; prefixes and shapes to one each.

1. Raw model: counts of all features over all documents, whole texts. Target model: counts over labelled documents of good
   quality that are not toxic; the fit takes about FIT labelled rows, all if there are fewer, by hash of doc_id.
2. Every feature's log ratio of target to raw is shrunk by PRIOR: log((c + PRIOR) / (e + PRIOR)), e the count expected from
   the raw model. A document's weakest passage is the least sum over WINDOW consecutive tokens (over all of a shorter text).
3. That sum falls with the number of passages to choose from, and a shorter text's with its spread alone. The log weight is
   what it is above what good text of as many tokens has, by one formula for all lengths (`levelled`), whose two constants
   come from good labelled documents kept out of the fit: the mean value of a token in their first WINDOW tokens, and how
   much the least sum falls when a text grows to twice its length, over prefixes of the same document.
4. Gumbel top-k: key = SHARPNESS * log weight + Gumbel noise (from a hash of doc_id), and the k largest keys are sampled. k is
   the number of documents whose weight passes the threshold that best parts good from other labelled rows kept out of the fit.

`passages=False` weighs a document by the plain importance ratio instead, the sum of all its tokens' log ratios (of bounded features as
above), levelled by nothing, and `sharpness=1.0` samples by it with the noise of plain Gumbel top-k. Such a sum grows with the length of
a text, so that long texts are sampled and short ones are not, whatever their quality; README gives figures. Passages are the default.

The k-th key is found by counting bins of ordered keys (65,536 at a time), not by sorting in one place; ties at it are kept.

Defined cases: a text without words has log weight 0. Without labels of both kinds all documents are sampled. Documents with
null doc_id are scored and sampled alike. Repeated rows get equal keys and are sampled together; labels given several times
count once, and contradicting ones as not good. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .support import fields, id_type, map_arrow, materialise, sampled

WORD_BITS, PREFIX_BITS, SHAPE_BITS = 19, 18, 16
PREFIX, PRIOR, WINDOW, SHARPNESS, FIT = 4, 3.0, 8, 16.0, 30_000
#: Log ratios are held between these, so that no single odd shape decides and no common feature outweighs a bad one.
SHAPE_LEAST, MOST = -1.0, 0.3
_SIZES = (1 << WORD_BITS, 1 << WORD_BITS, 1 << PREFIX_BITS, 1 << SHAPE_BITS)
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)])

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_M = np.uint64


def _slots(hashed: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (K.mix(hashed + _M(salt)) >> _M(64 - bits)).astype(np.int32)


def _cut_features(part: np.ndarray, bounds: np.ndarray, carry: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Slots (4, tokens) of one stretch of bytes, whether a token has a word, tokens before each bound, and what to carry on."""
    _, start, end = K.spans(part, K.NOT_SPACE, lower=False)
    start, end = K.split_at(start, end, bounds[1:-1])
    tokens = np.searchsorted(start, bounds, "left")
    if not len(start):
        return np.zeros((4, 0), np.int32), np.zeros(0, bool), tokens, carry or (0, 0)
    raw = K.hash_spans(part, start, end)
    kind = _CLASS[part]
    keep = ~K.NOT_SPACE[part]
    keep[1:] |= kind[1:] != kind[:-1]
    keep[start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = K.hash_spans(kind[keep], place[start], place[end])
    first = np.zeros(len(start) + 1, bool)
    first[tokens[:-1]] = True
    first = first[:-1]
    before = np.concatenate([np.zeros(1, _M), raw[:-1]])
    before[first] = 0
    if carry:
        before[0] = carry[0]
    shape = np.where(raw == before, _M(1), shape)
    last = np.concatenate([np.zeros(1, _M), shape[:-1]])
    last[first] = 0
    if carry:
        last[0] = carry[1]
    low, word, stop = K.spans(part, K.ALNUM)
    word, stop = K.split_at(word, stop, bounds[1:-1])
    at = np.searchsorted(word, start, "left")
    known = at < len(word)
    known[known] = word[at[known]] < end[known]
    hashed = np.zeros(len(start), _M)
    prefix = np.zeros(len(start), _M)
    hashed[known] = K.hash_spans(low, word, stop)[at[known]]
    prefix[known] = K.hash_spans(low, word, np.minimum(stop, word + PREFIX))[at[known]]
    slots = np.stack(
        [_slots(hashed, 1, WORD_BITS), _slots(hashed, 2, WORD_BITS), _slots(prefix, 3, PREFIX_BITS), _slots(shape * _M(3) + K.mix(last), 4, SHAPE_BITS)]
    )
    return slots, known, tokens, (int(raw[-1]), int(shape[-1]))


def features(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last + 1, slots, known, tokens before each document) for runs of whole documents."""
    data, offsets = K.buffers(column)
    held: list[tuple] = []
    carry = None
    for i, j, lo, hi in K._cuts(data, offsets, K.NOT_SPACE):
        whole = lo == offsets[i] and hi == offsets[j]
        bounds = offsets[i : j + 1] - lo if whole else np.array([0, hi - lo])
        slots, known, tokens, carry = _cut_features(data[lo:hi], bounds, carry if held else None)
        if whole:
            yield i, j, slots, known, tokens
            continue
        held.append((slots, known))
        if hi == offsets[j]:
            slots, known = np.concatenate([s for s, _ in held], axis=1), np.concatenate([k for _, k in held])
            yield i, j, slots, known, np.array([0, len(known)])
            held, carry = [], None


def _good(labels: DataFrame) -> DataFrame:
    """doc_id, good: a row for each labelled document."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = FIT) -> tuple[np.ndarray, np.ndarray]:
    """Counts of raw and target features, over all tables side by side. labels: doc_id, good."""
    chosen = labels.where("good").where(sampled("doc_id", 31, sample, labels.count()))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "good")), "doc_id", "left").select("text", "good")  # about `sample` ids at most
    schema = fields(("slot", "int"), ("raw", "long"), ("target", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(_STARTS[-1], np.int64), np.zeros(_STARTS[-1], np.int64)
        for batch in batches:
            good = np.array(batch.column(1).fill_null(False))
            for i, j, slots, known, tokens in features(batch.column(0)):
                mine = np.repeat(good[i:j], np.diff(tokens))
                for t in range(4):
                    own = slots[t] if t == 3 else slots[t][known]
                    raw[_STARTS[t] : _STARTS[t + 1]] += np.bincount(own, minlength=_SIZES[t])
                    if mine.any():
                        target[_STARTS[t] : _STARTS[t + 1]] += np.bincount(own[mine if t == 3 else mine[known]], minlength=_SIZES[t])
        some = np.flatnonzero(raw)
        for lo in range(0, len(some), 100_000):
            part = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw[part]), pa.array(target[part])], names=schema.names)

    got = rows.mapInArrow(run, schema).groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(_STARTS[-1], np.int64), np.zeros(_STARTS[-1], np.int64)
    found = got.toArrow()  # a row for each slot at most
    raw[found["slot"].to_numpy()], target[found["slot"].to_numpy()] = found["raw"].to_numpy(), found["target"].to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    out = np.zeros(len(raw), np.float32)
    for t in range(4):
        own = slice(_STARTS[t], _STARTS[t + 1])
        r, c = raw[own], target[own]
        if c.sum():
            out[own] = np.log((c + prior) / (r * (c.sum() / r.sum()) + prior))
    return out


def _weights(raw: np.ndarray, ratio: np.ndarray, slots: np.ndarray, known: np.ndarray, tokens: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For each document the least sum, the sum of its first `window` tokens, for the least sums of its prefixes of window, 2 window,
    4 window ... tokens the products of deviations (of doublings with sums, and of doublings with themselves), and the sum of all tokens."""
    one, two = slots[0], slots[1] + _STARTS[1]
    word = ratio[np.where(raw[one] <= raw[two], one, two)]
    value = np.where(known, np.minimum(word, MOST) + np.minimum(ratio[slots[2] + _STARTS[2]], MOST), 0.0)
    value = value + np.clip(ratio[slots[3] + _STARTS[3]], SHAPE_LEAST, MOST)
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    out, head, fall, spread = (np.zeros(len(tokens) - 1) for _ in range(4))
    counts = np.diff(tokens)
    for d in np.flatnonzero(counts).tolist():
        a, b = int(tokens[d]), int(tokens[d + 1])
        w = min(window, b - a)
        least = np.minimum.accumulate(total[a + w : b + 1] - total[a : b + 1 - w])
        out[d], head[d] = least[-1], least[0]
        if b - a >= 2 * window:
            n = ((b - a) // window).bit_length()
            x = np.arange(n) - (n - 1) / 2
            fall[d], spread[d] = x @ least[window * ((1 << np.arange(n)) - 1)], x @ x
    return np.round(out, 6), np.round(head, 6), np.round(fall, 6), spread, np.round(total[tokens[1:]] - total[tokens[:-1]], 6)


def score(docs: DataFrame, raw: np.ndarray, target: np.ndarray, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, least, head, fall, spread, whole (see _weights)."""
    sent = docs.sparkSession.sparkContext.broadcast((np.minimum(raw, 2**31 - 1).astype(np.int32), log_ratios(raw, target)))
    schema = fields(("doc_id", id_type(docs)), ("n_tokens", "long"), *((n, "double") for n in ("least", "head", "fall", "spread", "whole")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, ratio = sent.value
        for i, j, slots, known, tokens in features(batch.column(1)):
            found = [pa.array(c) for c in _weights(counts, ratio, slots, known, tokens, window)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(tokens)), *found], names=schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def length_null(scored: DataFrame, labels: DataFrame, window: int = WINDOW) -> tuple[float, float]:
    """Of good labelled documents: the mean value of a token, and the change of the least sum by each doubling of the length (0 at most).

    Summed as whole millionths, so that the order of rows doesn't matter."""
    parts = [F.sum(F.round(F.col(c) * 1_000_000).cast("long")) / 1_000_000 for c in ("head", "fall", "spread")]
    head, fall, spread, n = scored.join(labels.where("good"), "doc_id").agg(*parts, F.sum(F.least("n_tokens", F.lit(window)))).first()
    return head / n if n else 0.0, fall / spread if spread else 0.0


def levelled(scored: DataFrame, mean: float, slope: float, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, log_weight. A sum over fewer than `window` tokens is brought to the spread of `window`; 0 without tokens."""
    taken, doublings = F.least("n_tokens", F.lit(window)), F.log2(F.greatest(F.col("n_tokens") / window, F.lit(1.0)))
    level = (F.col("least") - taken * mean) / F.sqrt(taken / window) - doublings * slope
    return scored.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.round(level, 6)).otherwise(0.0).alias("log_weight"))


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The log weight that parts good from other labelled documents with the least balanced error; -inf if one kind is absent.

    Counted in steps of 1/8 from -64 to 64: a bounded table whatever the number of labels."""
    rows = scored.join(labels, "doc_id").groupBy(F.greatest(F.lit(-512), F.least(F.lit(512), F.floor(F.col("log_weight") * 8))).alias("bin"), "good").count().collect()
    good, bad = np.zeros(1026), np.zeros(1026)
    for r in rows:
        (good if r["good"] else bad)[r["bin"] + 512] += r["count"]
    if not good.sum() or not bad.sum():
        return -np.inf
    error = np.concatenate([[0], np.cumsum(good)])[:-1] / good.sum() + 1 - np.concatenate([[0], np.cumsum(bad)])[:-1] / bad.sum()
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((int(best[(len(best) - 1) // 2]) - 512) / 8)


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the column `ordered` (non-negative longs below 2**63), by counting 65,536 bins at a time."""
    low, rest = 0, k
    for shift in (47, 31, 15, 0):
        width = 63 - shift if shift == 47 else 16 if shift else 15
        top = low >> (shift + width) if shift != 47 else 0
        rows = keys.where(F.shiftright("ordered", shift + width) == top) if shift != 47 else keys
        counts = sorted(((r["bin"], r["count"]) for r in rows.groupBy(F.shiftright("ordered", shift).alias("bin")).count().collect()), reverse=True)
        for bin_, count in counts:
            if rest <= count:
                low = bin_ << shift
                break
            rest -= count
    return low


def gumbel_top_k(scored: DataFrame, k: int, n: int, sharpness: float = SHARPNESS, seed: int = 11) -> DataFrame:
    """The rows of scored with the k largest keys, with the column gumbel_key."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    key = F.col("log_weight") * sharpness - F.log(-F.log(u))
    # order kept in 39 bits of the key, ties broken by 24 bits of a hash
    whole = F.least(F.greatest(F.floor((key + (1 << 16)) * (1 << 21)), F.lit(0)), F.lit((1 << 38) - 1))
    keyed = scored.withColumn("gumbel_key", key).withColumn("ordered", F.shiftleft(whole, 24) + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 24)))
    if k >= n:
        return keyed.drop("ordered")
    if k <= 0:
        return keyed.limit(0).drop("ordered")
    return keyed.where(F.col("ordered") >= kth_largest(keyed, k)).drop("ordered")


def resample(docs: DataFrame, labels: DataFrame, sample: int = FIT, window: int = WINDOW, sharpness: float = SHARPNESS, passages: bool = True) -> DataFrame:
    """The documents sampled: doc_id, n_tokens, log_weight, gumbel_key."""
    known = materialise(_good(labels))
    held = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(4)) == 3
    raw, target = fit(docs, known.where(~held), sample)
    scored = materialise(score(docs, raw, target, window))
    if passages:
        scored = levelled(scored, *length_null(scored, known.where(held), window), window)
    else:
        scored = scored.select("doc_id", "n_tokens", F.col("whole").alias("log_weight"))
    least = threshold(scored, known.where(held))
    counted = scored.agg(F.count("*").alias("n"), F.count_if(F.col("log_weight") >= least).alias("k")).first()
    return gumbel_top_k(scored, counted["k"], counted["n"], sharpness)


def keep_sampled(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs, all columns, without the documents that weren't sampled. Rows with null doc_id stay."""
    sampled = resample(docs, labels, **how).select(F.col("doc_id").alias("fluxion_id")).distinct()
    return docs.join(sampled, F.col("doc_id") == F.col("fluxion_id"), "left_semi").unionByName(docs.where("doc_id is null"))
