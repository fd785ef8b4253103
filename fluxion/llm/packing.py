"""Best-fit packing by a configuration linear program.

1. Every whole text becomes tokens and a closing id; a document longer than `size` is cut into pieces of `size`, the first
   of which may be shorter. Only length, place and checksum of each piece leave the scan.
2. The histogram of piece lengths (at most `size` numbers, whatever the corpus) goes to the driver. The linear program over
   configurations (multisets of lengths that fit one sequence) is solved by multiplicative weights: lengths carry dual
   weights, a knapsack dynamic program prices the best configuration, and weights of lengths that are covered fall.
3. The fractional solution is rounded: whole multiples of the configurations found are taken as far as demand goes; the rest goes
   in configurations that the knapsack program prices anew against the remaining demand, gaps filled best-fit (see solve).
4. The plan says which ranks of each length go to which sequence and offset. Pieces get their rank within their length from
   per-partition counts, without gathering a length in one task: the pieces of one length may be a third of all.

Ids are those of the byte-level BPE of `tokenizers`; the faster encoder of `tiktoken` with the same vocabulary gives the
same ids (tests compare the two), with the text `<|endoftext|>` as its special id as there. Its pattern backtracks over white
space, so that texts with a very long run of it are left to `tokenizers`.

Defined cases: null and empty text are one piece holding id 0 only. Repeated rows are pieces of their own. A row with null
doc_id is packed as well. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import fields, id_type, map_arrow, materialise

SIZE, CLOSING, ROUNDS = 2048, 0, (30, 300)
_BLANKS = re.compile(r"\s+")


@lru_cache(2)
def encoder(path: str):
    """The encoder of a tokenizer file's path (`….json`), through the ranks file beside it if there is one."""
    import os

    from tokenizers import Tokenizer

    @lru_cache(1)
    def exact():
        return Tokenizer.from_file(path)

    slow = lambda text: exact().encode(text, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})

    def encode(text: str) -> list[int]:
        if len(text) >= 100_000 and any(m.end() - m.start() >= 100_000 for m in _BLANKS.finditer(text)):
            return slow(text)
        return fast.encode(text, allowed_special="all")

    return encode


def pieces(docs: DataFrame, path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), part (partition) and rank (within part and length, from 0)."""
    schema = fields(
        ("doc_id", id_type(docs)), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("part", "int"), ("rank", "long"),
        *([("ids", "array<int>")] if keep_ids else []),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, encode = TaskContext.get(), encoder(path)
        part, seen = context.partitionId() if context else 0, [0] * (size + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in schema.names]
            held = 0
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), CLOSING], "<u4")
                first = (len(ids) - 1) % size + 1
                at = [0, *range(first, len(ids) + 1, size)]
                for n, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    row = (k, n, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), part, seen[hi - lo], *([ids[lo:hi].astype(np.int32)] if keep_ids else []))
                    seen[hi - lo] += 1
                    held += hi - lo
                    for r, v in zip(rows, row, strict=True):
                        r.append(v)
                if held > 4_000_000 or k + 1 == batch.num_rows:
                    columns = [batch.column(0).take(pa.array(rows[0], pa.int32())), *[pa.array(r) for r in rows[1:]]]
                    kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=False)], names=schema.names)
                    rows, held = [[] for _ in schema.names], 0

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


@dataclass
class Plan:
    """Which ranks of a length go where: rank r of segment s is copy (r - first) % copies of sequence base + (r - first) // copies."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: float


def _knapsack(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity, any number of copies, and the item taken last (-1: a unit left free). lengths ascend."""
    best, taken = np.zeros(size + 1), np.full(size + 1, -1, np.int32)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for w in range(1, size + 1):
        best[w] = best[w - 1]
        if k := fits[w]:
            got = best[w - lengths[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[w] + 1e-12:
                best[w], taken[w] = got[i], i
    return best, taken


def _trace(lengths: np.ndarray, taken: np.ndarray, w: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while w > 0:
        if (i := int(taken[w])) < 0:
            w -= 1
        else:
            out[i] = out.get(i, 0) + 1
            w -= int(lengths[i])
    return out


def multiplicative_weights(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = ROUNDS[-1], step: float = 0.5) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """A covering of demand by fractions of configurations, the dual weights (best configuration 1), and the dual bound."""
    y = lengths / size
    pool: dict[tuple, list] = {}
    covered, bound, best_y = np.zeros(len(lengths)), 0.0, y
    for _ in range(rounds):
        value, taken = _knapsack(lengths, y, size)
        if (dual := float(demand @ y) / value[size]) > bound:
            bound, best_y = dual, y / value[size]
        cover = np.zeros(len(lengths))
        round_configs = []
        for i in range(len(lengths)):  # of each length, the best configuration that holds it
            if y[i] + value[size - lengths[i]] < 0.98 * value[size]:
                continue
            config = _trace(lengths, taken, int(size - lengths[i]))
            config[i] = config.get(i, 0) + 1
            share = demand[i] / config[i]
            round_configs.append((config, share))
            for j, c in config.items():
                cover[j] += c * share
        width = max(1e-12, float((cover / demand).max()))
        for config, share in round_configs:
            key = tuple(sorted(config.items()))
            pool.setdefault(key, [config, 0.0])[1] += share / width
        covered += cover / width
        y = y * np.exp(-step * (cover / demand) / width)
        y = np.maximum(y / y.max(), 1e-9)
    scale = np.where(covered > 0, demand / np.maximum(covered, 1e-12), 0).max(initial=0.0)
    return [(config, x * min(scale, 1.0)) for config, x in pool.values()], best_y, bound


class Rounding:
    """Whole numbers of configurations for a demand, by duals y (worth of a piece of each length)."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, size: int):
        self.lengths, self.size, self.rest = lengths, size, demand.copy()
        self.chosen: list[tuple[dict[int, int], int]] = []

    @property
    def used(self) -> int:
        return sum(times for _, times in self.chosen)

    def take(self, config: dict[int, int], most: int | None = None, y: np.ndarray | None = None, least: float = 0.0) -> bool:
        """Trims a configuration to what is left, fills its gap best-fit, and takes it as often as demand goes, if it is worth `least`."""
        lengths, rest = self.lengths, self.rest
        own = {i: min(c, int(rest[i])) for i, c in config.items() if rest[i] > 0}
        gap = self.size - sum(int(lengths[i]) * c for i, c in own.items())
        i = int(np.searchsorted(lengths, gap, "right")) - 1
        while gap > 0 and i >= 0:
            if (k := min(gap // int(lengths[i]), int(rest[i]) - own.get(i, 0))) > 0:
                own[i] = own.get(i, 0) + k
                gap -= k * int(lengths[i])
            i = min(i - 1, int(np.searchsorted(lengths, gap, "right")) - 1)
        if not own or y is not None and sum(float(y[i]) * c for i, c in own.items()) < least:
            return False
        times = min(int(rest[i]) // c for i, c in own.items())
        times = min(times, most) if most is not None else times
        if times < 1:
            return False
        for i, c in own.items():
            rest[i] -= c * times
        self.chosen.append((own, times))
        return True

    def whole_multiples(self, pool: list[tuple[dict[int, int], float]], y: np.ndarray) -> None:
        """The whole parts of a fractional solution, largest first, of configurations that the duals call tight."""
        for config, x in sorted(pool, key=lambda p: (-p[1], sorted(p[0].items()))):
            if x >= 1 and all(self.rest[i] >= c for i, c in config.items()):
                self.take(config, int(x), y, 0.995)

    def fullest_first(self, y: np.ndarray) -> None:
        """Configurations that leave almost nothing free, one for each length in every pass; less full ones once few are left."""
        fill = 0.9995
        while self.rest.any():
            left = np.flatnonzero(self.rest)
            _, taken = _knapsack(self.lengths[left], y[left], self.size)
            before = len(self.chosen)
            for i in left[::-1].tolist():
                if self.rest[i] > 0:
                    config = {int(left[j]): c for j, c in _trace(self.lengths[left], taken, int(self.size - self.lengths[i])).items()}
                    config[i] = config.get(i, 0) + 1
                    self.take(config, None, self.lengths / self.size, fill)
            if len(self.chosen) - before < max(1, len(left) // 50):
                fill = 1 - 4 * (1 - fill) if fill > 0.75 else 0.0

    def longest_first(self, y: np.ndarray) -> None:
        """The longest piece left with its most valuable company, priced anew after every few configurations."""
        again = max(1, len(self.lengths) // 40)
        while self.rest.any():
            left = np.flatnonzero(self.rest)
            _, taken = _knapsack(self.lengths[left], y[left], self.size)
            begun = len(self.chosen)
            for k in range(len(left) - 1, -1, -1):
                i = int(left[k])
                while self.rest[i] > 0 and len(self.chosen) - begun < again:
                    config = {int(left[j]): c for j, c in _trace(self.lengths[left], taken, int(self.size - self.lengths[i])).items()}
                    config[i] = config.get(i, 0) + 1
                    self.take(config)
                if len(self.chosen) - begun >= again:
                    break


def solve(histogram: dict[int, int], size: int = SIZE, rounds: tuple[int, ...] = ROUNDS) -> Plan:
    """Rounded solution for the histogram length -> number of pieces. Three roundings are made from the fractional solution and its duals: whole
    multiples and then the fullest configurations, whole multiples and then the longest piece first, or the longest first with companies priced
    by the duals throughout. The one of fewest sequences counts. `rounds`: numbers of rounds
    of multiplicative weights, tried in turn; a solution with no more sequences than a dual bound rounded up ends the search, since none can have fewer."""
    lengths = np.array(sorted(n for n in histogram if n < size), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    full = int(histogram.get(size, 0))
    bound, best = 0.0, Rounding(lengths, demand, size)
    if len(lengths):
        tries: list[Rounding] = []
        for n in rounds:
            pool, y, least = multiplicative_weights(lengths, demand.astype(float), size, n)
            y, bound = np.maximum(y, 1e-6 * lengths), max(bound, least)
            priced = 0.9 * y + 0.1 * lengths / size  # of companies of equal price the fuller one
            for whole, rest, price in ((True, Rounding.fullest_first, y), (True, Rounding.longest_first, priced), (False, Rounding.longest_first, priced)):
                if tries and min(r.used for r in tries) <= np.ceil(bound - 1e-6):
                    break
                r = Rounding(lengths, demand, size)
                if whole:
                    r.whole_multiples(pool, y)
                rest(r, price)
                tries.append(r)
            if min(r.used for r in tries) <= np.ceil(bound - 1e-6):
                break
        best = min(tries, key=lambda r: r.used)
    out: list[tuple[int, int, int, int, int]] = []
    used, at = np.zeros(len(lengths), np.int64), full
    for own, times in best.chosen:
        offset = 0
        for i, c in sorted(own.items(), reverse=True):
            out.append((int(lengths[i]), int(used[i]), c, at, offset))
            used[i] += c * times
            offset += c * int(lengths[i])
        at += times
    if full:
        out.append((size, 0, 1, 0, 0))
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=at, bound=bound + full)


def pack(docs: DataFrame, path: str, size: int = SIZE, rounds: tuple[int, ...] = ROUNDS, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    cut = materialise(pieces(docs, path, size, keep_ids))
    counts = materialise(cut.groupBy("part", "length").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most size rows
    plan = solve(histogram, size, rounds)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    # the table of ranks grows with the partitions: a sort-merge join, never a broadcast
    joined = cut.join(ranks.hint("merge"), ["part", "length"]).select(*[c for c in cut.columns if c not in ("part", "rank")], (F.col("rank") + F.col("before")).alias("rank"))
    # at most size configurations with at most sqrt(2 * size) lengths each, and as many again for the rest
    sent = docs.sparkSession.sparkContext.broadcast(plan)
    schema = fields(*[(f.name, f.dataType) for f in joined.schema if f.name != "rank"], ("sequence_id", "long"), ("offset", "long"))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = sent.value
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        n, r = named["length"].to_numpy(), named["rank"].to_numpy()
        s = np.searchsorted(p.length << 40 | p.first, n << 40 | r, "right") - 1
        since = r - p.first[s]
        named["sequence_id"] = pa.array(p.base[s] + since // p.copies[s])
        named["offset"] = pa.array(p.offset[s] + since % p.copies[s] * n)
        yield pa.RecordBatch.from_arrays([named[c] for c in schema.names], names=schema.names)

    return map_arrow(joined, place, schema)
