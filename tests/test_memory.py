"""Texts of which the first of alike ones stays, against the greedy pass over a list."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fluxion.operators import memory


def by_hand(rows, percent=60):
    bag = lambda s: set(re.findall("[a-z_]{3,}", (s or "").lower()))
    kept, out = [], {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        own = bag(text)
        like = [j for j, b in kept if own | b and 100 * len(own & b) > percent * len(own | b)]
        if not like:
            kept.append((i, own))
        out[i] = (len(own), not like, min(like, default=None))
    return out


@pytest.mark.parametrize("seed,percent", [(1, 60), (2, 60), (3, 75)])
def test_first_of_alike_equals_a_greedy_pass(spark, seed, percent):
    rng = random.Random(seed)
    words = [a + b + c for a in "bdk" for b in "aeiou" for c in "lmnr"]
    rows = []
    for i in range(220):
        if rows and rng.random() < 0.6:  # an edited copy, so that chains of alike texts arise
            own = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(4)):
                own = own[1:] + [rng.choice(words)]
        else:
            own = rng.sample(words, rng.randrange(1, 16))
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, rows[5][1]), (904, " ".join(rows[5][1].split()).upper())]
    df = spark.createDataFrame([*rows, (None, "bal bam")], "n long, t string").repartition(5)
    got = {r["n"]: (r["n_words"], r["kept"], r["resembles"]) for r in memory.first_of_alike(df, "n", "t", percent).collect()}
    assert got == by_hand(rows, percent)


def test_chain_ties_copies_and_nothing(spark):
    text = lambda ws: " ".join(ws)
    words = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    chain = [(k, text(words[k : k + 9])) for k in range(10)]  # each resembles its neighbours only
    got = {r["n"]: r["resembles"] for r in memory.first_of_alike(spark.createDataFrame(chain, "n long, t string"), "n", "t").collect()}
    assert got == {k: v[2] for k, v in by_hand(chain).items()}
    copies = spark.range(3000).selectExpr("id as n", "'the same words in all of them' as t")
    out = memory.first_of_alike(copies, "n", "t")
    assert out.where("kept").collect()[0]["n"] == 0 and out.where("resembles = 0").count() == 2999
    six = "one two six ten red"  # 3 of 5: not over 0.6
    assert memory.first_of_alike(spark.createDataFrame([(1, six), (2, "one two six")], "n long, t string"), "n", "t").where("kept").count() == 2
    assert memory.first_of_alike(spark.createDataFrame([], "n long, t string"), "n", "t").count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_sketches_leave_few_pairs_and_lose_none(spark, seed):
    """Few words shared by all texts: pairs that meet at a word are all of them, pairs to be confirmed are hardly more than the alike ones, in blocks of any size."""
    rng = random.Random(seed)
    words = [a + b + c + d for a in "bdkt" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    sets = [rng.sample(words, rng.randrange(6, 130)) for _ in range(250)]
    sets += [s[: len(s) * 4 // 5] for s in sets[:60]]
    alike = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(set(a) & set(b)) > 60 * len(set(a) | set(b))}
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, w array<string>").repartition(3)
    sketches = memory.sketched(df.selectExpr("id", "size(w) as n", "transform(w, x -> xxhash64(x)) as x")).cache()
    for block in (256, 1 << 21):
        got = {(r["a"], r["b"]) for r in memory.possible_pairs(sketches, block=block).collect()}
        assert alike <= got and len(got) < len(alike) + 400
    assert {(r["a"], r["b"]) for r in memory.alike_pairs(df).collect()} == alike


@pytest.mark.parametrize("room", [1, 40, 1 << 20])
def test_rarest_words_lose_no_alike_pair(room):
    """Blocks, prefixes and counts against all pairs; few of the pairs of common words are left."""
    rng = np.random.default_rng(6)
    for percent in (0, 50, 60, 90):
        weight = 1 / np.arange(1, 601) ** 0.8
        sets = [rng.choice(600, int(n), replace=False, p=weight / weight.sum()) for n in rng.integers(1, 60, 150)]
        sets += [np.append(s[len(s) // 7 :], rng.integers(600, 900, len(s) // 9)) for s in sets[:60] if len(s) > 3]
        sets = sorted((np.unique(s) for s in sets), key=len)
        n = np.array([len(s) for s in sets])
        alike = {(i, j) for j in range(len(sets)) for i in range(j) if (100 + percent) * len(np.intersect1d(sets[i], sets[j])) > percent * (n[i] + n[j])}
        got, order = set(), [np.sort(900 - s).astype(np.int32) for s in sets]  # common words have large keys
        lists = lambda rows, many: pa.array([order[i][:k] for i, k in zip(rows, many, strict=True)], pa.list_(pa.int32()))
        plan = memory._blocks([(int(k), int((n == k).sum())) for k in np.unique(n)], percent, 400)
        assert len({r[1] for r in plan}) > 2 and max(r[3] for r in plan) == 1
        for j in {r[1] for r in plan}:
            many = [{r[0]: r[6] for r in plan if r[1] == j and r[5] == side} for side in (0, 1)]
            a, b = ([i for i in range(len(sets)) if n[i] in m] for m in many)
            index = memory._index(lists(b, [many[1][n[i]] for i in b]))
            for x, y in memory._sharing(n[a], lists(a, [many[0][n[i]] for i in a]), n[b], index, percent, room):
                got |= {(min(a[i], b[k]), max(a[i], b[k])) for i, k in zip(x.tolist(), y.tolist(), strict=True) if a[i] != b[k]}
        assert alike <= got
        assert percent < 50 or len(got) < len(alike) + (1500 if percent < 90 else 300)


def test_pairs_of_frequent_words_are_not_compared(spark):
    """Sets that share frequent words only are compared by no pair of theirs: their meetings at rare words are few, where all pairs of like sizes were compared before."""
    rng = np.random.default_rng(7)
    weight = 1 / np.arange(1, 4001)
    sets = [rng.choice(4000, 60, replace=False, p=weight / weight.sum()) for _ in range(400)]
    sets += [s[8:] for s in sets[:30]]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id long, w array<string>").selectExpr("id", "size(w) as n", "transform(w, x -> xxhash64(x)) as x")
    p = memory.sketched(df, 60, memory.rarity(df)).select("p", "n").toPandas()
    asked = [r.p[: memory._asked(np.int64(r.n), np.int64(r.n), 60)] for r in p.itertuples()]
    keys, counts = np.unique(np.concatenate(asked), return_counts=True)
    assert (counts * (counts - 1) // 2).sum() < 430 * 429 // 2 // 5


def test_smaller_text_that_went_before_the_one_it_resembles(spark):
    """A text that goes with the first round, but resembles a smaller id that is settled later, names that one."""
    w = lambda *parts: " ".join(f"{p}{c}x" for p, k in parts for c in "abcdefghijklmnopqrst"[:k])
    rows = [(0, w(("pp", 16))), (1, w(("pp", 12), ("qq", 4))), (2, w(("pp", 9), ("qq", 7))), (3, w(("rr", 10))), (4, w(("pp", 7), ("qq", 9))), (5, w(("pp", 11), ("qq", 5)))]
    rng = random.Random(8)
    names = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in "lmnr"]
    for i in range(6, 120):
        own = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = rng.choice(names)
        rows.append((i, " ".join(own)))
    got = {r["n"]: (r["n_words"], r["kept"], r["resembles"]) for r in memory.first_of_alike(spark.createDataFrame(rows, "n long, t string"), "n", "t").collect()}
    assert got == by_hand(rows)
