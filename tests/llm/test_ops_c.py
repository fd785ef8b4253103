"""Line dedup, packing and the pipeline against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxion.llm import line_dedup, packing, queries
from fluxion.llm.near_dup import keep_one

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

# --- line dedup


def brute_lines(docs):
    seen, gone = set(), {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        own = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                own |= {p, p + 1, p + 2}
            seen.add(w)
        gone[i] = own
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs}


def test_line_dedup_on_random_texts(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(("a", "b", "c", "", "  ", "dd e")) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    want = brute_lines(docs)
    for i, text in docs:
        kept = 0 if got[i]["n_removed"] == got[i]["n_lines"] else len(got[i]["text"].split("\n"))
        assert got[i]["text"] == want[i] and got[i]["n_lines"] == len(text.split("\n")) == kept + got[i]["n_removed"]


def test_line_dedup_of_ties_and_repeated_rows(spark):
    """Equal windows: the first by doc_id, then by position, stays, whatever the order of rows; rows that share a doc_id are one document."""
    w = "a\nb\nc"
    docs = [(5, f"{w}\nx\n{w}"), (5, f"{w}\nx\n{w}"), (9, f"y\n{w}"), (2, f"z\n{w}"), (2, f"z\n{w}")]
    for parts in (1, 4):
        got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect())
        assert got == [(2, f"z\n{w}", 0)] * 2 + [(5, "x", 6)] * 2 + [(9, "y", 3)]


def test_line_dedup_query_against_duckdb(spark, data):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(duckdb.sql(line_dedup.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op10_line_window_dedup(spark, data).select("doc_id", "n_lines", "n_removed", "text_md5").collect())
    assert got == want


def test_line_dedup_is_native(spark, data):
    plan = line_dedup.dedup_lines(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_line_dedup_odd_and_empty(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = out.collect()
    text = {i: [r["text"] for r in rows if r["doc_id"] == i] for i in (1, 2, 3, 7)}
    assert len(rows) == 10 and text[2] == [None] and text[3] == [""] and text[7] == [""] and len(set(text[1])) == 1 and text[1][0]
    assert line_dedup.dedup_lines(empty).count() == 0


# --- packing


def check_packing(rows, docs, size=2048):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, text in docs:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % size + 1
        at = [0, *range(first, len(ids) + 1, size)]
        want += Counter((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held: dict = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_packing_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op9_best_fit_packing(spark, data).collect()
    used = check_packing(rows, docs)
    assert used <= 1 + -(-sum(r["length"] for r in rows) // 2048) * 1.01


def test_packing_odd_and_empty(odd, empty, spark):
    rows = packing.pack(odd, queries.tokenizer_path()).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, " " * 5000), (3, "\n\n\t \r\n x"), (4, "'s 'S don't 123abc ٣"), (5, "<|endoftext|>")], "doc_id long, text string")
    check_packing(packing.pack(special, queries.tokenizer_path()).collect(), [tuple(r) for r in special.collect()])


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, "a" + " \n\t" * 1_000_000 + "b", " " * 1_500_000 + "word" + "\u3000" * 1_500_000])
def test_packing_of_long_white_space(spark, text):
    docs = [(1, text), (2, "a word"), (3, None)]
    check_packing(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), queries.tokenizer_path()).collect(), docs)


def best_fit_decreasing(h, size):
    free, bins = Counter(), 0
    for k, n in sorted(h.items(), reverse=True):
        for _ in range(n):
            f = next((f for f in range(k, size + 1) if free[f]), None)
            if f is None:
                bins += 1
                free[size - k] += 1
            else:
                free[f] -= 1
                free[f - k] += 1
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_configuration_program(seed):
    rng = np.random.default_rng(seed)
    size = 64
    h = {int(k): int(n) for k, n in zip(rng.integers(1, size + 1, 40), rng.integers(1, 200, 40), strict=True)}
    if seed == 3:
        h = {33: 50, 40: 20, 20: 10}  # nothing pairs with the long ones but 20
    plan = packing.solve(h, size)
    total = sum(k * n for k, n in h.items())
    assert plan.bound <= plan.sequences + 1e-6 and plan.sequences >= total / size
    assert plan.sequences <= best_fit_decreasing(h, size)
    if seed == 3:
        assert plan.sequences == 70


def test_every_rounding_starts_from_the_fractional_solution(monkeypatch):
    """Whatever the number of lengths: the same numbers of rounds in turn, and no rounding without the pool and its duals."""
    rounds, whole, rest = [], [], []
    solved, multiples = packing.multiplicative_weights, packing.Rounding.whole_multiples

    def solving(lengths, demand, size, n):
        rounds.append(n)
        return solved(lengths, demand, size, 4)

    monkeypatch.setattr(packing, "multiplicative_weights", solving)
    monkeypatch.setattr(packing.Rounding, "whole_multiples", lambda self, pool, y: (whole.append((id(self), y.tobytes())), multiples(self, pool, y))[1])
    for name in ("fullest_first", "longest_first"):
        own = getattr(packing.Rounding, name)
        monkeypatch.setattr(packing.Rounding, name, lambda self, y, own=own: (rest.append((id(self), y.tobytes())), own(self, y))[1])
    for most in (20, 400):
        rounds.clear()
        assert packing.solve({n: 3 for n in range(1, most)}, 512).sequences >= 3 * most * (most - 1) / 2 / 512
        assert rounds == list(packing.ROUNDS[: len(rounds)])
    assert rest and whole and {k for k, _ in whole} <= {k for k, _ in rest}


def test_search_ends_only_with_a_certificate():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 129, 30), rng.integers(1, 60, 30), strict=True)}
        plan = packing.solve(h, 128)
        assert plan.sequences == np.ceil(plan.bound - 1e-6) or plan.sequences <= packing.solve(h, 128, (300,)).sequences


def test_multiplicative_weights_cover_all_demand():
    lengths, demand = np.array([3, 5, 7, 11]), np.array([10.0, 20.0, 5.0, 8.0])
    pool, y, bound = packing.multiplicative_weights(lengths, demand, 16)
    for config, _ in pool:
        assert sum(int(lengths[i]) * c for i, c in config.items()) <= 16
    best, _ = packing._knapsack(lengths, y, 16)
    assert best[16] <= 1 + 1e-9 and abs(demand @ y - bound) < 1e-6 and bound <= packing.solve(dict(zip(lengths.tolist(), demand.astype(int).tolist(), strict=True)), 16).sequences


def test_keep_ids(spark):
    docs = spark.createDataFrame([(1, "word " * 3000)], "doc_id long, text string")
    rows = packing.pack(docs, queries.tokenizer_path(), keep_ids=True).orderBy("piece").collect()
    assert [len(r["ids"]) for r in rows] == [r["length"] for r in rows] and rows[-1]["ids"][-1] == 0


# --- pipeline


def test_pipeline_stages(spark, data):
    """Every stage on what its predecessor kept, held against brute force where there is one."""
    from tests.llm.test_ops_b import brute_components

    data = data.replace("sf0.001", "sf0.01")  # labels enough for the classifier
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], data)
        assert out.columns == columns
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    rows = [[(r["doc_id"], r["text"]) for r in k.select("doc_id", "text").collect()] for k in kept]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = [{i for i, _ in r} for r in rows]
    good = [i for i, v in labels.items() if v == (1, 0)]
    assert sum(i in ids[1] for i in good) >= 0.9 * len(good) and not [i for i, (q, _) in labels.items() if q == 0 and i in ids[1]]
    want = brute_lines(rows[1])
    assert dict(rows[2]) == want and all(n == len(t) for n, t in kept[2].select("n_chars", "text").collect())
    assert ids[3] == {i for i, (_, c) in brute_components(rows[2]).items() if i == c}
    assert ids[4] <= ids[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], data).collect()
    check_packing(packed, rows[4])
    assert corpus_pipeline.run(spark, data).agg(F.sum("length")).first()[0] == sum(r["length"] for r in packed)


def test_pipeline_stage_on_odd_rows(spark, odd):
    assert keep_one(odd).columns == odd.columns and corpus_pipeline.lines(spark, odd, "").columns == odd.columns
