"""Spelling variants, the partition join and collocations against brute force; hostile URLs and blanks."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, SCHEMA

from fluxion.llm import collocations as C
from fluxion.llm import jaccard_join as J
from fluxion.llm import spelling as S
from fluxion.llm.packing import encoder
from fluxion.llm.queries import tokenizer_path
from fluxion.llm.url_filter import filter_urls


def small(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def docs_of(spark, rows):
    """doc_id, text, lang and columns whose names clash with those that operators add."""
    return spark.createDataFrame([(*r, *[None] * 20) for r in rows], SCHEMA)


# spelling variants


def spelling_by_hand(rows, least=3, letters=5):
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= least}
    near = defaultdict(set)
    for a in n:
        for i in range(len(a)):
            for b in n:
                if (len(a) == len(b) + 1 and a[:i] + a[i + 1 :] == b) or (len(a) == len(b) and a != b and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :]):
                    near[a].add(b)
                    near[b].add(a)
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def spelled(rng):
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    text = lambda: " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 200)))
    return [(k, text(), None) for k in range(60)] + ODD + [(None, "letters " * 7 + "lettters " * 3 + "letter " * 3 + "×÷×÷×÷ " * 3, "en")]


def test_spelling_against_brute_force(spark):
    rows = spelled(random.Random(5))
    got = [tuple(r) for r in S.spelling_variants(docs_of(spark, rows)).collect()]
    assert set(got) == spelling_by_hand(rows) and len(got) == len(set(got))
    assert any(r[1] for r in got) and any(r[2] != r[1] and r[1] for r in got)


def test_spelling_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 64)
    monkeypatch.setattr(S, "PIECE", 10)
    rows = spelled(random.Random(6))
    assert {tuple(r) for r in S.spelling_variants(docs_of(spark, rows)).collect()} == spelling_by_hand(rows)


def test_spelling_roots_follow_long_chains(spark):
    n, rows = 3, []
    for k in range(9):  # aaaaa <- aaaaaa <- ...: each twice as frequent as the one before
        rows.append((k, " ".join(["a" * (5 + k)] * n), None))
        n *= 2
    got = {r["word"]: r["root"] for r in S.spelling_variants(docs_of(spark, rows), every=1 << 31).collect()}
    assert len(got) == 9 and set(got.values()) == {"a" * 13}


def test_spelling_empty(empty):
    out = S.spelling_variants(empty)
    assert out.count() == 0 and dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_checksums_of_spans():
    rng = np.random.default_rng(1)
    low = rng.integers(0, 256, 5000).astype(np.uint8)
    start = np.sort(rng.integers(0, 4000, 300))
    end = start + rng.choice([1, 3, 9, 64, 65, 900], 300)
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    want = [zlib.crc32(low[s:e].tobytes(), int(b)) for s, e, b in zip(start, end, before, strict=True)]
    assert S.crc32_spans(low, start, end, before).tolist() == want


def test_long_words_cost_as_many_keys_as_letters(spark):
    rows = [(k, "x" * 100_000 + (" " + "x" * 99_999) + (" " + "x" * 50_000 + "y" + "x" * 49_999), None) for k in range(3)]
    got = {len(r["word"]): r["n_near"] for r in S.spelling_variants(docs_of(spark, rows), every=1 << 31).collect()}
    assert sorted(got.values()) == [2, 2] or sorted(got.values()) == [2, 2, 2]


# partition join


def sets_by_hand(rows, shingle=4):
    out = {}
    for doc, text, _ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", small(text or "")) if x]
        out[doc] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    return out


def joined_by_hand(rows, percent=85):
    sets = sets_by_hand(rows)
    up = {d: d for d in sets if d is not None}

    def root(x):
        return x if up[x] == x else root(up[x])

    ids = sorted(up)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(d, len(s), None if d is None else root(d)) for d, s in sets.items()}


def edited(rng, n=140):
    """Groups of copies with edits around the bound, passages that many share, texts of few words and exact copies."""
    words = [f"w{k}" for k in range(400)]
    passage, rows = rng.choices(words, k=60), []
    while len(rows) < n:
        base = rng.choices(words, k=rng.choice([1, 3, 4, 5, 8, 11, 15, 30, 60, 120, 400]))
        if rng.random() < 0.4:
            at = rng.randint(0, len(base))
            base[at:at] = passage
        for _ in range(rng.choice([1, 2, 5])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(text)) if text else 0
                text[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
            rows.append((len(rows), " ".join(text), None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"costly": 0, "block": 8}), (3, {"costly": 3, "block": 8})])
def test_join_against_brute_force(spark, seed, how):
    rows = edited(random.Random(seed)) + [(1000 + (k or 900), *r) for k, *r in ODD]
    got = [tuple(r) for r in J.jaccard_join(docs_of(spark, rows), **how).collect()]
    assert set(got) == joined_by_hand(rows) and len(got) == len(rows)


def test_join_odd_and_empty(odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(odd).collect()}
    assert {(1, 11, 1), (7, 11, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6)} <= got and {(r[0], r[2]) for r in got if r[0] is None} == {(None, None)}
    assert J.jaccard_join(empty).count() == 0


def test_allocations_cover_all_differences():
    rng = np.random.default_rng(2)
    for _ in range(500):
        m = int(rng.integers(1, 40))
        differ = int(rng.integers(0, m))
        key, count, dear = rng.integers(0, 9, m).astype(np.uint64), rng.integers(0, 6, m), rng.random(m) < rng.random()
        v = J._allocate(key, count, dear, differ)
        assert (v + 1).sum() >= differ + 1 and set(v.tolist()) <= {-1, 0, 1} and not ((v == 1) & (dear | (count < 2))).any()


def test_bands_hold_all_partners():
    plan = J.Plan(85)
    low = plan.to(3000)
    for a in range(1, 2500):
        least = -(-85 * a // 100)
        bands = plan.band(np.array([a, least]))
        assert bands[0] - bands[1] in (0, 1)
        for b in {least, (a + least) // 2, a}:  # the bound of the band holds for the pair
            i = -(-85 * (a + b) // 185)
            assert a + b - 2 * i <= plan.differ(np.array([a]), plan.band(np.array([b])))[0] < plan.segments(plan.band(np.array([b])))[0]
    assert low[0] == 1 and (np.diff(low) > 0).all()


def tables_written(monkeypatch, spark, rows, **how):
    """The result of the join, and of each table that it writes the columns and the number of rows."""
    out, write = [], J.materialise

    def seen(df):
        out.append((set(df.columns), (done := write(df)).count()))
        return done

    monkeypatch.setattr(J, "materialise", seen)
    return {tuple(r) for r in J.jaccard_join(docs_of(spark, rows), **how).collect()}, out


def test_join_passes_over_sets_that_share_a_passage_only(spark, monkeypatch):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(150)]
    rows = [(k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(300)]), None) for k in range(150)]
    rows += [(1000 + k, text + " more", None) for k, text, _ in rows[:3]]
    got, tables = tables_written(monkeypatch, spark, rows)
    assert got == joined_by_hand(rows)
    assert 0 < max(n for columns, n in tables if {"key", "doc_id"} <= columns) <= 6 * 200  # six sets, 200 segments at most


def test_join_rows_of_a_group_grow_as_its_members(spark, monkeypatch):
    """A group of copies edited so much that few are linked: no table with full sets or keys grows with the square."""
    words = [f"w{k}" for k in range(100)]

    def run(n):
        rng, rows = random.Random(6), []
        for k in range(n):
            text = list(words)
            for at in rng.sample(range(100), 6):
                text[at] = f"e{rng.randrange(10**6)}"
            rows.append((k, " ".join(text), None))
        got, tables = tables_written(monkeypatch, spark, rows)
        monkeypatch.undo()
        assert got == joined_by_hand(rows)
        return sum(n for _, n in tables)

    assert run(160) <= 3.2 * run(80)


def test_parities_differ_in_no_more_bits_than_sets_and_tell_sets_apart():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 700, 3000):
        for m in (n, n + n // 7):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, m - n + n // 10).astype(np.uint64)])
            x, y = J._bitmaps(np.concatenate([a, b]), np.array([0, n, n + m]))
            w = min(len(x), len(y)) // 8
            apart, differ = int(np.bitwise_count(J._folded(x, w) ^ J._folded(y, w)).sum()), len(set(a.tolist()) ^ set(b.tolist()))
            assert apart <= differ and (n < 700 or apart >= 0.8 * differ) and (apart - differ) % 2 == 0


def test_rows_that_meet(monkeypatch):
    rng = np.random.default_rng(4)
    part = np.sort(rng.integers(0, 12, 90))
    kind = part % 2
    mine = rng.random(90) < 0.4
    mine[kind == 1] = False
    order = np.lexsort((mine, part))
    part, kind, mine = part[order], kind[order], mine[order]
    want = {(a, b) for a in range(90) for b in range(90) if part[a] == part[b] and not mine[a] and (mine[b] if kind[a] == 0 else a < b)}
    for cells in (1, 7, 1 << 20):
        monkeypatch.setattr(J, "CELLS", cells)
        got = [p for a, b in J._met(part, kind, mine) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want


# collocations


def phrases_by_hand(rows, least=30, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", small(text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = set()
    for lang, found in f.items():
        rows = []
        for p, a in found.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            around = max((b for q, b in found.items() if b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * around < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out |= {(lang, r + 1, p.decode(), -a, l, g, total[lang], -s) for r, (s, a, p, l, g) in enumerate(sorted(rows)[:top])}
    return out


def worded(rng):
    words = [f"{c}{d}" for c in "abcdeé" for d in ("", "x", "'")]
    def text():
        out = []
        for _ in range(rng.randint(0, 60)):
            out += ["the", "very", "same", "Words"] if rng.random() < 0.2 else [rng.choice(words)]
            if rng.random() < 0.1:
                out[-1] += rng.choice(".,;:!?\n\x0b\r")
        return rng.choice([" ", "\t", "  "]).join(out)
    return [(k, text(), rng.choice(["en", "fr", None, "und"])) for k in range(120)] + ODD


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"most": 40}), (3, {"most": 5}), (4, {"most": 200})])
def test_collocations_against_brute_force(spark, seed, how):
    """Few places for a task: prefixes of one, two and three words are hot and split deeper."""
    rows = worded(random.Random(seed))
    got = [tuple(r) for r in C.collocations(docs_of(spark, rows), least=8, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert set(got) == phrases_by_hand(rows, 8) and len(got) == len(set(got)) > 30


def test_collocations_over_cuts_and_flushes(spark, monkeypatch):
    """Cuts inside long documents don't part phrases, ends of documents do."""
    monkeypatch.setattr("fluxion.llm.kernel.SLICE", 50)
    monkeypatch.setattr(C, "FLUSH", 100)
    rows = worded(random.Random(9))
    docs = docs_of(spark, rows)
    batch = docs.select("lang", "text").toArrow().combine_chunks().to_batches()[0]
    got = Counter()
    held, last = [], None
    names = {}
    for doc, ids, begins, (low, start, end, langs, of, which) in C._tokens(batch, 0):
        for k, (i, b) in enumerate(zip(ids.tolist(), begins.tolist(), strict=True)):
            names[i] = (langs[of[which[k]]], low[start[k] : end[k]].tobytes().decode())
            if not b:
                got[names[last], names[i]] += 1
            last = i
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", small(text or "")):
            w = [(lang or "und", x) for x in re.split("[\x20\x09]+", piece) if x]
            want.update(zip(w[:-1], w[1:], strict=True))
    assert got == want


def test_collocations_empty(empty):
    assert C.collocations(empty).count() == 0


def test_collocation_scores_past_64_bits(spark):
    """The score's arithmetic is decimal: counts of 10**15 give exact floors."""
    expr = "(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"
    a, l, r = 987_654_321_012_345, 1_987_654_321_012_347, 1_111_111_111_111_111
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(expr)).first()[0] == 2_000_000 * a // (l + r)


# hostile input of earlier operators


def test_a_url_of_a_million_slashes(spark):
    pages = spark.createDataFrame([(1, "http://a.net/" + "/" * 1_000_000 + "x"), (2, "http://b.net/x" + "/" * 1_000_000), (3, "http://b.net/x")], "page_id long, url string")
    listed = spark.createDataFrame([("b.net/x",)], "listed string")
    began = time.perf_counter()
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages, listed).collect()}
    assert got == {1: "allow", 2: "block", 3: "block"} and time.perf_counter() - began < 20


def test_runs_of_blanks_below_the_switch():
    encode = encoder(tokenizer_path())
    encode("warm")
    text = "a".join([" " * 99_999] * 40)
    began = time.perf_counter()
    ids = encode(text)
    assert time.perf_counter() - began < 10 and ids


def test_contract_types_of_the_new_queries(spark, data):
    from fluxion.llm.queries import queries

    want = {
        "op11_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
        "op12_partition_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op13_prefix_grown_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    }
    for name, columns in want.items():
        assert dict(queries()[name](spark, data).dtypes) == columns
    assert reduce(int.__add__, map(len, want.values())) == 17


# joins that a hot key can't hold


@pytest.fixture
def skewed(spark):
    """Adaptive execution with thresholds of a few kilobytes, so that small tables count as skewed."""
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hub_of_links_is_split(skewed):
    from fluxion.llm.graph import _handed_back, components
    from fluxion.llm.support import materialise

    star = materialise(skewed.range(1, 60_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).repartition(8))
    least = materialise(star.groupBy("src").agg(F.min("dst").alias("m")))
    joined = _handed_back(star, least)
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    found = components(star)
    assert found.count() == 60_001 and found.select("component").distinct().collect() == [(0,)]


def test_hot_window_is_split(skewed):
    from fluxion.llm.line_dedup import dedup_lines, later_than
    from fluxion.llm.support import materialise

    found = materialise(skewed.range(60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.lit(5).cast("long").alias("a"), F.lit(6).cast("long").alias("b")).repartition(8))
    first = materialise(found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "pos")).alias("first")))
    later = later_than(found, first)
    assert len(later.collect()) == 59_999
    assert "skew=true" in later._jdf.queryExecution().executedPlan().toString()
    docs = skewed.range(3_000).select(F.col("id").alias("doc_id"), F.lit("one\ntwo\nthree").alias("text"))
    assert dedup_lines(docs).where("n_removed = 3").count() == 2_999
