"""Quality classifier, personal data, near-duplicates and decontamination against brute force and planted cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxion.llm import decontaminate, kernel, near_dup, personal_data, quality, queries
from fluxion.llm.graph import components
from fluxion.llm.superminhash import signatures

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- kernel


def test_kernel_words_and_shingles_agree_with_strings(monkeypatch):
    texts = ["Ab  cd\x0bef", None, "", " x ", "é x y " * 50, "one two three four five six one two three four five", "z" * 300, "a b"]
    for size in (40, 2_000_000):
        monkeypatch.setattr(kernel, "SLICE", size)
        seen: dict = {}
        n = 0
        for i, j, hashed, offsets in kernel.words(pa.array(texts)):
            parts, at = kernel.shingles(hashed, offsets)
            for k in range(i, j):
                words = re.findall(r"[^\x20\x09-\x0D]+", (texts[k] or "").translate(LOW))
                own = hashed[offsets[k - i] : offsets[k - i + 1]]
                assert len(own) == len(words)
                for w, h in zip(words, own.tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
                want = [tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))] if words else []
                got = parts[at[k - i] : at[k - i + 1]].tolist()
                assert len(got) == len(want)
                for w, h in zip(want, got, strict=True):
                    assert seen.setdefault(w, h) == h
                n += 1
        assert n == len(texts) and len(set(seen.values())) == len(seen)


def test_superminhash_estimates_and_matches_the_sequential_form():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = pool[:300], pool[100:]
    s = signatures(np.concatenate([a, b, np.repeat(a, 2), pool[:0], pool[:1]]), np.array([0, 300, 600, 1200, 1200, 1201]), 128)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.15 and (s[0] == s[2]).all()
    assert (s[3] == np.iinfo(np.uint64).max).all() and len(set((s[4] >> np.uint64(57)).tolist())) == 128
    # sequential form: the same draws, one element after another with an explicit permutation
    m = 16
    got = signatures(pool[:20], np.array([0, 20]), m)[0]
    want = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for d in pool[:20]:
        p = list(range(m))
        for j in range(m):
            drawn = kernel.mix(np.array([d]) + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            k = j + int(((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32))[0])
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(want[p[j]], ((kernel.mix(drawn) >> np.uint64(4)) | np.uint64(j << 60))[0])
    assert (got == want).all()


# --- near-duplicates


def brute_components(docs):
    """{doc_id: (n_shingles, component)} by comparing every pair that shares a shingle."""
    sets, owner, held = {}, {}, defaultdict(set)
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for s in sets[i]:
            held[s].add(i)
    common = defaultdict(int)
    for own in held.values():
        own = sorted(own)
        for x in range(len(own)):
            for y in range(x):
                common[own[y], own[x]] += 1
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_on_test_tables(spark, data):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_superminhash_near_dup(spark, data).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute_components(docs)


def test_near_duplicates_of_a_large_group(spark):
    """A group that is most of the table: distinct texts around one base, links that no leader sees, several blocks."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = word()
        docs.append((i, " ".join(own)))
    docs += [(1000 + i, " ".join(word() for _ in range(50))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_components(docs)
    for estimate in (near_dup.LEAST_ESTIMATE, 0.0):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame, block=16, estimate=estimate).collect()}
        assert got == want


def test_near_duplicates_odd_and_empty(odd, empty):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == by[1]["component_id"] == 1 and not by[7]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (2, 3, 4))
    assert by[5]["n_shingles"] == 1 and by[6]["n_shingles"] == 1 and by[None]["component_id"] is None and by[None]["kept"]
    assert near_dup.near_duplicates(empty).count() == 0
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(odd).collect()) == sorted(map(str, [1, 1, 2, 3, 4, 5, None, 6, 8]))


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(300, 360)] + [(5, x) for x in range(400, 450)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 3), (8, 8)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in list(parent)}
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    assert {r["node"]: r["component"] for r in components(frame).collect()} == want
    assert components(frame.limit(0)).count() == 0


def test_components_of_a_long_path_raise_rather_than_stop(spark):
    path = [(k * 7919 % 1000, (k + 1) * 7919 % 1000) for k in range(999)]
    frame = spark.createDataFrame(path, "src long, dst long").repartition(50, "src")
    with pytest.raises(RuntimeError):
        components(frame, most=1)
    assert components(frame).agg(F.count("*"), F.max("component")).first() == (1000, 0)


def test_shares_of_huge_tables_are_not_none(spark):
    from fluxion.llm.support import sampled, share, shared_folder

    assert share(20_000, 10**11) > 0 and share(20_000, 10**18) > 0 and abs(share(3, 4) / (1 << 62) - 0.75) < 1e-9
    ids = spark.range(10_000).withColumnRenamed("id", "doc_id")
    assert ids.where(sampled("doc_id", 1, 5000, 10_000)).count() == pytest.approx(5000, abs=300) and ids.where(sampled("doc_id", 1, 10_000, 10_000)).count() == 10_000

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Cluster)


# --- quality


def planted(spark, n=1500, seed=2):
    rng = random.Random(seed)
    good_words = ["".join(rng.choice(("ka", "lo", "mi", "ter", "en", "sou")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad_words = ["vilest", "scumming", "hatred"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good_words) for _ in range(rng.randint(30, 120))]
        kind = rng.random()
        toxic, good = kind < 0.15, kind < 0.85
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad_words)
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), int(good and not toxic)))
        if i % 5 < 3:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, truth int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_parts_planted_documents(spark):
    docs, labels = planted(spark)
    kept = {r["doc_id"] for r in quality.resample(docs, labels).collect()}
    truth = {r["doc_id"]: r["truth"] for r in docs.select("doc_id", "truth").collect()}
    good = [i for i, t in truth.items() if t]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, t in truth.items() if not t) <= 0.03 * (len(truth) - len(good))


def planted_lengths(spark, n=3000, seed=5):
    """Good and bad documents of 2 to 4,000 words; 3 % of the words of good text and 60 % of those of bad text are shouted."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(("ka", "lo", "mi", "ter", "en", "sou", "ri", "da")) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = [words[int(len(words) * rng.random() ** 3)] for _ in range(int(2 ** rng.uniform(1, 12)))]
        text = [w.upper() + "!!" if rng.random() < (0.6 if bad else 0.03) else w for w in text]
        docs.append((i, " ".join(text), int(not bad), len(text)))
        if i % 5 < 3:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, truth int, n int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_judges_texts_of_all_lengths_alike(spark):
    docs, labels = planted_lengths(spark)
    weight = {r["doc_id"]: r["log_weight"] for r in quality.resample(docs, labels).collect()}
    rows = docs.select("doc_id", "truth", "n").collect()
    middle = []
    for a, b, most in ((2, 8, 0.35), (8, 32, 0.05), (32, 256, 0.05), (256, 1024, 0.05), (1024, 5000, 0.05)):
        good, bad = ([r["doc_id"] for r in rows if r["truth"] == t and a <= r["n"] < b] for t in (1, 0))
        assert sum(i in weight for i in good) >= 0.95 * len(good) and sum(i in weight for i in bad) <= most * len(bad)
        middle.append(sorted(weight[i] for i in good if i in weight)[len(good) // 2])
    assert max(middle) - min(middle) < 1.5


@pytest.mark.parametrize("passages", [True, False])
def test_log_weights_against_a_dictionary_model(spark, data, passages):
    """Counts of features kept in dictionaries by name, whole texts, token by token; on the smallest table."""
    import math

    docs = spark.read.parquet(f"{data.replace('sf0.01', 'sf0.001')}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {i for i in texts if i % 3 == 0}
    labels = spark.createDataFrame([(i, True) for i in good], "doc_id long, good boolean")
    raw, target = quality.fit(docs, labels, 10**9)
    got = {r["doc_id"]: r for r in quality.score(docs, raw, target).collect()}
    kind = lambda c: "a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c

    def tokens(text):
        out, last, before = [], None, None
        for token in re.findall(r"[^\x20\x09-\x0D]+", text):
            own = "".join(k for j, k in enumerate(map(kind, token)) if j == 0 or k != kind(token[j - 1]))
            own = "same" if token == before else own
            word = re.search(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", token.translate(LOW))
            # a letter beyond ASCII is two bytes: prefixes are bytes
            out.append((word.group().encode() if word else None, word.group().encode()[: quality.PREFIX] if word else None, (own, last)))
            last, before = own, token
        return out

    slot_of: dict = {}
    seen = {}
    for i, text in texts.items():
        ((_, _, slots, known, _),) = quality.features(pa.array([text]))
        names = tokens(text)
        assert slots.shape[1] == len(names) == got[i]["n_tokens"] and known.tolist() == [w is not None for w, _, _ in names]
        seen[i] = [[(t, s) for t, s in enumerate(row) if t == 3 or k] for row, k in zip(slots.T.tolist(), known.tolist(), strict=True)]
        for name, row, k in zip(names, slots.T.tolist(), known.tolist(), strict=True):  # one slot for each name, always
            for t, part in enumerate((name[0], name[0], name[1], name[2])):
                assert slot_of.setdefault((t, part), row[t]) == row[t] or not k and t < 3
    counts: dict = defaultdict(lambda: [0, 0])
    for i, own in seen.items():
        for f in (f for token in own for f in token):
            counts[f][0] += 1
            counts[f][1] += i in good
    total = {t: [sum(c[j] for (u, _), c in counts.items() if u == t) for j in (0, 1)] for t in range(4)}
    ratio = lambda f: math.log((counts[f][1] + quality.PRIOR) / (counts[f][0] * total[f[0]][1] / total[f[0]][0] + quality.PRIOR))
    for i, own in seen.items():
        value = []
        for token in own:
            parts = dict(token)
            word = min(((0, parts[0]), (1, parts[1])), key=lambda f: (counts[f][0], f[0])) if 0 in parts else None
            value.append((min(ratio(word), quality.MOST) + min(ratio((2, parts[2])), quality.MOST) if word else 0.0) + min(max(ratio((3, parts[3])), quality.SHAPE_LEAST), quality.MOST))
        w = min(quality.WINDOW, len(value))
        want = min((sum(value[k : k + w]) for k in range(len(value) - w + 1)), default=0.0) if passages else sum(value)
        assert got[i]["least" if passages else "whole"] == pytest.approx(want, abs=1e-3, rel=1e-4)


def test_gumbel_top_k_takes_exactly_the_largest_keys(spark):
    scored = spark.range(5000).selectExpr("id as doc_id", "cast(id % 7 as double) as log_weight")
    keys = sorted(((r["gumbel_key"], r["doc_id"]) for r in quality.gumbel_top_k(scored, 5000, 5000).collect()), reverse=True)
    for k in (0, 1, 37, 4999):
        assert {r["doc_id"] for r in quality.gumbel_top_k(scored, k, 5000).collect()} == {i for _, i in keys[:k]}


def test_quality_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality.resample(odd, labels).count() == 10  # too few labels of both kinds to calibrate: all stay
    assert quality.resample(odd, labels.limit(0)).count() == 10 and quality.resample(empty, labels).count() == 0
    assert quality.keep_sampled(odd, labels).columns == odd.columns and quality.keep_sampled(odd, labels).count() == 10


# --- personal data


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_patterns_agree_with_regular_expressions():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "@@", "x@y", ".", "..", "1", "25", "256", "1.2.3.4", ".5", "+", "+1", "(", ")", " ", "-", "4111 1111 1111 1111", "é", "١", "%", "_", "example.com", "555-123-4567", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert personal_data.base_spans(text) == brute_base(text), text


def test_personal_data_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    secrets = found = 0
    for r in queries.op6_semi_markov_pii(spark, data).collect():
        text = docs[r["doc_id"]] or ""
        base = brute_base(text)
        assert [r[f"n_{k}"] for k in personal_data.BASE] == [sum(t == k for _, t, _ in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(personal_data.joined(base).encode()).hexdigest()
        assert set(filter(None, personal_data.joined(base).split(","))) <= set(r["spans"].split(","))
        own = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",") if s.startswith("secret")]
        for m in re.finditer(r"password=\w+|AKIA[A-Z0-9]{16}|(?<=\")[0-9a-f]{40}(?=\")", text):
            secrets += 1
            found += m.group() in own
    assert found >= 0.9 * secrets


def test_long_tokens_are_described_whole():
    text = "w" * 500 + " " + "x" * 400 + "1 " + "x" * 400 + "."
    assert personal_data._before(text, 501, 3, 0) == [(0, 500)]
    of = lambda s: personal_data.segment_features(s, [(0, len(s))], 0, 1)
    assert "digits=1" in of("x" * 400 + "1") and "digits=0" in of("x" * 400) and of("a" * 900 + "=secret77") != of("a" * 900 + "=secret7")
    assert personal_data.shape("aB1" * 5) != personal_data.shape("aB1" * 5 + "-") and personal_data.shape("a1" * 50) == "many 0a" != personal_data.shape("a1" * 50 + "-")


def test_field_on_held_out_sentences():
    field = personal_data.trained()
    right = sum(field.decode(text, tokens) == [g for g in gold if g[2] != personal_data._OTHER] for text, tokens, gold in personal_data.training_sentences(200, 77))
    assert right >= 180


def test_decoding_is_the_best_of_all_segmentations():
    field = personal_data.trained()
    for text, tokens, _ in list(personal_data.training_sentences(30, 123)):
        tokens = tokens[:6]

        def every(at, before):
            if at == len(tokens):
                yield 0.0, ()
                return
            for b in range(at + 1, min(len(tokens), at + personal_data.MAX_TOKENS) + 1):
                score = field._score(text, tokens, at, b)[1]
                for t in range(personal_data._OTHER + 1):
                    for rest, own in every(b, t):
                        yield score[t] + field.follow[before, t] + rest, ((at, b, t), *own)

        if len(tokens) <= 4:
            best = max(every(0, personal_data._OTHER + 1))[1]
            assert [g for g in best if g[2] != personal_data._OTHER] == field.decode(text, tokens)


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 50_000, "a@" * 50_000, "x" * 200_000 + "@", "= " * 3000, "9" + " " * 100_000, "@", "+", "="])
def test_personal_data_takes_linear_time(text):
    base, spans = personal_data.all_spans(text, personal_data.trained())
    assert set(base) <= set(spans)


def test_personal_data_odd_and_empty(odd, empty):
    rows = personal_data.find_personal_data(odd).collect()
    assert len(rows) == 10 and personal_data.find_personal_data(empty).count() == 0
    assert {r["base_sha256"] for r in rows if r["doc_id"] in (2, 3, 4)} == {hashlib.sha256(b"").hexdigest()}
    assert [(r["n_email"], r["n_phone"]) for r in rows if r["doc_id"] == 8] == [(1, 1)]


# --- decontamination


def brute_alignment(item, words):
    best = 0
    row = [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(words):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def test_smith_waterman():
    rng = random.Random(9)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        words = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        got, a, b = decontaminate.smith_waterman(np.array(item, np.uint64), np.array(words, np.uint64))
        assert got == brute_alignment(item, words) and 0 <= a <= b <= len(words)
        assert got == 0 or brute_alignment(item, words[a:b]) == got


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_decontamination_against_all_alignments(spark, data):
    """Every document against every item by full alignment, on the smallest table."""
    small = data.replace("sf0.01", "sf0.001")
    docs = [(r["doc_id"], tokens(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], tokens(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    number: dict = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.uint64)
    items = [(i, code(w)) for i, w in items]
    want = set()
    for d, w in docs:
        own = code(w)
        want |= {(d, i) for i, item in items if decontaminate.smith_waterman(item, own)[0] >= decontaminate.LEAST * 2 * len(item)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_benchmark_decontamination(spark, small).collect()}
    assert got == want


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ter", "en", "sou")) for _ in range(rng.randint(2, 4)))
    items = [(k, [word() for _ in range(rng.randint(16, 50))]) for k in range(25)]
    docs = []
    for k, ws in items:
        edited = [word() if rng.random() < 0.2 else w for w in ws]
        del edited[rng.randrange(len(edited))]
        docs.append((k, " ".join([word() for _ in range(80)] + [w.upper() + "," for w in edited] + [word() for _ in range(80)])))
    docs += [(100 + k, " ".join(word() for _ in range(200))) for k in range(40)]
    benchmark = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items] + [(None, "x y z"), (90, None), (91, ""), (92, "solo")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, benchmark).collect()}
    number: dict = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.uint64)
    want = {(k, k) for k, ws in items if decontaminate.smith_waterman(code(ws), code(tokens(docs[k][1])))[0] >= decontaminate.LEAST * 2 * len(ws)}
    assert got == want and len(want) >= 24
    assert {r["doc_id"] for r in decontaminate.clean(frame, benchmark).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_odd_and_empty(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, "id at"), (2, "id at")], "item_id int, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in decontaminate.contaminated(odd, benchmark).collect())
    assert got == [(-1, 2), (-1, 2), (1, 1), (1, 1), (7, 1)]
    assert decontaminate.contaminated(empty, benchmark).count() == 0 and decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(odd, benchmark).columns == odd.columns


# --- the queries as a whole


def test_every_query_reads_whole_tables(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op1_mpeg_audio", "op2_hyperdimensional_language_id", "op5_suffix_automaton_licences", "op6_semi_markov_pii", "op7_superminhash_near_dup", "op10_line_window_dedup"):
        assert queries.queries()[name](spark, data).agg(F.countDistinct("doc_id")).first()[0] == n
