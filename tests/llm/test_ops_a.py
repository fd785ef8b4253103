"""Media columns, language ID, URL filter and licence scan against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from fluxion.llm import licences, mpeg_audio, queries, url_filter
from fluxion.llm.language_id import language_id

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def padded(text):
    b = (text or "").encode()
    return b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))


def test_mpeg_query_round_trip(spark, data):
    rows = {r["doc_id"]: r for r in queries.op1_mpeg_audio(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, p = rows[d["doc_id"]], padded(d["text"])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(d["text"].encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        assert r["crc_bad"] == 0 and r["skipped_bytes"] == 0


def test_mpeg_odd_and_empty(odd, empty):
    rows = mpeg_audio.probe_media(mpeg_audio.encode_texts(odd), "doc_id", "n_bytes").collect()
    assert len(rows) == 10
    null = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {r["payload_sha256"] for r in null} == {hashlib.sha256(bytes(64)).hexdigest()} and len({r["media_sha256"] for r in null}) == 1
    assert mpeg_audio.probe_media(mpeg_audio.encode_texts(empty), "doc_id").count() == 0


def test_mpeg_resynchronises_and_checks():
    media = mpeg_audio.encode(padded("a" * 5000))
    whole = mpeg_audio.probe(media)
    assert whole.samples == whole.frames * 1152 and whole.table == "Xing" and whole.table_frames == whole.frames
    start = 10 + int.from_bytes(media[8:10], "big")  # the tag is short
    assert start + whole.table_bytes == len(media) - 128 and len(whole.toc) == 100 and whole.offsets[0] > start
    at = whole.offsets[1]
    damaged = mpeg_audio.probe(media[:at] + b"\xff\xfb\x00junk" + media[at:])
    assert damaged.frames >= whole.frames - 1 and damaged.skipped >= 7
    broken = bytearray(media)
    broken[at + 7] ^= 0x55  # side information
    assert mpeg_audio.probe(bytes(broken)).crc_bad == 1
    assert mpeg_audio.probe(b"\xff" * 1000).frames == 0 and mpeg_audio.probe(None).frames == 0
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


@pytest.mark.parametrize(
    ("head", "allocation", "bits"),
    [
        ("fffe58c0", "1" * 8, 128),  # layer I, mono
        ("fffe5800", "1" * 8, 256),  # stereo
        ("fffe5860", "1" * 8, 176),  # joint from subband 12: 2 * 12 + 20 allocations of 4 bits
        ("fffc48c0", "0001" + "0" * 84, 90),  # layer II, mono, 64 kbit/s: 11 * 4 + 12 * 3 + 4 * 2 bits, and scfsi of one subband
        ("fffca8c0", "0" * 94, 94),  # 192 kbit/s: 11 * 4 + 12 * 3 + 7 * 2
        ("fffc18c0", "0" * 38, 38),  # 32 kbit/s at 32 kHz: 2 * 4 + 10 * 3
        ("fff444c0", "0" * 75, 75),  # MPEG-2: 4 * 4 + 7 * 3 + 19 * 2
    ],
)
def test_mpeg_checks_layers_one_and_two(head, allocation, bits):
    """A bit turned within the protected bits is seen, one behind them isn't; the checksum is bit by bit as in the standard."""
    head = bytes.fromhex(head)
    h = mpeg_audio.parse_header(head)
    body = allocation.ljust(8 * (h.size - 6), "0")
    c = 0xFFFF
    for bit in f"{int.from_bytes(head[2:], 'big'):016b}" + body[:bits]:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ int(bit) else 0)

    def frame(text):
        return head + c.to_bytes(2, "big") + int(text, 2).to_bytes(h.size - 6, "big")

    def turned(k):
        return body[:k] + "10"[int(body[k])] + body[k + 1 :]

    for text, bad in ((body, 0), (turned(1), 1), (turned(bits - 1), 1), (turned(bits), 0)):
        p = mpeg_audio.probe(frame(body) + frame(text) + frame(body))
        assert (p.frames, p.crc_checked, p.crc_bad) == (3, 3, bad)


def test_mpeg_other_streams():
    """A layer II stream at 44.1 kHz with padding, free of CRCs, and a VBRI table in layer III."""
    head = bytes([0xFF, 0xFD, 0xA2, 0xC0])  # layer II, 192 kbit/s, padded
    h = mpeg_audio.parse_header(head)
    assert (h.layer, h.kbps, h.rate, h.size, h.samples) == (2, 192, 44100, 144 * 192000 // 44100 + 1, 1152)
    p = mpeg_audio.probe((head + bytes(h.size - 4)) * 3)
    assert (p.frames, p.samples, p.offsets) == (3, 3456, [0, h.size, 2 * h.size])
    head = bytes([0xFF, 0xFB, 0x90, 0x00])
    h = mpeg_audio.parse_header(head)
    body = bytearray(h.size - 4)
    body[32:36] = b"VBRI"
    body[32 + 10 : 32 + 18] = (1234).to_bytes(4, "big") + (7).to_bytes(4, "big")
    p = mpeg_audio.probe(head + bytes(body) + (head + bytes(h.size - 4)) * 2)
    assert (p.table, p.table_bytes, p.table_frames, p.frames) == ("VBRI", 1234, 7, 2)


def walk(data):
    """Frames of layer III at 32 kHz mono, one after the other, read without the module: (offset, kbit/s)."""
    kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    at = 10 + sum((b & 127) << 7 * k for k, b in enumerate(reversed(data[6:10])))
    while data[at : at + 3] != b"TAG":
        k = kbps[data[at + 2] >> 4]
        yield at, k
        at += 144 * 1000 * k // 32000


@pytest.mark.parametrize("n", [0, 1, 500, 1396, 1397, 1398, 5000, 123_456])
def test_mpeg_durations_and_offsets_against_a_plain_walk(n):
    """The frame with the table is no sound: as many frames as the payload needs, and their offsets, rates and seconds."""
    media = mpeg_audio.encode(padded("x" * n))
    frames = list(walk(media))[1:]
    p = mpeg_audio.probe(media)
    assert p.offsets == [a for a, _ in frames] and (p.kbps_min, p.kbps_max) == (min(k for _, k in frames), max(k for _, k in frames))
    assert p.frames == p.table_frames == len(frames) and p.samples == 1152 * len(frames) and p.tags["TLEN"] == str(36 * len(frames))
    assert b"".join(media[a + 23 : a + 144000 * k // 32000] for a, k in frames)[: len(padded("x" * n))] == padded("x" * n)


def test_mpeg_table_of_another_writer():
    """Info table with frames and bytes only, and a writer's part with delay 576 and padding 1,000: 5 frames of sound."""
    head = bytes([0xFF, 0xFB, 0x90, 0xC0])  # layer III, 128 kbit/s, 44.1 kHz, mono
    size = mpeg_audio.parse_header(head).size
    table = b"Info" + (3).to_bytes(4, "big") + (5).to_bytes(4, "big") + (6 * size).to_bytes(4, "big")
    writer = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    first = (head + bytes(17) + table + writer).ljust(size, b"\0")
    p = mpeg_audio.probe(first + (head + bytes(size - 4)) * 5)
    assert (p.frames, p.samples, p.delay, p.padding, p.table_frames, p.offsets[0]) == (5, 5 * 1152 - 1576, 576, 1000, 5, size)
    plain = mpeg_audio.probe((head + bytes(17) + table).ljust(size, b"\0") + (head + bytes(size - 4)) * 5)
    assert (plain.frames, plain.samples, plain.delay) == (5, 5 * 1152, 0)


@pytest.mark.parametrize("said", ["abc", "-5", "", "9" * 30, "999999", "1e3", "٣"])
def test_mpeg_hostile_payload_lengths(said, spark):
    body = b"\3payload_bytes\0" + said.encode()
    tags = b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body
    media = b"ID3\x03\0\0" + mpeg_audio._synchsafe(len(tags)) + tags + mpeg_audio.encode(padded("abc"))[10:]
    assert mpeg_audio.payload_of(media, mpeg_audio.probe(media)) == b""


def test_language_accuracy(spark, data):
    got = {r["doc_id"]: r for r in queries.op2_hyperdimensional_language_id(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert all((zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) == got[d["doc_id"]]["held_out"] for d in docs)
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_against_explicit_hyperdimensional_vectors(spark):
    """Permutation, binding and bundling letter by letter, over a few texts, with ties."""
    import numpy as np

    from fluxion.llm import language_id as L

    texts = [(1, "aa ab", "x"), (2, "Ba! 7 b", "x"), (3, "ccc dcd", "y"), (4, "é É éa", "z"), (5, "aa ab", "w"), (6, "aa ab", None), (7, "?? 12", "x"), (8, None, "y"), (9, "a" * 50, None)]
    size = 256

    def vector(text):
        clean = "".join(c.lower() if c.isalpha() else " " for c in text or "")
        clean = " " + " ".join(clean.split()) + " "
        out = np.zeros(size)
        letter = lambda c: L.letter(0 if c == " " else ord(c), size).astype(float)
        for a, b, c in zip(clean, clean[1:], clean[2:], strict=False):
            if b != " ":
                out += np.roll(np.roll(letter(a), 1) * letter(b), 1) * letter(c)
        return out

    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    learned = {}
    for _, t, lang in texts:
        if lang:
            learned[lang] = learned.get(lang, np.zeros(size)) + unit(vector(t))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    names, prototypes = L.learn(docs.where("lang is not null"), size)
    assert names == sorted(learned) and np.allclose(prototypes, [unit(learned[n]) for n in names], atol=1e-5)
    got = {r["doc_id"]: r for r in L.identify(docs, names, prototypes).collect()}
    for i, t, _ in texts:
        v = unit(vector(t))
        cosine = [round(float(v @ unit(learned[n])), 5) for n in names]
        if not v.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert abs(got[i]["cosine"] - max(cosine)) < 1e-4 and abs(got[i]["score"] - (1 + max(cosine)) / 2) < 1e-4
            assert cosine[names.index(got[i]["lang_pred"])] >= max(cosine) - 1e-4
    tied = L.identify(docs, ["p", "q"], np.stack([prototypes[0], prototypes[0]])).where("doc_id = 1").first()
    assert tied["lang_pred"] == "p"  # equal cosines: the language first in order


def test_language_odd_and_empty(odd, empty):
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id(odd).collect()]
    assert len(got) == 10 and {lang for i, lang in got if i in (2, 3, 4)} == {"und"}
    assert language_id(empty).count() == 0


def test_urls_odd(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "HTTP://A.ORG"), (4, "http://a.org/x"), (5, "https://www.Example.org/en/12?x=1#f"), (6, "http://b.example.org/es/"),
        (7, "http://x.com/de/1"), (8, "http://x.com/fr/1"), (9, "http://www.listed.net/p/?utm_source=a&b=1"), (9, "http://www.listed.net/p/?utm_source=a&b=1"), (10, "http://notorg/"), (11, "a://b://c.org/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as html", "'r' as rule", "1 as block", "'l' as listed")
    listed = spark.createDataFrame([("listed.net/p?b=1",), (None,), ("listed.net/p?b=1",)], "listed string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(pages, listed).collect()}
    assert got[1] == got[2] == ("", "", None, "allow", False)
    assert got[3] == ("a.org", "", None, "allow", False) and got[4][2:4] == ("org/", "allow")
    assert got[5][2:4] == ("example.org/en/1", "block") and got[6][2:4] == ("example.org/es/", "block")
    assert got[7][2:4] == ("com/de/", "block") and got[8][2:4] == ("com/fr/", "allow")
    assert got[9] == ("www.listed.net", "/p/", None, "block", True) and got[10][2] is None and got[11][0] == "b:"
    assert url_filter.filter_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_path_and_query_decide_and_the_join_removes_false_positives(spark, data, monkeypatch):
    """The list names no host: hosts have listed and other pages. A full filter lets everything through, and the join still parts them; without
    the join the result would differ, and without the filter's pass nothing would be listed."""
    pages = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet")
    listed = url_filter.listed_of(pages, "0123456")
    want = sorted((r["page_id"], r["verdict"], r["listed"]) for r in url_filter.filter_urls(pages, listed).collect())
    assert 0.3 < sum(x for *_, x in want) / len(want) < 0.6
    hosts = {}
    for r in url_filter.filter_urls(pages, listed).select("host", "listed").collect():
        hosts.setdefault(r["host"].removeprefix("www."), set()).add(r["listed"])
    assert any(len(v) == 2 for v in hosts.values())
    full = url_filter.filter_urls(pages, listed, blocks=1)  # a single block of 512 bits: many false positives
    words = url_filter.build_filter(listed, 1, 1)
    block, bits = url_filter._hashes(url_filter.canonical(pages["url"]), 1)
    p = pages.select(block.alias("k"), bits.alias("b")).toPandas()
    assert url_filter.may_contain(words, p["k"].to_numpy(), p["b"].to_numpy()).sum() > sum(x for *_, x in want)
    assert sorted((r["page_id"], r["verdict"], r["listed"]) for r in full.collect()) == want
    monkeypatch.setattr(url_filter, "may_contain", lambda words, block, bits: block < 0)
    assert not any(r["listed"] for r in url_filter.filter_urls(pages, listed).collect())


def test_urls_long_and_extra_columns_on_empty_input(spark):
    path = "/p" * 500_000
    pages = spark.createDataFrame([(1, f"http://Listed.net{path}/?b=2&a=1&utm_x=3"), (2, f"http://listed.net{path}x"), (3, None)], "page_id long, url string").selectExpr("*", "'x' as canonical", "'y' as maybe")
    listed = spark.createDataFrame([(f"listed.net{path}?a=1&b=2",)], "listed string")
    got = {r["page_id"]: (r["verdict"], len(r["path"])) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {1: ("block", len(path) + 1), 2: ("allow", len(path) + 1), 3: ("allow", 0)}
    out = url_filter.filter_urls(pages.limit(0), listed)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "listed"] and out.count() == 0 and url_filter.listed_of(pages.limit(0)).count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    listed = spark.range(20_000).selectExpr("concat('h', id) as listed")
    words = url_filter.build_filter(listed, 20_000)
    others = spark.range(20_000).selectExpr("concat('x', id) as listed")
    for frame, low, high in ((listed, 1.0, 1.0), (others, 0.0, 0.01)):
        block, bits = url_filter._hashes(frame["listed"], len(words))
        p = frame.select(block.alias("k"), bits.alias("b")).toPandas()
        assert low <= url_filter.may_contain(words, p["k"].to_numpy(), p["b"].to_numpy()).mean() <= high


def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at = []
    for label, phrase in licences.BASE.items():
        p = phrase.split()
        at += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licence_base(spark, data, odd, empty):
    extra = spark.createDataFrame([(10, "under the MIT licen\u017fe under the mit license. APACHE-license, version 2.0 cc by-nc/4 under the mit\nlicense"), (11, "under the mit"), (12, "license")], "doc_id long, text string")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(extra).union(odd.select("doc_id", "text"))
    want = sorted(((r["doc_id"] or -1, *brute_licences(r["text"])) for r in docs.collect()), key=str)
    got = sorted(((r["doc_id"] or -1, *r[1:6]) for r in licences.scan_licences(docs).collect()), key=str)
    assert got == want
    assert licences.scan_licences(empty).count() == 0


def test_licence_matching_statistics(spark):
    s = licences._scanner((tuple((k, tuple(v)) for k, v in licences.TEMPLATES.items()), tuple(licences.BASE.items()), 3, 12, 0.6))
    seqs = [[1, 2, 3, 1, 2, 4], [2, 3, 1, 5]]
    auto = licences.Automaton(seqs)
    import random

    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randint(1, 5) for _ in range(12)]
        best = []
        for end in range(1, 13):
            n = max((k for k in range(end + 1) if any(words[end - k : end] == q[i : i + k] for q in seqs for i in range(len(q) - k + 1))), default=0)
            best.append(n)
        want = [(best[e - 1], e) for e in range(1, 13) if best[e - 1] >= 1 and (e == 12 or best[e] != best[e - 1] + 1)]
        assert [(n, e) for _, n, e in auto.matches(words, 1)] == want
    assert s.sizes


@pytest.mark.parametrize("label", sorted(licences.TEMPLATES))
def test_licence_templates_are_found_with_edits(spark, label):
    text = "Some words before. " + licences.TEMPLATES[label][-1].replace("software", "library").upper() + " and after"
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert label in row["labels"].split(",") and row["score"] >= 0.6


def test_licence_chains_cover_as_many_words_as_any():
    import random
    from itertools import combinations

    rng = random.Random(11)

    def worth(chain, gap):
        """Words that a series of matches covers, or 0 if it is no chain."""
        total, text, template = 0, None, 0
        for start, end, lo, hi in chain:
            lost = max(0, text - start, template - lo) if text is not None else 0
            if lost >= hi - lo or text is not None and start + lost - text > gap:
                return 0
            total, text, template = total + hi - lo - lost, end, hi
        return total

    for _ in range(300):
        matches = []
        for _ in range(rng.randint(1, 7)):
            start, lo, n = rng.randint(0, 30), rng.randint(0, 20), rng.randint(1, 6)
            matches.append((start, start + n, lo, lo + n))
        matches = sorted(set(matches), key=lambda m: (m[1], m[3], m[0]))
        most = max(worth(c, 5) for k in range(1, len(matches) + 1) for c in combinations(matches, k))
        chains = licences.chains_of(matches, 5)
        assert sum(hi - lo for _, _, lo, hi in chains[0]) == most
        places = sorted((c[0][0], c[-1][1]) for c in chains)
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
        assert all(p[1] <= q[0] and p[3] <= q[2] for c in chains for p, q in zip(c, c[1:], strict=False))


def test_licence_keeps_its_label_with_long_insertions_and_gaps(spark):
    texts = []
    for label in ("mit", "apache-2", "gpl-3", "bsd-3"):
        w = re.findall("[A-Za-z0-9]+", licences.TEMPLATES[label][-1])
        for k in range(1, len(w)):
            texts.append((label, " ".join(w[:k] + ["zebra"] * 13 + w[k:])))
    texts.append(("mit", licences.TEMPLATES["mit"][-1].replace("a copy of this software and associated documentation files (the Software)", "a copy of the Software")))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.scan_licences(docs).collect()}
    assert [i for i, (label, _) in enumerate(texts) if label not in got[i]] == []


def test_licence_words_strewn_over_a_long_text_give_no_label(spark):
    w = re.findall("[A-Za-z0-9]+", licences.TEMPLATES["mit"][-1])
    text = " ".join(" ".join(w[k : k + 3]) + " zebra" * 400 for k in range(0, len(w) - 2, 3))
    row = licences.scan_licences(spark.createDataFrame([(1, text * 3)], "doc_id long, text string")).collect()[0]
    assert row["labels"] == "" and row["score"] < 0.6
