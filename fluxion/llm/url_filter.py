"""URL filter: rules by host and path, and a blocked Bloom filter in front of an exact join with a list of URLs.

Listed canonical URLs are folded into a split-block Bloom filter: a hash picks a block of eight 64-bit words, a second hash
one bit in each word. Blocks are built by partial aggregates (bit_or) and never number more than MAX_BLOCKS, so that the
broadcast filter has 16 MB at most however long the list; a longer list only lets more rows through. Pages that may be
listed meet the list in an exact hash join on the canonical URL, which removes false positives; all others never move.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is never listed. Repeated rows
give repeated results. Null and repeated entries of the list change nothing; an empty list blocks nothing, and only rules
decide. Extra columns are ignored. URLs are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import fields, map_arrow, materialise

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BLOCKS = 1 << 18
#: Rules of the query: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The query's list, for want of a table of its own: the canonical URLs whose md5 begins with one of these digits, an eighth.
LISTED_DIGITS = "01"
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query."""
    after = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(after, "^[^?#]*[?]([^#]*)", 1)
    return F.translate(host, UPPER, SMALL), path, query


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without a closing `/` or index page, sorted query without tracking; no scheme, no fragment. Null if there is no host."""
    host, path, query = parts(url)
    host = F.regexp_replace(F.regexp_replace(host, "(:80|:443)?$", ""), "^www[.]", "")
    path = F.rtrim(F.regexp_replace(path, "/index[.]html?$", "/"), F.lit("/"))
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def apply_rules(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _hashes(url: Column, blocks: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int"), F.xxhash64(url, F.lit(7))


def build_filter(listed: DataFrame, count: int, blocks: int | None = None) -> np.ndarray:
    """The filter of the column `listed` as (blocks, 8) words; some 16 bits for each URL, up to MAX_BLOCKS blocks."""
    blocks = blocks or min(MAX_BLOCKS, 1 << max(0, (max(1, count) * 16 // 512)).bit_length())
    block, bits = _hashes(F.col("listed"), blocks)
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(bits, {6 * i}) & 63 as int))")).alias(f"w{i}") for i in range(8)]
    got = listed.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(*words).toPandas()
    out = np.zeros((blocks, 8), np.int64)
    out[got["block"].to_numpy()] = got[[f"w{i}" for i in range(8)]].to_numpy(np.int64)
    return out


def may_contain(words: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(block), bool)
    for i in range(8):
        out &= (words[block, i] >> (bits >> 6 * i & 63) & 1).astype(bool)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (boolean). listed: a column `listed` of canonical URLs. blocks: of the filter, by the list's size if not given."""
    listed = materialise(listed.select("listed").where("listed is not null").distinct())
    words = build_filter(listed, listed.count(), blocks)
    sent = pages.sparkSession.sparkContext.broadcast(words)
    host, path, _ = parts(F.col("url"))
    url = canonical(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), url.alias("canonical"))
    block, bits = _hashes(F.col("canonical"), len(words))
    rows = rows.select("*", block.alias("block"), bits.alias("bits"))
    schema = fields(*[(f.name, f.dataType) for f in rows.schema.fields[:4]], ("maybe", "boolean"))

    def probe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = may_contain(sent.value, batch.column(4).to_numpy(), batch.column(5).to_numpy()) & np.array(batch.column(3).is_valid())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hit)], names=schema.names)

    probed = materialise(map_arrow(rows, probe, schema))
    found = (
        probed.where("maybe")
        .join(listed, F.col("canonical") == F.col("listed"), "left")
        .select("page_id", "host", "path", F.col("listed").isNotNull().alias("listed"))
        .union(probed.where("not maybe").select("page_id", "host", "path", F.lit(False)))
    )
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_of(pages: DataFrame, digits: str = LISTED_DIGITS) -> DataFrame:
    """A list of URLs that says nothing of hosts: canonical URLs of pages whose md5 begins with one of the digits. A host has listed and other
    URLs, so that path and query decide, and spellings of a listed URL with another scheme, `www.`, tracking or fragment are listed as well."""
    url = pages.select(canonical(F.col("url")).alias("listed")).where("listed is not null")
    return url.where(F.substring(F.md5(F.col("listed").cast("binary")), 1, 1).isin(*digits))


ORACLE_SQL = rf"""
WITH a AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS r FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{SMALL}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS q
  FROM a),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '(:80|:443)?$', ''), '^www[.]', '')
    || regexp_replace(regexp_replace(path, '/index[.]html?$', '/'), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS u
  FROM b),
l AS (SELECT DISTINCT u FROM c WHERE left(md5(u), 1) IN ({", ".join(f"'{d}'" for d in LISTED_DIGITS)})),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in RULES)}) AS r(what, rule, site, rest)),
best AS (
  SELECT c.page_id, c.host, c.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.what, length(r.rule)) AS what
  FROM (SELECT DISTINCT page_id, host, path FROM c) c JOIN r ON (c.host = r.site OR ends_with(c.host, '.' || r.site)) AND starts_with(c.path, r.rest)
  GROUP BY ALL)
SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.what, CASE WHEN l.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.u IS NOT NULL AS listed
FROM c LEFT JOIN best ON c.page_id = best.page_id AND c.host = best.host AND c.path = best.path LEFT JOIN l ON c.u = l.u
"""
