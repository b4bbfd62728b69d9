"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, langid, mixing, neardup, quality, secretscan, sharding, tokenstore, urlfilter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_digests(_documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = langid.train(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against dated lists; fetch times and lists follow from page ids and hosts by fixed rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(366)) * 86400 + F.pmod(F.col("page_id") * 104729, F.lit(86400)))
    captures = common.materialise(pages.withColumn("fetch_time", fetched), "op6-captures")
    digit = lambda key, salt, mod: F.pmod(F.conv(F.substring(F.md5(F.concat(key, salt)), 1, 8), 16, 10).cast("long"), F.lit(mod))
    sites = captures.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.segment_of(F.col("url")).alias("segment")).filter("host is not null")
    path, domain = F.when(F.col("segment") != "", F.concat("host", "segment")), F.regexp_extract("host", r"([^.]+\.[^.]+)\z", 1)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("hosts", F.col("host")), ("paths", path), ("domains", domain))])
    keys = sites.select(F.explode(kinds).alias("x")).select("x.*").filter("key != ''").distinct()
    lists = F.array(*[F.struct(F.lit(k).alias("of"), F.lit(n).alias("list"), F.lit(v).alias("verdict"), F.lit(s).alias("share")) for k, n, v, s in _LISTS])
    chosen = keys.withColumn("x", F.explode(lists)).select("kind", "key", "x.*").filter("kind = of").filter(digit(F.col("key"), F.col("list"), 100) < F.col("share"))
    steps = F.array(*[F.struct(F.lit(a).alias("action"), (F.lit(first) + digit(F.col("key"), F.concat("list", F.lit(str(i))), span)).alias("day")) for i, a, first, span in ((0, "add", 0, 120), (1, "remove", 120, 120), (2, "add", 240, 126))])
    entries = chosen.withColumn("x", F.explode(steps)).select("list", "key", "verdict", "x.action", F.timestamp_seconds(F.lit(1704067200) + F.col("x.day") * 86400).alias("at"))
    out = urlfilter.filter_captures(captures, entries)
    return out.select("page_id", F.unix_seconds("fetch_time").alias("fetch_second"), "n_active", "verdict", "entry")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), width=4, percent=80)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_round_trip(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_secrets, op3_language, op4_bpe, op5_sharding, op6_urls, op7_nearest, op8_near_duplicates, op9_token_files, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_urls": _URLS_SQL, "op8_near_duplicates": _NEAR_SQL, "op10_mixing": _MIX_SQL}


_SPLIT = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_NEAR_SQL = rf"""
with recursive words as (
  select doc_id, {_SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words),
members as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb
  from members a join members b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)),
ways as (select a, b from links union all select b, a from links),
reach(node, root) as (select doc_id, doc_id from documents union select w.b, r.root from reach r join ways w on r.node = w.a),
found as (select node, min(root) as root from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, f.root as component_id, f.root = s.doc_id as kept
from sets s join found f on f.node = s.doc_id
"""

# Quotas that stop at twice a source's size and share the rest by weight are least(2 * size, level * weight) for one
# level. It is found among the levels that leave the r sources of least size for their weight at their stops.
_MIX_SQL = rf"""
with docs as (
  select doc_id, source, len({_SPLIT.format(text="coalesce(text, '')")})::bigint as size, md5('11|' || doc_id) as digest from documents),
sources as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from docs group by source),
ranked as (
  select *, row_number() over (order by 2.0 * source_size / weight, source nulls last) as r, 2.0::double * source_size / weight as stop from sources),
levels as (
  select r, (1.5::double * (select sum(source_size) from sources) - 2 * coalesce(sum(source_size) over (order by r rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by r rows between current row and unbounded following) as level, stop from ranked),
level as (select arg_min(level, r) as level from levels where level <= stop),
targets as (
  select source, source_size, least(2.0::double * source_size, weight * coalesce((select level from level), 1e300)) as target from ranked),
placed as (
  select d.*, t.source_size, t.target, case when t.source_size = 0 then 0 else least(2, floor(t.target / t.source_size))::int end as whole,
    sum(size) over (partition by d.source order by ('0x' || substr(digest, 1, 6))::bigint % 4096, digest, size rows unbounded preceding) as upto
  from docs d join targets t on d.source is not distinct from t.source),
marked as (
  select *, target - whole * source_size as rest, size > 0 and whole < 2 and upto - size / 2.0 <= target - whole * source_size as more from placed),
gaps as (select source, any_value(rest) - coalesce(sum(size) filter (where more), 0) as gap from marked group by source),
swaps as (
  select m.source, m.digest, m.size, row_number() over (partition by m.source order by abs(abs(gap) - size), m.digest, m.size) as k
  from marked m join gaps g on m.source is not distinct from g.source
  where m.size > 0 and m.whole < 2 and m.more = (gap < 0) and abs(abs(gap) - size) < abs(gap)),
best as (select * from swaps where k = 1)
select m.doc_id, m.size, m.source_size, round(m.target, 6) as target,
  case when m.size = 0 then 0 else m.size * (m.whole + (m.more <> coalesce(m.digest = b.digest and m.size = b.size, false))::int) end::bigint as taken
from marked m left join best b on m.source is not distinct from b.source
"""

_LISTS = (("hosts", "malware", "block", 40), ("hosts", "trusted", "allow", 15), ("paths", "spam", "block", 30), ("domains", "parked", "block", 100))
_DIGIT = "(('0x' || substr(md5(key || '{salt}'), 1, 8))::bigint % {mod})"


def _spans_sql() -> str:
    """Both validity intervals of every chosen key: from the first addition to the removal, and from the second on."""
    parts = []
    for keys, name, verdict, share in _LISTS:
        day = [f"1704067200 + 86400 * ({first} + {_DIGIT.format(salt=f'{name}{i}', mod=span)})" for i, first, span in ((0, 0, 120), (1, 120, 120), (2, 240, 126))]
        chosen = f"from {keys} where {_DIGIT.format(salt=name, mod=100)} < {share}"
        parts.append(f"select '{name}' as list, key, '{verdict}' as verdict, {day[0]} as valid_from, {day[1]} as valid_to {chosen}")
        parts.append(f"select '{name}', key, '{verdict}', {day[2]}, null {chosen}")
    return " union all ".join(parts)


_URLS_SQL = rf"""
with seen as (
  select page_id, 1704067200 + (page_id * 7919) % 366 * 86400 + (page_id * 104729) % 86400 as fetch_second,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1), '') as segment
  from pages),
hosts as (select distinct host as key from seen where host is not null),
paths as (select distinct host || segment as key from seen where host is not null and segment <> ''),
domains as (select distinct regexp_extract(key, '([^.]+\.[^.]+)$', 1) as key from hosts where regexp_extract(key, '([^.]+\.[^.]+)$', 1) <> ''),
spans as ({_spans_sql()}),
labels as (select page_id, fetch_second, host, segment, string_split(host, '.') as l from seen),
keys as (
  select page_id, fetch_second, lower(array_to_string(l[i:len(l)], '.')) as key, len(l) - i + 1 as spec
  from labels, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as u(i) where host is not null
  union all
  select page_id, fetch_second, lower(host || segment), len(l) + 1000 from labels where host is not null and segment <> ''),
hits as (
  select k.page_id, s.verdict, s.list || ':' || s.key as entry,
    row_number() over (partition by k.page_id order by k.spec desc, s.valid_from desc, s.list desc, s.key desc, s.verdict desc) as r,
    count(*) over (partition by k.page_id) as n
  from keys k join (select list, lower(key) as key, verdict, valid_from, valid_to from spans) s
    on k.key = s.key and s.valid_from <= k.fetch_second and (s.valid_to is null or k.fetch_second < s.valid_to))
select seen.page_id, seen.fetch_second, coalesce(n, 0) as n_active, coalesce(verdict, 'none') as verdict, entry
from seen left join (select * from hits where r = 1) h on seen.page_id = h.page_id
"""
