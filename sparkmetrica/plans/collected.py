"""Collected-page and snapshot queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sparkmetrica.plans.registry import query
from sparkmetrica.sources import pages as P
from sparkmetrica.sources.tables import load

RULES = {
    "title": P.Rule(r"(?is)<title[^>]*>(.*?)</title>"),
    "lang": P.Rule(r'(?is)<html[^>]*\blang="([a-z-]+)"'),
    "heading": P.Rule(r"(?is)<h1[^>]*>(.*?)</h1>"),
    "track": P.Rule(r"track\(([^)]*)\)", type="int", text=False),
    "year": P.Rule(r"(?i)(?:19|20)([a-z0-9]{2})\b", type="int"),
    "body": P.Rule(r"(?is)<body[^>]*>(.*)"),
    "links": P.Rule(r'(?is)<a[^>]*href="([^"]*)"', text=False, many=True),
}


def _text_sql(x: str) -> str:
    out = f"regexp_replace({x}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    # the references that occur in the given pages, the ampersand's last so that none is decoded twice
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _field_sql(name: str) -> str:
    rule = RULES[name]
    hit = f"regexp_matches(html, '{rule.pattern}')"
    value = f"CASE WHEN {hit} THEN regexp_extract(html, '{rule.pattern}', {rule.group}) END"
    value = _text_sql(value) if rule.text else value
    value = value if rule.type == "string" else f"try_cast({value} AS {rule.type})"
    return f"{value} AS {name}, {hit} AS {name}_hit"


ONE = [n for n, r in RULES.items() if not r.many]
HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"


@query(
    "extract_fields",
    f"""
    SELECT page_id, url, {HOST_SQL} AS host, {', '.join(_field_sql(n) for n in ONE)},
      len(regexp_extract_all(html, '{RULES['links'].pattern}', 1))::int AS n_links FROM pages
    """,
)
def extract_fields(spark, folder):
    """Raw pages to typed records, over the whole text of each page."""
    records = P.extract(load(spark, folder, "pages"), RULES, ["page_id", "url"])
    flat = [c for n in ONE for c in (n, f"{n}_hit")]
    return records.select("page_id", "url", P.host("url").alias("host"), *flat, F.size("links").alias("n_links"))


@query(
    "extraction_coverage",
    f"WITH r AS (SELECT {', '.join(_field_sql(n) for n in ONE)} FROM pages) "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS field, count(*) AS pages, count(*) FILTER ({n}_hit) AS hits, count(*) FILTER ({n}_hit AND {n} IS NOT NULL) AS typed,
        count(*) FILTER ({n}_hit) / count(*)::double AS hit_share, count(*) FILTER ({n}_hit AND {n} IS NOT NULL) / count(*)::double AS typed_share FROM r"""
        for n in ONE
    ),
    "hit_share typed_share",
)
def extraction_coverage(spark, folder):
    return P.coverage(P.extract(load(spark, folder, "pages"), {n: RULES[n] for n in ONE}), ONE)


NORMAL_URL_SQL = """regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '[?#].*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)', 1))
    || regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+', ''), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), 'ref='), '&'), lambda p: NOT regexp_matches(p, '^(utm_source|ref)=')), '&'), ''), '')"""


@query(
    "dedupe_listings",
    f"""
    SELECT page_id, url, as_of FROM (SELECT page_id, url, (date '2024-01-01' + (page_id % 30)::int)::date AS as_of, {NORMAL_URL_SQL} AS k FROM pages)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY as_of DESC, page_id DESC) = 1
    """,
)
def dedupe_listings(spark, folder):
    """The same address collected on several days: the latest copy stays."""
    pages = load(spark, folder, "pages").withColumn("as_of", F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("page_id") % 30).cast("int")))
    rows = pages.select("page_id", "url", "as_of")
    return P.dedupe_listings(rows, {"url": P.normal_url("url", drop=["utm_source", "ref"])}, "as_of", "page_id")


@query(
    "dedupe_by_site_and_path",
    f"""
    SELECT page_id, host, path FROM (
      SELECT page_id, {HOST_SQL} AS host, regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)', 1) AS path FROM pages)
    QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(host), '[\\s[:punct:]]+', ' ', 'g')), path ORDER BY page_id DESC) = 1
    """,
)
def dedupe_by_site(spark, folder):
    pages = load(spark, folder, "pages")
    path = F.regexp_extract("url", "^[^:]+://[^/]+/([a-z]+)", 1)
    rows = pages.select("page_id", P.host("url").alias("host"), path.alias("path"))
    return P.dedupe_listings(rows, {"host": P.normal_key("host"), "path": F.col("path")}, "page_id", "page_id")


def _snapshot_sql(date: str) -> str:
    return f"""SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate <= timestamp '{date}'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def _snapshot(spark, folder, year):
    rows = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    date = F.lit(f"{year}-12-31").cast("timestamp_ntz")
    return P.snapshot(rows, "o_custkey", "o_orderdate", date, "o_orderkey")


@query("snapshot", _snapshot_sql("1996-12-31"))
def snapshot(spark, folder):
    """The latest order of each customer at the end of 1996."""
    return _snapshot(spark, folder, 1996)


@query(
    "snapshot_diff",
    f"""
    WITH a AS ({_snapshot_sql('1996-12-31')}), b AS ({_snapshot_sql('1998-12-31')})
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_orderkey AS o_orderkey_before, b.o_orderkey AS o_orderkey_after,
      a.o_orderstatus AS o_orderstatus_before, b.o_orderstatus AS o_orderstatus_after,
      CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed'
        WHEN a.o_orderkey = b.o_orderkey AND a.o_orderstatus = b.o_orderstatus THEN 'same' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
    """,
)
def snapshot_diff(spark, folder):
    before, after = _snapshot(spark, folder, 1996), _snapshot(spark, folder, 1998)
    return P.diff(before, after, "o_custkey", ["o_orderkey", "o_orderstatus"])
