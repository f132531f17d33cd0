"""Collected web pages to clean, dated record tables.

Fields are taken out with patterns the caller gives; pages are not parsed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmetrica.functions.scalars import col
from sparkmetrica.operators.tables import dedupe

NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
USUAL = ["amp", "nbsp", "quot", "lt", "gt", "apos"]  # asked for first: a map of all names is searched in order


def decode_references(text: Column) -> Column:
    """Named and numeric character references as their characters, each decoded once; unknown ones stay as they are."""
    named = F.create_map(*[F.lit(x) for item in NAMES.items() for x in item])

    def numbered(name: Column) -> Column:
        hexadecimal, decimal = F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]{1,6})$", 1), F.regexp_extract(name, r"^#([0-9]{1,7})$", 1)
        code = F.coalesce(F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10), F.nullif(decimal, F.lit(""))).try_cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))

    def usual(name: Column) -> Column:
        found = reduce(lambda c, n: c.when(name == n, F.lit(NAMES[n])), USUAL[1:], F.when(name == USUAL[0], F.lit(NAMES[USUAL[0]])))
        return found.otherwise(F.try_element_at(named, name))

    def decoded(piece: Column) -> Column:
        # up to the first semicolon; patterns are only tried on numbers
        name = F.substring_index(piece, ";", 1)
        char = F.when(F.contains(piece, F.lit(";")), F.when(name.startswith("#"), numbered(name)).otherwise(usual(name)))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&")
        later = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
        return F.when(F.contains(t, F.lit("&")), F.concat(pieces[0], F.array_join(later, ""))).otherwise(t)

    return F.transform(F.array(text), whole)[0]  # bound once: the text is itself the result of several patterns


def strip_tags(html: str | Column) -> Column:
    """Text of a piece of HTML: no scripts, styles, comments or tags; spaces collapsed."""
    text = F.regexp_replace(col(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_references(text), r"\s+", " "))


def host(url: str | Column) -> Column:
    found = F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(found != "", found)


def normal_url(url: str | Column, drop=()) -> Column:
    """Lower-case scheme and host, no fragment or trailing slash; the query without the parameters named in ``drop``."""
    whole = F.regexp_replace(F.trim(col(url)), r"#.*$", "")
    asked = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin([d.lower() for d in drop]))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    bare = F.regexp_replace(whole, r"\?.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)", 1))
    tail = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+", "")
    return F.concat(F.regexp_replace(F.concat(head, tail), r"/+$", ""), query)


@dataclass(frozen=True)
class Rule:
    """How to find a field: first match of ``pattern``, or all matches with ``many``."""

    pattern: str
    group: int = 1
    type: str = "string"
    source: str = "html"
    text: bool = True  # drop tags from what was matched
    many: bool = False


def extract(pages: DataFrame, rules: dict[str, Rule], keep=("url",)) -> DataFrame:
    """One typed record per page. ``<field>_hit`` tells whether the pattern was found.

    A found text that does not cast to the type is NULL with the hit flag set.
    """
    out = []
    for name, rule in rules.items():
        source = F.col(rule.source)
        if rule.many:
            found = F.regexp_extract_all(source, F.lit(rule.pattern), F.lit(rule.group))
            value = F.transform(found, lambda s: strip_tags(s)) if rule.text else found
            value = value if rule.type == "string" else F.transform(value, lambda s: s.try_cast(rule.type))
            hit = F.size(found) > 0
        else:
            hit = F.coalesce(F.regexp_like(source, F.lit(rule.pattern)), F.lit(False))
            found = F.when(hit, F.regexp_extract(source, rule.pattern, rule.group))
            value = strip_tags(found) if rule.text else found
            value = value if rule.type == "string" else value.try_cast(rule.type)
        out += [value.alias(name), hit.alias(f"{name}_hit")]
    return pages.select(*keep, *out)


def coverage(records: DataFrame, fields) -> DataFrame:
    """Per field: pages, pages with a hit, hits whose value could be typed, shares."""
    n = F.count(F.lit(1))
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_h{i}").alias("hits"), F.col(f"_v{i}").alias("typed")) for i, f in enumerate(fields)])
    aggs = [n.alias("pages")]
    for i, f in enumerate(fields):
        aggs += [F.count_if(F.col(f"{f}_hit")).alias(f"_h{i}"), F.count_if(F.col(f"{f}_hit") & F.col(f).isNotNull()).alias(f"_v{i}")]
    long = records.agg(*aggs).select("pages", F.inline(entries))
    return long.select(
        "field", "pages", "hits", "typed",
        F.try_divide(F.col("hits").cast("double"), F.col("pages")).alias("hit_share"),
        F.try_divide(F.col("typed").cast("double"), F.col("pages")).alias("typed_share"),
    )


def normal_key(c: str | Column) -> Column:
    """Text key without case, punctuation runs or outer spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[\s\p{Punct}]+", " "))


def dedupe_listings(df: DataFrame, keys, as_of: str, tie: str) -> DataFrame:
    """One row per listing, the latest; ``keys`` maps helper names to key columns."""
    rows = df.withColumns({f"_k_{n}": c for n, c in keys.items()})
    helpers = [f"_k_{n}" for n in keys]
    return dedupe(rows, helpers, [F.col(as_of), F.col(tie)]).drop(*helpers)


def snapshot(df: DataFrame, key, as_of: str, date, tie: str) -> DataFrame:
    """State on ``date``: for each key the latest row not after it."""
    keys = [key] if isinstance(key, str) else list(key)
    return dedupe(df.where(F.col(as_of) <= F.lit(date)), keys, [F.col(as_of), F.col(tie)])


def diff(before: DataFrame, after: DataFrame, key, columns) -> DataFrame:
    """Change between two snapshots: ``status`` and both values of each column."""
    keys = [key] if isinstance(key, str) else list(key)
    a = before.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"{c}_before") for c in columns])
    b = after.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"{c}_after") for c in columns])
    both = a.join(b, keys, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) for c in columns])
    status = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "same").otherwise("changed")
    )
    return both.withColumn("status", status).drop("_a", "_b")
