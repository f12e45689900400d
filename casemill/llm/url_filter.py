"""URL filters: host rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter's blocks are rows (block number and four words of 64 bits), made by bitwise
aggregation, so building it is one shuffle and no listed URL reaches the driver. It grows with the list; up to
MOST_BLOCKS rows it is broadcast, beyond that the URLs are shuffled to its blocks. The URLs that it
lets through, each once and with the number of its rows, go to an exact hash join with the list, which removes the false hits. What is left
marks the rows: broadcast if it is few URLs, else joined with the possible hits alone, hot URLs being dealt to many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import BROADCAST_ROWS, join_groups, keep, nested

#: Words of a block and bits that a URL sets, one in each word; bits of filter for a listed URL.
WORDS, BITS_PER_URL = 4, 16
#: A filter of up to so many blocks is broadcast, at most 48 MB in memory: rows of five longs and a hash table's entry each.
MOST_BLOCKS = 1 << 19
#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What the query's list is made of: numbered pages 0 to 699 in four languages of spam names, and 300 to 399 of one ordinary host.
LISTED_NAMES = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")
LISTED_PREFIXES, LISTED_ENDS, LISTED_LANGUAGES = ("", "m.", "blog."), ("com", "net", "org"), ("en", "fr", "de", "es")
LISTED_PAGES, LISTED_HOST, LISTED_HOST_PAGES = 700, "blog.tionsh.example.com", (300, 400)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.` or a default port, and path without a closing slash; scheme, query and fragment go."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.concat(plain, F.regexp_replace(path, "/+$", ""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (verdict, rule) that fits, as a struct; null if none does. A rule fits its host and all subdomains."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    ranked = sorted(rules, key=lambda r: len(r[1]))
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    return reduce(lambda rest, r: F.when(fits(r[1]), F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1]).alias("rule"))).otherwise(rest), ranked, none)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One bit in each word of a block."""
    second = F.xxhash64(F.lit("bits"), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, url_col: str, count: int) -> tuple[DataFrame, int]:
    """(block, w0 .. w3) of the blocks with a bit, and the number of blocks."""
    blocks = max(1, -(-count * BITS_PER_URL // (64 * WORDS)))
    url = F.col(url_col)
    masks = listed.select(_block(url, blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(url))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def filter_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url", rules=RULES) -> DataFrame:
    """Every row of `urls` with host, path, rule, verdict, canonical_url and listed added.

    The rule's verdict holds where one fits; else a URL is blocked if its canonical form is
    that of a listed one, and allowed if not. Null and schemeless urls have empty host and
    path, fit no rule and are never listed. Null and repeated entries of the list count for nothing
    and once; an empty list blocks nothing. Rows are never multiplied or dropped, repeated ones included. A column of
    `urls` that has one of the added names is replaced; no other name can clash.
    """
    seen = keep(listed.select(canonical(host_of(F.col(listed_col)), path_of(F.col(listed_col))).alias("listed_url")).where("listed_url <> ''").distinct())
    blocks_df, blocks = bloom(seen, "listed_url", seen.count())
    parsed = nested(urls, host=host_of(F.col(url_col)), path=path_of(F.col(url_col)))
    parsed = parsed.withColumn("canonical_url", canonical(F.col("host"), F.col("path")))
    with_block = parsed.where("canonical_url <> ''").select("canonical_url", _block(F.col("canonical_url"), blocks).alias("block"))
    probed = with_block.join(F.broadcast(blocks_df) if blocks <= MOST_BLOCKS else blocks_df, "block")
    hit = reduce(Column.__and__, ((F.col(f"w{i}").bitwiseAND(m) != 0) for i, m in enumerate(_masks(F.col("canonical_url")))))
    possible = probed.where(hit).groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"))
    exact = keep(possible.join(seen, F.col("canonical_url") == F.col("listed_url")).select("canonical_url", "n", F.lit(True).alias("on_list")))
    found, rows = exact.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found <= BROADCAST_ROWS:
        judged = parsed.join(F.broadcast(exact.drop("n")), "canonical_url", "left")
    else:  # only rows that may be on the list are shuffled
        may = parsed.withColumn("block", F.when(F.col("canonical_url") != "", _block(F.col("canonical_url"), blocks)))
        may = may.join(F.broadcast(blocks_df) if blocks <= MOST_BLOCKS else blocks_df, "block", "left").withColumn("may", F.coalesce(hit, F.lit(False))).select("row", "host", "path", "canonical_url", "may")
        hits = may.where("may").withColumn("spread", F.xxhash64("row"))
        judged = join_groups(hits, exact, ["canonical_url"], "n", rows, "left", "spread").drop("spread").unionByName(may.where("not may").withColumn("on_list", F.lit(None).cast("boolean"))).drop("may")
    judged = judged.withColumn("on_list", F.coalesce("on_list", F.lit(False))).withColumn("matched", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow"))
    added = {
        "host": F.col("host"), "path": F.col("path"), "canonical_url": F.col("canonical_url"), "listed": F.col("on_list"),
        "rule": F.col("matched.rule"), "verdict": F.coalesce(F.col("matched.verdict"), method),
    }
    return judged.select(*(F.col("row").getField(c).alias(c) for c in urls.columns if c not in added), *(v.alias(k) for k, v in added.items()))


def listed_urls(spark) -> DataFrame:
    """The query's list, about 151,000 URLs made by the rule above: it stands for a published blocklist."""
    pick = lambda values: F.explode(F.array(*map(F.lit, values)))
    pages = spark.range(LISTED_PAGES).select("id", pick(LISTED_NAMES).alias("name")).select("*", pick(LISTED_PREFIXES).alias("prefix")).select("*", pick(LISTED_ENDS).alias("end")).select("*", pick(LISTED_LANGUAGES).alias("lang"))
    spam = pages.select(F.format_string("http://%s%s.example.%s/%s/%d", "prefix", "name", "end", "lang", "id").alias("url"))
    some = spark.range(*LISTED_HOST_PAGES).select("id", pick(LISTED_LANGUAGES).alias("lang"))
    return spam.unionByName(some.select(F.format_string(f"http://{LISTED_HOST}/%s/%d", "lang", "id").alias("url")))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def _sql_values(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


ORACLE = {
    "op1_url_filter": rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') AS canonical_url,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b),
l AS (SELECT x || s || '.example.' || e || '/' || g || '/' || i AS canonical_url FROM (VALUES {_sql_values(LISTED_PREFIXES)}) x(x), (VALUES {_sql_values(LISTED_NAMES)}) s(s), (VALUES {_sql_values(LISTED_ENDS)}) e(e),
   (VALUES {_sql_values(LISTED_LANGUAGES)}) g(g), range({LISTED_PAGES}) i(i)
  UNION ALL SELECT '{LISTED_HOST}/' || g || '/' || i FROM (VALUES {_sql_values(LISTED_LANGUAGES)}) g(g), range({LISTED_HOST_PAGES[0]}, {LISTED_HOST_PAGES[1]}) i(i))
SELECT page_id, host, path, rule, canonical_url, canonical_url IN (SELECT canonical_url FROM l) AS listed,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical_url IN (SELECT canonical_url FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
}
QUERIES = {"op1_url_filter": op1_url_filter}
