"""URL filter: host and path rules, then a listed-URL test.

Canonical keys of the list fill a blocked Bloom filter: a key's hash picks one
block of four 64-bit words and sets two bits in each word, so a test touches
one row of the filter. Keys that the filter may hold go to an exact join with
the list, which removes false positives. All of it is built-in expressions.

A page's keys are its host and each parent domain, joined with its path and
each folder above it, so a listed key covers what lies below it.

Defined cases: a null URL, or one without "://", has empty host and path and is
allowed; equal URLs get equal verdicts and are tested once; an empty list or
an empty table works; null list entries are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Workspace, ascii_lower

#: Bits of filter for each listed key, and keys above which the filter itself is joined by shuffle.
BITS_PER_KEY = 16
BLOCK_BITS = 256
BROADCAST_BLOCKS = 2_000_000
BROADCAST_KEYS = 1_000_000
COMMON = 10_000
#: Pages whose id is a multiple of this give the list's single URLs.
FEED = 23

# Default rules and listed keys of the production query.
DEFAULT_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DEFAULT_HOSTS = (
    "http://ads-track.example.com/",
    "http://free-bets.example.net/",
    "http://cheap-pills.example.net/",
    "http://spam-farm.example.org/",
    "http://casino-win.example.net/",
    "http://adult-x.example.com/",
)


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(rules: list[HostRule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of name and verdict; else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def canonical(host: Column, path: Column) -> Column:
    """Host without a final dot or port, path without repeated slashes; never empty path."""
    clean = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.+$", "")
    return F.concat(clean, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "/{2,}", "/")))


def _parts(key: Column) -> tuple[Column, Column]:
    """Host and path of a canonical key."""
    host = F.substring_index(key, "/", 1)
    return host, F.substring(key, F.length(host) + 1, F.length(key))


def extent(keys: DataFrame) -> tuple[int, int, int]:
    """The number of listed keys, and the most host labels and folders of any: no deeper part of a URL can be listed."""
    host, path = _parts(F.col("key"))
    labels, folders = F.size(F.split(host, r"\.")), F.size(F.split(path, "/")) - 1
    return tuple(x or 0 for x in keys.agg(F.count("*"), F.max(labels), F.max(folders)).first())


def lookup_keys(urls: DataFrame, labels: int, folders: int) -> DataFrame:
    """(url, key) for the keys that could list each (url, host, path) row.

    A host's own name and its parents of up to so many labels, and a path's own
    name and its first folders, up to so many; extent() of the list loses none.
    """
    full = canonical(F.col("host"), F.col("path"))
    df = urls.select("url", full.alias("full"))
    h, rest = _parts(F.col("full"))
    df = df.select("url", h.alias("h"), rest.alias("rest"))
    df = df.select("url", "h", "rest", F.split("h", r"\.").alias("labels"), F.split("rest", "/").alias("parts"))
    hosts = F.expr(
        f"""transform(sequence(1, least(size(labels), {max(1, labels)})),
            k -> array_join(slice(labels, size(labels) - k + 1, k), '.'))"""
    )
    above = F.expr(
        f"""transform(sequence(1, least(size(parts) - 1, {max(1, folders)})),
            k -> concat(array_join(slice(parts, 1, k), '/'), '/'))"""
    )
    df = df.select(
        "url",
        F.array_distinct(F.concat(hosts, F.array("h"))).alias("hosts"),
        F.array_distinct(F.concat(above, F.array("rest"))).alias("tails"),
    )
    df = df.select("url", "tails", F.explode("hosts").alias("one"))
    return df.select("url", "one", F.explode("tails").alias("tail")).select("url", F.concat("one", "tail").alias("key"))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of four words, from slices of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(k))
    return [one(2 * k).bitwiseOR(one(2 * k + 1)) for k in range(4)]


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row of four words for each block that has a key, and the number of blocks."""
    n_blocks = 1
    while n_blocks * BLOCK_BITS < max(1, n_keys) * BITS_PER_KEY:
        n_blocks *= 2
    cols = [m.alias(f"m{k}") for k, m in enumerate(_masks(F.col("key")))]
    rows = keys.select(_block(F.col("key"), n_blocks).alias("block"), *cols)
    return rows.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)]), n_blocks


def possible(keys: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose key the filter may hold."""
    masked = keys.withColumns({"block": _block(F.col("key"), n_blocks)} | {f"m{k}": m for k, m in enumerate(_masks(F.col("key")))})
    side = F.broadcast(bloom) if n_blocks <= BROADCAST_BLOCKS else bloom
    inside = F.lit(True)
    for k in range(4):
        inside = inside & (F.col(f"m{k}").bitwiseAND(F.col(f"w{k}")) == F.col(f"m{k}"))
    return masked.join(side, "block").filter(inside).select(*keys.columns)


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Of distinct (url, host, path) rows, those that the list (column url) covers."""
    at = F.col("url")
    keys = listed.filter(at.contains("://")).select(canonical(host_of(at), path_of(at)).alias("key")).distinct()
    n_keys, labels, folders = extent(keys)
    bloom, n_blocks = build_filter(keys, n_keys)
    hits = possible(lookup_keys(urls.filter(F.col("host") != ""), labels, folders), bloom, n_blocks)
    exact = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    return hits.join(exact, "key", "left_semi").select("url").distinct()


def url_filter(pages: DataFrame, rules: list[HostRule], listed: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict for each page."""
    at = F.col("url")
    fits = rule_column(rules, F.col("host"), F.col("path"))
    judged = (
        pages.select("page_id", "url")
        .withColumns({"host": host_of(at), "path": path_of(at)})
        .withColumn("_fit", fits)
    )
    space = Workspace(pages.sparkSession, "urls")
    is_open = F.col("_fit").isNull() & (F.col("host") != "")
    open_urls = judged.filter(is_open).groupBy("url", "host", "path").agg(F.count("*").alias("n"))
    open_urls = space.keep(open_urls, "open")
    total = open_urls.agg(F.sum("n")).first()[0] or 0
    hits = listed_urls(open_urls.select("url", "host", "path"), listed).withColumn("_listed", F.lit(True))
    tested = space.keep(open_urls.join(hits, "url", "left").select("url", "n", F.coalesce("_listed", F.lit(False)).alias("_listed")), "tested")
    # A URL of a COMMON-th of all pages or more is common; those are broadcast, so no task gets all pages of one URL.
    common = F.col("n") * COMMON >= total
    known = judged.join(F.broadcast(tested.filter(common).select("url", "_listed")), "url", "left")
    asked = is_open & F.col("_listed").isNull()
    rare = tested.filter(~common & F.col("_listed")).select("url", F.col("_listed").alias("_rare"))
    rest = known.filter(asked).join(rare, "url", "left").withColumn("_listed", F.col("_rare")).drop("_rare")
    known = known.filter(~asked).unionByName(rest)
    verdict = F.coalesce(F.col("_fit.verdict"), F.when(F.col("_listed"), F.lit("block")), F.lit("allow"))
    return known.select("page_id", "url", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"))


def default_list(pages: DataFrame) -> DataFrame:
    """The production list: DEFAULT_HOSTS, and as a feed of single URLs those of every FEED-th page."""
    hosts = F.explode(F.array(*[F.lit(u) for u in DEFAULT_HOSTS]))
    feed = pages.filter(F.col("page_id") % FEED == 0).select("url")
    return pages.sparkSession.range(1).select(hosts.alias("url")).unionByName(feed)
