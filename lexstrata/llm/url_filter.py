"""URL filters: dated list entries as validity intervals, matched as of fetch time.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import keys_for_join
from .storage import materialize

#: Days of one time slice; captures of a busy host spread over slices.
SLICE_DAYS = 16
#: Hash values of listed domains that captures are sifted by (so many rows are broadcast at most).
SIEVE = 1 << 20
#: Captures of one (domain, slice) beyond which they are dealt over parts.
BUSY = 1_000_000


def host_of(url: F.Column) -> F.Column:
    """Lower-case host without user, port, trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, verdict, valid_from, valid_to) of dated entries (domain, action, listed_at).

    action: block, allow or remove. Each entry holds until the next of its domain;
    at one time the order is remove, block, allow and the last holds; entries with a
    null are left out; valid_to is null while nothing follows.
    """
    rank = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).when(F.col("action") == "remove", 0)
    rows = (
        entries.select(F.lower("domain").alias("domain"), "listed_at", rank.alias("rank"))
        .where("domain IS NOT NULL AND listed_at IS NOT NULL AND rank IS NOT NULL")
        .groupBy("domain", "listed_at")
        .agg(F.max("rank").alias("rank"))
    )
    later = F.lead("listed_at").over(Window.partitionBy("domain").orderBy("listed_at"))
    return rows.select("domain", "rank", F.col("listed_at").alias("valid_from"), later.alias("valid_to")).where("rank > 0").select(
        "domain", F.when(F.col("rank") == 2, "allow").otherwise("block").alias("verdict"), "valid_from", "valid_to"
    )


def filter_urls(captures: DataFrame, entries: DataFrame, *, slice_days: int = SLICE_DAYS, busy: int = BUSY) -> DataFrame:
    """Each capture (page_id, url, fetched_at) with host, n_active, rule, blocked.

    Entries of the host and of its parent domains apply if valid_from <= fetched_at < valid_to;
    the longest domain decides (rule), n_active counts them. Captures without host, time
    or match are not blocked and have rule null. Repeated captures are each judged; no captures give no
    rows, and an empty list blocks nothing. Intervals are cut into time slices, so the join key is (domain, slice).
    Before the join a capture keeps only parent domains that may be listed (by their hash, so none is lost),
    and one row of its own key that meets nothing; busy (domain, slice) are dealt over parts, each with all
    intervals of its slice.
    """
    day = lambda c: F.floor(F.unix_seconds(c) / (86400 * slice_days))
    spans = intervals(entries)
    last = captures.agg(F.max("fetched_at").alias("last"))
    active = (
        spans.join(F.broadcast(last), F.lit(True))
        .withColumn("_to", F.least(F.coalesce("valid_to", "last"), "last"))
        .where("valid_from <= _to")
        .withColumn("slice", F.explode(F.sequence(day(F.col("valid_from")), day(F.col("_to")))))
        .select("domain", "slice", "verdict", "valid_from", "valid_to")
    )
    sieve = lambda c: F.xxhash64(c).bitwiseAND(F.lit(SIEVE - 1))
    listed = spans.select(sieve("domain").alias("_hash")).distinct().withColumn("_listed", F.lit(True))
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    alone = F.array(F.concat(F.lit("\0"), F.col("_row").cast("string")))
    rows = captures.select("page_id", "url", "fetched_at").withColumn("host", host_of(F.col("url"))).withColumn("_row", F.monotonically_increasing_id())
    keyed = (
        rows.select("*", day(F.col("fetched_at")).alias("slice"), F.explode(F.when(F.col("host").isNull(), alone).otherwise(F.concat(alone, parents))).alias("domain"))
        .withColumn("_hash", sieve("domain"))
        .join(F.broadcast(listed), "_hash", "left")
        .where(F.col("_listed") | F.col("domain").startswith("\0"))
    )
    crowd = keyed.where("_listed AND slice IS NOT NULL").groupBy("domain", "slice").agg(F.count("*").alias("_n")).where(F.col("_n") > busy)
    crowd = keys_for_join(materialize(crowd.select("domain", "slice", F.ceil(F.col("_n") / busy).cast("int").alias("_fan")), "busy"))
    fan = F.coalesce("_fan", F.lit(1))
    keyed = keyed.join(crowd, ["domain", "slice"], "left").withColumn("_part", F.pmod(F.xxhash64("_row"), fan).cast("int"))
    active = active.join(crowd, ["domain", "slice"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), fan - 1)))
    hit = keyed.alias("c").join(
        active.alias("a"),
        (F.col("c.domain") == F.col("a.domain"))
        & (F.col("c.slice") == F.col("a.slice"))
        & (F.col("c._part") == F.col("a._part"))
        & (F.col("a.valid_from") <= F.col("c.fetched_at"))
        & (F.col("a.valid_to").isNull() | (F.col("c.fetched_at") < F.col("a.valid_to"))),
        "left",
    )
    best = F.max(F.when(F.col("a.verdict").isNotNull(), F.struct(F.length("a.domain").alias("n"), F.col("a.domain").alias("domain"), "a.verdict")))
    return (
        hit.groupBy("c._row", "c.page_id", "c.url", "c.host", "c.fetched_at")
        .agg(F.count("a.verdict").alias("n_active"), best.alias("best"))
        .select("page_id", "url", "host", "fetched_at", "n_active", F.col("best.domain").alias("rule"),
                (F.coalesce(F.col("best.verdict"), F.lit("allow")) == "block").alias("blocked"))
    )


def derived_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a fetch time, which the table lacks: spread over 2024 by page_id."""
    seconds = 1704067200 + F.pmod(F.col("page_id") * 1000003, F.lit(366 * 86400))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.timestamp_seconds(seconds).alias("fetched_at"))


def derived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list history for each host seen: three dated entries, and two for its parent domain.

    Days and actions follow from the lengths and first letters of the names.
    """
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    a, n = F.ascii(F.col("host")), F.length("host")
    at = lambda d: F.timestamp_seconds(1704067200 + F.pmod(d, F.lit(366)) * 86400)
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    own = [(n * 7 + a, "block"), (n * 7 + a + 40, "remove"), (n * 13 + a + 90, "block"), (n * 5 + a * 3, "allow")]
    rows = F.array(*(F.struct(F.col("host").alias("domain"), F.lit(k).alias("action"), at(d).alias("listed_at")) for d, k in own),
                   F.struct(parent.alias("domain"), F.lit("block").alias("action"), at(F.length(parent) * 11).alias("listed_at")),
                   F.struct(parent.alias("domain"), F.lit("remove").alias("action"), at(F.length(parent) * 11 + 25).alias("listed_at")))
    return hosts.select(F.inline(rows)).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(derived_captures(spark, sf_dir), derived_entries(spark, sf_dir))


ORACLE_SQL = r"""
WITH cap AS (
  SELECT page_id, url, make_timestamp((1704067200 + (page_id * 1000003) % (366 * 86400)) * 1000000) AS fetched_at,
         nullif(rtrim(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host, ascii(host) AS a, length(host) AS n, regexp_replace(host, '^[^.]*\.', '') AS parent FROM cap WHERE host IS NOT NULL),
raw AS (
  SELECT host AS domain, 1 AS rank, n * 7 + a AS d FROM hosts UNION ALL
  SELECT host, 0, n * 7 + a + 40 FROM hosts UNION ALL
  SELECT host, 1, n * 13 + a + 90 FROM hosts UNION ALL
  SELECT host, 2, n * 5 + a * 3 FROM hosts UNION ALL
  SELECT parent, 1, length(parent) * 11 FROM hosts UNION ALL
  SELECT parent, 0, length(parent) * 11 + 25 FROM hosts),
dated AS (SELECT domain, make_timestamp((1704067200 + (d % 366) * 86400) * 1000000) AS listed_at, max(rank) AS rank FROM raw GROUP BY ALL),
iv AS (SELECT domain, rank, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY domain ORDER BY listed_at) AS valid_to FROM dated)
SELECT c.page_id, c.url, c.host, c.fetched_at, count(i.domain) AS n_active,
       max_by(i.domain, length(i.domain)) AS rule,
       coalesce(max_by(i.rank, length(i.domain)) = 1, false) AS blocked
FROM cap c LEFT JOIN iv i ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain)) AND i.rank > 0
  AND i.valid_from <= c.fetched_at AND (i.valid_to IS NULL OR c.fetched_at < i.valid_to)
GROUP BY c.page_id, c.url, c.host, c.fetched_at
"""
