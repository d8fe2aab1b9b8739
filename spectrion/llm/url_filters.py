"""URL filters with dated list entries.

Entries (domain, time, action) become validity intervals: an entry holds from
its time until the domain's next one. A capture is judged by the entries that
were active when it was fetched, on its host and on the host's parent domains;
the most specific domain with an active entry decides.

The as-of join is an equi-join on (domain, month) with a test of the time, so
that a busy domain is spread over months and large partitions can be split.
An entry's interval is cut at the month's end; what is carried into later
months comes from each month's last entry, a partial aggregate, and only into
months in which the domain has captures, so no date multiplies the list. No
window runs over more than a domain's month or a domain's list of months.
Captures are reduced to distinct (host, time) before the join. Native Spark
only.

Defined results: a capture with a null or malformed URL or null time has no
verdict; entries with a null domain, time or action are ignored; of entries
for one domain at one time a block wins over an allow, an allow over a
removal; repeated captures each get a row. Numeric addresses have no parent
domains; suffixes such as co.uk count for a capture of that very host only.
An empty list blocks nothing; no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Actions by precedence at equal times.
ACTIONS = ("remove", "allow", "block")

#: Host of a URL, with or without a scheme, behind the last @ if there is a user; a backslash counts as a slash, as browsers take it.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\][/\\](?:[^/?#\\]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\\]+)"

#: Numeric addresses.
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"

#: Suffixes under which registries of countries give out names.
SUFFIX = r"^(ac|co|com|edu|gob|gov|go|gr|mil|ne|net|or|org)\.[a-z][a-z]$"


def host_of(url: Column) -> Column:
    """Host in lower case without user and port, a numeric address of version 6 in its brackets; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more; a numeric address has no parents, and a registry's suffix is nobody's parent."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    named = F.filter(parents, lambda domain, i: (i == 0) | ~domain.rlike(SUFFIX))
    return F.when(host.rlike(ADDRESS), F.array(host)).when(host.isNotNull(), named)


def _month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def _month_start(month: Column) -> Column:
    return F.make_timestamp(((month - 1) / 12).cast("int"), (month - 1) % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def intervals(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(domain, month, action, listed_at, start, end): what holds on a domain, cut by months, in months with entries and in the asked (domain, month)."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    known = (
        entries.where("domain IS NOT NULL AND listed_at IS NOT NULL AND action IS NOT NULL")
        .select(F.lower("domain").alias("domain"), "listed_at", rank.alias("rank"))
        .where("rank > 0").groupBy("domain", "listed_at").agg(F.max("rank").alias("rank"))
        .withColumn("month", _month(F.col("listed_at")))
    )
    in_month = Window.partitionBy("domain", "month").orderBy("listed_at")
    month_end = _month_start(F.col("month") + 1)
    own = known.select("domain", "month", "rank", "listed_at", F.col("listed_at").alias("start"), F.coalesce(F.lead("listed_at").over(in_month), month_end).alias("end"))
    listed = known.select("domain", "month", "rank", "listed_at").unionByName(asked.select("domain", "month"), allowMissingColumns=True)
    months = listed.groupBy("domain", "month").agg(F.max_by("rank", "listed_at").alias("rank"), F.min("listed_at").alias("first"), F.max("listed_at").alias("listed_at"))
    before = Window.partitionBy("domain").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("rank").isNotNull(), F.struct("rank", "listed_at"))
    carried = months.withColumn("held", F.last(held, ignorenulls=True).over(before)).where("held IS NOT NULL")
    carried = carried.select("domain", "month", "held.rank", "held.listed_at", _month_start(F.col("month")).alias("start"), F.coalesce("first", month_end).alias("end"))
    both = own.unionByName(carried).where("start < end")
    return both.select("domain", "month", F.array(*map(F.lit, ACTIONS))[F.col("rank").cast("int") - 1].alias("action"), "listed_at", "start", "end")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """All columns of the captures and host, matched_domain, action, listed_at and blocked (false without an active entry, null without a host or time); columns of these names are replaced."""
    mine = captures.drop("matched_domain", "action", "listed_at", "blocked", "_host", "_at").withColumn("host", host_of(F.col(url)))
    asked = mine.where(F.col("host").isNotNull() & F.col(fetched).isNotNull()).select("host", F.col(fetched).alias("at")).distinct()
    parts = asked.select("host", "at", _month(F.col("at")).alias("month"), F.explode(domains_of(F.col("host"))).alias("domain"))
    active = parts.join(intervals(entries, parts.select("domain", "month").distinct()), ["domain", "month"]).where("at >= start AND at < end AND action <> 'remove'")
    best = active.groupBy("host", "at").agg(F.max_by(F.struct("domain", "action", "listed_at"), F.length("domain")).alias("e"))
    verdict = best.select(F.col("host").alias("_host"), F.col("at").alias("_at"), F.col("e.domain").alias("matched_domain"), F.col("e.action").alias("action"), F.col("e.listed_at").alias("listed_at"))
    joined = mine.join(verdict, (F.col("host") == F.col("_host")) & (F.col(fetched) == F.col("_at")), "left").drop("_host", "_at")
    known = F.col("host").isNotNull() & F.col(fetched).isNotNull()
    return joined.withColumn("blocked", F.when(known, F.coalesce(F.col("action") == "block", F.lit(False))))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no time, so it is derived from page_id: minutes within two years."""
    return pages.select("page_id", "url", (F.timestamp_seconds(F.lit(1640995200) + F.col("page_id") * 37 % 1051200 * 60)).alias("fetched_at"))


def entries_of(captures: DataFrame) -> DataFrame:
    """A dated list derived from the captures: each host is blocked and later removed, each parent domain allowed or blocked for a time."""
    hosts = captures.withColumn("host", host_of(F.col("url"))).where("host IS NOT NULL")
    parents = hosts.select("page_id", F.explode(F.slice(domains_of(F.col("host")), 1, 2)).alias("domain"))
    seen = parents.groupBy("domain").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    start = F.lit(1640995200) + (F.col("first") * 911 + F.length("domain") * 7919) % 700000 * 60
    days = (F.col("n") % 17 + 3) * 20 * 86400
    change = lambda seconds, action: F.struct(F.timestamp_seconds(seconds).alias("listed_at"), action.alias("action"))
    kind = F.when(F.length("domain") % 3 == 0, "allow").otherwise("block")
    dated = F.array(change(start, kind), change(start + days, F.lit("remove")), change(start + 2 * days, F.lit("block")))
    return seen.select("domain", F.explode(dated).alias("e")).select("domain", "e.listed_at", "e.action")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = captures_of(table(spark, sf_dir, "pages"))
    return judge(captures, entries_of(captures))


OP4_SQL = r"""
WITH c AS (SELECT page_id, url, make_timestamp((1640995200 + page_id * 37 % 1051200 * 60) * 1000000) AS fetched_at,
    nullif(rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\][/\\](?:[^/?#\\]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\\]+)', 1)), '.'), '') AS host FROM pages),
h AS (SELECT host, CASE WHEN regexp_matches(host, '^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$') THEN [host] ELSE
    [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)
     if i = 1 OR NOT regexp_matches(array_to_string(string_split(host, '.')[i:], '.'), '^(ac|co|com|edu|gob|gov|go|gr|mil|ne|net|or|org)\.[a-z][a-z]$')] END AS ds FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
s AS (SELECT d AS domain, min(page_id) AS f, count(*) AS n FROM (SELECT page_id, unnest(ds[1:2]) AS d FROM c JOIN h USING (host)) GROUP BY d),
t AS (SELECT domain, 1640995200 + (f * 911 + length(domain) * 7919) % 700000 * 60 AS s, (n % 17 + 3) * 20 * 86400 AS k, CASE WHEN length(domain) % 3 = 0 THEN 'allow' ELSE 'block' END AS a FROM s),
e AS (SELECT domain, make_timestamp(s * 1000000) AS since, a FROM t UNION ALL SELECT domain, make_timestamp((s + k) * 1000000), 'remove' FROM t
    UNION ALL SELECT domain, make_timestamp((s + 2 * k) * 1000000), 'block' FROM t),
q AS (SELECT DISTINCT host, fetched_at FROM c WHERE host IS NOT NULL AND fetched_at IS NOT NULL),
j AS (SELECT q.host, fetched_at, e.domain, a, since, row_number() OVER (PARTITION BY q.host, fetched_at, e.domain ORDER BY since DESC) AS r
    FROM (SELECT q.host, fetched_at, unnest(ds) AS d FROM q JOIN h USING (host)) q JOIN e ON e.domain = q.d AND e.since <= q.fetched_at),
b AS (SELECT host, fetched_at, domain, a, since, row_number() OVER (PARTITION BY host, fetched_at ORDER BY length(domain) DESC) AS r FROM j WHERE r = 1 AND a <> 'remove')
SELECT page_id, url, c.fetched_at, c.host, b.domain AS matched_domain, b.a AS action, b.since AS listed_at,
    CASE WHEN c.host IS NOT NULL AND c.fetched_at IS NOT NULL THEN coalesce(b.a = 'block', false) END AS blocked
FROM c LEFT JOIN b ON c.host = b.host AND c.fetched_at = b.fetched_at AND b.r = 1
"""
