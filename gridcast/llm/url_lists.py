"""URL filter with dated lists: every capture is judged by the list entries
that were active when it was fetched.

Dated entries (add, remove) of a host, a domain or a URL prefix become
validity intervals: an entry holds from its add to the next event of the same
list, kind and pattern. A capture asks for its host, each parent domain and
each path prefix; the as-of join takes the entries of those keys whose
interval holds the fetch time. Keys are salted, because one host may have a
third of all captures: captures are dealt over ``SALTS`` copies of the
intervals, so no key's captures meet in one task.

Defined results: a capture without url, or whose url has no host, matches
nothing; one without fetch time neither; an add while listed changes nothing
but starts a new interval; of events of one day the remove counts last;
repeated captures (same id, url and time) give one row; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
#: labels of a host name at most (a name has 253 characters)
MAX_LABELS = 127


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of dated entries (list,
    kind, pattern, action, dated); valid_to is null while still listed."""
    own = Window.partitionBy("list", "kind", "pattern").orderBy("dated", "action")
    return (entries.select("list", "kind", normal_pattern(F.col("pattern")).alias("pattern"), "action", "dated")
            .where("pattern is not null and dated is not null")
            .withColumn("valid_to", F.lead("dated").over(own)).where("action = 'add'")
            .where("valid_to is null or valid_to > dated")
            .select("list", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to"))


def normal_pattern(pattern: Column) -> Column:
    """A pattern as hosts are written: its host in lower case without final
    dots; the path of a prefix as it is, without empty parts at its ends."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(pattern), r"^([^/]*)", 1)), r"\.+$", "")
    path = F.regexp_replace(F.regexp_extract(F.trim(pattern), r"^[^/]*/+(.*)$", 1), r"/+$", "")
    slash = F.when(F.contains(pattern, F.lit("/")), F.lit("/")).otherwise("")
    return F.when(F.length(host) > 0, F.concat(host, slash, F.regexp_replace(path, "/+", "/")))


def host_of(url: Column) -> Column:
    """Lower-case host without scheme, user, port and final dot; an IPv6
    address keeps its brackets; null if none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.%]+\]|[^/?#:@\[\]]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def lookup_keys(url: Column, max_parts: int, max_chars: int) -> Column:
    """kind:pattern keys that may list a url. No listed prefix has more than
    ``max_parts`` path parts or ``max_chars`` characters, so longer ones
    need not be asked for."""
    host = host_of(url)
    # a part cut here ends beyond the longest listed prefix, so it matches none
    path = F.substring(F.regexp_replace(path_of(url), "/+", "/"), 1, max_chars + 2)
    labels = F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.split(host, r"\."))
    labels = F.slice(labels, F.greatest(F.size(labels) - MAX_LABELS + 1, F.lit(1)), F.lit(MAX_LABELS))
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: F.length(x) > 0), 1, max(max_parts, 1))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(max_parts))), lambda i: F.concat(
        F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes))


def judge_captures(captures: DataFrame, entries: DataFrame, salts: int = SALTS, id_col: str = "page_id",
                   url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, url, fetched_at, n_active (entries that held), matched (their
    list=kind:pattern, sorted), blocked."""
    listed = intervals(entries)
    longest = listed.where("kind = 'prefix'").agg(  # one row: how far a listed prefix reaches
        F.max(F.size(F.split("pattern", "/")) - 1).alias("parts"), F.max(F.length("pattern")).alias("chars")).first()
    held = (listed.withColumn("key", F.concat("kind", F.lit(":"), "pattern"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            .select("key", "salt", "valid_from", "valid_to", F.concat("list", F.lit("="), "key").alias("entry")))
    asked = (captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
             .withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(salts)).cast("int"))
             .withColumn("key", F.explode_outer(F.array_distinct(lookup_keys(
                 F.col("url"), longest["parts"] or 0, longest["chars"] or 0)))))
    met = asked.join(held, (asked["key"] == held["key"]) & (asked["salt"] == held["salt"])
                     & (F.col("fetched_at") >= F.col("valid_from"))
                     & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))), "left")
    return (met.groupBy("page_id", "url", "fetched_at")
            .agg(F.array_join(F.array_sort(F.collect_set("entry")), ",").alias("matched"),
                 F.countDistinct("entry").alias("n_active"))
            .select("page_id", "url", "fetched_at", "n_active", "matched", (F.col("n_active") > 0).alias("blocked")))


def _part(text: Column, at: int) -> Column:
    """A number from a text's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def _day(days: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), days)


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, fetched over one year by their id's digest."""
    return pages.select("page_id", "url", _day(F.pmod(_part(F.col("page_id").cast("string"), 1), F.lit(365))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts, domains and first path parts of
    ``pages``: about a quarter, a fifth and a fifth of them are listed at a
    date of their digest, two thirds of these are taken off again later."""
    def kind(name: str, pattern: Column, every: int) -> Column:
        return F.struct(F.lit(name).alias("kind"), pattern.alias("pattern"), F.lit(every).alias("every"))

    host, first = host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), r"^/([^/]+)", 1)
    named = (pages.select(host.alias("host"), first.alias("first")).where("host is not null").distinct()
             .select(F.explode(F.array(
                 kind("host", F.col("host"), 4), kind("domain", F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1), 5),
                 kind("prefix", F.concat("host", F.lit("/"), "first"), 5))).alias("e"))
             .select("e.*").where("length(pattern) > 0").distinct()
             .where(F.pmod(_part(F.concat("kind", "pattern"), 1), F.col("every")) == 0))
    day = F.pmod(_part(F.col("pattern"), 5), F.lit(240))
    stay = F.pmod(_part(F.col("pattern"), 9), F.lit(120)) + 1
    events = F.array(F.struct(F.lit("add").alias("action"), _day(day).alias("dated")),
                     F.struct(F.lit("remove").alias("action"), F.when(
                         F.pmod(_part(F.col("pattern"), 13), F.lit(3)) > 0, _day(day + stay)).alias("dated")))
    return (named.withColumn("ev", F.explode(events)).where("ev.dated is not null")
            .select(F.lit("blocklist").alias("list"), "kind", "pattern", "ev.action", "ev.dated"))


ORACLE = r"""
WITH p AS (SELECT page_id, url,
    nullif(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1) AS path,
    (DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 365)) AS fetched_at FROM pages),
n AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS first FROM p WHERE host IS NOT NULL),
e AS (SELECT DISTINCT * FROM (
    SELECT 'host' AS kind, host AS pattern, 4 AS every FROM n
    UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), 5 FROM n
    UNION ALL SELECT 'prefix', host || '/' || first, 5 FROM n) WHERE length(pattern) > 0
    AND ('0x' || substr(md5(kind || pattern), 1, 4))::INT % every = 0),
i AS (SELECT kind || ':' || pattern AS key, DATE '2024-01-01' + (('0x' || substr(md5(pattern), 5, 4))::INT % 240) AS valid_from,
    CASE WHEN ('0x' || substr(md5(pattern), 13, 4))::INT % 3 > 0 THEN DATE '2024-01-01' + (('0x' || substr(md5(pattern), 5, 4))::INT % 240
        + ('0x' || substr(md5(pattern), 9, 4))::INT % 120 + 1) END AS valid_to FROM e),
k AS (SELECT DISTINCT page_id, unnest(
    ['host:' || host]
    || list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: 'domain:' || array_to_string(string_split(host, '.')[j:], '.'))
    || list_transform(range(0, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1),
        lambda j: 'prefix:' || host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:j], '/'))) AS key
    FROM p WHERE host IS NOT NULL),
m AS (SELECT p.page_id, count(DISTINCT i.key) AS n_active,
    array_to_string(list_sort(list(DISTINCT 'blocklist=' || i.key)), ',') AS matched
    FROM p JOIN k USING (page_id) JOIN i ON i.key = k.key AND p.fetched_at >= i.valid_from
        AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to) GROUP BY 1)
SELECT p.page_id, p.url, p.fetched_at, coalesce(n_active, 0) AS n_active, coalesce(matched, '') AS matched,
    coalesce(n_active, 0) > 0 AS blocked FROM p LEFT JOIN m USING (page_id)"""
