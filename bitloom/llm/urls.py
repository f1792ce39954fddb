"""URL filters by dated lists: an as-of join of captures with validity intervals. DataFrame functions only.

A list is a set of dated entries (list, kind, value, effect, at, action). Sorted by date, each
``add`` opens an interval that the next entry for the same value closes, so the intervals of one
value are disjoint and at most one of them holds any instant: joining a capture on equality of
the value and ``start <= fetched_at < end`` is an as-of join.

Kinds: ``domain`` (the host and all hosts below it), ``host`` (this host alone), ``prefix`` (host
and leading path segments). Of the entries active at the fetch time the longest value decides;
at equal length prefix before host before domain, then block before allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from bitloom.llm.common import cut

#: A popular value's captures are dealt out in parts of about so many; its list entries are repeated as often.
PART_ROWS = 16_384

OPEN_END = (1 << 62) - 1


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """All values that an entry about this URL can have, as array<struct<kind, value>>."""
    host, segments = host_of(url), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    labels = F.split(host, r"\.")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: entry("domain", F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")),
    )
    prefixes = F.when(
        F.size(segments) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(segments)),
            lambda i: entry("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))),
        ),
    ).otherwise(none)
    return F.when(host == "", none).otherwise(F.concat(F.array(entry("host", host)), domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, kind, value, effect, start, end of each validity interval.

    Entries of one value at the same instant count once, an add before a remove. Entries with a
    null value, kind or date are void; a null list name is a list of its own; a null effect blocks.
    Grouping by instant first leaves at most one row per value and date for the window.
    """
    name = ["list_name", "kind", "value", "effect"]
    clean = entries.where("value IS NOT NULL AND kind IS NOT NULL AND at IS NOT NULL").select(
        "list_name", "kind", F.when(F.col("kind") != "prefix", F.lower("value")).otherwise(F.col("value")).alias("value"),
        F.coalesce("effect", F.lit("block")).alias("effect"), "at", (F.coalesce("action", F.lit("add")) == "add").alias("adds"),
    )
    states = clean.groupBy(*name, "at").agg(F.max("adds").alias("adds"))
    ends = F.lead("at", 1).over(Window.partitionBy(*name).orderBy("at"))
    return (
        states.withColumn("end", F.coalesce(ends, F.lit(OPEN_END)))
        .where("adds")
        .select(*name, F.col("at").alias("start"), "end")
    )


def judge(captures: DataFrame, entries: DataFrame, row_id: str = "page_id") -> DataFrame:
    """Every capture (row_id, url, fetched_at as a long) with the verdict of the lists at its fetch time.

    Adds n_active (active entries about it), effect (block, allow or none), matched_kind,
    matched_value, matched_list. Repeated rows come back as often as they went in. A null or
    malformed URL or a null fetch time matches nothing. Columns besides the three are left out, so
    their names can't clash.
    """
    rows = captures.select(F.col(row_id).alias("_id"), "url", "fetched_at")
    distinct = rows.groupBy("_id", "url", "fetched_at").agg(F.count("*").alias("_n"))
    every = distinct.withColumn("_k", F.explode_outer(keys_of(F.col("url"))))
    # values with more captures than a part: their number is bounded by the captures over PART_ROWS
    parts = F.ceil(F.col("_c") / PART_ROWS).cast("int").alias("_parts")
    hot = cut(every.groupBy("_k").agg(F.count("*").alias("_c")).where(F.col("_c") > PART_ROWS).where("_k IS NOT NULL").select("_k.kind", "_k.value", parts), "hot")
    of_key = hot.select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), "_parts")
    salted = every.join(of_key, (F.col("_k.kind") == F.col("_kind")) & (F.col("_k.value") == F.col("_value")), "left")
    keyed = salted.withColumn("_salt", F.pmod(F.xxhash64("_id", "url"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_kind", "_value", "_parts")
    listed = intervals(entries).join(hot, ["kind", "value"], "left")
    active = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    c, e = keyed.alias("c"), active.alias("e")
    hits = c.join(
        e,
        (F.col("c._k.value") == F.col("e.value"))
        & (F.col("c._k.kind") == F.col("e.kind"))
        & (F.col("c._salt") == F.col("e._salt"))
        & (F.col("c.fetched_at") >= F.col("e.start"))
        & (F.col("c.fetched_at") < F.col("e.end")),
        "left",
    )
    rank = F.when(F.col("e.kind") == "prefix", 3).when(F.col("e.kind") == "host", 2).otherwise(1)
    best = F.max(
        F.when(
            F.col("e.value").isNotNull(),
            F.struct(
                F.length("e.value").alias("l"), rank.alias("r"), (F.col("e.effect") == "block").cast("int").alias("b"),
                F.coalesce(F.col("e.list_name"), F.lit("")).alias("list"), F.col("e.value").alias("value"),
                F.col("e.kind").alias("kind"), F.col("e.effect").alias("effect"),
            ),
        )
    )
    judged = hits.groupBy("c._id", "c.url", "c.fetched_at").agg(
        F.max("c._n").alias("_n"), F.count("e.value").alias("n_active"), best.alias("_b")
    )
    return judged.select(
        F.col("_id").alias(row_id), "url", "fetched_at", "n_active",
        F.coalesce("_b.effect", F.lit("none")).alias("effect"), F.col("_b.kind").alias("matched_kind"),
        F.col("_b.value").alias("matched_value"), F.col("_b.list").alias("matched_list"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"),
    ).drop("_copy")


# The tables have neither fetch times nor lists, so the query derives both from the pages: hours
# since 2022-01-01 from the page id, and for values seen in the pages dated entries from their MD5.
EPOCH, HOURS = 1640995200, 17520


def number(key: Column) -> Column:
    """32 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    at = F.lit(EPOCH) + number(F.concat(F.lit("fetch|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))) % HOURS * 3600
    return pages.select("page_id", "url", at.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries: for every second value of a kind an add, for half of these a remove, for some an add again."""
    values = pages.select(F.explode(keys_of(F.col("url"))).alias("k")).select("k.*").distinct()
    n = number(F.concat("kind", F.lit("|"), "value"))
    event = lambda day, action: F.struct((F.lit(EPOCH) + day * 86400).alias("at"), F.lit(action).alias("action"))
    events = F.concat(
        F.array(event(n % 500, "add")),
        F.when(n % 4 < 2, F.array(event(n % 500 + 60, "remove"))).otherwise(F.array().cast("array<struct<at:bigint,action:string>>")),
        F.when(n % 8 == 0, F.array(event(n % 500 + 150, "add"))).otherwise(F.array().cast("array<struct<at:bigint,action:string>>")),
    )
    return (
        values.where((n % 3 != 0) & (F.col("value") != ""))
        .select(
            F.when(n % 5 == 0, F.lit("partner")).otherwise(F.lit("abuse")).alias("list_name"), "kind", "value",
            F.when(n % 5 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("effect"), F.explode(events).alias("_e"),
        )
        .select("list_name", "kind", "value", "effect", "_e.at", "_e.action")
    )


def query(pages: DataFrame) -> DataFrame:
    """The verdict on every page: page_id, url, fetched_at, n_active, effect, matched_kind, matched_value, matched_list.

    Null ids and URLs, repeated pages and an empty table are as in ``judge``.
    """
    return judge(captures_of(pages), entries_of(pages))


SQL = r"""
WITH parsed AS (
  SELECT page_id, url, 1640995200 + ('0x' || substr(md5('fetch|' || coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT % 17520 * 3600 AS fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1) AS host,
         list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages
), keys AS (
  SELECT page_id, url, fetched_at, 'host' AS kind, host AS value FROM parsed WHERE host <> ''
  UNION ALL
  SELECT page_id, url, fetched_at, 'domain', array_to_string(labels[i:], '.') FROM (
    SELECT page_id, url, fetched_at, labels, unnest(range(1, len(labels) + 1)) AS i
    FROM (SELECT *, string_split(host, '.') AS labels FROM parsed WHERE host <> ''))
  UNION ALL
  SELECT page_id, url, fetched_at, 'prefix', host || '/' || array_to_string(segs[1:i], '/') FROM (
    SELECT page_id, url, fetched_at, host, segs, unnest(range(1, len(segs) + 1)) AS i FROM parsed WHERE host <> '')
), vals AS (
  SELECT DISTINCT kind, value, ('0x' || substr(md5(kind || '|' || value), 1, 8))::BIGINT AS n FROM keys
), listed AS (
  SELECT CASE WHEN n % 5 = 0 THEN 'partner' ELSE 'abuse' END AS list_name, kind, value,
         CASE WHEN n % 5 = 0 THEN 'allow' ELSE 'block' END AS effect, n FROM vals WHERE n % 3 <> 0 AND value <> ''
), entries AS (
  SELECT *, 1640995200 + n % 500 * 86400 AS dated, 'add' AS action FROM listed
  UNION ALL SELECT *, 1640995200 + (n % 500 + 60) * 86400, 'remove' FROM listed WHERE n % 4 < 2
  UNION ALL SELECT *, 1640995200 + (n % 500 + 150) * 86400, 'add' FROM listed WHERE n % 8 = 0
), spans AS (
  SELECT *, coalesce(lead(dated) OVER (PARTITION BY list_name, kind, value, effect ORDER BY dated), 4611686018427387903) AS until FROM entries
), hits AS (
  SELECT k.*, s.list_name, s.effect FROM keys k JOIN spans s
  ON k.kind = s.kind AND k.value = s.value AND s.action = 'add' AND k.fetched_at >= s.dated AND k.fetched_at < s.until
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active, row_number() OVER (PARTITION BY page_id ORDER BY length(value) DESC,
         CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, (effect = 'block')::INT DESC, list_name DESC) AS r FROM hits
)
SELECT p.page_id, p.url, p.fetched_at, coalesce(n_active, 0) AS n_active, coalesce(effect, 'none') AS effect,
       r.kind AS matched_kind, r.value AS matched_value, r.list_name AS matched_list
FROM parsed p LEFT JOIN ranked r ON p.page_id = r.page_id AND r.r = 1
"""
