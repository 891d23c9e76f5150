"""URL filters by a sort-merge range join of rules and pages.

A rule is a host, a path and a verdict. It fits its host and all subdomains,
where the url's path starts with the rule's. Of the rules that fit, the one of
the longest host wins, and of those the one of the longest path.

Method. A host's labels turned round, each with a dot behind it, and then the
path give a key under which a rule fits exactly the keys that begin with its
own: an interval of the sorted keys. A url has such a key for its host and each
parent domain, up to as many labels as rules have. Intervals are nested or
apart. Keys and rules are dealt out by ranges of the key, sorted, and swept:
a stack holds the rules whose interval is open, a key closes those that it
doesn't begin with, and the top of the stack is the rule that fits best.

A range of keys begins inside the intervals of rules that were sorted into
earlier ranges. They are found by the ranges' first keys (the driver gets one of
``BOUNDARY`` characters at most for each range) and travel to each range that
they reach, as many as nested rules can begin one key. Equal urls are judged
once, so a url that a third of all pages share is one row of the sweep, and a
host that does is cut by its paths.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, bound_batches, discard, materialize, plain_columns, plan_bytes, read_table

#: Ranges that keys are dealt out to, the input bytes that one stands for, and the characters of a range's first key that the driver gets.
MOST_RANGES, RANGE_BYTES, BOUNDARY = 4096, 64 << 20, 1024

RULES = "host string, path string, verdict string"
OUTPUT = ["host", "path", "rule", "verdict"]


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column, labels: Column | None = None) -> Column:
    """A host's labels from the last one, each with a dot behind it; only so many of them where ``labels`` is given."""
    turned = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(turned if labels is None else F.slice(turned, 1, labels), "."), F.lit("."))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rule of each key: rows are sorted by range and key, rules before the urls of their key."""
    stack: list[tuple[str, str, str, int]] = []
    current = None
    for batch in batches:
        part, key, kind, host, path, verdict, depth = (column.to_pylist() for column in batch.columns)
        hosts, paths, names, verdicts, depths = [], [], [], [], []
        for i, own in enumerate(key):
            if part[i] != current:
                current = part[i]
                stack.clear()
            while stack and not own.startswith(stack[-1][0]):
                stack.pop()
            if kind[i] == 0:
                if not stack or stack[-1][0] != own:  # a rule may have come from an earlier range as well
                    stack.append((own, host[i] + path[i], verdict[i], depth[i]))
            elif stack and stack[-1][3] == depth[i]:
                hosts.append(host[i])
                paths.append(path[i])
                names.append(stack[-1][1])
                verdicts.append(stack[-1][2])
                depths.append(depth[i])
        columns = [*(pa.array(c, pa.string()) for c in (hosts, paths, names, verdicts)), pa.array(depths, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "rule", "verdict", "depth"])


def judged_places(places: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) that a rule fits."""
    bound_batches(places.sparkSession)
    rules = rules.filter(F.col("host").isNotNull() & F.col("verdict").isNotNull() & F.col("path").rlike("^(/|$)"))  # no url's path begins otherwise
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    depth = F.size(F.split("host", r"\."))
    keyed = rules.select(F.concat(host_key(F.col("host")), F.col("path")).alias("key"), F.lit(0).alias("kind"), "host", "path", "verdict", depth.alias("depth"))
    keyed = materialize(keyed, "url-rules")
    deepest = keyed.agg(F.max("depth")).first()[0]
    if deepest is None:
        return places.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    levels = F.explode(F.sequence(F.lit(1), F.least(depth, F.lit(deepest)))).alias("depth")
    events = places.select("host", "path", levels).select(F.concat(host_key(F.col("host"), F.col("depth")), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), "depth")
    dealt = keyed.unionByName(events).repartitionByRange(ranges, "key", "kind", "host")
    dealt = materialize(dealt.select(F.spark_partition_id().alias("part"), "*"), "url-keys")

    firsts = sorted((row["key"], row["part"]) for row in dealt.groupBy("part").agg(F.min(F.substring("key", 1, BOUNDARY)).alias("key")).collect())

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                head = key[:BOUNDARY]
                at = bisect_left(firsts, (head, -1))
                while at < len(firsts) and firsts[at][0].startswith(head):
                    rows.append(i)
                    parts.append(firsts[at][1])
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.take(pa.array(rows, pa.int64())).columns], names=["part", *batch.schema.names])

    carry = keyed.mapInArrow(carried, f"part int, {', '.join(f'{name} {kind}' for name, kind in keyed.dtypes)}")
    swept = dealt.unionByName(carry).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    found = swept.select("part", "key", "kind", "host", "path", "verdict", "depth").mapInArrow(_swept, "host string, path string, rule string, verdict string, depth int")
    best = found.groupBy("host", "path").agg(F.max(F.struct("depth", "rule", "verdict")).alias("best"))
    out = materialize(best.select("host", "path", "best.rule", "best.verdict"), "url-verdicts")
    discard(keyed, dealt)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Each row with host, path, rule (host and path of the rule that fits best, else null) and verdict (the rule's, else ``default``).

    ``rules`` has host, path and verdict; rows with a null among them are no
    rules, and of rules of one host and path the greatest verdict counts (block
    before allow). Null urls and those without :// have an empty host and path,
    which only a rule of an empty host fits. An empty path starts with an empty one
    alone. Rows are kept as often as they come; without rules all get
    the default; an empty table gives an empty one. Input columns with the
    results' names are replaced, others kept, whatever their names.
    """
    free = next(name for k in range(len(pages.columns) + 1) if (name := f"page{k}") not in [c.lower() for c in pages.columns])
    row = F.struct(*plain_columns(pages, OUTPUT)).alias(free)
    cut = pages.select(row, url_host(F.col(f"`{url_column}`")).alias("host"), url_path(F.col(f"`{url_column}`")).alias("path"))
    if ranges is None:
        ranges = max(8, min(MOST_RANGES, plan_bytes(pages) // RANGE_BYTES))
    verdicts = judged_places(cut.select("host", "path").distinct(), rules, ranges)
    joined = cut.join(verdicts.hint("merge"), ["host", "path"], "left")  # verdicts grow with the pages, so they are never broadcast
    kept = [F.col(free)[name].alias(name) for name in pages.columns if name.lower() not in OUTPUT]
    return joined.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
PAGE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op13_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(PAGE_RULES, RULES)).select("page_id", *OUTPUT)


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, arg_max(h || q, len(h) * 100 + len(q)) AS rule, arg_max(v, len(h) * 100 + len(q)) AS verdict
  FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id
"""
