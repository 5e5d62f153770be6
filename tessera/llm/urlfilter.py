"""URL allow and block rules by a sort-merge range join (DataFrame functions
only).

A key is the reversed host (``net.example.www``), a byte that no UTF-8 text
has, and the path.  A rule covers the interval of keys that begin with its
own.  As it fits all subdomains of its host, a URL is probed once for each
domain above its host (no deeper than the rules go), with its path.  Intervals
of prefixes nest or are disjoint, so a sweep over the sorted keys needs only a
stack of the open rules; a probe meets the rule on top, the longest that fits
for that domain, and the longest over a URL's domains wins.

The sweep runs in range partitions.  Inside one, a running sum of +1 (a rule
opens) and -1 (it closes) is the depth of the stack, and the top of the stack
at depth d is the last rule that opened there; rules that opened in an earlier
partition come from a table of (partition, depth), whose size is bounded by
the number of partitions and the nesting of the rules.

Equal URLs are swept once and joined back.

Defined cases: a null URL or one without ``://`` has an empty host and path
and gets the default verdict, as does an empty host; a rule repeated with both
verdicts blocks; rules with a null host or path are ignored; of two rules of
equal length the one with the longer host wins; repeated pages each get their
row; an empty rule table gives the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _key(reversed_host: Column, path: Column) -> Column:
    return F.concat(F.encode(reversed_host, "UTF-8"), F.expr("X'FE'"), F.encode(path, "UTF-8"))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _sweep(points: DataFrame) -> DataFrame:
    """``points``: (key, kind, tie, host, path, rule).  kind 0 opens a rule, 1
    probes, 2 closes.  Returns (host, path, rule) of the probes under a rule."""
    order = ["key", "kind", "tie"]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: every later step has to see the same partitions
    dealt = (points.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())).checkpoint()

    delta = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    sofar = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth_in = (dealt.groupBy("part").agg(F.sum(delta).alias("change"))
                .withColumn("depth_in", F.coalesce(F.sum("change").over(
                    Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .select("part", "depth_in"))
    x = dealt.join(F.broadcast(depth_in), "part")  # one row per partition
    x = x.withColumn("depth", F.col("depth_in") + F.sum(delta).over(sofar))
    top = Window.partitionBy("part", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("kind") == 0, F.col("rule"))
    x = x.withColumn("here", F.last(opened, ignorenulls=True).over(top))

    # rules still open when a partition begins: of each depth the last to open before it
    last_open = (x.where("kind = 0").groupBy("part", "depth")
                 .agg(F.max_by("rule", F.struct(*order)).alias("rule")))
    wanted = depth_in.where("depth_in > 0").select("part", F.explode(F.expr("sequence(1L, depth_in)")).alias("depth"))
    both = wanted.join(last_open, ["part", "depth"], "full")
    before = Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select("part", "depth", F.last("rule", ignorenulls=True).over(before).alias("carried"))
    probes = x.where("kind = 1 and depth > 0").select("part", "depth", "host", "path", "here")
    return (probes.join(carried, ["part", "depth"], "left")
            .select("host", "path", F.coalesce("here", "carried").alias("rule")).where("rule is not null"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = ALLOW) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` of every page.  ``rules`` has
    host, path and verdict; ``rule`` is host and path of the one that wins."""
    page = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    page = page.select("_id", host.alias("host"), path.alias("path"))
    urls = page.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))

    rules = (rules.where("host is not null and path is not null").groupBy("host", "path")
             .agg(F.max("verdict").alias("verdict")))  # block after allow
    labels = F.size(F.split("host", r"\."))
    deepest = rules.agg(F.max(labels)).first()[0] or 0
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                    F.concat("host", "path").alias("rule"), "verdict")
    start = _key(_reversed(F.col("host")), F.col("path"))
    nothing = F.lit(None).cast("string")
    edges = rules.select(start.alias("key"), rule.alias("rule"))
    opens = edges.select("key", F.lit(0).alias("kind"), F.octet_length("key").cast("long").alias("tie"),
                         nothing.alias("host"), nothing.alias("path"), "rule")
    # inner rules close first: longer keys get smaller closing ties
    closes = edges.select(F.concat("key", F.expr("X'FF'")).alias("key"), F.lit(2).alias("kind"),
                          (-F.octet_length("key")).cast("long").alias("tie"), nothing.alias("host"), nothing.alias("path"), "rule")
    backwards = F.reverse(F.split("host", r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size("names"), F.lit(max(deepest, 1)))),
                          lambda i: F.array_join(F.slice("names", 1, i), "."))
    probes = (urls.select("host", "path", backwards.alias("names")).select("host", "path", F.explode(domains).alias("domain"))
              .select(_key(F.col("domain"), F.col("path")).alias("key"), F.lit(1).alias("kind"),
                      F.xxhash64("host", "path").alias("tie"), "host", "path",
                      F.lit(None).cast(edges.schema["rule"].dataType).alias("rule")))
    met = _sweep(opens.unionByName(closes).unionByName(probes))
    best = met.groupBy("host", "path").agg(F.max("rule").alias("won"))
    return page.join(best, ["host", "path"], "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
