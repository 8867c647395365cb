"""URL filters: a sort-merge range join of urls with nested host and path rules, on DataFrame functions only.

A host turns into a canonical key, its labels in reverse with a dot behind each (`www.example.com` ->
`com.example.www.`): a rule for a host and its subdomains is the interval of all keys that begin with the rule's
key. Path rules of one host are intervals of paths in the same way. Intervals of prefixes nest or are disjoint. So
a sweep over sorted keys needs a stack only: the rule met last in the sweep carries the stack of the rules around
it, and those of the stack whose interval the swept key has left are popped.

Two sweeps follow each other. The first sorts urls and rule hosts by key and gives every url the rule hosts that are
open; the second sorts the (url, open rule host) pairs and the host's path rules by path. Of the rules that are
open in both, the longest (host and path together, then host, then block before allow) gives the verdict.

A sweep's task holds the rows of one (label group, salt): rules of one or more labels are copied to the salts of
their group, so a hot host is spread over all salts, whatever it weighs. Urls are never copied; only urls with an
open rule host go through the second sweep.

Cases: a null url, or one without `://`, has empty host and path and gets the default verdict, as has an empty
table's none. Repeated rows stay. Rules with a null part or an unknown verdict aren't rules; repeated rules count
once, and of a block and an allow rule with the same pattern block wins. Other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

GROUPS = 4


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, pattern `host/path`) as the table that judge() takes."""
    rows = [(verdict, pattern.split("/", 1)[0], "/" + pattern.split("/", 1)[1] if "/" in pattern else "") for verdict, pattern in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def _prefixes(rules: DataFrame, key: str, within: list[str]) -> DataFrame:
    """rules(within, key, open) with stack: the keys of all rules of the same `within` whose key is a prefix of key.

    Every rule looks up the prefixes of its own key by an equi-join; a stack has at most one entry for each
    prefix, so its length is bounded by that of the key.
    """
    own = rules.select(*within, key).distinct()
    ahead = own.select(*within, F.col(key).alias("__own"), F.explode(F.transform(F.sequence(F.lit(0), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))).alias(key))
    met = ahead.join(own, [*within, key])
    return met.groupBy(*within, F.col("__own").alias(key)).agg(F.array_sort(F.collect_list(key)).alias("stack"))


def _swept(rows: DataFrame, marks: DataFrame, deal: list[str], key: str) -> DataFrame:
    """rows with `stack`: that of the last mark at or before the row's key among the same `deal`, popped."""
    left = rows.withColumn("__turn", F.lit(1)).withColumn("stack", F.lit(None).cast("array<string>"))
    right = marks.withColumn("__turn", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*deal).orderBy(key, "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("stack", ignorenulls=True).over(order)
    swept = both.withColumn("stack", last).where("__turn = 1").drop("__turn")
    return swept.withColumn("stack", F.filter("stack", lambda s: F.col(key).startswith(s)))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", groups: int = GROUPS, salts: int | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of urls by rules(verdict, host, path)."""
    spark = urls.sparkSession
    salts = salts or shuffle_width(spark)
    known = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict in ('allow', 'block')")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the greater
    known = known.withColumn("key", host_key(F.col("host")))

    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("__salt", F.pmod(F.xxhash64("id", "host", "path"), F.lit(salts)))

    def group(key: Column) -> Column:
        """A number by the first two labels; rules with one label go to all groups."""
        return F.pmod(F.xxhash64(F.substring_index(key, ".", 2)), F.lit(groups))

    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    hosts = _prefixes(known, "key", [])
    hosts = hosts.select("key", "stack", F.explode(F.when(F.length("key") - F.length(F.replace("key", F.lit("."))) < 2, F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).otherwise(F.array(group(F.col("key"))))).alias("__group"))
    hosts = hosts.select("*", every_salt.alias("__salt"))
    # read twice below: written, so that the first sweep runs once
    first = written(_swept(rows.withColumn("__group", group(F.col("key"))), hosts, ["__group", "__salt"], "key").select("id", "host", "path", "stack", "__salt"), "url-swept", 4)

    open_ = first.where(F.size(F.coalesce("stack", F.array())) > 0).select("id", "host", "path", F.size("stack").alias("__depth"), "__salt", F.explode("stack").alias("owner"))
    rest = first.where(F.size(F.coalesce("stack", F.array())) <= 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    by_host = known.select(F.col("key").alias("owner"), "path")
    paths = _prefixes(by_host, "path", ["owner"]).select("*", every_salt.alias("__salt"))
    second = _swept(open_, paths, ["owner", "__salt"], "path")
    # of one owner's open rules the last of the stack is the longest
    longest = second.withColumn("won", F.when(F.size("stack") > 0, F.element_at("stack", -1)))
    # equal rows have equal stacks: they are counted, judged once and dealt out again
    best = longest.groupBy("id", "host", "path").agg(
        F.expr("count(*) div first(__depth)").alias("copies"),
        F.max(F.when(F.col("won").isNotNull(), F.struct((F.length("owner") + F.length("won")).alias("n"), F.length("owner").alias("h"), "owner", "won"))).alias("best"),
    )
    best = best.select("id", "host", "path", "best", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    named = known.select(F.col("key").alias("owner"), F.col("path").alias("won"), F.concat("host", "path").alias("rule"), "verdict")
    judged = best.select("id", "host", "path", F.col("best.owner").alias("owner"), F.col("best.won").alias("won")).join(named, ["owner", "won"], "left")
    judged = judged.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(rest).withColumnRenamed("id", id_col)
