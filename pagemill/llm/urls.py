"""URL filter rules as a sort-merge range join, in DataFrame operations only.

The host's labels are reversed, so that a rule's host and all its subdomains are one interval of keys. Pages and the starts
of rules are sorted together; since intervals of this kind nest, the last rule that started before a page and the rules
around it are the only ones that can be active there. Each rule carries that stack, and a running `last` brings it to the
pages behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.session import fresh

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ROWS_A_TASK = 100_000
#: Rules up to which their last labels are broadcast.
FEW = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the right, each with a dot behind it: a host's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """For each distinct host of rules its key and the rules of it and of the hosts around it, outermost first."""
    own = rules.select(reversed_host(F.col("host")).alias("key"), "host", "path", "verdict").distinct()
    hosts = own.select("key").distinct()
    around = hosts.select("key", F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.").alias("labels"))
    around = around.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.concat(F.array_join(F.slice("labels", F.lit(1), n), "."), F.lit(".")))).alias("outer"))
    entries = around.join(own.withColumnRenamed("key", "outer"), "outer")
    entry = F.struct(F.length("outer").alias("depth"), F.col("outer").alias("key"), F.col("path"), F.col("verdict"), F.concat("host", "path").alias("rule"))
    return entries.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def _few(rules: DataFrame) -> bool:
    return rules.limit(FEW + 1).count() <= FEW


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, *, url: str = "url", default: str = "allow", rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced.

    A rule (host, path, verdict) fits urls of its host and all subdomains whose path starts with the rule's. The longest
    fitting rule wins (of equal length, the one with the longer host; then block before allow is decided by the verdict's
    name, the later one winning). Without a fitting rule, `rule` is null and the verdict is `default`.

    Pages are dealt by the last label of their host and, where that has more than rows_a_task pages, by a hash of the
    row, so that one host or top-level domain spreads over as many tasks as it takes; rules are repeated for each. Null urls, and urls without ://, have an empty host
    and path and fit no rule. Rules with a null or empty host are ignored. Repeated rows are each judged.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path, key, top, salt, stack, best, is_rule, salts = fresh(columns, "host", "path", "sort_key", "top_label", "salt", "stack", "best", "is_rule", "salts")
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> ''")
    first_label = lambda c: F.substring_index(c, ".", 1)
    rows = pages.select(*columns, host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path))
    rows = rows.withColumn(key, reversed_host(F.col(host))).withColumn(top, first_label(key))
    ruled = _stacks(rules).select(F.col("key").alias(key), first_label("key").alias(top), F.col("stack").alias(stack))
    # only last labels that rules have are counted; pages of others meet no rule
    tops = F.broadcast(ruled.select(top).distinct()) if _few(rules) else ruled.select(top).distinct()
    sized = rows.join(tops, top, "left_semi").groupBy(top).agg(F.ceil(F.count("*") / rows_a_task).cast("int").alias(salts))
    sized = F.broadcast(sized) if _few(rules) else sized
    stacks = ruled.join(sized, top).select(key, top, stack, F.explode(F.sequence(F.lit(0), F.col(salts) - 1)).alias(salt), F.lit(True).alias(is_rule))
    # by the row's values, so that a recomputed task deals its rows as before; pages without a rule spread likewise
    hashed = F.xxhash64(*(c for c in (*columns, host, path) if "map<" not in rows.schema[c].dataType.simpleString()))
    place = F.when(F.col(salts).isNotNull(), F.pmod(hashed, F.col(salts))).otherwise(-1 - F.pmod(hashed, F.lit(1 << 20))).cast("int")
    rows = rows.join(sized, top, "left").withColumn(salt, place).drop(salts).withColumn(is_rule, F.lit(False))
    sweep = Window.partitionBy(top, salt).orderBy(key, F.desc(is_rule)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(stacks, allowMissingColumns=True).withColumn(stack, F.last(stack, ignorenulls=True).over(sweep)).where(~F.col(is_rule))
    fits = F.filter(stack, lambda r: F.startswith(F.col(key), r["key"]) & F.startswith(F.col(path), r["path"]))
    found = swept.withColumn(best, F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["depth"].alias("depth"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))))
    return found.select(*columns, F.col(host).alias("host"), F.col(path).alias("path"), F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))
