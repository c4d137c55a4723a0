"""Metering: monthly counters, quotas, entitlements, plan economics, cached requests and sessions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators.ranges import PARTS, earlier, ranged, within
from pagemill.sources.tables import FIELDS

#: key, rank, monthly price, yearly price, limits (pages to recognise, actions, voice characters, files a month), file MB, pages, page cap, ai, ocr, voice; fixed values.
TIERS = [
    ("free", 0, None, None, 0, 0, 0, 1, 20, 2000, 100, False, False, False),
    ("reader_plus", 1, 4.99, 39.99, 0, 0, 0, 100, 100, 2000, 0, False, False, False),
    ("ai_pro", 2, 12.99, 119.99, 750, 150, 45000, 300, 100, 1500, 0, True, True, True),
    ("power", 3, 29.99, 279.99, 2500, 400, 100000, 1000, 200, 5000, 0, True, True, True),
]
TIER_SCHEMA = "key string, rank int, monthly double, yearly double, ocrPages long, aiActions long, cloudVoiceChars long, pdfs long, max_mb long, max_pages long, page_cap long, ai boolean, ocr boolean, voice boolean"
TIER_FIELDS = [x.split()[0] for x in TIER_SCHEMA.split(", ")]
NET_SHARE, VENDOR_SHARE, USD_PER_CHAR, USD_PER_ACTION = 0.84, 0.2, 30 / 1_000_000, 0.00185


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, TIER_SCHEMA)


def month_of(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def usage_monthly(events: DataFrame) -> DataFrame:
    """month, app_user_id and six counters, 0 where nothing happened."""
    sums = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("amount"))), F.lit(0)).alias(f) for f in FIELDS]
    return events.groupBy(month_of("ts").alias("month"), "app_user_id").agg(*sums)


def highest_tier(entitlements: DataFrame, all_tiers: DataFrame) -> DataFrame:
    """app_user_id, tier: the highest tier that a user's entitlements name, else free."""
    known = entitlements.join(F.broadcast(all_tiers.select(F.col("key").alias("entitlement_id"), "rank")), "entitlement_id", "left")
    return known.groupBy("app_user_id").agg(F.coalesce(F.max_by("entitlement_id", "rank"), F.lit("free")).alias("tier"))


def active_entitlements(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """req_id, entitlement_id: once for each entitlement of the user that lasts beyond the request; no end means for ever, an unreadable end never.

    Grants of an entitlement are first reduced to the one that lasts longest, so a request meets as many rows as its user has
    entitlements, however many grants there are. A request without a time, or a grant without a user, has none but those for ever.
    """
    end = F.when(F.col("expires").isNull(), F.lit(None)).otherwise(F.try_to_timestamp("expires"))
    longest = grants.groupBy("app_user_id", "entitlement_id").agg(F.bool_or(F.col("expires").isNull()).alias("_ever"), F.max(end).alias("_end"))
    return requests.join(longest, "app_user_id").where(F.col("_ever") | (F.col("_end") > F.col("ts"))).select("req_id", "entitlement_id")


def with_limits(requests: DataFrame, user_tiers: DataFrame, all_tiers: DataFrame, field: str) -> DataFrame:
    """requests with `limit`: what their user's tier (app_user_id, tier) allows of a field in a month; users without a known tier are free."""
    tier = user_tiers.select(F.col("app_user_id").alias("_user"), F.col("tier").alias("_tier"))
    limits = all_tiers.select(F.col("key").alias("_key"), F.col(field).alias("limit"))
    free = F.lit(next(t for t in TIERS if t[0] == "free")[TIER_FIELDS.index(field)])
    rows = requests.join(tier, F.col("app_user_id") == F.col("_user"), "left").join(F.broadcast(limits), F.col("_tier") == F.col("_key"), "left")
    return rows.select(*requests.columns, F.coalesce("limit", free).cast("long").alias("limit"))


def usage_remaining(usage: DataFrame, user_tiers: DataFrame, all_tiers: DataFrame) -> DataFrame:
    """month, app_user_id, field, used, limit, remaining of the four metered fields."""
    metered = ["ocrPages", "aiActions", "cloudVoiceChars", "pdfs"]
    rows = usage.join(user_tiers, "app_user_id", "left").withColumn("tier", F.coalesce("tier", F.lit("free")))
    limits = all_tiers.select(F.col("key").alias("tier"), *(F.col(f).alias(f"max_{f}") for f in metered))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("used"), F.col(f"max_{f}").alias("limit")) for f in metered))).alias("x")
    return rows.join(F.broadcast(limits), "tier").select("month", "app_user_id", cells).select("month", "app_user_id", "x.*", F.greatest(F.lit(0), F.col("x.limit") - F.col("x.used")).alias("remaining"))


def plan_economics(all_tiers: DataFrame) -> DataFrame:
    """key, net, budget, cost, ok of the tiers with a vendor behind them, at their allowance and lower price."""
    net = F.least("monthly", F.col("yearly") / 12) * NET_SHARE
    cost = F.col("cloudVoiceChars") * USD_PER_CHAR + F.col("aiActions") * USD_PER_ACTION
    return all_tiers.where("ai or voice").select("key", net.alias("net"), (net * VENDOR_SHARE).alias("budget"), cost.alias("cost"), (cost <= net * VENDOR_SHARE + 0.005).alias("ok"))


def ocr_unit_cost(page_counts: DataFrame, fee: float) -> DataFrame:
    """USD for 100 pages at each monthly volume."""
    return page_counts.select("*", (F.lit(100.0) * fee / F.col("volume")).alias("usd_per_100"))


def request_outcomes(requests: DataFrame) -> DataFrame:
    """month, app_user_id and how many requests were hits, fresh, failed and denied."""
    counts = [F.count_if(F.col("outcome") == x).alias(n) for x, n in (("hit", "hits"), ("fresh", "fresh"), ("failed", "failed"), ("denied", "denied"))]
    return requests.groupBy(month_of("ts").alias("month"), "app_user_id").agg(*counts)


def quota_admit_unit(requests: DataFrame, limit: Column) -> DataFrame:
    """Requests of one unit in order of time: admitted while the limit is not reached."""
    order = Window.partitionBy("app_user_id", "month", "field").orderBy("ts", "req_id")
    return requests.withColumn("admitted", F.row_number().over(order) <= limit)


def _in_order(rows: DataFrame, keys: list[str], columns: list[str], start, step, schema: str) -> DataFrame:
    """Rows of each key in order of (ts, req_id) through step(state, *arrays) -> (state, *arrays of results), a run of a key's rows at a time; what is kept between runs is one state.

    Spark sorts within partitions and spills, so a key of very many rows is a long stream but no large group.
    """
    kept = [*keys, "req_id"]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        key, state = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            edges = np.append(np.flatnonzero(new), batch.num_rows)
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = [batch.column(k)[a].as_py() for k in keys]
                if own != key:
                    key, state = own, start
                state, *result = step(state, *(v[a:b] for v in values))
                out.append(result)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], names)

    spark = rows.sparkSession
    sorted_ = rows.select(*dict.fromkeys([*kept, "ts", *columns])).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "ts", "req_id")
    return sorted_.select(*dict.fromkeys([*kept, *columns])).mapInArrow(run, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _ok(requests: DataFrame) -> Column:
    """Whether the work of a request succeeded, as far as that is known."""
    return F.coalesce(F.col("ok"), F.lit(True)) if "ok" in requests.columns else F.lit(True)


def quota_steps(used: int, amounts: np.ndarray, limits: np.ndarray, ok: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """used after a user's requests of a month, which of them were admitted, and used after each.

    As long as all that comes fits, that is one running sum; a request that does not fit, or fails, ends the sum and uses nothing.
    """
    n = len(amounts)
    admitted, after = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
    at, step = 0, 32
    while at < n:
        upto = min(at + step, n)
        sums = used + np.cumsum(amounts[at:upto])
        stop = np.flatnonzero((sums > limits[at:upto]) | ~ok[at:upto])
        end = at + (int(stop[0]) if len(stop) else upto - at)
        admitted[at:end], after[at:end] = True, sums[: end - at]
        used = int(sums[end - at - 1]) if end > at else used
        step = min(step * 2, 1 << 16) if end == upto else 32
        if end < upto:  # refused, or admitted and failed
            admitted[end], after[end] = used + amounts[end] <= limits[end], used
            end += 1
            # what is refused by more than is left comes in runs
            more = np.flatnonzero((used + amounts[end:upto] <= limits[end:upto]) & ok[end:upto])
            stop = end + (int(more[0]) if len(more) else upto - end)
            admitted[end:stop], after[end:stop] = used + amounts[end:stop] <= limits[end:stop], used
            end = stop
        at = end
    return used, admitted, after


def quota_admit_amount(requests: DataFrame, limit: Column | int | None = None) -> DataFrame:
    """app_user_id, month, req_id, admitted, used: in order of time, what would exceed the limit is refused and uses nothing; smaller ones may follow.

    The limit is that of each request (column `limit`, see with_limits) unless one is given; a null limit is 0. A null amount uses nothing, nor does an admitted request that
    failed (column `ok`, if there is one: false).
    """
    schema = f"app_user_id {_type(requests, 'app_user_id')}, month string, req_id long, admitted boolean, used long"
    return _in_order(metered(requests, limit), ["app_user_id", "month"], ["amount", "limit", "ok"], 0, quota_steps, schema)


def metered(requests: DataFrame, limit: Column | int | None) -> DataFrame:
    """requests with amount, limit and ok as quota_steps takes them."""
    most = F.col("limit") if limit is None else limit if isinstance(limit, Column) else F.lit(limit)
    rows = requests.withColumn("ok", _ok(requests)).withColumn("limit", F.coalesce(most, F.lit(0)).cast("long"))
    return rows.withColumn("amount", F.coalesce(F.col("amount").cast("long"), F.lit(0))).withColumn("req_id", F.col("req_id").cast("long"))


def quota_trim_pages(requests: DataFrame, limit: Column) -> DataFrame:
    """req_id, granted, pending: page lists cut to what is left of the month's limit."""
    order = Window.partitionBy("app_user_id", "month").orderBy("ts", "req_id").rowsBetween(Window.unboundedPreceding, -1)
    granted = F.greatest(F.lit(0), F.least(F.col("n"), limit - F.coalesce(F.sum("n").over(order), F.lit(0))))
    return requests.withColumn("granted", granted).withColumn("pending", F.col("n") - F.col("granted"))


NEVER = -(1 << 62)


def ttl_steps(set_at: int, us: np.ndarray, ok: np.ndarray, ttl: int) -> tuple[int, np.ndarray]:
    """When a key was last set, and which of its requests (in order of time; NEVER stands for none) are hits. From one setting to the next, by bisection."""
    hits = np.zeros(len(us), dtype=bool)
    sets, at = np.flatnonzero(ok & (us != NEVER)), 0
    while at < len(us):
        if set_at != NEVER:
            end = max(at, int(np.searchsorted(us, set_at + ttl, side="right")))
            hits[at:end] = us[at:end] != NEVER
            at = end
        k = int(np.searchsorted(sets, at))
        if k == len(sets):
            break
        set_at, at = int(us[sets[k]]), int(sets[k]) + 1
    return set_at, hits


def timed(requests: DataFrame) -> DataFrame:
    """requests with us (NEVER where there is no time) and ok as ttl_steps takes them."""
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER))
    return requests.withColumn("us", us).withColumn("ok", _ok(requests)).withColumn("req_id", F.col("req_id").cast("long"))


def ttl_dedupe(requests: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """key, req_id, hit: a request whose key was set at most that long ago is a hit and does not renew it.

    Only fresh work that succeeded sets a key: a miss that failed or was denied (column `ok`, if there is one: false) leaves it, so the next request is a
    miss as well. A request without a time is a miss that sets nothing.
    """
    ttl = ttl_hours * 3_600_000_000
    return _in_order(timed(requests), ["key"], ["us", "ok"], NEVER, lambda at, us, ok: ttl_steps(at, us, ok, ttl), f"key {_type(requests, 'key')}, req_id long, hit boolean")


def sliding_sessions(accesses: DataFrame, key: str, gap_minutes: int = 45, parts: int = PARTS) -> DataFrame:
    """accesses with session_id from 0: a pause of gap_minutes or more starts a new one.

    Ranges of time are looked through apart. Between two ranges of a key the last access of the earlier one is carried over, and so is the number of
    sessions before. Accesses without a time come first and begin nothing.
    """
    gap = gap_minutes * 60_000_000
    rows = ranged(accesses.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))), [key], F.col("_us"), parts)
    order = Window.partitionBy("_at").orderBy("ts", "req_id")
    pause = F.coalesce((F.col("_us") - F.lag("_us").over(order) >= gap).cast("long"), F.lit(0))
    marked = rows.withColumn("_pause", pause)
    spans = marked.groupBy("_at", "_key", "_range").agg(F.min("_us").alias("first"), F.max("_us").alias("last"), F.sum("_pause").alias("inner"))
    border = F.coalesce((F.col("first") - F.max("last").over(earlier()) >= gap).cast("long"), F.lit(0))
    spans = spans.withColumn("border", border)
    spans = spans.select("_at", (F.coalesce(F.sum(F.col("inner") + F.col("border")).over(earlier()), F.lit(0)) + F.col("border")).alias("_before"))
    numbered = marked.withColumn("session_id", F.sum("_pause").over(within("ts", "req_id"))).join(spans, "_at")
    return numbered.withColumn("session_id", F.col("session_id") + F.col("_before")).select(*accesses.columns, "session_id")


#: Requests a minute of each route; fixed values.
RATE_LIMITS = {"extract": 12, "ai": 20, "tts": 180}


def rate_violations(requests: DataFrame, limits: dict[str, int] = RATE_LIMITS) -> DataFrame:
    """app_user_id, route, minute, n: minutes in which a user asked more often than the route allows."""
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("route")]
    counts = requests.groupBy("app_user_id", "route", F.window("ts", "1 minute")["start"].alias("minute")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit)
