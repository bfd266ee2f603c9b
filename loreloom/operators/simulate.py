"""Route tables: longest-prefix match, plan gates, journal replay and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of a healthy path.
THRESHOLDS = {"tcp_success_percent": (">=", 99.5), "packet_loss_percent": ("<=", 1.0), "latency_p95_ms": ("<=", 30.0)}
MOST_UTILIZATION = 60.0


def ipv4(address: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    parts = F.split(address, r"\.")
    numbers = F.transform(parts, lambda p: p.try_cast("long"))
    ok = (F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull() & n.between(0, 255))
    return F.when(ok, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a * 256 + n))


def longest_prefix(addresses: DataFrame, routes: DataFrame) -> DataFrame:
    """addresses(address_id, ip) with prefixlen and next_hop of the longest matching route(network, prefixlen, next_hop).

    An address gives one row for each prefix length that the routes use, 33 at most, so the range join is an equi-join
    on (prefixlen, network). Equal lengths: the larger next hop wins.
    """
    lengths = routes.select("prefixlen").distinct()
    mask = lambda ip, n: F.floor(ip / F.pow(F.lit(2), 32 - n)) * F.pow(F.lit(2), 32 - n)
    tried = addresses.join(F.broadcast(lengths)).withColumn("network", mask(F.col("ip"), F.col("prefixlen")).cast("long"))
    hit = tried.join(routes.select("prefixlen", F.col("network").cast("long").alias("network"), "next_hop"), ["prefixlen", "network"])
    best = hit.groupBy("address_id").agg(F.max(F.struct("prefixlen", "next_hop")).alias("b")).select("address_id", "b.prefixlen", "b.next_hop")
    return addresses.join(best, "address_id", "left")


def plan_gates(steps: DataFrame, routes: DataFrame, hops: DataFrame) -> DataFrame:
    """(step_id, gate, passed) of steps(step_id, route_table_id, destination, from_next_hop, to_next_hop).

    Three gates a step: exactly one route there, it still points where the plan says, and the new hop is healthy, below
    its capacity limit and advertises the destination.
    """
    found = routes.groupBy("route_table_id", "destination").agg(F.count("*").alias("n"), F.min("next_hop").alias("now"))
    hop = hops.select(F.col("hop").alias("to_next_hop"), F.col("status").alias("hop_status"), F.col("utilization").alias("utilization"), F.col("prefixes").alias("prefixes"))
    got = steps.join(found, ["route_table_id", "destination"], "left").join(hop, "to_next_hop", "left")
    healthy = F.col("hop_status").eqNullSafe("ACTIVE") & F.coalesce(F.col("utilization") < MOST_UTILIZATION, F.lit(False)) & F.coalesce(F.array_contains("prefixes", F.col("destination")), F.lit(False))
    gates = F.array(F.struct(F.lit("single_route").alias("gate"), F.col("n").eqNullSafe(1).alias("passed")), F.struct(F.lit("baseline").alias("gate"), F.col("now").eqNullSafe(F.col("from_next_hop")).alias("passed")), F.struct(F.lit("target").alias("gate"), healthy.alias("passed")))
    return got.select("step_id", F.explode(gates).alias("g")).select("step_id", "g.*")


def verified(measures: DataFrame) -> DataFrame:
    """measures with whether every threshold holds; a missing measure fails."""
    ok = F.lit(True)
    for name, (way, limit) in THRESHOLDS.items():
        ok = ok & F.coalesce(F.col(name) >= limit if way == ">=" else F.col(name) <= limit, F.lit(False))
    return measures.withColumn("verified", ok)


def replay(journal: DataFrame, env: str = "env", key: str = "key") -> DataFrame:
    """The state after journal(env, seq, key, before, after): the last value of each key, and the state's version."""
    last = journal.groupBy(env, key).agg(F.max_by("after", "seq").alias("value"))
    version = journal.groupBy(env).agg(F.max("seq").alias("version"))
    return last.join(version, env)


def rollback(journal: DataFrame, env: str = "env", key: str = "key") -> DataFrame:
    """The undo journal: entries in reverse order, before and after swapped; replayed, it restores the first state."""
    total = F.max("seq").over(Window.partitionBy(env))
    return journal.select(env, (total + 1 + total - F.col("seq")).alias("seq"), key, F.col("after").alias("before"), F.col("before").alias("after"))


def state_hash(state: DataFrame, env: str = "env", key: str = "key", value: str = "value") -> DataFrame:
    """(env, state_hash): digest of the sorted key and value pairs."""
    pairs = F.array_sort(F.collect_list(F.concat(F.col(key).cast("string"), F.lit("="), F.coalesce(F.col(value).cast("string"), F.lit("")))))
    return state.groupBy(env).agg(F.sha2(F.array_join(pairs, "\n"), 256).alias("state_hash"))
