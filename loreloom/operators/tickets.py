"""Change tickets and the runs that carry them out: gates, digests, approvals, checkpoints, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simulate import MOST_UTILIZATION

# Which ticket statuses a run's status may go with.
PAIRS = {"WAITING_APPROVAL": ["WAITING_APPROVAL"], "SUCCEEDED": ["SUCCEEDED", "ROLLED_BACK", "FAILED"]}
REJECTED_RUN = "TOOL_APPROVAL_REJECTED"


def gates(tickets: DataFrame, steps: DataFrame, routes: DataFrame, hops: DataFrame) -> DataFrame:
    """(ticket_id, validator, passed): nine gates for each ticket and three for each of its steps.

    tickets: ticket_id, synthetic, environment_synthetic, vpc_id, actual_vpc_id, destination, to_next_hop, statuses,
    starts, ends, window_minutes, expected_version, actual_version, expected_hash, actual_hash. steps: ticket_id,
    route_table_id, destination, from_next_hop. routes: route_table_id, destination, next_hop (null destination: the
    table has no route). hops: hop, status, utilization, prefixes. What is missing fails.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    hop = hops.select(F.col("hop").alias("to_next_hop"), F.col("status").alias("hop_status"), "utilization", "prefixes")
    t = tickets.join(hop, "to_next_hop", "left")
    octets = F.split(F.regexp_extract("destination", r"^(\d+\.\d+\.\d+\.\d+)/\d+$", 1), r"\.")
    length = F.regexp_extract("destination", r"/(\d+)$", 1).try_cast("int")
    number = F.aggregate(F.transform(octets, lambda o: o.try_cast("long")), F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    cidr = (F.size(octets) == 4) & length.between(0, 32) & F.forall(octets, lambda o: o.try_cast("long").between(0, 255)) & (F.pmod(number, F.pow(F.lit(2), 32 - length).cast("long")) == 0)
    checks = {
        "synthetic_boundary": F.col("synthetic") & F.col("environment_synthetic"),
        "vpc_exists": F.col("vpc_id") == F.col("actual_vpc_id"),
        "destination_cidr": cidr,
        "standby_link_health": F.col("hop_status") == "UP",
        "standby_capacity": F.col("utilization") < MOST_UTILIZATION,
        "standby_prefix_advertisement": F.array_contains("prefixes", F.col("destination")),
        "approved_knowledge_only": (F.size("statuses") > 0) & F.forall("statuses", lambda s: s == "APPROVED"),
        "change_window": (F.col("ends") > F.col("starts")) & (F.unix_seconds("ends") - F.unix_seconds("starts") == F.col("window_minutes") * 60),
        "snapshot_consistency": (F.col("expected_version") == F.col("actual_version")) & (F.col("expected_hash") == F.col("actual_hash")),
    }
    whole = t.select("ticket_id", F.explode(F.array(*(F.struct(F.lit(n).alias("validator"), sure(c).alias("passed")) for n, c in checks.items()))).alias("g")).select("ticket_id", "g.*")
    tables = routes.select("route_table_id").distinct().withColumn("there", F.lit(True))
    exact = routes.groupBy("route_table_id", "destination").agg(F.count("*").alias("n"), F.min("next_hop").alias("now"))
    s = steps.join(tables, "route_table_id", "left").join(exact, ["route_table_id", "destination"], "left")
    one = sure(F.col("n") == 1)
    each = {"resource_exists": sure(F.col("there")), "single_exact_route": one, "baseline_next_hop": one & sure(F.col("now") == F.col("from_next_hop"))}
    each_ = F.array(*(F.struct(F.concat(F.lit(f"{n}:"), "route_table_id").alias("validator"), c.alias("passed")) for n, c in each.items()))
    return whole.unionByName(s.select("ticket_id", F.explode(each_).alias("g")).select("ticket_id", "g.*"))


def plan_hash(*contract: str) -> Column:
    """Digest of the named columns, the contract that an approval covers, as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(contract)), {"ignoreNullFields": "false"}), 256)


def executed(plan: DataFrame, state: DataFrame) -> DataFrame:
    """The journal of a plan(env, seq, key, expected, after) on a state(env, key, value), up to the first step that finds
    something else than it expects: env, seq, key, before, after, applied. Steps on one key build on one another."""
    w = Window.partitionBy("env", "key").orderBy("seq")
    got = plan.join(state, ["env", "key"], "left").withColumn("before", F.coalesce(F.lag("after").over(w), F.col("value")))
    wrong = F.min(F.when(~F.col("before").eqNullSafe(F.col("expected")), F.col("seq"))).over(Window.partitionBy("env"))
    return got.select("env", "seq", "key", "before", "after", F.coalesce(F.col("seq") < wrong, F.lit(True)).alias("applied"))


def recovered(tickets: DataFrame, executions: DataFrame) -> DataFrame:
    """(ticket_id, status): tickets that were VERIFYING end as their last execution did; a rollback whose state differs has failed.

    executions: ticket_id, seq, outcome, matches_before. Tickets of other statuses, or without an execution, stay.
    """
    last = executions.groupBy("ticket_id").agg(F.max_by(F.struct("outcome", "matches_before"), "seq").alias("e"))
    bad = (F.col("e.outcome") == "ROLLED_BACK") & ~F.coalesce("e.matches_before", F.lit(False))
    done = F.when((F.col("status") == "VERIFYING") & F.col("e").isNotNull(), F.when(bad, "FAILED").otherwise(F.col("e.outcome"))).otherwise(F.col("status"))
    return tickets.join(last, "ticket_id", "left").select("ticket_id", done.alias("status"))


def consistent(run_status: Column, error_code: Column, ticket_status: Column) -> Column:
    """Whether a run and its ticket, read one after the other, can be a true pair."""
    said = F.coalesce(ticket_status, F.lit(""))
    ok = F.when((run_status == "FAILED") & error_code.eqNullSafe(REJECTED_RUN), said == "REJECTED")
    for status, pairs in PAIRS.items():
        ok = ok.when(run_status == status, said.isin(pairs))
    return ok.otherwise(True)


def approvals(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """(run_id, tool, state) of requests(run_id, tool, digest): PENDING until decisions(run_id, tool, digest, seq, decision)
    holds one on the same digest; the last such decision counts. A decision on another digest approves nothing."""
    last = decisions.groupBy("run_id", "tool", "digest").agg(F.max_by("decision", "seq").alias("decision"))
    return requests.join(last, ["run_id", "tool", "digest"], "left").select("run_id", "tool", F.coalesce("decision", F.lit("PENDING")).alias("state"))


def interrupted(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(run_id, status, resume_at) after a restart: running runs are INTERRUPTED, those asked to cancel CANCELLED; resume_at
    is the step of the last checkpoint(run_id, step) of the interrupted ones."""
    last = checkpoints.groupBy("run_id").agg(F.max("step").alias("step"))
    status = F.when(F.col("status") == "RUNNING", "INTERRUPTED").when(F.col("status") == "CANCEL_REQUESTED", "CANCELLED").otherwise(F.col("status"))
    return runs.join(last, "run_id", "left").select("run_id", status.alias("status"), F.when(F.col("status") == "RUNNING", F.col("step")).alias("resume_at"))


def claimed(queue: DataFrame, workers: int, now: Column) -> DataFrame:
    """(run_id, attempt) that workers take next: queued runs and running ones whose lease is over, oldest first.

    queue: run_id, status, created_at, attempt, lease_until.
    """
    free = queue.filter((F.col("status") == "QUEUED") | ((F.col("status") == "RUNNING") & F.coalesce(F.col("lease_until") <= now, F.lit(True))))
    return free.orderBy("created_at", "run_id").limit(max(1, workers)).select("run_id", (F.col("attempt") + 1).alias("attempt"))


def queue_depth(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("status") == "QUEUED").alias("queued"))


def saved_revisions(drafts: DataFrame, changes: DataFrame) -> DataFrame:
    """drafts(draft_id, revision, status) and a new revision of each changed one: changes(draft_id, blocked)."""
    last = drafts.groupBy("draft_id").agg(F.max("revision").alias("last"))
    new = changes.join(last, "draft_id", "left").select("draft_id", (F.coalesce("last", F.lit(0)) + 1).alias("revision"), F.when(F.col("blocked"), "BLOCKED").otherwise("READY_FOR_REVIEW").alias("status"))
    return drafts.select("draft_id", "revision", "status").unionByName(new)


def invalidated(drafts: DataFrame, cases: DataFrame) -> DataFrame:
    """drafts(draft_id, case_ids, status) with those INVALIDATED that rest on one of cases(case_id)."""
    hit = drafts.select("draft_id", F.explode("case_ids").alias("case_id")).join(cases.select("case_id").distinct(), "case_id", "left_semi").select("draft_id").distinct().withColumn("hit", F.lit(True))
    return drafts.join(hit, "draft_id", "left").withColumn("status", F.when(F.col("hit"), "INVALIDATED").otherwise(F.col("status"))).drop("hit")


def blind_leaks(targets: DataFrame, sources: DataFrame, least: float = 0.9) -> DataFrame:
    """(case_id, leaks) of targets(case_id, profile_case_id, terms): whether the profile's source case is it, or as good as it."""
    s = sources.select(F.col("case_id").alias("profile_case_id"), F.col("terms").alias("theirs"))
    both = F.size(F.array_intersect("terms", "theirs")) / F.greatest(F.size(F.array_union("terms", "theirs")), F.lit(1))
    return targets.join(s, "profile_case_id", "left").select("case_id", ((F.col("case_id") == F.col("profile_case_id")) | F.coalesce(both >= least, F.lit(False))).alias("leaks"))
