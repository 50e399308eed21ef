"""Who is affected by a change, and what a change is coupled to; for many parts at once.

Answers are long tables (one row per reason), never lists collected per part: a part
that a third of the product depends on stays spread over its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from . import graph


def _named(part: DataFrame, prefix: str) -> DataFrame:
    return part.select(F.col("part_id").alias(f"{prefix}part"), F.col("part_number").alias(f"{prefix}number"),
                       F.col("team_id").alias(f"{prefix}team"))


def subscribers(asked: DataFrame, subscription: DataFrame) -> DataFrame:
    """asked(part_id, interface_name) against subscriptions; null on either side matches all."""
    s = subscription.select("part_id", "team_id", F.col("interface_name").alias("subscribed"))
    return asked.join(s, "part_id").filter(
        "interface_name IS NULL OR subscribed IS NULL OR interface_name = subscribed")


def chain_partners(asked: DataFrame, member: DataFrame) -> DataFrame:
    """Chains of the asked parts and every part with a dimension in them: (source_part, chain_id, part_id).

    Pairs are made only for the asked parts, from distinct (chain, part) rows. Members travel to the
    asked parts and to their chains; only what stays is made distinct.
    """
    pairs = member.select("chain_id", "part_id")
    mine = cut(pairs.join(asked.select("part_id").distinct(), "part_id", "left_semi").distinct().withColumnRenamed("part_id", "source_part"))
    near = pairs.join(mine.select("chain_id").distinct(), "chain_id", "left_semi").distinct()
    return mine.join(near, "chain_id")


def filled_sockets(asked: DataFrame, socket: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    """Sockets whose fill path ends in the asked part's number: (source_part, socket_name, revision_id, part_id)."""
    last = F.element_at(F.split("fills", "/"), -1)
    want = asked.select("part_id").distinct().join(part.select("part_id", "part_number"), "part_id").select(
        F.col("part_id").alias("source_part"), F.col("part_number").alias("last"))
    s = socket.filter("fills IS NOT NULL").select(last.alias("last"), F.col("name").alias("socket_name"), "revision_id")
    return s.join(want, "last").join(rev.select("revision_id", "part_id"), "revision_id").select(
        "source_part", "socket_name", "revision_id", "part_id")


def impact_reasons(asked: DataFrame, part: DataFrame, rev: DataFrame, occ: DataFrame, subscription: DataFrame,
                   chain: DataFrame, member: DataFrame, socket: DataFrame, live: DataFrame | None) -> DataFrame:
    """(source_part, interface_name, team_id, route, reason, part_number), the owner's own team left out.

    Four routes: subscription (1), containing assembly (2), shared tolerance chain (3),
    socket that the part fills (4).
    """
    src, other = _named(part, "source_"), _named(part, "other_")
    ask = asked.select("part_id", "interface_name").distinct()
    both = ask.select(F.col("part_id").alias("source_part"), "interface_name")

    r1 = (subscribers(ask, subscription).withColumnRenamed("part_id", "source_part").join(src, "source_part").select(
        "source_part", "interface_name", "team_id", F.lit(1).alias("route"),
        F.format_string("follows %s (%s)", "source_number", F.coalesce("subscribed", F.lit("whole contract"))).alias("reason"),
        F.lit(None).cast("string").alias("part_number"), "source_team"))
    used = graph.where_used(ask, occ, rev, part, live)
    r2 = used.select("source_part", "team_id", "part_number").distinct().join(src, "source_part").select(
        "source_part", "team_id", F.lit(2).alias("route"),
        F.format_string("is responsible for %s, which holds %s", "part_number", "source_number").alias("reason"), "part_number", "source_team")
    shared = chain_partners(ask, member).join(chain.select("chain_id", "name"), "chain_id")
    r3 = shared.withColumnRenamed("part_id", "other_part").join(other, "other_part").join(src, "source_part").select(
        "source_part", F.col("other_team").alias("team_id"), F.lit(3).alias("route"),
        F.format_string("meets it in chain '%s' via %s", "name", "other_number").alias("reason"),
        F.col("other_number").alias("part_number"), "source_team")
    r4 = filled_sockets(ask, socket, rev, part).withColumnRenamed("part_id", "other_part").join(other, "other_part").join(
        src, "source_part").select(
        "source_part", F.col("other_team").alias("team_id"), F.lit(4).alias("route"),
        F.format_string("holds it by socket '%s' of %s", "socket_name", "other_number").alias("reason"),
        F.col("other_number").alias("part_number"), "source_team")
    rest = r2.unionByName(r3).unionByName(r4).join(both, "source_part")
    return (r1.unionByName(rest).filter("team_id IS NOT NULL AND team_id <> source_team")
            .drop("source_team").distinct())


def impact_teams(reasons: DataFrame) -> DataFrame:
    """One row per affected team: first reason (by route, then text), counts of reasons and parts."""
    return reasons.groupBy("source_part", "interface_name", "team_id").agg(
        F.min(F.struct("route", "reason")).getField("reason").alias("first_reason"),
        F.count_distinct("reason").alias("reasons"), F.count_distinct("part_number").alias("parts"))


def budget_children(changed: DataFrame, socket: DataFrame, occ: DataFrame, rev: DataFrame) -> DataFrame:
    """Children of the changed parts whose sockets allocate mass, power or heat: (source_part, part_id, socket_name)."""
    s = socket.filter("mass_budget IS NOT NULL OR power_budget IS NOT NULL OR thermal_budget IS NOT NULL").select(
        F.col("revision_id").alias("parent_rev"), F.col("name").alias("socket_name"))
    up = rev.join(changed.select("part_id").distinct(), "part_id", "left_semi").select(
        F.col("revision_id").alias("parent_rev"), F.col("part_id").alias("source_part"))
    down = rev.select(F.col("revision_id").alias("child_rev"), "part_id")
    # One reason per (parent, child part): the first socket by name, so that sockets do not multiply the children.
    first = s.groupBy("parent_rev").agg(F.min("socket_name").alias("socket_name"))
    return (first.join(up, "parent_rev").join(occ.select("parent_rev", "child_rev").distinct(), "parent_rev")
            .join(down, "child_rev").groupBy("source_part", "part_id").agg(F.min("socket_name").alias("socket_name")))


def dependency_closure(changed: DataFrame, member: DataFrame, chain: DataFrame, socket: DataFrame, occ: DataFrame,
                       rev: DataFrame, subscription: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """changed(commit_id, part_id) widened by chains and budgets: (commit_id, part_id, own, why).

    Subscribers add a reason to a changed part but no part. A caller that needs some rows of the closure only names
    them, asked(commit_id, part_id): chains are then followed from these parts, not from the changed ones to all they meet.
    """
    at = ["commit_id", "part_id"]
    mine = changed.select(*at).distinct()
    by_source = mine.withColumnRenamed("part_id", "source_part")
    # Through chains: commit -> its chains -> their parts, both sides distinct before the join. Members travel to the
    # changed parts and to the chains found there, where they are made distinct.
    pairs = member.select("chain_id", "part_id")
    hit = pairs.join(mine, "part_id").select("commit_id", "chain_id").distinct()
    if asked is None:
        met = hit.join(pairs.join(hit.select("chain_id").distinct(), "chain_id", "left_semi").distinct(), "chain_id")
    else:
        asked = asked.select(*at).distinct()
        met = pairs.join(asked, "part_id").join(hit, ["commit_id", "chain_id"], "left_semi")
    # Of what travels per chain, the words that are always the same are added last; the quote counts in the order of names.
    quoted = F.concat(F.coalesce(F.col("name").cast("string"), F.lit("null")), F.lit("'"))
    chains = met.join(chain.select("chain_id", "name"), "chain_id").groupBy(*at).agg(F.min(quoted).alias("_n")).select(
        *at, F.struct(F.lit(1).alias("o"), F.concat(F.lit("meets it in chain '"), "_n").alias("why")).alias("r"))
    budgets = budget_children(mine, socket, occ, rev).join(by_source, "source_part").groupBy(*at).agg(
        F.min(F.struct(F.lit(2).alias("o"),
                       F.format_string("draws on the budget of socket '%s'", "socket_name").alias("why"))).alias("r"))
    subs = mine.join(subscription.select("part_id", "team_id"), "part_id").groupBy(*at).agg(
        F.min(F.struct(F.lit(3).alias("o"), F.format_string("team %s follows it", "team_id").alias("why"))).alias("r"))
    own = mine.withColumn("own", F.lit(True))
    if asked is not None:
        own, subs, budgets = (x.join(asked, at, "left_semi") for x in (own, subs, budgets))
    wide = chains.unionByName(budgets).groupBy(*at).agg(F.min("r").alias("r"))
    added = wide.join(mine, at, "left_anti").select(*at, F.lit(False).alias("own"), "r.why")
    kept = own.join(subs, at, "left").select(*at, "own", F.col("r.why").alias("why"))
    return kept.unionByName(added)
