"""Validation of change proposals, each alone against one base, all in one pass.

The proposed state is never copied per commit. What a commit changes is carried as
differences: replaced revisions, corrected child sums, changed totals. So the work
grows with the changed paths, not with commits times product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import impact, lookup, sockets, tolerance
from ..session import bucketed, cut, union_all
from . import declared, overlay
from .base import Product

# Fixed order of the stages; the first failure ends a trace.
STAGES = ["concurrency", "declaration", "contract", "classification", "envelope", "socket", "budget", "chain", "notification", "swap"]


def prepare(proposal: DataFrame, product: Product) -> DataFrame:
    """Proposals with the revision they replace and the revision they would make.

    proposal(commit_id, part_id, author, new_fingerprint?, new_contract_hash?, new_density?).
    Missing values carry the previous ones forward. part_id is null-free; parts unknown to
    the product are new.
    """
    cur = lookup.current_revision(product.rev).join(product.contract.select("revision_id", "contract_hash"), "revision_id", "left")
    old = cur.select("part_id", F.col("revision_id").alias("old_rev"), F.col("revision_index").alias("old_index"), F.col("fingerprint").alias("old_fp"),
                     F.col("contract_hash").alias("old_hash"), F.col("material").alias("material"), F.col("density").alias("old_density"),
                     "is_assembly", F.lit(True).alias("had"))
    p = proposal.join(old, "part_id", "left").join(product.part.select("part_id", "part_number", "team_id"), "part_id", "left")
    for c in ("new_fingerprint", "new_contract_hash", "new_density"):
        if c not in proposal.columns:
            p = p.withColumn(c, F.lit(None).cast("double" if c == "new_density" else "string"))
    return p.select("commit_id", "part_id", "part_number", "team_id", "author", "old_rev", "old_fp", "old_hash", "had", "material",
                    F.coalesce("is_assembly", F.lit(0)).alias("is_assembly"),
                    F.concat_ws("/", F.col("commit_id").cast("string"), F.col("part_id").cast("string")).alias("new_rev"),
                    (F.coalesce("old_index", F.lit(0)) + 1).alias("revision_index"),
                    F.coalesce("new_fingerprint", "old_fp").alias("fingerprint"), F.coalesce("new_contract_hash", "old_hash").alias("contract_hash"),
                    F.coalesce("new_density", "old_density").alias("density"))


def rebuild_ancestors(prepared: DataFrame, product: Product) -> tuple[DataFrame, DataFrame]:
    """New revisions and edges above replaced ones: (revisions, occurrences), keyed by commit.

    revisions(commit_id, old_rev, new_rev, part_id, revision_index). Every revision of the
    live configuration that reaches a replaced one is made anew; nothing else changes.
    """
    inside = product.live.select(F.col("revision_id").alias("parent_rev")).distinct()
    edges = bucketed(product.occ.join(inside, "parent_rev", "left_semi").select("parent_rev", "child_rev").distinct(), "child_rev")
    start = cut(prepared.filter("old_rev IS NOT NULL").select("commit_id", F.col("old_rev").alias("revision_id")))
    level = seen = start
    while True:  # a pair is walked from once
        nxt = (level.join(edges, level.revision_id == edges.child_rev).select("commit_id", F.col("parent_rev").alias("revision_id")).distinct())
        level = cut(nxt.join(seen, ["commit_id", "revision_id"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    top = product.rev.groupBy("part_id").agg(F.max("revision_index").alias("top"))
    made = (seen.join(start, ["commit_id", "revision_id"], "left_anti").join(product.rev.select("revision_id", "part_id"), "revision_id").join(top, "part_id")
            .select("commit_id", F.col("revision_id").alias("old_rev"),
                    F.concat_ws("/", F.col("commit_id").cast("string"), F.col("part_id").cast("string")).alias("new_rev"), "part_id",
                    (F.col("top") + 1).alias("revision_index")))
    revisions = cut(prepared.filter("old_rev IS NOT NULL").select("commit_id", "old_rev", "new_rev", "part_id", "revision_index").unionByName(made))
    up = revisions.select("commit_id", F.col("old_rev").alias("parent_rev"), F.col("new_rev").alias("new_parent"))
    down = revisions.select("commit_id", F.col("old_rev").alias("child_rev"), F.col("new_rev").alias("new_child"))
    rest = [c for c in product.occ.columns if c not in ("parent_rev", "child_rev", "occurrence_id", "sort_key")]
    occ = product.occ.join(up, "parent_rev").join(down, ["commit_id", "child_rev"], "left").select(
        "commit_id", F.concat_ws("/", "new_parent", F.col("occurrence_id").cast("string")).alias("occurrence_id"),
        F.col("new_parent").alias("parent_rev"), F.coalesce("new_child", F.col("child_rev").cast("string")).alias("child_rev"), *rest)
    return revisions, occ


def new_roots(prepared: DataFrame, found: DataFrame, product: Product, hashes: DataFrame) -> DataFrame:
    """(commit_id, new_root): the hash the product would have after each commit alone, its present one
    where nothing below the root changes. ``found``: :func:`overlay.totals`."""
    top = product.root.select(F.col("root_rev").cast("string").alias("node"))
    now = hashes.select(F.col("revision_id").cast("string").alias("node"), "node_hash").join(top, "node").select("node_hash").scalar()
    moved = found.join(top, "node").select("commit_id", "new_hash")
    return prepared.select("commit_id").distinct().join(moved, "commit_id", "left").select("commit_id", F.coalesce("new_hash", now).alias("new_root"))


def budget_steps(found: DataFrame, product: Product, target: DataFrame) -> DataFrame:
    """Mass limits, centre-of-gravity windows and socket allocations that a commit moves:
    (commit_id, constraint_name, passed, detail, part_number, team_id). ``found``: :func:`overlay.totals`.
    """
    cg = [F.when(F.col("mass") > 0, F.col(f"s{a}") / F.col("mass")).alias(f"cg_{a}") for a in "xyz"]
    now = found.select("commit_id", F.col("node").alias("_node"), F.col("mass").alias("mass_g"), F.col("power").alias("power_w"), F.col("thermal").alias("thermal_w"), *cg)
    owner = product.rev.select("revision_id", "part_id").join(product.part.select("part_id", "part_number", "team_id"), "part_id")
    limits = product.contract.select("revision_id", "mass_max", F.from_json("cg_window", "min array<double>, max array<double>").alias("_w")).filter("mass_max IS NOT NULL OR _w IS NOT NULL")
    c = now.join(limits, F.col("_node") == F.col("revision_id").cast("string")).join(owner, "revision_id")
    mass = c.filter("mass_max IS NOT NULL").select(
        "commit_id", F.lit("mass_max").alias("constraint_name"), (F.col("mass_g") <= F.col("mass_max") + sockets.BUDGET_SLACK).alias("passed"),
        F.format_string("%s weighs %.1f g, its limit is %.1f g", "part_number", "mass_g", "mass_max").alias("detail"), "part_number", "team_id")
    inside = F.lit(True)
    for k, a in enumerate("xyz"):
        inside = inside & F.col(f"cg_{a}").between(F.col("_w.min")[k] - sockets.BUDGET_SLACK, F.col("_w.max")[k] + sockets.BUDGET_SLACK)
    window = c.filter("cg_x IS NOT NULL AND size(_w.min) = 3 AND size(_w.max) = 3").select(
        "commit_id", F.lit("cg_window").alias("constraint_name"), inside.alias("passed"),
        F.format_string("%s would balance at (%.1f, %.1f, %.1f) mm, which its window must hold", "part_number", "cg_x", "cg_y", "cg_z").alias("detail"), "part_number", "team_id")
    s = product.socket.join(target.select("socket_id", "target_rev"), "socket_id").join(owner, "revision_id")
    s = now.join(s, F.col("_node") == F.col("target_rev").cast("string"))
    frames = [mass, window]
    for key, actual, unit in (("mass_budget", "mass_g", "g"), ("power_budget", "power_w", "W"), ("thermal_budget", "thermal_w", "W")):
        frames.append(s.filter(F.col(key).isNotNull()).select(
            "commit_id", F.format_string(f"socket.%s.{key}", "name").alias("constraint_name"), (F.col(actual) <= F.col(key) + sockets.BUDGET_SLACK).alias("passed"),
            F.format_string(f"takes %.1f {unit} of the %.1f {unit} that %s grants at socket '%s'", actual, key, "part_number", "name").alias("detail"), "part_number", "team_id"))
    return union_all(frames)


def socket_steps(prepared: DataFrame, product: Product, target: DataFrame, interfaces: DataFrame | None = None, derived: DataFrame | None = None) -> DataFrame:
    """Sockets that a changed part fills or that are read off one, checked with what the commit proposes.

    interfaces(commit_id, part_id, and the columns of the interface table but its revision):
    what a changed body offers, as derived from it (:func:`declared.proposed_interfaces`). They replace all
    interfaces of the part; a part without any there keeps its current ones. derived: :func:`declared.proposed_sockets`.
    """
    swap = prepared.filter("old_rev IS NOT NULL").select("commit_id", F.col("old_rev").alias("target_rev"), F.col("new_rev"), "part_id", "fingerprint")
    changed = target.join(swap, "target_rev").select("commit_id", *target.columns, "new_rev")
    if derived is not None:  # whoever fills such a socket, changed or not
        seen = derived.select("commit_id", "socket_id").distinct().join(target, "socket_id").join(
            changed.select("commit_id", "socket_id"), ["commit_id", "socket_id"], "left_anti")
        changed = changed.unionByName(seen.select("commit_id", *target.columns, F.col("target_rev").cast("string").alias("new_rev")))
    t = cut(changed)
    key = F.concat_ws("/", F.col("commit_id").cast("string"), "socket_id")
    inside = product.live.select("revision_id").distinct()
    s = product.socket.join(inside, "revision_id", "left_semi").join(t.select("socket_id", "commit_id"), "socket_id")
    if derived is not None:
        s = declared.with_patterns(s, derived, ["commit_id", "socket_id"])
    s = s.withColumn("socket_id", key).drop("commit_id")
    at = t.withColumn("socket_id", key).select("socket_id", F.col("new_rev").alias("target_rev"), *[c for c in target.columns if c not in ("socket_id", "target_rev")])
    iface = t.select("target_rev", "new_rev").distinct().join(product.interface, F.col("target_rev") == F.col("revision_id")).withColumn(
        "revision_id", F.col("new_rev")).drop("target_rev", "new_rev")
    if interfaces is not None:
        new = interfaces.join(swap.select("commit_id", "part_id", "new_rev"), ["commit_id", "part_id"]).withColumn("revision_id", F.col("new_rev"))
        kept = iface.join(new.select("revision_id").distinct(), "revision_id", "left_anti")
        iface = kept.unionByName(new.select(*kept.columns))
    revs = product.rev.select(F.col("revision_id").cast("string").alias("revision_id"), "part_id", "fingerprint").unionByName(
        swap.select(F.col("new_rev").alias("revision_id"), "part_id", "fingerprint").distinct())
    s = s.withColumn("revision_id", F.col("revision_id").cast("string"))
    done = sockets.check_filled(s, at, iface, revs, product.part, product.shape)
    commit = t.select(key.alias("socket_id"), "commit_id").distinct()
    return done.join(commit, "socket_id").select("commit_id", F.concat(F.lit("socket."), "name").alias("constraint_name"), "passed", "detail",
                                                 F.col("other_part").alias("part_number"), F.col("other_team").alias("team_id"))


def chain_steps(prepared: DataFrame, product: Product, dimensions: DataFrame | None = None) -> DataFrame:
    """Chains a changed part takes part in, totalled for every commit on the dimensions it proposes.

    dimensions(commit_id, chain_id, seq, nominal, tol_plus, tol_minus): members that a commit
    changes; all others keep their current values. A chain that crosses teams names all of them.
    """
    pairs = product.member.select("chain_id", "part_id").distinct().join(prepared.select("commit_id", "part_id").distinct(), "part_id")
    hit = pairs.select("commit_id", "chain_id")
    if dimensions is not None:
        hit = hit.unionByName(dimensions.select("commit_id", "chain_id"))
    # every commit sees a copy of its chains
    key = F.concat_ws("/", F.col("commit_id").cast("string"), F.col("chain_id").cast("string"))
    hit = cut(hit.distinct().withColumn("_key", key))
    member = product.member.join(hit, "chain_id")
    if dimensions is not None:
        values = ["nominal", "tol_plus", "tol_minus"]
        new = dimensions.select("commit_id", "chain_id", "seq", *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new"))
        member = member.join(new, ["commit_id", "chain_id", "seq"], "left")
        for c in values:
            member = member.withColumn(c, F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)))
    member = cut(member.withColumn("chain_id", F.col("_key")).select(*product.member.columns))
    chain = product.chain.join(hit, "chain_id").withColumn("chain_id", F.col("_key")).select(*product.chain.columns)
    t = tolerance.with_verdict(tolerance.totals(chain, member))
    owner = product.part.select("part_id", "part_number", "team_id")
    worst = tolerance.worst_contributor(member).join(owner, "part_id").select("chain_id", "part_number")
    teams = member.select("chain_id", "part_id").join(owner, "part_id").groupBy("chain_id").agg(
        F.array_join(F.array_sort(F.collect_set("team_id")), ", ").alias("team_id"))  # as many as there are teams
    return hit.select("commit_id", F.col("_key").alias("chain_id")).join(t, "chain_id").join(worst, "chain_id", "left").join(teams, "chain_id", "left").select(
        "commit_id", F.concat(F.lit("chain."), "name").alias("constraint_name"), "passes", tolerance.explanation().alias("detail"), "part_number", "team_id").withColumnRenamed("passes", "passed")


def validate(proposal: DataFrame, product: Product, hashes: DataFrame, rollups: DataFrame,
             target: DataFrame, children: DataFrame | None = None, concurrency: DataFrame | None = None, problems: DataFrame | None = None,
             inherited: DataFrame | None = None, interfaces: DataFrame | None = None, dimensions: DataFrame | None = None,
             bore: DataFrame | None = None, plane: DataFrame | None = None, selectors: DataFrame | None = None, declarations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run all stages: tables ``steps``, ``verdicts``, ``classifications``, ``notifications``.

    children: new child lists, as :func:`overlay.proposed_edges` takes them; without any, structure stays. A commit whose
    lists name unknown parts or close a cycle is rejected at its declaration.
    concurrency: result of the conflict analysis. problems(commit_id, problem): declarations
    that do not match their geometry. inherited(stage, failures): failures the base itself
    has, which fail every commit. interfaces and dimensions: what the commits propose, as
    :func:`socket_steps` and :func:`chain_steps` take them.
    bore and plane, extracted from all bodies: with the ``selectors`` of stored interfaces and the ``declarations`` that commits
    bring (:func:`declared.proposed_interfaces`), they give the interfaces of changed bodies; a declaration that its
    body doesn't meet fails the contract stage. Sockets of parents that are read off a changed part follow it, and
    so do the contract hashes, up to the root. Nothing is written: a dry run is this result, landing is
    appending its tables.
    """
    p = prepare(proposal, product)
    if children is None:
        shape = T.StructType([p.schema["commit_id"], p.schema["part_id"], T.StructField("child_part_id", p.schema["part_id"].dataType),
                              T.StructField("instance_name", T.StringType()), *[product.occ.schema[c] for c in overlay.EDGE]])
        children = proposal.sparkSession.createDataFrame([], shape)
    filled = children.filter("child_part_id IS NOT NULL").select("commit_id", "part_id").distinct().withColumn("_holds", F.lit(1))
    p = p.join(filled, ["commit_id", "part_id"], "left").withColumn("is_assembly", F.coalesce("_holds", "is_assembly")).drop("_holds")
    located = None
    if selectors is not None or declarations is not None:
        if bore is None or plane is None:
            raise ValueError("declarations need the bores and planes of the bodies")
        if selectors is None:
            selectors = declarations.withColumn("revision_id", F.lit(None).cast(product.rev.schema["revision_id"].dataType)).limit(0)
        interfaces, located = declared.proposed_interfaces(p, product, bore, plane, selectors, declarations)
    derived = unread = faces = None
    if interfaces is not None:
        derived, unread = declared.proposed_sockets(p, product, interfaces)
        faces = declared.proposed_hashes(p, product, interfaces, derived)
        own = F.concat_ws("/", F.col("commit_id").cast("string"), F.col("old_rev").cast("string"))
        new = faces.select(F.concat_ws("/", F.col("commit_id").cast("string"), "node").alias("_face"), F.col("contract_hash").alias("_hash"))
        p = p.join(new, own == F.col("_face"), "left").withColumn("contract_hash", F.when(
            F.col("contract_hash").eqNullSafe(F.col("old_hash")), F.coalesce("_hash", "contract_hash")).otherwise(F.col("contract_hash"))).drop("_face", "_hash")
    p = cut(overlay.with_own_state(p, product))
    edges, unknown = overlay.proposed_edges(p, children, product)
    edges = cut(edges)
    loops = overlay.cycles(edges, overlay.base_edges(product))
    amiss = cut(unknown.unionByName(loops.select("commit_id", F.format_string("%s can't hold %s, which holds it", "parent", "child").alias("problem"))))
    sound = cut(p.join(amiss, "commit_id", "left_anti"))
    found = cut(overlay.totals(sound, edges.join(amiss, "commit_id", "left_anti"), product, hashes, rollups, faces))
    no_text = F.lit(None).cast("string")

    def step(df: DataFrame, stage: str, passed: Column, detail: Column, name: Column = no_text, part: Column = no_text, team: Column = no_text) -> DataFrame:
        return df.select("commit_id", F.lit(STAGES.index(stage)).alias("stage_no"), F.lit(stage).alias("stage"), passed.alias("passed"), name.alias("constraint_name"),
                         detail.alias("detail"), part.alias("other_part"), team.alias("other_team"))

    steps = []
    if concurrency is not None:
        steps.append(step(concurrency, "concurrency", F.col("can_rebase"), F.col("detail"), F.lit("compare-and-swap"), F.col("other_part"), F.col("other_team")))
    bare = F.col("contract_hash").isNull()
    steps.append(step(p, "declaration", ~bare & F.col("part_number").isNotNull(), F.when(
        F.col("part_number").isNull(), "new part without a team").when(bare, F.format_string(
            "%s has a body but no contract", "part_number")).otherwise("carries a contract declaration"),
        F.when(F.col("part_number").isNull(), "ownership required").when(bare, "declaration required")))
    steps.append(step(amiss, "declaration", F.lit(False), F.col("problem"), F.lit("structure")))
    for amiss_ in (problems, located, unread):
        if amiss_ is not None:
            steps.append(step(amiss_, "contract", F.lit(False), F.col("problem"), F.lit("faces contradict the declaration")))
    classes = cut(p.select("commit_id", "part_id", "part_number", "had", *lookup.classification()))
    steps.append(step(classes, "classification", F.lit(True), F.concat_ws("=", "part_number", "classification")))
    e = p.join(product.contract.select(F.col("revision_id").alias("old_rev"), *[f"envelope_d{a}" for a in "xyz"]), "old_rev").join(
        product.shape.select("fingerprint", *[f"bbox_d{a}" for a in "xyz"]), "fingerprint").filter("envelope_dx IS NOT NULL")
    for a in "xyz":
        steps.append(step(e, "envelope", F.col(f"bbox_d{a}") <= F.col(f"envelope_d{a}") + sockets.EXTENT_SLACK, F.format_string(
            f"%s {a}-size %.2f mm against its declared envelope %.2f mm", "part_number", f"bbox_d{a}", f"envelope_d{a}"), F.lit(f"envelope.{a}")))
    for stage, df in (("socket", socket_steps(p, product, target, interfaces, derived)), ("budget", budget_steps(found, product, target)), ("chain", chain_steps(p, product, dimensions))):
        steps.append(step(df, stage, F.col("passed"), F.col("detail"), F.col("constraint_name"), F.col("part_number"), F.col("team_id")))
    if inherited is not None:
        known = p.select("commit_id").distinct()
        for stage in ("socket", "budget"):
            count = F.coalesce(inherited.filter(F.col("stage") == stage).agg(F.sum("failures")).scalar(), F.lit(0))
            steps.append(step(known.withColumn("_n", count).filter("_n > 0"), stage, F.lit(False),
                              F.format_string("%d constraint(s) of the configuration already fail", "_n"), F.lit(f"{stage}.inherited")))
    breaking = classes.filter("classification = 'breaking' AND had").select("commit_id", "part_id")
    reasons = impact.impact_reasons(breaking.select("part_id", F.lit(None).cast("string").alias("interface_name")).distinct(), product.part, product.rev,
                                    product.occ, product.subscription, product.chain, product.member, product.socket, product.live)
    teams = impact.impact_teams(reasons)
    notes = cut(breaking.join(teams.withColumnRenamed("source_part", "part_id"), "part_id").select("commit_id", "team_id", "part_id", F.col("first_reason").alias("reason")))
    told = notes.groupBy("commit_id").agg(F.count_distinct("team_id").alias("n"))
    steps.append(step(told, "notification", F.lit(True), F.format_string("%d dependent team(s) named", "n")))
    roots = cut(new_roots(sound, found, product, hashes))
    steps.append(step(roots, "swap", F.lit(True), F.concat(F.lit("the ref would point at "), "new_root")))
    every = cut(union_all(steps))
    first = every.filter("NOT passed").groupBy("commit_id").agg(F.min(F.struct("stage_no", F.coalesce("constraint_name", F.lit("")).alias("n"), "detail", "stage")).alias("f"))
    cut_here = first.select("commit_id", F.col("f.stage_no").alias("stop"), F.col("f.n").alias("stop_name"), F.col("f.detail").alias("stop_detail"))
    name = F.coalesce("constraint_name", F.lit(""))
    kept = every.join(cut_here, "commit_id", "left").filter(
        F.col("stop").isNull() | (F.col("stage_no") < F.col("stop"))
        | ((F.col("stage_no") == F.col("stop")) & (F.col("passed") | ((name == F.col("stop_name")) & (F.col("detail") == F.col("stop_detail")))))).drop("stop", "stop_name", "stop_detail")
    verdict = p.select("commit_id", "author").distinct().join(first, "commit_id", "left").join(roots, "commit_id", "left").select(
        "commit_id", "author", F.when(F.col("f").isNull(), "landed").otherwise("rejected").alias("verdict"), F.col("f.stage").alias("failed_stage"),
        F.col("f.detail").alias("reason"), F.when(F.col("f").isNull(), F.col("new_root")).alias("new_root"))
    landed = verdict.filter("verdict = 'landed'").select("commit_id")
    return {"steps": kept, "verdicts": verdict, "classifications": classes.drop("had"), "notifications": notes.join(landed, "commit_id", "left_semi"), "new_roots": roots}


def counts(result: dict[str, DataFrame]) -> DataFrame:
    """Per commit: changes by class, teams notified, steps run."""
    c = result["classifications"].groupBy("commit_id").agg(*[F.count_if(F.col("classification") == k).alias(k) for k in ("breaking", "internal", "no_op")])
    n = result["notifications"].groupBy("commit_id").agg(F.count(F.lit(1)).alias("notified"))
    s = result["steps"].groupBy("commit_id").agg(F.count(F.lit(1)).alias("steps"))
    return result["verdicts"].select("commit_id", "verdict").join(c, "commit_id", "left").join(n, "commit_id", "left").join(s, "commit_id", "left").fillna(0)


def outbox_rows(result: dict[str, DataFrame]) -> DataFrame:
    """Events for the document store: (topic, doc_key, payload) per commit, landed or rejected.

    One trace document per step and per commit head, so no commit's steps are gathered.
    """
    head = result["verdicts"].select(F.lit("validation_trace").alias("topic"), F.col("commit_id").cast("string").alias("doc_key"),
                                     F.to_json(F.struct("commit_id", "author", "verdict", "failed_stage", "reason", "new_root")).alias("payload"))
    steps = result["steps"].select(F.lit("validation_step").alias("topic"), F.concat_ws(":", F.col("commit_id").cast("string"), "stage", F.coalesce("constraint_name", F.lit("")), F.md5("detail")).alias("doc_key"),
                                   F.to_json(F.struct("commit_id", "stage", "passed", "constraint_name", "detail", "other_part", "other_team")).alias("payload"))
    notes = result["notifications"].select(F.lit("notification_detail").alias("topic"), F.concat_ws(":", F.col("commit_id").cast("string"), "team_id", F.col("part_id").cast("string")).alias("doc_key"),
                                           F.to_json(F.struct("commit_id", "team_id", "part_id", "reason")).alias("payload"))
    return head.unionByName(steps).unionByName(notes)
