"""Lookups by name, current rows, and the listings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import numbered, rank_within
from ..session import cut


def current_revision(rev: DataFrame) -> DataFrame:
    """The newest revision of every part: a partial maximum, then an equi-join."""
    top = rev.groupBy("part_id").agg(F.max("revision_index").alias("revision_index"))
    return rev.join(top, ["part_id", "revision_index"])


def next_revision_index(proposed: DataFrame, rev: DataFrame, order: list[str]) -> DataFrame:
    """Index of each proposed revision: the part's maximum plus its place in the batch."""
    top = rev.groupBy("part_id").agg(F.max("revision_index").alias("_top"))
    return (rank_within(proposed, ["part_id"], order, "_place").join(top, "part_id", "left")
            .withColumn("revision_index", F.coalesce("_top", F.lit(0)) + F.col("_place")).drop("_top", "_place"))


def resolve_revisions(names: DataFrame, rev: DataFrame, part: DataFrame, ref: DataFrame) -> DataFrame:
    """names(name) -> (name, revision_id, how): a revision id, else the newest revision
    of a part number, else a ref. Unresolved names keep a null revision."""
    asked = names.select("name").distinct()
    by_id = rev.select(F.col("revision_id").cast("string").alias("name"), F.col("revision_id").alias("_id"))
    by_part = current_revision(rev.select("revision_id", "part_id", "revision_index")).join(
        part.select("part_id", "part_number"), "part_id").select(
        F.col("part_number").alias("name"), F.col("revision_id").alias("_part"))
    by_ref = ref.select(F.col("ref_name").alias("name"), F.col("revision_id").alias("_ref"))
    found = asked.join(by_id, "name", "left").join(by_part, "name", "left").join(by_ref, "name", "left")
    how = F.when(F.col("_id").isNotNull(), "revision").when(F.col("_part").isNotNull(), "part").when(
        F.col("_ref").isNotNull(), "ref")
    return found.select("name", F.coalesce("_id", "_part", "_ref").alias("revision_id"), how.alias("how"))


def resolve_parts(names: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    """names(name) -> (name, part_id): part id or number, else the part of a revision id."""
    asked = names.select("name").distinct()
    by_key = part.select(F.col("part_id").cast("string").alias("name"), F.col("part_id").alias("_p")).unionByName(
        part.select(F.col("part_number").alias("name"), F.col("part_id").alias("_p"))).distinct()
    by_rev = rev.select(F.col("revision_id").cast("string").alias("name"), F.col("part_id").alias("_r"))
    return asked.join(by_key, "name", "left").join(by_rev, "name", "left").select(
        "name", F.coalesce("_p", "_r").alias("part_id"))


def revision_of_root(hashes: DataFrame, rev: DataFrame) -> DataFrame:
    """hashes(root_hash) -> newest revision whose subtree has that hash (null if none)."""
    newest = rev.filter("merkle_hash IS NOT NULL").groupBy(F.col("merkle_hash").alias("root_hash")).agg(
        F.max(F.struct("revision_index", "revision_id")).getField("revision_id").alias("revision_id"))
    return hashes.select("root_hash").distinct().join(newest, "root_hash", "left")


def _volume() -> Column:
    return F.coalesce("volume_exact", "volume")


def part_mass(rev: DataFrame, part: DataFrame, shape: DataFrame) -> DataFrame:
    """Mass per revision with an unknown density counted as zero."""
    return (rev.join(part.select("part_id", "part_number", "team_id"), "part_id")
            .join(shape.select("fingerprint", "volume", "volume_exact"), "fingerprint", "left")
            .select("revision_id", "part_id", "part_number", "team_id", _volume().alias("volume"), "density",
                    (_volume() * F.coalesce("density", F.lit(0.0))).alias("mass_g")))


def part_listing(rev: DataFrame, part: DataFrame, shape: DataFrame, contract: DataFrame) -> DataFrame:
    """Every part at its current revision with mass, contract hash and provenance."""
    return (current_revision(rev).join(part.select("part_id", "part_number", "team_id"), "part_id")
            .join(shape.select("fingerprint", "volume", "volume_exact"), "fingerprint", "left")
            .join(contract.select("revision_id", "contract_hash", "provenance"), "revision_id", "left")
            .select("part_number", "team_id", "revision_index", "material", "fingerprint",
                    (_volume() * F.col("density")).alias("mass_g"), "contract_hash", "provenance")
            .orderBy("team_id", "part_number"))


def part_summary(revisions: DataFrame, rev: DataFrame, part: DataFrame, shape: DataFrame) -> DataFrame:
    """Identity, shape figures and mass of the given revisions; no mass reads as null, not zero."""
    return (rev.join(revisions.select("revision_id").distinct(), "revision_id", "left_semi")
            .join(part.select("part_id", "part_number", "team_id", "description"), "part_id")
            .join(shape.select("fingerprint", "volume", "volume_exact", "area", "char_length", "chirality",
                               "bbox_dx", "bbox_dy", "bbox_dz"), "fingerprint", "left")
            .withColumn("mass_g", F.nullif(_volume() * F.col("density"), F.lit(0.0))))


def published_contract(revisions: DataFrame, contract: DataFrame, interface: DataFrame, socket: DataFrame) -> DataFrame:
    """The public face of revisions, one row per interface or socket (a revision with
    neither keeps one row). Internal features are not part of it."""
    faces = interface.select("revision_id", F.lit("interface").alias("face"), "name", "kind", "hole_count",
                             "hole_radius", "fastener", "fit_class", F.lit(None).cast("double").alias("mass_budget"),
                             F.lit(None).cast("string").alias("fills")).unionByName(
        socket.select("revision_id", F.lit("socket").alias("face"), "name", "kind", "hole_count", "hole_radius",
                      "fastener", "fit_class", "mass_budget", "fills"))
    head = contract.join(revisions.select("revision_id").distinct(), "revision_id", "left_semi").select(
        "revision_id", "mass_max", "attributes", "contract_hash", "provenance", "reviewed")
    return head.join(faces, "revision_id", "left")


def children(revisions: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    number = rev.select("revision_id", "part_id").join(part.select("part_id", "part_number"), "part_id").select(
        F.col("revision_id").alias("child_rev"), "part_number")
    return (occ.join(revisions.select(F.col("revision_id").alias("parent_rev")).distinct(), "parent_rev", "left_semi")
            .select("parent_rev", "occurrence_id", "child_rev", "instance_name", "quantity")
            .join(number, "child_rev").orderBy("parent_rev", "occurrence_id"))


def revision_history(rev: DataFrame, commit: DataFrame) -> DataFrame:
    """Revisions of every part, newest first, with the author and time of their commit."""
    return (rev.select("part_id", "revision_index", "status", "commit_id")
            .join(commit.select("commit_id", "author", "created_at"), "commit_id", "left")
            .orderBy("part_id", F.desc("revision_index")))


def commits_by_prefix(asked: DataFrame, commit: DataFrame) -> DataFrame:
    """asked(prefix) -> (prefix, commit_id), the first commit whose id starts with it.

    An equi-join: each commit id is cut only to the lengths that were asked for.
    """
    ids = commit.select("commit_id", F.col("commit_id").cast("string").alias("text"))
    cuts = commit.sparkSession.sql("""
        SELECT commit_id, left(text, n) AS prefix
        FROM (SELECT commit_id, text, explode((SELECT collect_set(length(prefix)) FROM {a})) AS n FROM {c})
        WHERE n <= length(text)""", a=asked, c=ids)
    return (asked.select("prefix").distinct().join(cuts, "prefix")
            .groupBy("prefix").agg(F.min("commit_id").alias("commit_id")))


def validation_trace(asked: DataFrame, commit: DataFrame, validation: DataFrame) -> DataFrame:
    """The validation steps of the commits named by id or id prefix, in order."""
    return (commits_by_prefix(asked, commit).join(commit.select("commit_id", "author", "verdict"), "commit_id")
            .join(validation, "commit_id").orderBy("prefix", "validation_id"))


def mentioned_part(texts: DataFrame, part: DataFrame) -> DataFrame:
    """texts(text_id, text) -> the longest part number found anywhere in the text, else
    the first word that looks like one.

    The containment test is an equi-join and never texts times parts: every place of a text
    is looked up by the first characters that all part numbers have, and only where a part
    number starts like that is the text cut into the lengths that such part numbers have.
    Texts are dealt out first, as few files may hold very many.
    """
    spark = texts.sparkSession
    up = texts.select("text_id", F.upper("text").alias("text"))
    number = cut(part.filter("part_number IS NOT NULL").select("part_number", F.length("part_number").alias("size")).distinct())
    reach = number.agg(F.min("size").alias("least"), F.max("size").alias("most"))
    head = spark.sql("SELECT substring(part_number, 1, (SELECT least FROM {r})) AS head, collect_set(size) AS sizes FROM {n} GROUP BY 1", n=number, r=reach)
    place = spark.sql("""
        SELECT text_id, rest, substring(rest, 1, least) AS head
        FROM (SELECT text_id, least, substring(text, pos, most) AS rest
              FROM (SELECT text_id, text, least, most, explode(sequence(1, length(text) - least + 1)) AS pos
                    FROM (SELECT text_id, text, (SELECT least FROM {r}) AS least, (SELECT most FROM {r}) AS most FROM {t})
                    WHERE least <= length(text)))""", t=up.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), r=reach)
    pieces = place.join(head, "head").select("text_id", "rest", F.explode("sizes").alias("size")).filter("size <= length(rest)").select(
        "text_id", F.expr("substring(rest, 1, size)").alias("part_number"))
    best = pieces.join(number.select("part_number"), "part_number").groupBy("text_id").agg(
        F.min(F.struct(-F.length("part_number"), "part_number")).getField("part_number").alias("exact"))
    token = F.nullif(F.regexp_extract("text", r"\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)\b", 1), F.lit(""))
    return up.join(best, "text_id", "left").select("text_id", F.coalesce("exact", token).alias("part_number"))


def acknowledged(notification: DataFrame, events: DataFrame) -> DataFrame:
    """Notifications with append-only acknowledgement events(notification_id, acknowledged_by, at) applied."""
    last = events.groupBy("notification_id").agg(
        F.max(F.struct("at", "acknowledged_by")).alias("_e"))
    return notification.join(last, "notification_id", "left").withColumn(
        "acknowledged", F.when(F.col("_e").isNotNull(), 1).otherwise(F.col("acknowledged"))).select(
        *notification.columns, F.col("_e.acknowledged_by").alias("acknowledged_by"), F.col("_e.at").alias("acknowledged_at"))


def gaps() -> Column:
    """What a revision (its contract left-joined) has not declared, as an array of texts."""
    rules = [
        F.when(F.col("contract_id").isNull(), "lacks a contract")
        .when((F.col("provenance") == "auto_drafted") & (F.col("reviewed") == 0), "its drafted contract awaits review"),
        F.when((F.col("is_assembly") == 0) & F.col("fingerprint").isNotNull() & F.col("density").isNull(),
               "has no density and counts as weightless"),
        F.when(F.col("status") == "draft", "is a draft"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def commit_history(commit: DataFrame, limit: int | None = None, rev: DataFrame | None = None, part: DataFrame | None = None,
                   part_number: str | None = None) -> DataFrame:
    """The newest commits, of all parts or of one; equal times are ordered by commit id."""
    if part_number is not None:
        of_part = part.filter(F.col("part_number") == part_number).join(rev, "part_id").select("commit_id").distinct()
        commit = commit.join(of_part, "commit_id", "left_semi")
    newest = commit.orderBy(F.desc("created_at"), F.desc("commit_id"))
    return newest if limit is None else newest.limit(limit)


def latest_author(rev: DataFrame) -> DataFrame:
    return rev.groupBy("part_id").agg(F.max(F.struct("revision_index", "author")).getField("author").alias("author"))


def classify_changes(rev: DataFrame, contract: DataFrame) -> DataFrame:
    """Every revision against the newest earlier one of its part.

    Indexes mostly count up by one, so the earlier revision is found by an equi-join on
    (part, index - 1); that key spreads a part with very many revisions, where a
    window over the part would sort them in one task. Only revisions behind a gap are
    compared with all earlier indexes of their part.
    """
    full = rev.select("revision_id", "part_id", "revision_index", "fingerprint").join(
        contract.select("revision_id", "contract_hash"), "revision_id", "left")
    old = full.select("part_id", (F.col("revision_index") + 1).alias("revision_index"),
                      F.col("contract_hash").alias("old_hash"), F.col("fingerprint").alias("old_fp"),
                      F.lit(True).alias("had"))
    both = full.join(old, ["part_id", "revision_index"], "left")
    first = full.groupBy("part_id").agg(F.min("revision_index").alias("_first"))
    gap = both.filter("had IS NULL").join(first, "part_id").filter("revision_index > _first").select("part_id", "revision_index")
    before = gap.join(old.select("part_id", (F.col("revision_index") - 1).alias("_index")), "part_id").filter("_index < revision_index").groupBy(
        "part_id", "revision_index").agg(F.max("_index").alias("_index"))
    moved = before.join(old.withColumn("_index", F.col("revision_index") - 1).drop("revision_index"), ["part_id", "_index"]).drop("_index")
    both = full.join(old.unionByName(moved.select(*old.columns)), ["part_id", "revision_index"], "left")
    return both.select("revision_id", "part_id", "revision_index", *classification())


def classification() -> list[Column]:
    """Columns contract_changed, body_changed, classification over contract_hash/old_hash, fingerprint/old_fp, had."""
    contract_changed = ~F.col("contract_hash").eqNullSafe(F.col("old_hash"))
    body_changed = ~F.col("fingerprint").eqNullSafe(F.col("old_fp"))
    kind = (F.when(F.col("had").isNull() | contract_changed, "breaking").when(body_changed, "internal")
            .otherwise("no_op"))
    return [contract_changed.alias("contract_changed"), body_changed.alias("body_changed"), kind.alias("classification")]


def cut_traces(validation: DataFrame) -> DataFrame:
    """Each commit's trace up to and including its first failed step, which is marked."""
    first = validation.groupBy("commit_id").agg(
        F.min(F.when(F.col("passed") == 0, F.col("validation_id"))).alias("first_failure"))
    return (validation.join(first, "commit_id")
            .filter("first_failure IS NULL OR validation_id <= first_failure")
            .withColumn("is_first_failure", F.coalesce(F.col("validation_id") == F.col("first_failure"), F.lit(False))))


def number_colliding_names(definition: DataFrame) -> DataFrame:
    """definition(file_id, definition_key, name, first_seen): part numbers unique in the file.

    The second definition with one name becomes ``name#2``, and so on.
    """
    one = definition.groupBy("file_id", "name", "definition_key").agg(F.min("first_seen").alias("first_seen"))
    return with_part_numbers(one)


def with_part_numbers(definition: DataFrame, split: bool = True) -> DataFrame:
    """Distinct definitions, with any other columns, and their part numbers as in :func:`number_colliding_names`.

    A caller whose files are short passes ``split=False`` for a plain window.
    """
    by = ["file_id", "name"], ["first_seen", "definition_key"]
    ranked = numbered(definition, *by) if split else rank_within(definition, *by, split=False)
    return ranked.withColumn("part_number", F.when(F.col("rn") == 1, F.col("name"))
                             .otherwise(F.concat_ws("#", "name", "rn"))).drop("rn")


def first_seen(instances: DataFrame) -> DataFrame:
    """Distinct revisions of each walk with the least path they appear under."""
    return instances.groupBy("root_rev", "revision_id").agg(F.min("path").alias("first_path"))


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group. Spark limits each task's share of a group before
    the shuffle, so a hot group does not reach one task whole."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")
