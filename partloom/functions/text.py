"""Name rules and the sentences that reports print."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Parts whose whole purpose is to sit in another part's hole.
FASTENER_HINTS = ("BOLT", "SCREW", "WASHER", "NUT", "PIN", "DOWEL", "RIVET", "STUD")


def is_fastener(part_number: Column | str) -> Column:
    c = F.col(part_number) if isinstance(part_number, str) else part_number
    return F.upper(c).rlike("|".join(FASTENER_HINTS))


def first_rule(name: Column, rules: list[tuple[str, object]], default: object = None) -> Column:
    """Value of the first rule whose pattern is found in the name; '' and 0 become null."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(name.rlike(pattern), F.lit(value or None)).otherwise(out)
    return out


def safe_file_name(part_number: Column) -> Column:
    return F.regexp_replace(part_number, r"[^\p{L}\p{N}\-_.]", "_")


def clash_text(kind: Column, path_a: Column, path_b: Column, part_a: Column, part_b: Column,
               team_a: Column, team_b: Column, volume: Column, depth: Column) -> Column:
    return (F.when(kind == "clash", F.format_string(
                "%s and %s share %.1f mm^3 (%s, team %s / %s, team %s)",
                path_a, path_b, volume, part_a, team_a, part_b, team_b))
            .when(depth < 0, F.format_string(
                "%s and %s lie closer than allowed (%.2f mm apart)", path_a, path_b, -depth))
            .otherwise(F.format_string(
                "%s and %s: their boxes reach %.2f mm into each other, the bodies are untested",
                path_a, path_b, depth)))


def step_text(stage: Column, constraint: Column, detail: Column, other_part: Column, other_team: Column) -> Column:
    """'[stage] constraint: detail (other party: part and team)', absent pieces left out."""
    head = F.concat(F.lit("["), stage, F.lit("] "),
                    F.when(constraint.isNotNull() & (constraint != ""), F.concat(constraint, F.lit(": "))).otherwise(""),
                    detail)
    who = F.concat_ws(" and ", F.nullif(other_part, F.lit("")), F.nullif(other_team, F.lit("")))
    return F.when(who != "", F.concat(head, F.lit(" (other party: "), who, F.lit(")"))).otherwise(head)


def ingest_text(file: Column, c: dict[str, Column]) -> Column:
    return F.format_string(
        "%s: solids %d, of them new shapes %d, exact hits %d, near hits %d; parts made %d, "
        "known %d; revisions made %d, reused %d; occurrences %d",
        file, c["solids"], c["shapes_new"], c["exact_hits"], c["bounded_hits"], c["parts_created"],
        c["parts_known"], c["revisions_created"], c["revisions_reused"], c["occurrences"])
