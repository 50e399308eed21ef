"""One-dimensional tolerance chains: worst case, statistical and sampled totals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

# The sampled band quoted for a chain (percent), and the pass slack.
BAND_PERCENTILES = (0.00135, 0.99865)
PASS_SLACK = 1e-12
SAMPLES = 20_000
# Members of a chain that one task draws; of a longer chain, sums of such pieces are added up.
PIECE = 4096


def half_band() -> Column:
    return (F.col("tol_plus") + F.col("tol_minus")) / 2


def bias() -> Column:
    return (F.col("tol_plus") - F.col("tol_minus")) / 2


def sigma() -> Column:
    """Standard deviation the band stands for; the declared span applies to normal only."""
    return (F.when(F.col("distribution") == "uniform", half_band() / math.sqrt(3.0))
            .when(F.col("distribution") == "triangular", half_band() / math.sqrt(6.0))
            .otherwise(half_band() / F.col("sigma_span")))


def convention() -> Column:
    span = F.regexp_replace(F.col("sigma_span").cast("string"), r"\.0$", "")
    return F.concat("distribution", F.lit("/"), span, F.lit("sigma"))


def members(chain_member: DataFrame, dimension: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    """Chain members with their dimension, part and team; ``seq`` gives the order."""
    return (chain_member.join(dimension, "dimension_id")
            .join(rev.select("revision_id", "part_id"), "revision_id")
            .join(part.select("part_id", "part_number", "team_id"), "part_id"))


def teams_per_chain(member: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct teams of each chain: (chain_id, team_count, teams)."""
    pairs = member.join(part.select("part_id", "team_id"), "part_id").select("chain_id", "team_id").distinct()
    return pairs.groupBy("chain_id").agg(
        F.count("team_id").alias("team_count"),
        F.array_join(F.array_sort(F.collect_set("team_id")), ", ").alias("teams"))


def totals(chain: DataFrame, member: DataFrame) -> DataFrame:
    """All chains by worst case and root sum of squares, one aggregation pass over the
    members. A chain without members totals to zero and says so in ``warnings``."""
    d = F.col("direction")
    up = F.when(d > 0, F.col("tol_plus")).otherwise(F.col("tol_minus"))
    down = F.when(d > 0, F.col("tol_minus")).otherwise(F.col("tol_plus"))
    # Numbers first, per (chain, convention): plain hash aggregation, reduced on the map
    # side. Only its few rows per chain meet the sets of words.
    units = ["units"] if "units" in member.columns else []
    sums = {"members": F.count(F.lit(1)), "nominal": F.sum(d * F.col("nominal")), "_down": F.sum(down), "_up": F.sum(up),
            "_var": F.sum(sigma() * sigma()), "bias": F.sum(d * bias())}
    part = member.groupBy("chain_id", convention().alias("_c"), *units).agg(
        *[c.alias(k) for k, c in sums.items()], F.max("sigma_span").alias("span"), F.min("sigma_span").alias("_least"))
    agg = part.groupBy("chain_id").agg(
        *[F.sum(k).alias(k) for k in sums], F.max("span").alias("span"), F.min("_least").alias("_least"),
        F.array_sort(F.collect_set("_c")).alias("_conv"), *[F.collect_set(u).alias("_units") for u in units])
    t = chain.join(agg, "chain_id", "left").withColumn("sigma_total", F.sqrt(F.coalesce("_var", F.lit(0.0))))
    n, s, b = F.coalesce("nominal", F.lit(0.0)), F.col("sigma_total"), F.coalesce("bias", F.lit(0.0))
    band = F.coalesce("span", F.lit(0.0)) * s
    mixed_units = (F.when(F.size("_units") > 1, F.concat(F.lit("units differ: "), F.array_join(F.array_sort("_units"), ", ")))
                   if units else F.lit(None).cast("string"))
    warnings = F.filter(F.array(
        F.when(F.col("members").isNull(), "is empty, all totals are zero"), mixed_units,
        F.when(F.col("_least") != F.col("span"), F.concat(
            F.lit("spans differ between members: "), F.array_join("_conv", ", ")))),
        lambda x: x.isNotNull())
    return t.select(
        "chain_id", "name", "method", "target_low", "target_high", F.coalesce("members", F.lit(0)).alias("members"),
        n.alias("nominal"), (n - F.coalesce("_down", F.lit(0.0))).alias("worst_low"),
        (n + F.coalesce("_up", F.lit(0.0))).alias("worst_high"), "sigma_total", band.alias("rss_half_band"),
        (n + b - band).alias("rss_low"), (n + b + band).alias("rss_high"),
        F.array_join(F.coalesce("_conv", F.array().cast("array<string>")), ", ").alias("sigma_conventions"),
        F.array_join(warnings, "; ").alias("warnings"))


def _uniform(digest: Column, start: int) -> Column:
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def draw(u: Column, v: Column) -> Column:
    """One draw per distribution by inverse transform (normal: Box-Muller), centred at nominal + bias."""
    centre, h = F.col("nominal") + bias(), half_band()
    flat = centre - h + 2 * h * u
    peak = F.when(u < 0.5, centre - h + h * F.sqrt(2 * u)).otherwise(centre + h - h * F.sqrt(2 * (1 - u)))
    bell = centre + sigma() * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
    return (F.when(F.col("distribution") == "uniform", flat).when(F.col("distribution") == "triangular", peak)
            .otherwise(bell))


def sampled_totals(member: DataFrame, samples: int = SAMPLES, source: str = "xxhash64", spread: bool = False) -> DataFrame:
    """(chain_id, sample, total). Draws are a hash of (chain, seq, sample), so a retried
    task repeats them.

    Members are placed by chain first and drawn there: the shuffle carries members, not
    members times samples. A caller with chains of very many members passes ``spread``:
    they are then drawn where they lie and added up per (chain, sample) on the map side.

    ``source`` is ``xxhash64`` (fast) or ``md5`` (portable to other engines).
    """
    m = member.select("chain_id", "seq", "nominal", "tol_plus", "tol_minus", "direction", "sigma_span", "distribution")
    if spread:
        return _draw_and_add(m, samples, source)
    # A fixed number of pieces: the placed rows are few, but each becomes many draws.
    pieces = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _draw_and_add(m.repartition(pieces, "chain_id"), samples, source)


def _draw_and_add(member: DataFrame, samples: int, source: str) -> DataFrame:
    rows = member.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    if source == "md5":
        digest = F.md5(F.concat_ws("|", F.col("chain_id").cast("string"), F.col("seq").cast("string"),
                                   F.col("sample").cast("string")))
        rows = rows.withColumn("_d", digest)
        value = draw(_uniform(F.col("_d"), 1), _uniform(F.col("_d"), 9))
    else:
        # Two 31-bit halves of one 64-bit hash.
        rows = rows.withColumn("_h", F.xxhash64("chain_id", "seq", "sample"))
        half = lambda shift: (F.shiftrightunsigned("_h", shift).bitwiseAND(F.lit(0x7FFFFFFF)) + F.lit(0.5)) / F.lit(2147483648.0)
        value = draw(half(0), half(33))
    return rows.groupBy("chain_id", "sample").agg(F.sum(F.col("direction") * value).alias("total"))


def _bits(key: np.uint64, samples: np.ndarray) -> np.ndarray:
    """Sixty-four mixed bits for every sample number of one member (a counter-based generator)."""
    x = samples * np.uint64(0x9E3779B97F4A7C15)
    x += key
    high = x >> np.uint64(30)
    for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        x ^= high
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(shift), out=high)
    x ^= high
    return x


# Cosine and sine of the first twelve bits of a turn; the rest is less than a step and needs few terms.
_STEPS = 4096
_COS, _SIN = np.cos(2 * math.pi / _STEPS * np.arange(_STEPS)), np.sin(2 * math.pi / _STEPS * np.arange(_STEPS))


def _turned(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of whole turns times ``part`` (0 to 1), to the last digits of a double."""
    steps = part * _STEPS
    at = steps.astype(np.int64)
    steps -= at
    steps *= 2 * math.pi / _STEPS
    square = steps * steps
    small_sin = square / 120
    small_sin -= 1 / 6
    small_sin *= square
    small_sin += 1
    small_sin *= steps
    square /= -2
    small_cos = square / 6
    small_cos += 1
    small_cos *= square
    small_cos += 1
    cos, sin = _COS.take(at), _SIN.take(at)
    return cos * small_cos - sin * small_sin, sin * small_cos + cos * small_sin


def _draws(key: int, distribution: str, centre: float, half: float, sigma: float, numbers: np.ndarray) -> np.ndarray:
    """Two draws of one member per number, by the formulas of :func:`draw`: the halves of its bits, or the
    two normal values that Box-Muller makes of them."""
    words = _bits(np.uint64(key & 0xFFFFFFFFFFFFFFFF), numbers).astype("<u8", copy=False).view("<u4")
    n = len(numbers)
    u = np.empty(2 * n)
    u[:n], u[n:] = words[1::2], words[::2]
    u += 0.5
    u *= 1 / 4294967296
    if distribution == "uniform":
        u *= 2 * half
        u += centre - half
    elif distribution == "triangular":
        side = u - 0.5
        np.minimum(u, 1 - u, out=u)
        u *= 2
        np.sqrt(u, out=u)
        np.subtract(1, u, out=u)
        np.copysign(u, side, out=u)
        u *= half
        u += centre
    else:
        far, (cos, sin) = sigma * np.sqrt(-2 * np.log(u[:n])), _turned(u[n:])
        np.multiply(far, cos, out=u[:n])
        np.multiply(far, sin, out=u[n:])
        u += centre
    return u


def _running(batches: Iterator[pd.DataFrame], samples: int) -> Iterator[tuple[object, np.ndarray]]:
    """(group, totals) of rows sorted by ``group``: one vector of totals is held at a time."""
    numbers = np.arange(1, (samples + 1) // 2 + 1, dtype=np.uint64)
    group, total = None, None
    with np.errstate(over="ignore"):
        for b in batches:
            for r in b.itertuples(index=False):
                drawn = _draws(r.key, r.distribution, r.centre, r.half, r.sigma, numbers)[:samples]
                drawn *= r.direction
                if total is None or r.group != group:
                    if total is not None:
                        yield group, total
                    group, total = r.group, drawn
                else:
                    total += drawn
    if total is not None:
        yield group, total


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` least values in order, picked below a bound that a part of them suggests."""
    some = values[::16]
    at = min(len(some) - 1, n // 4 + 8)
    few = values[values <= np.partition(some, at)[at]]
    return np.sort(few if len(few) >= n else values)[:n]


def _ends(total: np.ndarray) -> tuple[float, float]:
    """``np.quantile(total, BAND_PERCENTILES)``, of the few values at either end alone."""
    if not np.isfinite(total).all():
        return tuple(np.quantile(total, BAND_PERCENTILES))
    last, out = len(total) - 1, []
    for share in BAND_PERCENTILES:
        at = share * last
        below = math.floor(at)
        above = min(below + 1, last)
        if share < 0.5:
            a, b = _least(total, above + 1)[[below, above]]
        else:
            b, a = -_least(-total, last - below + 1)[[last - above, last - below]]
        part = at - below
        out.append(a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part))
    return out[0], out[1]


def _band(total: np.ndarray, low: float, high: float) -> tuple:
    """Size, mean, band and failure rate of one chain's totals; a bound that is not set is NaN."""
    bounded = not (math.isnan(low) and math.isnan(high))
    with np.errstate(invalid="ignore"):
        failed = np.count_nonzero((total < low) | (total > high))
        q = _ends(total)
    return len(total), float(total.mean()), float(q[0]), float(q[1]), failed / len(total) if bounded else None


CHAINS_A_BATCH = 1000  # bands that go back to Spark at once


def _in_batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, CHAINS_A_BATCH)):
        yield pd.DataFrame(some, columns=columns)


_BAND = "chain_id string, mc_samples long, mc_mean double, mc_low double, mc_high double, mc_failure_rate double"


def monte_carlo(chain: DataFrame, member: DataFrame, samples: int = SAMPLES, piece: int = PIECE) -> DataFrame:
    """Sampled mean, band and failure rate of every chain that has members (rate null without a target).

    A draw is a hash of (chain, seq, sample), so a retried task and another partitioning repeat it. Members
    travel once, sorted by chain, and a task holds the totals of one chain: neither draws nor samples are
    rows. A chain with members numbered ``piece`` and above is dealt to pieces of that many, whose totals
    are written as one cell each and added up. Members with a null in their numbers make a chain's totals null.
    """
    spark = member.sparkSession
    kind = member.schema["chain_id"].dataType
    m = member.select(
        F.col("chain_id").cast("string").alias("chain"), F.coalesce(F.floor(F.col("seq") / piece), F.lit(0)).cast("long").alias("piece"),
        F.xxhash64("chain_id", "seq").alias("key"), F.coalesce("distribution", F.lit("normal")).alias("distribution"),
        *[F.col("direction").cast("double").alias("direction"), (F.col("nominal") + bias()).cast("double").alias("centre"),
          half_band().cast("double").alias("half"), sigma().cast("double").alias("sigma")])
    long = cut(m.filter("piece > 0").select("chain").distinct())
    limits = chain.select(F.col("chain_id").cast("string").alias("chain"), *[F.col(c).cast("double").alias(c) for c in ("target_low", "target_high")])
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by a hash of the group: by the group itself Spark would keep the pieces of the joins, and it makes
    # few of them, as members are few bytes and their draws much work.
    inputs = ["key", "distribution", "direction", "centre", "half", "sigma"]
    out = [c.split()[0] for c in _BAND.split(", ")]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds: dict[str, tuple[float, float]] = {}

        def noted() -> Iterator[pd.DataFrame]:
            for b in batches:
                bounds.update({r.group: (r.target_low, r.target_high) for r in b.drop_duplicates("group").itertuples(index=False)})
                yield b

        yield from _in_batches(((group, *_band(total, *bounds.pop(group))) for group, total in _running(noted(), samples)), out)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, total in _running(batches, samples):
            yield pd.DataFrame([(group, total.tobytes())], columns=["group", "total"])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, at = None, None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.chain != now:
                    if total is not None:
                        yield pd.DataFrame([(now, *_band(total, *at))], columns=out)
                    now, total, at = r.chain, np.zeros(samples), (r.target_low, r.target_high)
                total += np.frombuffer(r.total)
        if total is not None:
            yield pd.DataFrame([(now, *_band(total, *at))], columns=out)

    short = (m.join(long, "chain", "left_anti").join(limits, "chain").select(F.col("chain").alias("group"), *inputs, "target_low", "target_high")
             .repartition(pieces, F.xxhash64("group")).sortWithinPartitions("group", "key"))
    done = short.mapInPandas(whole, _BAND)
    dealt = (m.join(long, "chain", "left_semi").select(F.concat_ws("/", F.col("piece").cast("string"), "chain").alias("group"), *inputs)
             .repartition(pieces, F.xxhash64("group")).sortWithinPartitions("group", "key"))
    sums = cut(dealt.mapInPandas(parts, "group string, total binary").select(
        F.substring_index("group", "/", 1).cast("long").alias("piece"), F.expr("substring(group, instr(group, '/') + 1)").alias("chain"), "total"))
    done = done.unionByName(sums.join(limits, "chain").repartition(pieces, "chain").sortWithinPartitions("chain", "piece").mapInPandas(added, _BAND))
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return done.select(F.col("chain_id").cast(kind).alias("chain_id"), "mc_samples", *[null(c) for c in ("mc_mean", "mc_low", "mc_high")],
                       F.when(~F.isnan("mc_mean"), F.col("mc_failure_rate")).alias("mc_failure_rate"))


def with_verdict(t: DataFrame, method: str | None = None) -> DataFrame:
    """Add band_low, band_high and passes for the chain's own method (or ``method``)."""
    m = F.lit(method) if method else F.col("method")
    if "mc_low" in t.columns:
        mc = (m == "monte_carlo") & F.col("mc_low").isNotNull()
        low = F.when(m == "worst_case", F.col("worst_low")).when(mc, F.col("mc_low")).otherwise(F.col("rss_low"))
        high = F.when(m == "worst_case", F.col("worst_high")).when(mc, F.col("mc_high")).otherwise(F.col("rss_high"))
    else:
        low = F.when(m == "worst_case", F.col("worst_low")).otherwise(F.col("rss_low"))
        high = F.when(m == "worst_case", F.col("worst_high")).otherwise(F.col("rss_high"))
    ok = (F.coalesce(F.col("band_low") >= F.col("target_low") - PASS_SLACK, F.lit(True))
          & F.coalesce(F.col("band_high") <= F.col("target_high") + PASS_SLACK, F.lit(True)))
    return (t.withColumn("method", m).withColumn("band_low", low).withColumn("band_high", high).withColumn("passes", ok))


def explanation() -> Column:
    """One sentence per chain over the columns of :func:`with_verdict` (and teams, mc_failure_rate if joined)."""
    text = lambda fmt, *c: F.format_string(fmt, *[F.col(x) if isinstance(x, str) else x for x in c])
    lo = F.coalesce(text("%.3f", "target_low"), F.lit("-inf"))
    hi = F.coalesce(text("%.3f", "target_high"), F.lit("+inf"))
    bounded = F.col("target_low").isNotNull() | F.col("target_high").isNotNull()
    short, over = F.col("target_low") - F.col("band_low"), F.col("band_high") - F.col("target_high")
    return F.concat(
        text("chain '%s' (%s): nominal %.3f, band from %.3f to %.3f mm", "name", "method", "nominal", "band_low", "band_high"),
        F.when(bounded, F.concat(F.lit("; wanted "), F.when(F.col("target_low").isNull(), "-inf").otherwise(lo),
                                 F.lit(" to "), F.when(F.col("target_high").isNull(), "+inf").otherwise(hi))).otherwise(""),
        F.when(~F.col("passes") & F.coalesce(short > 0, F.lit(False)), text(" (%.3f mm too low)", short)).otherwise(""),
        F.when(~F.col("passes") & F.coalesce(over > 0, F.lit(False)), text(" (%.3f mm too high)", over)).otherwise(""))


def evaluate(chain: DataFrame, member: DataFrame, part: DataFrame | None = None, samples: int | None = None,
             method: str | None = None) -> DataFrame:
    """Totals, verdict, teams and sentence of every chain: cross-team first, failing first, by name."""
    t = totals(chain, member)
    if samples:
        t = t.join(monte_carlo(chain, member, samples), "chain_id", "left")
    t = with_verdict(t, method)
    sentence = explanation()
    if samples:
        sentence = F.concat(sentence, F.when(F.col("mc_failure_rate").isNotNull(), F.format_string(
            "; Monte Carlo failure rate %.3f%%", F.col("mc_failure_rate") * 100)).otherwise(""))
    if part is not None:
        t = t.join(teams_per_chain(member, part), "chain_id", "left").withColumn(
            "cross_team", F.coalesce(F.col("team_count") > 1, F.lit(False)))
        sentence = F.concat(sentence, F.when(F.col("cross_team"), F.concat(F.lit("; teams involved: "), "teams")).otherwise(""))
        return t.withColumn("explanation", sentence).orderBy(F.desc("cross_team"), "passes", "name")
    return t.withColumn("explanation", sentence).orderBy("passes", "name")


def worst_contributor(member: DataFrame) -> DataFrame:
    """The member with the largest sigma of each chain (the first in sequence on a tie)."""
    best = F.max(F.struct(sigma().alias("sigma"), (-F.col("seq")).alias("_order"), F.col("part_id").alias("part_id")))
    return member.groupBy("chain_id").agg(best.alias("b")).select(
        "chain_id", (-F.col("b._order")).alias("seq"), "b.part_id", "b.sigma")


def chains_touching(member: DataFrame, changed: DataFrame, key: str = "part_id") -> DataFrame:
    """Distinct chains with a member on the given parts (or revisions, with ``key='revision_id'``)."""
    return member.join(changed.select(key).distinct(), key, "left_semi").select("chain_id").distinct()


def rebind_members(chain_member: DataFrame, dimension: DataFrame, replaced: DataFrame) -> DataFrame:
    """Point members at the same-named dimension of the revision that replaces theirs.

    replaced(old_rev, new_rev); a dimension missing on the new revision stays bound to the old one.
    """
    d = dimension.select("dimension_id", "revision_id", "name")
    old = d.join(replaced, d.revision_id == replaced.old_rev).select("dimension_id", "new_rev", "name")
    new = d.select(F.col("revision_id").alias("new_rev"), "name", F.col("dimension_id").alias("new_dimension"))
    return (chain_member.join(old.join(new, ["new_rev", "name"]).select("dimension_id", "new_dimension"), "dimension_id", "left")
            .withColumn("dimension_id", F.coalesce("new_dimension", "dimension_id")).drop("new_dimension"))


def author_chains(specs: DataFrame, members: DataFrame, existing: DataFrame, dimension: DataFrame,
                  rev: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains from specs(name, ...) and members(name, seq, part_number, dimension_name, direction).

    A member binds to the newest revision carrying that dimension. A chain with any
    member missing, or whose name exists, is left out whole. Returns (chains, members).
    """
    dims = (dimension.select("dimension_id", "revision_id", F.col("name").alias("dimension_name"))
            .join(rev.select("revision_id", "part_id", "revision_index"), "revision_id")
            .join(part.select("part_id", "part_number"), "part_id")
            .groupBy("part_number", "dimension_name")
            .agg(F.max(F.struct("revision_index", "dimension_id")).getField("dimension_id").alias("dimension_id")))
    bound = members.join(dims, ["part_number", "dimension_name"], "left")
    whole = bound.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.count("dimension_id").alias("_b")).filter("_n = _b").select("name")
    new = specs.join(existing.select("name"), "name", "left_anti").join(whole, "name", "left_semi")
    return new, bound.join(new.select("name"), "name", "left_semi").select("name", "seq", "dimension_id", "direction")
