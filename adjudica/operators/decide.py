"""Tables of options and evidence: scorers, candidates, the gate, arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as d
from ..kernels.decide import ARBITRATION_STAGE, check_arbitration, check_drives


def score(evidence: DataFrame, keys: list[str], option: str = "option", value: str = "c", scorer: str = "max") -> DataFrame:
    """(keys, option, c): evidence of an option raised to its maximum, or summed up to 1000; partial sums are combined map-side."""
    total = F.max(value) if scorer == "max" else F.least(F.lit(1000).cast("long"), F.sum(value))
    return evidence.groupBy(*keys, option).agg(total.alias("c")).withColumn("c", d.confidence(F.col("c")))


def subtract(scores: DataFrame, penalties: DataFrame, keys: list[str], option: str = "option") -> DataFrame:
    """Scores less the penalties of their options, never below zero."""
    off = penalties.groupBy(*keys, option).agg(F.sum("c").alias("off"))
    return scores.join(off, [*keys, option], "left").withColumn("c", F.greatest(F.lit(0), F.col("c") - F.coalesce("off", F.lit(0))).cast("int")).drop("off")


def dense(scores: DataFrame, keys: list[str], arity: int, option: str = "option", value: str = "c") -> DataFrame:
    """One row per key with an array of one confidence per option, zero where there is none. Options out of range are an error."""
    checked = F.when(F.col(option).between(0, arity - 1), F.col(option)).otherwise(F.raise_error(F.concat(F.lit("option out of range: "), F.col(option).cast("string"))).cast("int"))
    given = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(checked.alias("k"), F.col(value).cast("int").alias("v")))).alias("_given"))
    return given.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda i: F.coalesce(F.col("_given")[i], F.lit(0)))).drop("_given")


def decide(scored: DataFrame, profile: str | Column = "standard", shape: str = "choice", scores: str = "scores") -> DataFrame:
    """Adds *answer* to rows with a score array. No shuffle: the gate is an expression over the row."""
    p = F.lit(profile) if isinstance(profile, str) else profile
    return scored.withColumn("answer", d.answer(d.ranked(F.col(scores)), p, shape))


def flat(answered: DataFrame) -> DataFrame:
    """The fields of *answer* as columns, with the ranking as text."""
    a = F.col("answer")
    rest = [c for c in answered.columns if c not in ("answer", "scores")]
    return answered.select(*rest, a["answer"].alias("answer"), d.chosen(a).alias("chosen"), a["confidence"].alias("confidence"), a["why"]["kind"].alias("why"), a["why"]["value"].alias("why_value"), a["why"]["min"].alias("why_min"), d.ranked_text(a["ranked"]).alias("ranked"))


def candidate_options(candidates: DataFrame, keys: list[str], id: str = "candidate") -> DataFrame:
    """Candidates as options: the i-th id in byte order is option i; an id that repeats within a key, or one of more than 256 bytes, is an error."""
    once = candidates.groupBy(*keys, id).agg(F.count("*").alias("_n"))
    fault = F.when(F.col("_n") > 1, F.concat(F.lit("duplicate candidate "), F.col(id))).when(d.label_fault(F.col(id)).isNotNull(), F.concat(F.lit("bad candidate: "), d.label_fault(F.col(id))))
    checked = once.withColumn("_n", F.when(fault.isNull(), F.lit(0)).otherwise(F.raise_error(fault).cast("int"))).filter("_n = 0")
    return checked.withColumn("option", F.row_number().over(Window.partitionBy(*keys).orderBy(id)) - 1).drop("_n")


def choose(evidence: DataFrame, keys: list[str], profile: str = "standard", id: str = "candidate", value: str = "c") -> DataFrame:
    """The chosen candidate's id per key, or null where the gate abstains. *evidence*: one confidence per candidate of a key.

    Only the two best of a key matter, so rows are ranked by a window whose group limit runs before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(id))
    best = evidence.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    two = best.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(id))).alias(id), F.max(F.when(F.col("_r") == 1, F.col(value))).alias("top"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(value))), F.lit(0)).alias("second"))
    p = F.lit(profile)
    passed = (F.col("top") >= d.least_confidence(p)) & (F.col("top") - F.col("second") >= d.least_margin(p))
    return two.select(*keys, F.when(passed, F.col(id)).alias("chosen"), F.col("top").cast("int").alias("top"), (F.col("top") - F.col("second")).cast("int").alias("margin"))


def arbitrate(scored: DataFrame, levels: list[int], weights: list[list[int]], incumbent: str | None = None, profile: str = "standard", shape: str = "choice", scores: str = "scores", drives: list[str] | None = None) -> DataFrame:
    """Adds urges, dominant (a drive per option, null where none pulls), persisted, bonus, answer and winner_drive.

    Drives and affinities are literals (16 drives at most), so everything is an expression over the row. Specifications that don't fit are
    refused at once; a row whose options are not those of the affinities, or whose incumbent is none of them, is an error when it is read.
    """
    check_drives(drives if drives is not None else [f"drive {i}" for i in range(len(levels))], levels, weights)
    check_arbitration(len(weights[0]) if weights else 0, levels, weights)
    arity = len(weights[0])
    fault = F.when(F.size(scores) != arity, "question mismatch")
    if incumbent:
        fault = fault.when(~F.col(incumbent).between(0, arity - 1), F.concat(F.lit("option out of range: "), F.col(incumbent).cast("string")))
    scored = scored.withColumn(scores, F.when(fault.isNull(), F.col(scores)).otherwise(F.raise_error(fault).cast("array<int>")))
    pulls = F.array(*(F.array(*(F.lit(level * w // 1000) for w in row)) for level, row in zip(levels, weights)))
    best = lambda i: F.array_max(F.transform(pulls, lambda row, k: F.struct(F.get(row, i).alias("pull"), (-k).alias("k"))))
    both = F.transform(F.col(scores), lambda c, i: F.struct(d.confidence(d.quotient(best(i)["pull"] * c, F.lit(1000))).alias("urge"), F.when(best(i)["pull"] > 0, -best(i)["k"]).alias("drive")))
    out = scored.withColumn("_both", both).withColumn("urges", F.col("_both.urge")).withColumn("dominant", F.col("_both.drive"))
    p, held = F.lit(profile), (F.col(incumbent) if incumbent else F.lit(None).cast("int"))
    raw = F.get(F.col("urges"), held)
    out = out.withColumn("persisted", F.when(raw >= d.least_confidence(p), held)).withColumn("bonus", F.when(F.col("persisted").isNotNull(), F.least(F.lit(1000), raw + d.least_margin(p)) - raw))
    final = F.transform(F.col("urges"), lambda u, i: F.when(i == F.col("persisted"), u + F.col("bonus")).otherwise(u))
    out = out.withColumn("_final", final).withColumn("answer", d.answer(d.ranked(F.col("_final")), p, shape))
    return out.withColumn("winner_drive", F.get(F.col("dominant"), d.chosen(F.col("answer")))).drop("_both", "_final")


def arbitration_trail(arbitrated: DataFrame, keys: list[str], labels: list[str], drives: list[str], stage: str = ARBITRATION_STAGE) -> DataFrame:
    """(keys, step, stage, millis, text): one record per option with an urge, by option, and one for a persisted incumbent."""
    label, drive = (F.array(*map(F.lit, x)) for x in (labels, drives))
    urges = F.transform("urges", lambda u, i: F.when((u > 0) & F.get(F.col("dominant"), i).isNotNull(), F.struct(u.alias("millis"), F.format_string("%s urge %d dominant %s", F.get(label, i), u, F.get(drive, F.get(F.col("dominant"), i))).alias("text"))))
    persisted = F.when(F.col("persisted").isNotNull(), F.struct(F.col("bonus").alias("millis"), F.format_string("persist %s +%d", F.get(label, F.col("persisted")), F.col("bonus")).alias("text")))
    records = F.filter(F.concat(urges, F.array(persisted)), lambda r: r.isNotNull())
    each = arbitrated.select(*keys, F.posexplode(records).alias("_i", "r"))
    return each.select(*keys, (F.col("_i") + 1).alias("step"), F.lit(stage).alias("stage"), "r.millis", "r.text")
