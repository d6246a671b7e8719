"""Choosing among enhancement candidates of a page.

A page has a bounded number of candidates: the passes (at most ``max_passes``), one
clean polish, two polish clips and the escalation recipes. Passes beyond the limit
are never run, so limiting them is part of the rule, and every window below works on
that bounded set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TARGET_QS = 100.0
MAX_PASSES = 16
MIN_GAIN = 0.12
STALL_WINDOW = 2
PHASES = ["clean", "pass", "polish", "escalation"]


def limited_passes(max_passes: int) -> int:
    """The configured number of passes, kept within 4 and 32."""
    return max(4, min(32, max_passes))


def running_best(passes: DataFrame, start_qs: str | None = None, max_passes: int = MAX_PASSES) -> DataFrame:
    """Adds ``best_qs`` after each pass, ``prev_best`` and ``gain``; ties keep the earlier pass."""
    over = Window.partitionBy("page_key").orderBy("pass")
    start = F.col(start_qs) if start_qs else F.lit(0.0)
    limited = passes.where(F.col("pass") <= limited_passes(max_passes))
    best = F.greatest(start, F.max("qs").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.greatest(start, F.coalesce(F.max("qs").over(over.rowsBetween(Window.unboundedPreceding, -1)), start))
    return limited.withColumn("best_qs", best).withColumn("prev_best", before).withColumn(
        "gain", F.col("best_qs") - F.col("prev_best")
    )


def best_pass(passes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Earliest pass that reaches the page's best score. Combined before the shuffle."""
    limited = passes.where(F.col("pass") <= limited_passes(max_passes))
    top = F.max(F.struct(F.col("qs"), (-F.col("pass")).alias("neg")))
    return limited.groupBy("page_key").agg(top.alias("__t")).select(
        "page_key", (-F.col("__t.neg")).alias("pass"), F.col("__t.qs").alias("best_qs")
    )


def executed_passes(
    passes: DataFrame,
    target_qs: float = TARGET_QS,
    start_qs: str | None = None,
    max_passes: int = MAX_PASSES,
    min_gain: float = MIN_GAIN,
    stall_window: int = STALL_WINDOW,
) -> DataFrame:
    """Passes that run before the loop stops, with ``stall_count``.

    The loop stops at the target, after ``stall_window`` small gains in a row, or at
    the last pass. The stopping pass itself is kept.
    """
    over = Window.partitionBy("page_key").orderBy("pass")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    ranked = running_best(passes, start_qs, max_passes)
    small = F.col("gain") < min_gain
    islands = ranked.withColumn("__island", F.sum(F.when(small, 0).otherwise(1)).over(upto))
    within = Window.partitionBy("page_key", "__island").orderBy("pass").rowsBetween(Window.unboundedPreceding, 0)
    stalled = islands.withColumn("stall_count", F.sum(F.when(small, 1).otherwise(0)).over(within).cast("int"))
    stop = (F.col("stall_count") >= max(2, stall_window)) | (F.col("best_qs") >= target_qs)
    stops_before = F.coalesce(
        F.sum(F.when(stop, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    started_below = (F.col(start_qs) if start_qs else F.lit(0.0)) < target_qs
    return (
        stalled.withColumn("__before", stops_before)
        .where((F.col("__before") == 0) & started_below)
        .withColumn("met_target", F.col("best_qs") >= target_qs)
        .drop("__island", "__before")
    )


def candidate_union(*phases: DataFrame) -> DataFrame:
    """Candidates of several phases as one table: ``(page_key, phase, pos, label, qs)``."""
    out = phases[0]
    for more in phases[1:]:
        out = out.unionByName(more)
    return out


def _step(state: Column, c: Column, target_qs: float, min_gain: float, stall_window: int) -> Column:
    """The state of a page after one more candidate: best score, score before polishing, stall count, winner."""
    best, phase, qs = state["best"], c["phase"], c["qs"]
    below = best < target_qs
    running = (phase == "pass") & below & (state["stall"] < stall_window)
    takes = (
        F.when(phase == "clean", qs >= best)
        .when(phase == "pass", running & (qs > best))
        .when(phase == "polish", (state["polish_from"] < target_qs) & (qs > best))
        .otherwise(below & (qs > best))
    )
    small = F.greatest(best, qs) - best < min_gain
    after = F.when(takes, qs).otherwise(best)
    return F.struct(
        after.alias("best"),
        # Both polish clips are tried when the passes end below the target.
        F.when(phase == "polish", state["polish_from"]).otherwise(after).alias("polish_from"),
        F.when(running, F.when(small, state["stall"] + 1).otherwise(0)).otherwise(state["stall"]).alias("stall"),
        F.when(takes, c).otherwise(state["won"]).alias("won"),
    )


def select_candidate(
    candidates: DataFrame,
    pages: DataFrame,
    target_qs: float = TARGET_QS,
    max_passes: int = MAX_PASSES,
    min_gain: float = MIN_GAIN,
    stall_window: int = STALL_WINDOW,
) -> DataFrame:
    """The winning candidate of a page with its verdict.

    ``pages`` gives ``page_key, original_qs, start_qs, washed, final_qs`` (the score of
    the file as written; null takes the winner's). A clean polish wins when at least as
    good, any other candidate only when strictly better. Later phases are considered
    only while the best is below the target, passes only until ``stall_window`` small gains
    in a row, and a result below the original is rolled back. Where a page has a clean
    polish, no other candidate competes. A null score never wins; phases of other names are left out.

    The candidates of a page, few by rule, are gathered in order and walked once.
    """
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(PHASES) for x in (p, i)])
    known = candidates.where(F.col("phase").isin(PHASES) & ((F.col("phase") != "pass") | (F.col("pos") <= limited_passes(max_passes))))
    step = F.struct(F.try_element_at(rank, F.col("phase")).alias("rank"), F.col("pos").cast("int").alias("pos"), "label", F.col("qs").cast("double").alias("qs"), "phase")
    gathered = known.groupBy("page_key").agg(F.array_sort(F.collect_list(step)).alias("__steps"))
    kind = "struct<rank:int,pos:int,label:string,qs:double,phase:string>"
    steps = F.coalesce("__steps", F.array().cast(f"array<{kind}>"))
    clean = F.filter(steps, lambda c: c["phase"] == "clean")
    start = F.col("start_qs").cast("double")
    begin = F.struct(start.alias("best"), start.alias("polish_from"), F.lit(0).alias("stall"), F.lit(None).cast(kind).alias("won"))
    walked = F.aggregate(F.when(F.size(clean) > 0, clean).otherwise(steps), begin, lambda state, c: _step(state, c, target_qs, min_gain, max(2, stall_window)))
    picked = pages.join(gathered, "page_key", "left").withColumn("__t", walked["won"])
    verdict = (
        F.when(F.col("__t").isNull(), F.when(F.col("washed"), F.lit("washed_recovery")).otherwise(F.lit("no_change")))
        .when(F.col("__t.phase") == "clean", F.lit("clean_doc_polish"))
        .when(F.col("__t.phase") == "pass", F.concat(F.lit("iterative_pass_"), F.col("__t.pos").cast("string")))
        .when(F.col("__t.phase") == "polish", F.concat(F.lit("polish_clip_"), F.col("__t.label")))
        .otherwise(F.concat(F.lit("escalation:"), F.col("__t.label")))
    )
    best = F.coalesce(F.col("__t.qs"), F.col("start_qs"))
    final = F.coalesce(F.col("final_qs"), best)
    rolled_back = final < F.col("original_qs")
    return picked.select(
        "page_key",
        best.alias("best_qs"),
        F.when(rolled_back, F.col("original_qs")).otherwise(final).alias("final_qs"),
        F.when(rolled_back, F.lit("rolled_back_to_original")).otherwise(verdict).alias("verdict"),
    )
