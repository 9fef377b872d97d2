"""Mixing sources to target weights, by weighted fair queueing.

The documents of a source stand in a queue in shuffled order, as often as they may be
repeated; no document comes again before all others came once more. A queued document
finishes at virtual time (tokens of the queue up to and with it) / weight. Served in the
order of these times, every source has its share at any moment as long as its queue lasts. The
order is cut where the total budget is reached. Both running sums are taken over
range-sorted tables, with a start per range; no source is ever in one task.

Defined cases: sources are compared without regard to letter case, outer spaces and
hyphens; documents of null or other sources, null ids and without tokens are never chosen; a weight that is
null, zero or less closes a source, of several targets of a source the greatest counts; max_repeats below one or null counts as one; equal
finishing times are broken by source, repeat and id; with an empty corpus nothing is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordering import range_sorted, with_running
from ..plans.runtime import materialize

#: The settings table of targets may be broadcast up to this many rows.
TARGETS_BROADCAST = 10_000


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.where("target_weight > 0 and source is not null").select(source_name(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("repeats"))
    t = t.groupBy("source").agg(F.max(F.struct("weight", "repeats")).alias("_t")).select("source", "_t.*")
    small = t.limit(TARGETS_BROADCAST + 1).count() <= TARGETS_BROADCAST
    return F.broadcast(t) if small else t


def _enough(sources: list[dict], budget: int) -> float:
    """A virtual time by which the budget is served for sure.

    By time v a source has served all its copies, or at least weight * v less one document. The sum of
    that grows piecewise in a straight line, so the time is found at a corner or between two.
    """
    def served(v: float) -> float:
        return sum(max(0.0, min(s["supply"] * s["repeats"], s["weight"] * v - s["largest"])) for s in sources)

    corners = sorted({c for s in sources for c in (s["largest"] / s["weight"], (s["supply"] * s["repeats"] + s["largest"]) / s["weight"])})
    before = 0.0
    for c in corners:
        if served(c) >= budget:
            lo, hi = served(before), served(c)
            return before + (c - before) * (max(0.0, budget - lo) / (hi - lo) if hi > lo else 1.0)
        before = c
    return float("inf")


def mix(sizes: DataFrame, targets: DataFrame, budget_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """The chosen documents: doc_id, source, repeat_no, n_tokens, virtual_finish.

    ``sizes`` has doc_id, source, n_tokens. Without a budget it is the size of the corpus of
    the targeted sources, each document once. Copies that can only finish after the budget is served are never made.
    """
    queue = sizes.where("n_tokens > 0 and doc_id is not null").select("doc_id", "n_tokens", source_name(F.col("source")).alias("source")).join(_targets(targets), "source")
    # a row per target source
    sources = [r.asDict() for r in queue.groupBy("source", "weight", "repeats").agg(F.sum("n_tokens").alias("supply"), F.max("n_tokens").alias("largest")).collect()]
    budget = budget_tokens if budget_tokens is not None else sum(s["supply"] for s in sources)
    end = _enough(sources, budget)
    # the k-th copies of a source start at (k - 1) * supply / weight; one more copy makes up for rounding
    need = [(s["source"], int(min(s["repeats"], end * s["weight"] / s["supply"] + 2 if end < float("inf") else s["repeats"]))) for s in sources]
    copies = F.broadcast(sizes.sparkSession.createDataFrame(need, "source string, _copies int"))
    served = queue.join(copies, "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), "_copies"))).withColumn("_h", F.xxhash64(F.lit(seed), "repeat_no", "doc_id"))
    lined = range_sorted(served.select("source", "repeat_no", "_h", "doc_id", "n_tokens", "weight"), [F.col("source"), F.col("repeat_no"), F.col("_h"), F.col("doc_id")])
    timed = with_running(lined, {"_cum": "n_tokens"}, ["source"]).select("source", "repeat_no", "doc_id", "n_tokens", (F.col("_cum") / F.col("weight")).alias("virtual_finish"))
    # what finishes after that time isn't served either, so the second sort needs only the rest; the cut is exact
    timed = timed.where(F.col("virtual_finish") <= F.lit(end * (1 + 1e-9))) if end < float("inf") else timed
    order = [F.col("virtual_finish"), F.col("source"), F.col("repeat_no"), F.col("doc_id")]
    total = with_running(range_sorted(timed, order), {"_total": "n_tokens"})
    return total.where(F.col("_total") <= F.lit(budget)).select("doc_id", "source", "repeat_no", "n_tokens", "virtual_finish")


def shares(sizes: DataFrame, targets: DataFrame, budget_tokens: int | None = None, seed: int = 1) -> DataFrame:
    """Per target source: target_weight, supply and chosen tokens, share reached, most repeats used."""
    sizes = materialize(sizes, "sizes")
    chosen = mix(sizes, targets, budget_tokens, seed).groupBy("source").agg(F.sum("n_tokens").alias("chosen_tokens"), F.count(F.lit(1)).alias("n_chosen"), F.max("repeat_no").alias("repeats_used"))
    supply = sizes.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("supply_tokens"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_weight", "max_repeats")
    j = t.join(supply, "source", "left").join(chosen, "source", "left").na.fill(0, ["supply_tokens", "chosen_tokens", "n_chosen", "repeats_used"])
    all_chosen = chosen.agg(F.sum("chosen_tokens").alias("_all"))
    return j.join(F.broadcast(all_chosen), F.lit(True), "left").withColumn("share", F.coalesce(F.col("chosen_tokens") / F.col("_all"), F.lit(0.0))).drop("_all")
