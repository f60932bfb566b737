"""Choosing factors: status and score, correlation, redundancy clusters, final pick, review."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import clip, correlation, finite
from tidepanel.operators.keys import require_columns
from tidepanel.operators.ordered import cell_starts, cut_groups, number_rows, ranked_in_cells, with_cells
from tidepanel.scale import freeze, settled

# Default thresholds.
MIN_RANK_IC_DAYS = 60
MIN_COVERAGE = 0.05
MIN_ABS_RANK_IC = 0.01
CORR_THRESHOLD = 0.95
MIN_CORR_PAIRS = 10_000
MAX_IR = 3.0
GLOBAL_NOTE = "global_note"
# Other names of review flags.
REVIEW_FLAG_ALIASES = {
    "sparse_event_factor": "sparse_event_signal",
    "event_factor": "sparse_event_signal",
    "event_signal": "sparse_event_signal",
    "market_state": "state_factor",
    "regime_factor": "state_factor",
    "state": "state_factor",
}
REVIEW_FLAGS = (
    "state_factor",
    "interaction_candidate",
    "watchlist",
    "redundancy_risk",
    "sparse_event_signal",
    "manual_review",
    "other",
)


# -- candidates ----------------------------------------------------------------------


def merge_reports(quality: DataFrame, summary: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Quality with the primary label's summary, and the secondary label's rank IC beside it.

    Both labels read one stored summary, so the days behind it are judged once.
    """
    summary = settled(summary, "summary")
    first = summary.where(F.col("label") == primary)
    second = summary.where(F.col("label") == secondary).select(
        "factor_name",
        F.col("rank_ic_mean").alias("secondary_rank_ic_mean"),
        F.col("rank_ic_ir").alias("secondary_rank_ic_ir"),
        F.col("rank_ic_day_count").alias("secondary_rank_ic_day_count"),
    )
    clash = [c for c in first.columns if c in quality.columns and c != "factor_name"]
    return quality.drop(*clash).join(first, "factor_name").join(second, "factor_name", "left")


def candidate_status(
    merged: DataFrame,
    min_days: int = MIN_RANK_IC_DAYS,
    min_coverage: float = MIN_COVERAGE,
    min_abs_rank_ic: float = MIN_ABS_RANK_IC,
    min_abs_ir: float = 0.0,
) -> DataFrame:
    """Status, reasons, direction, hit rate, agreement of labels, and selection score.

    A news factor that only has too few days or too little coverage is borderline
    instead of rejected.
    """
    c = F.col
    strength, ir = F.abs(c("rank_ic_mean")), F.abs(c("rank_ic_ir"))
    unsure = lambda condition: ~F.coalesce(condition, F.lit(False))
    failed = unsure(c("quality_pass"))
    constant = F.coalesce(c("constant_flag"), F.lit(False))
    few_days, thin = unsure(c("rank_ic_day_count") >= min_days), unsure(c("coverage_mean") >= min_coverage)
    weak = unsure(strength >= min_abs_rank_ic)
    shaky = unsure(ir >= min_abs_ir) if min_abs_ir > 0 else F.lit(False)
    reasons = F.concat_ws(
        ";",
        F.when(failed, "quality_failed"),
        F.when(constant, "constant"),
        F.when(few_days, "rank_ic_days_too_low"),
        F.when(thin, "coverage_too_low"),
        F.when(weak, "rank_ic_too_weak"),
        F.when(shaky, "rank_ic_ir_too_weak"),
    )
    news = c("factor_name").startswith("news_")
    if "source" in merged.columns:
        news = news | F.coalesce(c("source") == "news_llm", F.lit(False))
    spared = news & ~failed & ~constant & ~weak & (thin | few_days)
    status = F.when(reasons == "", "candidate").when(spared, "borderline").otherwise("rejected")
    direction = F.coalesce(F.signum("rank_ic_mean"), F.lit(0.0)).cast("int")
    work = merged.withColumns(
        {
            "reject_reason": reasons,
            "selection_status": status,
            "direction": direction,
            "abs_rank_ic_mean": strength,
            "abs_rank_ic_ir": ir,
        }
    )
    hit = F.when(c("direction") > 0, c("rank_ic_positive_rate")).when(c("direction") < 0, 1.0 - c("rank_ic_positive_rate"))
    agree = F.when(
        (c("rank_ic_mean") != 0) & (c("secondary_rank_ic_mean") != 0),
        F.signum("rank_ic_mean") == F.signum("secondary_rank_ic_mean"),
    )
    work = work.withColumns({"directional_rank_ic_hit_rate": hit, "secondary_direction_consistent": agree})
    score = (
        c("abs_rank_ic_mean")
        * F.sqrt(F.greatest(c("rank_ic_day_count").cast("double"), F.lit(1.0)))
        * F.sqrt(F.greatest(c("coverage_mean"), F.lit(1e-6)))
        * (clip("abs_rank_ic_ir", upper=MAX_IR) + 1.0)
        * F.greatest(F.coalesce(c("directional_rank_ic_hit_rate"), F.lit(0.5)), F.lit(0.1))
    )
    return work.withColumn("selection_score", F.when(c("selection_status") == "rejected", 0.0).otherwise(score))


# -- correlation ---------------------------------------------------------------------


def standardised(panel: DataFrame, factors: Sequence[str], method: str = "spearman", key: str = "sample_id") -> DataFrame:
    """Each factor as z-score of its values (or of their ranks) over the whole table, 0 where missing."""
    wide = panel.select(key, *[finite(f).alias(f) for f in factors])
    long = wide.unpivot([key], list(factors), "factor_name", "x").where(F.col("x").isNotNull())
    if method == "spearman":
        long = number_rows(long, ["factor_name"], [F.col("x")], key, "_n", rank="v")
    else:
        long = long.withColumn("v", F.col("x"))
    stats = long.groupBy("factor_name").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    z = long.join(stats, "factor_name").select(
        key, "factor_name", F.coalesce(F.try_divide(F.col("v") - F.col("_m"), F.col("_s")), F.lit(0.0)).alias("z")
    )
    # a sample has one row per factor, so one aggregation does; a pivot would first group by sample and factor
    return z.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("factor_name") == f, F.col("z"))), F.lit(0.0)).alias(f) for f in factors])


def correlation_matrix(
    panel: DataFrame, factors: Sequence[str], method: str = "spearman", key: str = "sample_id"
) -> DataFrame:
    """Upper triangle of correlations from standardised columns, missing values counting as the mean.

    The denominator is the smaller number of values minus one, so this is not the
    pairwise-complete correlation. Each task reduces its rows to one small matrix
    of products; only those matrices are summed.
    """
    factors = list(factors)
    z = standardised(panel, factors, method, key).select(F.array(*factors).alias("z"))

    def products(batches):
        import pyarrow as pa

        total = np.zeros((len(factors), len(factors)))
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(factors))
            total += block.T @ block
        i, j = np.triu_indices(len(factors), k=1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "dot"])

    sums = z.mapInArrow(products, "i int, j int, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot"))
    present = panel.agg(*[F.count(finite(f)).alias(f) for f in factors]).unpivot([], factors, "factor_name", "n")
    names = panel.sparkSession.createDataFrame(list(enumerate(factors)), "i int, factor_name string")
    sizes = names.join(present, "factor_name")
    left = sizes.select("i", F.col("factor_name").alias("factor_a"), F.col("n").alias("_na"))
    right = sizes.select(F.col("i").alias("j"), F.col("factor_name").alias("factor_b"), F.col("n").alias("_nb"))
    out = sums.join(left, "i").join(right, "j").withColumn("overlap_count", F.least("_na", "_nb"))
    corr = F.when(F.col("overlap_count") > 1, F.col("dot") / (F.col("overlap_count") - 1))
    return out.select("factor_a", "factor_b", corr.alias("corr"), "overlap_count")


def pair_correlation(
    panel: DataFrame, pairs: DataFrame, factors: Sequence[str], method: str = "spearman", key: str = "sample_id"
) -> DataFrame:
    """Exact correlation of listed pairs over the rows where both are present, ranked anew for each pair."""
    # both values are in the sample's row, so rows meet the listed pairs and not each other; the samples are stored
    # once, and the rows of pairs are made from them wherever they are read
    place = {f: i for i, f in enumerate(factors)}
    at = F.create_map(*[F.lit(v) for f, i in place.items() for v in (f, i)])
    group = ["factor_a", "factor_b"]
    listed = pairs.select(*group, *[F.element_at(at, F.col(f"factor_{s}")).alias(f"_{s}") for s in "ab"])
    wide = settled(panel.select(key, *[finite(f).alias(f) for f in factors]), "samples")
    value = lambda at: F.get(F.array(*factors), F.col(at))
    both = wide.crossJoin(freeze(listed, "pairs")).select(key, *group, value("_a").alias("x"), value("_b").alias("y"))
    both = both.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    if method != "spearman":
        return both.groupBy(*group).agg(
            F.when(varied, correlation(F.col("x"), F.col("y"))).alias("corr"), F.count(F.lit(1)).alias("overlap_count")
        )
    # a row moves twice: to those of its cell by x, and with its rank to those of its cell by y
    found = cut_groups(both, group, ["x", "y"], more={"_varied": varied})
    celled = with_cells(both, found, group, ["x", "y"], key).drop(key)
    ranked = ranked_in_cells(celled, cell_starts(celled, "x"), "x", "rx").select("_cell_y", "y", "rx")
    ranked = ranked_in_cells(ranked, cell_starts(celled, "y"), "y", "ry")
    corr = ranked.groupBy("_group").agg(correlation(F.col("rx"), F.col("ry")).alias("corr"))
    return found.join(corr, "_group").select(
        *group, F.when(F.col("_varied"), F.col("corr")).alias("corr"), F.col("_total").alias("overlap_count")
    )


def conflicts(correlations: DataFrame, threshold: float = CORR_THRESHOLD, min_pairs: int = MIN_CORR_PAIRS) -> DataFrame:
    """Pairs correlated at least as strongly as the threshold over enough rows."""
    found = correlations.where((F.abs("corr") >= threshold) & (F.col("overlap_count") >= min_pairs))
    return found.withColumn("abs_corr", F.abs("corr"))


def correlation_conflicts(
    panel: DataFrame,
    factors: Sequence[str],
    method: str = "spearman",
    threshold: float = CORR_THRESHOLD,
    min_pairs: int = MIN_CORR_PAIRS,
    exact: bool = True,
    key: str = "sample_id",
) -> DataFrame:
    """Conflicts by the matrix, each confirmed by its exact correlation unless ``exact`` is off."""
    rough = conflicts(correlation_matrix(panel, factors, method, key), threshold, min_pairs)
    if not exact:
        return rough
    rough = freeze(rough, "conflicts")
    return conflicts(pair_correlation(panel, rough, factors, method, key), threshold, min_pairs)


# -- clusters ------------------------------------------------------------------------


def connected_clusters(nodes: DataFrame, edges: DataFrame, node: str = "factor_name") -> DataFrame:
    """Smallest member name as the ``root`` of each connected component.

    Every round a node takes the smallest root among its neighbours, then the root
    of that root; long chains halve their length, so few rounds are needed. Each
    round is written to the shared folder.
    """
    both = edges.select(F.col("factor_a").alias("a"), F.col("factor_b").alias("b"))
    both = freeze(both.union(both.select("b", "a")).distinct(), "edges")
    roots = freeze(nodes.select(F.col(node).alias("n"), F.col(node).alias("root")).distinct(), "roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("n")).groupBy("a").agg(F.min("root").alias("_near"))
        pulled = roots.join(near, F.col("n") == F.col("a"), "left").select(
            "n", F.least("root", "_near").alias("_next"), F.col("root").alias("_old")
        )
        of_root = roots.select(F.col("n").alias("_m"), F.col("root").alias("_rr"))
        step = pulled.join(of_root, F.col("_next") == F.col("_m"), "left").select(
            "n", F.least("_next", "_rr").alias("root"), "_old"
        )
        step = freeze(step, "roots")
        moved = step.where(F.col("root") != F.col("_old")).limit(1).count()
        roots = step.drop("_old")
        if not moved:
            return roots.select(F.col("n").alias(node), "root")


def redundancy_clusters(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of conflicting factors, numbered by size, each with its best factor as representative."""
    rooted = candidates.select("factor_name", "selection_score", "coverage_mean").join(
        connected_clusters(candidates, pairs), "factor_name"
    )
    inside = Window.partitionBy("root").orderBy(
        F.col("selection_score").desc_nulls_last(), F.col("coverage_mean").desc_nulls_last(), "factor_name"
    )
    ranked = rooted.withColumns(
        {
            "_place": F.row_number().over(inside),
            "cluster_size": F.count(F.lit(1)).over(Window.partitionBy("root")),
            "representative": F.first("factor_name").over(inside),
        }
    )
    # the catalog holds one row per factor, so numbering the clusters is a small job
    order = Window.orderBy(F.col("cluster_size").desc(), "root")
    numbered = ranked.select("root", "cluster_size").distinct().withColumn("_number", F.row_number().over(order))
    out = ranked.join(numbered.select("root", "_number"), "root")
    return out.select(
        F.concat(F.lit("cluster_"), F.lpad(F.col("_number").cast("string"), F.greatest(F.length(F.col("_number").cast("string")), F.lit(4)), F.lit("0"))).alias("cluster_id"),
        "factor_name",
        "representative",
        (F.col("_place") == 1).alias("is_representative"),
        "cluster_size",
    )


def final_pick(candidates: DataFrame, clusters: DataFrame, pairs: DataFrame, max_selected: int = 0) -> DataFrame:
    """Selected factors: representatives that are candidates, at most ``max_selected`` of them."""
    work = candidates.join(clusters, "factor_name", "left")
    chosen = (F.col("selection_status") == "candidate") & F.coalesce("is_representative", F.lit(False))
    work = work.withColumn("selected", chosen)
    if max_selected > 0:
        best = (
            work.where("selected").orderBy(F.col("selection_score").desc(), "factor_name").limit(max_selected)
            .select("factor_name", F.lit(True).alias("_best"))
        )
        work = work.join(best, "factor_name", "left").withColumn("selected", F.coalesce("_best", F.lit(False))).drop("_best")
    lookup = pairs.select("factor_a", "factor_b", "corr")
    lookup = lookup.union(lookup.select("factor_b", "factor_a", "corr"))
    lookup = lookup.select(F.col("factor_a").alias("factor_name"), F.col("factor_b").alias("representative"), F.col("corr").alias("_corr"))
    work = work.join(lookup, ["factor_name", "representative"], "left")
    beaten = ~F.col("selected") & (F.col("selection_status") == "candidate") & (F.col("representative") != F.col("factor_name"))
    reason = (
        F.when(F.col("selected"), "")
        .when(beaten, F.concat(F.lit("high_corr_with:"), F.col("representative")))
        .when((F.col("selection_status") == "candidate") & F.lit(max_selected > 0), "max_selected_cap")
        .otherwise(F.col("reject_reason"))
    )
    return work.withColumns(
        {
            "final_reject_reason": reason,
            "high_corr_with": F.when(beaten, F.col("representative")),
            "corr_with_selected": F.when(beaten, F.col("_corr")),
        }
    ).drop("_corr")


# -- review --------------------------------------------------------------------------


def review_problems(candidates: DataFrame, selected: DataFrame, review: DataFrame, allow_failed: bool = False) -> DataFrame:
    """Rows of a review that break a rule, with the broken ``rule``.

    ``review`` has action (remove, add_back, flag or global_note), factor_name, flag and reason.
    """
    review = review_items(review)
    known = candidates.select("factor_name", "quality_pass", "constant_flag", F.lit(True).alias("_known"))
    mine = selected.select("factor_name", F.lit(True).alias("_selected")).distinct()
    work = review.join(known, "factor_name", "left").join(mine, "factor_name", "left")
    again = F.count(F.lit(1)).over(Window.partitionBy("action", "factor_name", F.coalesce("flag", F.lit("")))) > 1
    sound = F.coalesce(F.col("quality_pass"), F.lit(False)) & ~F.coalesce(F.col("constant_flag"), F.lit(False))
    rule = (
        F.when(F.col("action") == GLOBAL_NOTE, F.lit(None).cast("string"))
        .when(F.col("_known").isNull(), "unknown factor")
        .when(again, "listed twice")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
        .when((F.col("action") == "remove") & F.col("_selected").isNull(), "not selected")
        .when((F.col("action") == "add_back") & F.col("_selected").isNotNull(), "already selected")
        .when((F.col("action") == "add_back") & ~sound & F.lit(not allow_failed), "quality failed")
        .when((F.col("action") == "flag") & ~F.coalesce(F.col("flag").isin(*REVIEW_FLAGS), F.lit(False)), "unknown flag")
    )
    return work.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*review.columns, "rule")


def review_items(review: DataFrame) -> DataFrame:
    """Review rows with flags under their own names; a global note belongs to no factor."""
    flag = F.coalesce(*[F.when(F.col("flag") == a, F.lit(f)) for a, f in REVIEW_FLAG_ALIASES.items()], F.col("flag"))
    name = F.when(F.col("action") == GLOBAL_NOTE, F.lit("")).otherwise(F.col("factor_name"))
    return review.withColumns({"flag": flag, "factor_name": name})


def apply_review(candidates: DataFrame, selected: DataFrame, review: DataFrame) -> DataFrame:
    """Candidates still selected after the review, with action, reason and flags."""
    require_columns(review, ["action", "factor_name", "flag", "reason"], "review")
    review = review_items(review)
    mine = selected.select("factor_name").distinct().withColumn("_selected", F.lit(True))
    decision = review.where(F.col("action").isin("remove", "add_back")).select("factor_name", "action", "reason")
    flags = review.where(F.col("action") == "flag").groupBy("factor_name").agg(
        F.concat_ws(";", F.array_sort(F.collect_set("flag"))).alias("review_flags")
    )
    work = candidates.join(mine, "factor_name", "left").join(decision, "factor_name", "left").join(flags, "factor_name", "left")
    kept = (F.col("_selected").isNotNull() | F.col("action").eqNullSafe("add_back")) & ~F.col("action").eqNullSafe("remove")
    return work.where(kept).select(
        *candidates.columns,
        F.when(F.col("action") == "add_back", "added_back").otherwise("kept_auto").alias("review_action"),
        F.coalesce("reason", F.lit("")).alias("review_reason"),
        F.coalesce("review_flags", F.lit("")).alias("review_flags"),
    )


def review_audit(selected_after: DataFrame, review: DataFrame) -> DataFrame:
    """One audit row per review item and whether its factor is selected in the end; notes always count."""
    review = review_items(review)
    final = selected_after.select("factor_name", F.lit(True).alias("_in")).distinct()
    work = review.join(final, "factor_name", "left")
    action = F.when(F.col("action") == "flag", F.concat(F.lit("flag:"), F.col("flag"))).otherwise(F.col("action"))
    applied = F.when(F.col("action") == "flag", F.col("_in").isNotNull()).otherwise(F.lit(True))
    return work.select(action.alias("action"), "factor_name", applied.alias("applied"), "reason")

