"""Factor evaluation and selection over samples with candlestick and return factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import keys as ky
from tidepanel.operators.joins import align_to_samples, feature_panel
from tidepanel.operators.ordered import in_order
from tidepanel.plans import catalogue as ct
from tidepanel.plans import evaluate as ev
from tidepanel.plans import price_factors as pf
from tidepanel.plans import select as se
from tidepanel.plans import value_factors as vf
from tidepanel.plans.samples import apply_scaler, fit_scaler
from tidepanel.registry import tables
from tidepanel.registry.base import query, rounded, tidy
from tidepanel.registry.q_factors import METRIC_BASE, P
from tidepanel.registry.tables import define, sql
from tidepanel.scale import freeze

FACTORS = [f"{P}KMID", f"{P}KMID2", f"{P}KLEN", f"{P}KSFT2", f"{P}ROC5", "coarse"]
LABELS = ["label_next_open_return", "label_next_vwap_return"]
ENTITY = "PARTITION BY stock_code ORDER BY trade_date"


def panel(spark, sf) -> DataFrame:
    """Samples with labels and six factors of their feature date, one of them with many ties."""
    price = tables.stored_price(spark, sf)  # read by factors, samples and the check of keys
    table = pf.price_factors(price, kbar=True, relative=False, return_windows=(5,), rolling_windows=())
    coarse = price.select("stock_code", "trade_date", F.when(F.col("mno") % 9 != 0, F.floor(F.col("volume") / 60).cast("double")).alias("coarse"))
    daily = table.output().join(coarse, ["stock_code", "trade_date"]).select("stock_code", "trade_date", *FACTORS)
    samples = tables.predictions(spark, sf, price).select(
        "sample_id", "stock_code", "feature_asof_date", "target_trade_date", *LABELS
    )
    return align_to_samples(samples, daily)


def stored_panel(spark, sf) -> DataFrame:
    """The panel as a stage table in the order of its samples, for reports that read it several times."""
    return in_order(panel(spark, sf), "sample_id", "_row")


define(
    "panel",
    f"""daily AS (SELECT stock_code, trade_date, (close - open) / open AS {P}KMID, (close - open) / (high - low + 1e-12) AS {P}KMID2,
  (high - low) / open AS {P}KLEN, (2 * close - high - low) / (high - low + 1e-12) AS {P}KSFT2, lag(close, 5) OVER ({ENTITY}) / close AS {P}ROC5,
  CASE WHEN mno % 9 <> 0 THEN floor(volume / 60) END AS coarse FROM price),
panel AS (SELECT s.sample_id, s.stock_code, s.feature_asof_date, s.target_trade_date, s.label_next_open_return, s.label_next_vwap_return,
  {', '.join('d.' + f for f in FACTORS)} FROM predictions s LEFT JOIN daily d ON d.stock_code = s.stock_code AND d.trade_date = s.feature_asof_date)""",
    ("predictions",),
)
_PAIRS = " UNION ALL ".join(
    f"SELECT sample_id, target_trade_date, '{f}' AS factor_name, '{y}' AS label, {f} AS x, {y} AS y FROM panel" for f in FACTORS for y in LABELS
)
GROUPS = 5
define(
    "evaluated",
    f"""rows_long AS ({_PAIRS}),
pairs AS (SELECT *, rank() OVER (d ORDER BY x) + (count(*) OVER (PARTITION BY factor_name, label, target_trade_date, x) - 1) / 2 AS rx,
    rank() OVER (d ORDER BY y) + (count(*) OVER (PARTITION BY factor_name, label, target_trade_date, y) - 1) / 2 AS ry,
    row_number() OVER (d ORDER BY x, sample_id) AS n, count(*) OVER d AS total
  FROM rows_long WHERE x IS NOT NULL AND y IS NOT NULL WINDOW d AS (PARTITION BY factor_name, label, target_trade_date)),
grouped AS (SELECT *, greatest(1, CAST(ceil((n - 1) * {GROUPS} / greatest(total - 1, 1)) AS INTEGER)) AS grp FROM pairs),
day_stats AS (SELECT factor_name, label, target_trade_date, count(*) AS pair_count,
    count(*) >= 10 AND min(x) < max(x) AND min(y) < max(y) AS usable, corr(x, y) AS ic, corr(rx, ry) AS rank_ic,
    avg(y) FILTER (grp = {GROUPS}) - avg(y) FILTER (grp = 1) AS spread FROM grouped GROUP BY ALL),
evaluated AS (SELECT r.factor_name, r.label, r.target_trade_date, row_count, coalesce(pair_count, 0) AS pair_count,
    coalesce(pair_count, 0) / row_count AS coverage, CASE WHEN usable THEN ic END AS ic, CASE WHEN usable THEN rank_ic END AS rank_ic,
    CASE WHEN usable AND pair_count >= {GROUPS} THEN spread END AS group_spread
  FROM (SELECT factor_name, label, target_trade_date, count(*) AS row_count FROM rows_long GROUP BY ALL) r
  LEFT JOIN day_stats USING (factor_name, label, target_trade_date)),
group_rows AS (SELECT factor_name, label, target_trade_date, grp, count(*) AS n, avg(y) AS mean_return FROM grouped
  SEMI JOIN (SELECT factor_name, label, target_trade_date FROM day_stats WHERE usable AND pair_count >= {GROUPS})
  USING (factor_name, label, target_trade_date) GROUP BY ALL)""",
    ("panel",),
)


def daily(spark, sf) -> DataFrame:
    rows = ev.factor_label_rows(panel(spark, sf), FACTORS, LABELS)
    return ev.daily_ic(rows, 10, GROUPS)


def group_rows(spark, sf) -> DataFrame:
    rows = ev.factor_label_rows(panel(spark, sf), FACTORS, LABELS)
    return ev.group_returns(rows, 10, GROUPS)


_DAILY = ["coverage", "ic", "rank_ic", "group_spread"]


@query(
    "factor_daily_ic",
    sql("evaluated", f"SELECT factor_name, label, target_trade_date, row_count, pair_count, {rounded(_DAILY)} FROM evaluated"),
)
def factor_daily_ic(spark, sf):
    """IC, rank IC, coverage and spread per factor, label and month."""
    return tidy(daily(spark, sf).select("factor_name", "label", "target_trade_date", "row_count", "pair_count", *_DAILY))


@query(
    "factor_group_returns",
    sql(
        "evaluated",
        'SELECT factor_name, label, target_trade_date, grp AS "group", n AS "count", round(mean_return, 6) + 0 AS mean_return FROM group_rows',
    ),
)
def factor_group_returns(spark, sf):
    """Mean label of each quantile group."""
    return tidy(group_rows(spark, sf))


def summary_sql(source: str, where: str = "true") -> str:
    stats = []
    for m in ("ic", "rank_ic"):
        stats += [
            f"avg({m}) AS {m}_mean", f"stddev_samp({m}) AS {m}_std",
            f"avg({m}) / nullif(stddev_samp({m}), 0) AS {m}_ir", f"avg(({m} > 0)::INT) AS {m}_positive_rate",
        ]
    return f"""SELECT factor_name, label, count(*) AS target_day_count, count(ic) AS ic_day_count, count(rank_ic) AS rank_ic_day_count,
      avg(pair_count) AS pair_count_mean, avg(coverage) AS coverage_mean, {', '.join(stats)}, avg(group_spread) AS group_spread_mean,
      avg((group_spread > 0)::INT) AS group_spread_positive_rate FROM {source} WHERE {where} GROUP BY ALL"""


_COUNTS = ["target_day_count", "ic_day_count", "rank_ic_day_count"]
_MEANS = ["pair_count_mean", "coverage_mean", "ic_mean", "ic_std", "ic_ir", "ic_positive_rate", "rank_ic_mean",
          "rank_ic_std", "rank_ic_ir", "rank_ic_positive_rate", "group_spread_mean", "group_spread_positive_rate"]


@query(
    "factor_summary",
    sql("evaluated", f"SELECT factor_name, label, {', '.join(_COUNTS)}, {rounded(_MEANS)} FROM ({summary_sql('evaluated')})"),
)
def factor_summary(spark, sf):
    """Means, deviations, ratios and positive rates over all months."""
    return tidy(ev.factor_summary(daily(spark, sf)))


_SINCE, _UNTIL = "1997-01-01", "1999-12-31"
_RANGE = f"target_trade_date BETWEEN DATE '{_SINCE}' AND DATE '{_UNTIL}'"
_SPREAD_SQL = f"""SELECT factor_name, label, count(spread) AS group_spread_day_count, avg(spread) AS group_spread_mean,
  avg((spread > 0)::INT) AS group_spread_positive_rate FROM (SELECT factor_name, label, target_trade_date,
    arg_max(mean_return, grp) - arg_min(mean_return, grp) AS spread FROM group_rows WHERE {_RANGE} GROUP BY ALL) GROUP BY ALL"""


@query(
    "slice_spread",
    sql(
        "evaluated",
        f"SELECT factor_name, label, group_spread_day_count, {rounded(['group_spread_mean', 'group_spread_positive_rate'])} FROM ({_SPREAD_SQL})",
    ),
)
def slice_spread(spark, sf):
    """Spread between the outermost groups over three years."""
    return tidy(ev.slice_spread(group_rows(spark, sf), _SINCE, _UNTIL))


@query(
    "slice_summary",
    sql(
        "evaluated",
        f"SELECT b.factor_name, b.label, {', '.join(_COUNTS)}, group_spread_day_count, {rounded(_MEANS[:-2])}, "
        f"{rounded(['group_spread_mean', 'group_spread_positive_rate'], source='s')} FROM (SELECT * EXCLUDE (group_spread_mean, group_spread_positive_rate) "
        f"FROM ({summary_sql('evaluated', _RANGE)})) b LEFT JOIN ({_SPREAD_SQL}) s ON s.factor_name = b.factor_name AND s.label = b.label",
    ),
)
def slice_summary(spark, sf):
    """Summary of stored daily metrics over three years."""
    rows = ev.factor_label_rows(panel(spark, sf), FACTORS, LABELS)
    return tidy(ev.slice_summary(ev.daily_ic(rows, 10, GROUPS), ev.group_returns(rows, 10, GROUPS), _SINCE, _UNTIL))


# -- quality -------------------------------------------------------------------------


def dirty(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    """A block with infinite, missing, constant and textual columns, and its samples."""
    p = panel(spark, sf)
    m = F.month("target_trade_date")
    block = p.select(
        "sample_id",
        F.col(f"{P}KLEN").alias("clean"),
        F.when(m == 3, F.lit(float("inf"))).when(m == 4, F.lit(float("nan"))).otherwise(F.col(f"{P}ROC5")).alias("odd"),
        F.when(m == 5, F.lit("n/a")).otherwise(F.col("coarse").cast("string")).alias("textual"),
        F.lit(7.0).alias("constant"),
        F.when(F.year("target_trade_date") == 1997, F.col(f"{P}KMID")).alias("sparse"),
    )
    return block, p.where(F.col("target_trade_date") < F.lit("2001-01-01").cast("date")), ["clean", "odd", "textual", "constant", "sparse"]


_Q = ["zero_rate", "mean", "std", "min", "p01", "p05", "p50", "p95", "p99", "max", "missing_rate", "non_missing_rate",
      "year_coverage_min", "year_coverage_max", "year_coverage_std"]
_QC = ["row_count", "non_missing_count", "raw_nan_count", "inf_count", "non_numeric_count", "unique_count", "missing_count",
       "year_count", "worst_year"]
_PARTS = {
    "clean": (f"{P}KLEN", "false", "false", "false"),
    "odd": (f"CASE WHEN month(target_trade_date) NOT IN (3, 4) THEN {P}ROC5 END", "month(target_trade_date) = 3",
            "month(target_trade_date) = 4", "false"),
    "textual": ("CASE WHEN month(target_trade_date) <> 5 THEN coarse END", "false", "false", "month(target_trade_date) = 5"),
    "constant": ("7.0::DOUBLE", "false", "false", "false"),
    "sparse": (f"CASE WHEN year(target_trade_date) = 1997 THEN {P}KMID END", "false", "false", "false"),
}


@query(
    "factor_quality",
    sql(
        "panel",
        f"""SELECT factor_name, {', '.join(_QC)}, {rounded(_Q)}, constant_flag, quality_flags, quality_flags = '' AS quality_pass FROM (
          SELECT *, concat_ws(';', CASE WHEN non_numeric_count > 0 THEN 'non_numeric_values' END, CASE WHEN inf_count > 0 THEN 'has_inf' END,
            CASE WHEN missing_rate > 0.8 THEN 'missing_rate_high' END, CASE WHEN non_missing_count < 1000 THEN 'non_missing_too_low' END,
            CASE WHEN unique_count <= 1 THEN 'constant' END, CASE WHEN year_coverage_min < 0.05 THEN 'year_coverage_low' END) AS quality_flags
          FROM (SELECT factor_name, count(*) AS row_count, count(x) AS non_missing_count, count(*) FILTER (nan OR (x IS NULL AND NOT inf AND NOT txt)) AS raw_nan_count,
              count(*) FILTER (inf) AS inf_count, count(*) FILTER (txt) AS non_numeric_count, avg((x = 0)::INT) AS zero_rate, avg(x) AS mean,
              stddev_samp(x) AS std, min(x) AS min, max(x) AS max, count(DISTINCT x) AS unique_count, count(*) - count(x) AS missing_count,
              1 - count(x) / count(*) AS missing_rate, count(x) / count(*) AS non_missing_rate, count(DISTINCT x) <= 1 AS constant_flag,
              quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95,
              quantile_cont(x, 0.99) AS p99 FROM parts GROUP BY 1)
          JOIN (SELECT factor_name, count(*) AS year_count, min(share) AS year_coverage_min, max(share) AS year_coverage_max,
              stddev_pop(share) AS year_coverage_std, arg_min(yr, share * 10000 + yr / 10000) AS worst_year FROM (
              SELECT factor_name, year(target_trade_date) AS yr, count(x) / count(*) AS share FROM parts GROUP BY ALL) GROUP BY 1) USING (factor_name))""",
        "parts AS ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS factor_name, target_trade_date, {x} AS x, {inf} AS inf, {nan} AS nan, {txt} AS txt FROM panel WHERE target_trade_date < DATE '2001-01-01'"
            for n, (x, inf, nan, txt) in _PARTS.items()
        )
        + ")",
    ),
)
def factor_quality(spark, sf):
    """Quality report of a block with every kind of defect."""
    block, samples, names = dirty(spark, sf)
    out = ev.factor_quality(block, samples, names, 0.8, 1000, 0.05)
    return tidy(out.select("factor_name", *_QC, *_Q, "constant_flag", "quality_flags", "quality_pass"))


@query(
    "block_match",
    sql(
        "panel",
        """SELECT count(*) FILTER (s) AS sample_count, count(*) FILTER (s AND b) AS matched_sample_count, count(*) FILTER (s AND NOT b) AS missing_sample_count,
          count(*) FILTER (b AND NOT s) AS extra_sample_count, round(count(*) FILTER (s AND b) / count(*) FILTER (s), 6) + 0 AS sample_match_rate
          FROM (SELECT month(target_trade_date) > 2 AS s, month(target_trade_date) < 11 AS b FROM panel) WHERE s OR b""",
    ),
)
def block_match(spark, sf):
    """How many samples a block covers."""
    p = panel(spark, sf)
    m = F.month("target_trade_date")
    return tidy(ev.block_match(p.where(m < 11), p.where(m > 2)))


@query(
    "industry_coverage",
    sql(
        "price",
        """SELECT count(*) AS row_count, round(avg((coalesce(trim(industry), '') = '')::INT), 6) + 0 AS missing_rate,
          count(DISTINCT trade_date) FILTER (trim(industry) <> '') AS covered_days FROM price""",
    ),
)
def industry_coverage(spark, sf):
    """Share of bars without industry."""
    return tidy(ev.industry_coverage(tables.price(spark, sf)))


# -- selection -----------------------------------------------------------------------

THRESHOLDS = {"min_days": 60, "min_coverage": 0.95, "min_abs_rank_ic": 0.004}


def candidates(spark, sf, p: DataFrame | None = None) -> DataFrame:
    """Quality and summary reports merged; the panel (``p`` if it is at hand) and the result are stage tables, as in a daily run."""
    p = stored_panel(spark, sf) if p is None else p
    quality = ev.factor_quality(p.select("sample_id", *FACTORS), p, FACTORS, 0.8, 1000, 0.05)
    days = ev.daily_ic(ev.factor_label_rows(p, FACTORS, LABELS), 10, GROUPS)
    merged = se.merge_reports(quality, ev.factor_summary(days), *LABELS)
    return freeze(se.candidate_status(merged, **THRESHOLDS), "candidates")


define(
    "candidates",
    f"""summary AS ({summary_sql('evaluated')}),
merged AS (SELECT a.*, b.rank_ic_mean AS second FROM summary a JOIN summary b USING (factor_name)
  WHERE a.label = 'label_next_open_return' AND b.label = 'label_next_vwap_return'),
judged AS (SELECT *, abs(rank_ic_mean) AS strength, abs(rank_ic_ir) AS abs_ir, CAST(coalesce(sign(rank_ic_mean), 0) AS INTEGER) AS direction,
    concat_ws(';', CASE WHEN NOT coalesce(rank_ic_day_count >= 60, false) THEN 'rank_ic_days_too_low' END,
      CASE WHEN NOT coalesce(coverage_mean >= 0.95, false) THEN 'coverage_too_low' END,
      CASE WHEN NOT coalesce(abs(rank_ic_mean) >= 0.004, false) THEN 'rank_ic_too_weak' END) AS reject_reason FROM merged),
scored AS (SELECT *, CASE WHEN reject_reason = '' THEN 'candidate' ELSE 'rejected' END AS selection_status,
    CASE WHEN direction > 0 THEN rank_ic_positive_rate WHEN direction < 0 THEN 1 - rank_ic_positive_rate END AS hit FROM judged),
candidates AS (SELECT *, CASE WHEN selection_status = 'rejected' THEN 0 ELSE strength * sqrt(greatest(rank_ic_day_count, 1)) * sqrt(greatest(coverage_mean, 1e-6))
    * (1 + CASE WHEN abs_ir > 3 THEN 3 ELSE abs_ir END) * greatest(coalesce(hit, 0.5), 0.1) END AS selection_score FROM scored)""",
    ("evaluated",),
)


@query(
    "candidate_status",
    sql(
        "candidates",
        """SELECT factor_name, selection_status, reject_reason, direction, round(hit, 6) + 0 AS directional_rank_ic_hit_rate,
          CASE WHEN rank_ic_mean <> 0 AND second <> 0 THEN sign(rank_ic_mean) = sign(second) END AS secondary_direction_consistent,
          round(selection_score, 6) + 0 AS selection_score FROM candidates""",
    ),
)
def candidate_status(spark, sf):
    """Status, direction, hit rate, agreement and score of each factor."""
    return tidy(
        candidates(spark, sf).select(
            "factor_name", "selection_status", "reject_reason", "direction", "directional_rank_ic_hit_rate",
            "secondary_direction_consistent", "selection_score",
        )
    )


define(
    "matrix",
    "wide_ranks AS (SELECT sample_id, "
    + ", ".join(
        f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (ORDER BY {f} NULLS LAST) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 END AS {f}" for f in FACTORS
    )
    + " FROM panel),\nz AS (SELECT "
    + ", ".join(f"coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0), 0) AS {f}" for f in FACTORS)
    + " FROM wide_ranks),\nsizes AS (SELECT "
    + ", ".join(f"count({f}) AS {f}" for f in FACTORS)
    + " FROM panel),\nmatrix AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, (SELECT sum({a} * {b}) FROM z) / (least({a}, {b}) - 1) AS corr, least({a}, {b}) AS overlap_count FROM sizes"
        for i, a in enumerate(FACTORS)
        for b in FACTORS[i + 1 :]
    )
    + ")",
    ("panel",),
)


@query(
    "factor_correlation_matrix",
    sql("matrix", "SELECT factor_a, factor_b, round(corr, 6) + 0 AS corr, overlap_count FROM matrix"),
)
def factor_correlation_matrix(spark, sf):
    """Rank correlations of all factors from standardised columns."""
    return tidy(se.correlation_matrix(freeze(panel(spark, sf), "panel"), FACTORS))


def _exact_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS factor_a, '{b}' AS factor_b, corr(ra, rb) AS corr, count(*) AS overlap_count FROM (
      SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_EXACT = " UNION ALL ".join(_exact_sql(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :])


@query(
    "exact_pair_correlation",
    sql("panel", f"SELECT factor_a, factor_b, round(corr, 6) + 0 AS corr, overlap_count FROM ({_EXACT})"),
)
def exact_pair_correlation(spark, sf):
    """Rank correlations of all pairs over their common rows."""
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]], "factor_a string, factor_b string")
    return tidy(se.pair_correlation(freeze(panel(spark, sf), "panel"), pairs, FACTORS))


CONFLICT = 0.7


@query(
    "correlation_conflicts",
    sql(
        "matrix",
        f"""SELECT factor_a, factor_b, round(e.corr, 6) + 0 AS corr, round(abs(e.corr), 6) + 0 AS abs_corr, e.overlap_count FROM ({_EXACT}) e
          JOIN matrix m USING (factor_a, factor_b) WHERE abs(e.corr) >= {CONFLICT} AND abs(m.corr) >= {CONFLICT} AND e.overlap_count >= 100""",
    ),
)
def correlation_conflicts(spark, sf):
    """Factor pairs that say nearly the same, confirmed exactly."""
    p = freeze(panel(spark, sf), "panel")
    return tidy(se.correlation_conflicts(p, FACTORS, threshold=CONFLICT, min_pairs=100))


define(
    "clusters",
    f"""edges AS (SELECT factor_a AS a, factor_b AS b FROM matrix WHERE abs(corr) >= {CONFLICT} UNION SELECT factor_b, factor_a FROM matrix WHERE abs(corr) >= {CONFLICT}),
reach(a, b) AS (SELECT factor_name, factor_name FROM candidates UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
rooted AS (SELECT a AS factor_name, min(b) AS root FROM reach GROUP BY 1),
placed AS (SELECT factor_name, root, count(*) OVER (PARTITION BY root) AS cluster_size,
    first(factor_name) OVER (PARTITION BY root ORDER BY selection_score DESC, coverage_mean DESC, factor_name) AS representative
  FROM rooted JOIN candidates USING (factor_name)),
clusters AS (SELECT 'cluster_' || lpad(CAST(n AS VARCHAR), 4, '0') AS cluster_id, factor_name, representative, factor_name = representative AS is_representative, cluster_size
  FROM placed JOIN (SELECT root, row_number() OVER (ORDER BY max(cluster_size) DESC, root) AS n FROM placed GROUP BY root) USING (root))""",
    ("matrix", "candidates"),
)


def clusters(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = stored_panel(spark, sf)
    scored = candidates(spark, sf, p)
    pairs = freeze(se.conflicts(se.correlation_matrix(p, FACTORS), CONFLICT, 100), "conflicts")
    return scored, pairs, se.redundancy_clusters(scored, pairs)


@query("redundancy_clusters", sql("clusters", "SELECT * FROM clusters"))
def redundancy_clusters(spark, sf):
    """Groups of conflicting factors with their best member."""
    return clusters(spark, sf)[2]


@query(
    "final_pick",
    sql(
        "clusters",
        """SELECT factor_name, selected, CASE WHEN selected THEN '' WHEN beaten THEN 'high_corr_with:' || representative
            WHEN selection_status = 'candidate' THEN 'max_selected_cap' ELSE reject_reason END AS final_reject_reason FROM (
          SELECT *, coalesce(n <= 2, false) AS selected, selection_status = 'candidate' AND representative <> factor_name AS beaten FROM (
            SELECT c.*, representative, CASE WHEN selection_status = 'candidate' AND is_representative THEN row_number() OVER (
              PARTITION BY selection_status = 'candidate' AND is_representative ORDER BY selection_score DESC, factor_name) END AS n
            FROM candidates c JOIN clusters USING (factor_name)))""",
    ),
)
def final_pick(spark, sf):
    """At most two representatives, and why the others are out."""
    scored, pairs, groups = clusters(spark, sf)
    out = se.final_pick(scored, groups, pairs, 2)
    return out.select("factor_name", "selected", "final_reject_reason")


_REVIEW = [
    ("remove", f"{P}KLEN", None, "too close to range"),
    ("add_back", f"{P}KMID", None, "keep one body factor"),
    ("flag", f"{P}KMID", "watchlist", "new"),
    ("flag", f"{P}ROC5", "manual_review", "short history"),
    ("flag", f"{P}ROC5", "redundancy_risk", "see volume"),
    ("flag", f"{P}ROC5", "regime_factor", "follows the market"),
    ("flag", f"{P}KLEN", "market_state", "of a removed factor"),
    ("global_note", None, None, "few factors of volume"),
]
_AUTO = (f"{P}KLEN", f"{P}ROC5", "coarse")


@query(
    "review_selection",
    sql(
        "candidates",
        f"""SELECT factor_name, selection_status, CASE WHEN factor_name = '{P}KMID' THEN 'added_back' ELSE 'kept_auto' END AS review_action,
          CASE WHEN factor_name = '{P}KMID' THEN 'keep one body factor' ELSE '' END AS review_reason,
          CASE WHEN factor_name = '{P}KMID' THEN 'watchlist' WHEN factor_name = '{P}ROC5' THEN 'manual_review;redundancy_risk;state_factor' ELSE '' END AS review_flags
          FROM candidates WHERE factor_name IN ('{P}KMID', '{P}ROC5', 'coarse')""",
    ),
)
def review_selection(spark, sf):
    """A review applied to an automatic selection."""
    scored = candidates(spark, sf)
    review = spark.createDataFrame(_REVIEW, "action string, factor_name string, flag string, reason string")
    out = se.apply_review(scored, scored.where(F.col("factor_name").isin(*_AUTO)), review)
    return out.select("factor_name", "selection_status", "review_action", "review_reason", "review_flags")


@query(
    "existing_factors",
    sql(
        "candidates",
        f"""SELECT factor_name, selected FROM (SELECT factor_name, factor_name IN ('coarse') AS selected, selection_score FROM candidates)
          ORDER BY selected DESC, selection_score DESC, factor_name LIMIT 4""",
    ),
)
def existing_factors(spark, sf):
    """Known factors, selected first, at most four rows."""
    scored = candidates(spark, sf)
    return ct.existing_factors(scored, scored.where(F.col("factor_name") == "coarse"), 4).select("factor_name", "selected")


@query(
    "feature_list_choice",
    sql(
        "candidates",
        """SELECT 'both' AS given, factor_name, CAST(row_number() OVER (ORDER BY factor_name) AS INTEGER) AS place, 'reviewed' AS mode FROM candidates
            WHERE selection_status = 'candidate'
          UNION ALL SELECT 'auto only', factor_name, CAST(row_number() OVER (ORDER BY selection_score DESC, factor_name) AS INTEGER), 'auto' FROM candidates""",
    ),
)
def feature_list_choice(spark, sf):
    """The reviewed list where there is one, else the automatic one, each feature once."""
    scored = candidates(spark, sf)
    # one row per factor of the catalog
    by_score = Window.orderBy(F.col("selection_score").desc(), "factor_name")
    automatic = scored.select(F.row_number().over(by_score).alias("place"), "factor_name")
    kept = scored.where(F.col("selection_status") == "candidate")
    reviewed = kept.select(F.row_number().over(Window.orderBy("factor_name")).alias("place"), "factor_name")
    repeated = automatic.unionByName(automatic.withColumn("place", F.col("place") + 100))
    both = ct.chosen_features(reviewed, repeated).withColumn("given", F.lit("both"))
    return both.unionByName(ct.chosen_features(None, repeated).withColumn("given", F.lit("auto only")))


@query(
    "review_audit",
    sql(
        "candidates",
        f"""SELECT action, factor_name, applied, reason FROM (VALUES ('remove', '{P}KLEN', true, 'too close to range'),
            ('add_back', '{P}KMID', true, 'keep one body factor'), ('flag:watchlist', '{P}KMID', true, 'new'),
            ('flag:manual_review', '{P}ROC5', true, 'short history'), ('flag:redundancy_risk', '{P}ROC5', true, 'see volume'),
            ('flag:state_factor', '{P}ROC5', true, 'follows the market'), ('flag:state_factor', '{P}KLEN', false, 'of a removed factor'),
            ('global_note', '', true, 'few factors of volume'))
            t(action, factor_name, applied, reason) WHERE factor_name IN (SELECT factor_name FROM candidates) OR factor_name = ''""",
    ),
)
def review_audit(spark, sf):
    """What each review item did."""
    scored = candidates(spark, sf)
    review = spark.createDataFrame(_REVIEW, "action string, factor_name string, flag string, reason string")
    after = se.apply_review(scored, scored.where(F.col("factor_name").isin(*_AUTO)), review)
    return se.review_audit(after, review)


_BAD_REVIEW = [
    *_REVIEW,
    ("remove", "coarser", None, "no such factor"),
    ("remove", f"{P}KMID", None, "was never in"),
    ("add_back", "coarse", None, "is in already"),
    ("flag", "coarse", "event_factor", "an alias is no problem"),
    ("flag", "coarse", "nonsense", "no such flag"),
    ("flag", f"{P}ROC5", "watchlist", " "),
]


@query(
    "review_problems",
    sql(
        "candidates",
        f"""SELECT action, factor_name, flag, rule FROM (VALUES ('remove', 'coarser', NULL, 'unknown factor'), ('remove', '{P}KMID', NULL, 'not selected'),
            ('add_back', 'coarse', NULL, 'already selected'), ('flag', 'coarse', 'nonsense', 'unknown flag'), ('flag', '{P}ROC5', 'watchlist', 'no reason'))
            t(action, factor_name, flag, rule) WHERE rule = 'unknown factor' OR factor_name IN (SELECT factor_name FROM candidates)""",
    ),
)
def review_problems(spark, sf):
    """Review items that break a rule."""
    scored = candidates(spark, sf)
    review = spark.createDataFrame(_BAD_REVIEW, "action string, factor_name string, flag string, reason string")
    found = se.review_problems(scored, scored.where(F.col("factor_name").isin(*_AUTO)), review, allow_failed=True)
    return found.select("action", "factor_name", "flag", "rule")


# -- catalog, panels, keys, scaler --------------------------------------------------------


@query(
    "feature_panel",
    sql(
        "panel metric",
        f"SELECT p.sample_id, {rounded(['coarse', P + 'KMID'], source='p')}, round(m.metric_pe, 6) + 0 AS metric_pe FROM panel p "
        "LEFT JOIN base m ON m.stock_code = p.stock_code AND m.trade_date = p.feature_asof_date WHERE month(p.target_trade_date) = 6",
        METRIC_BASE,
    ),
)
def feature_panel_query(spark, sf):
    """Chosen features of two blocks for the samples of one month of every year."""
    p = panel(spark, sf)
    metric = vf.value_factors(tables.metric(spark, sf), delta_windows=(), mean_windows=()).output()
    keys = p.select("sample_id", "stock_code", "feature_asof_date")
    second = align_to_samples(keys, metric.select("stock_code", "trade_date", "metric_pe")).select("sample_id", "metric_pe")
    wanted = p.where(F.month("target_trade_date") == 6).select("sample_id")
    return tidy(feature_panel([p.select("sample_id", *FACTORS), second], ["coarse", f"{P}KMID", "metric_pe"], wanted))


@query(
    "point_in_time_alignment",
    sql("panel", f"SELECT sample_id, feature_asof_date, target_trade_date, {rounded(FACTORS)} FROM panel"),
)
def point_in_time_alignment(spark, sf):
    """Daily factors at each sample's feature date."""
    return tidy(panel(spark, sf).select("sample_id", "feature_asof_date", "target_trade_date", *FACTORS))


@query(
    "key_uniqueness",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def key_uniqueness(spark, sf):
    """Order lines whose key is not unique."""
    return ky.duplicate_keys(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_SCALED = [f"{P}KMID", f"{P}ROC5", "coarse"]
_TRAIN = "target_trade_date < DATE '1999-01-01'"
_FIT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS std FROM panel WHERE {_TRAIN}"
    for c in _SCALED
)


@query("scaler_fit", sql("panel", f"SELECT feature, {rounded(['median', 'mean', 'std'])} FROM ({_FIT})"))
def scaler_fit(spark, sf):
    """Median, mean and deviation of features over the train split."""
    train = ky.split_filter(panel(spark, sf), "train", {"train": ("1990-01-01", "1998-12-31")})
    return tidy(fit_scaler(train, _SCALED))


@query(
    "scaler_transform",
    sql(
        "panel",
        "SELECT sample_id, "
        + ", ".join(f"round((coalesce({c}, (SELECT median FROM fit WHERE feature = '{c}')) - (SELECT mean FROM fit WHERE feature = '{c}')) / (SELECT std FROM fit WHERE feature = '{c}'), 6) + 0 AS {c}, "
                    f"{c} IS NOT NULL AS {c}_present" for c in _SCALED)
        + " FROM panel WHERE target_trade_date >= DATE '1999-01-01'",
        f"fit AS ({_FIT})",
    ),
)
def scaler_transform(spark, sf):
    """Later samples standardised with the train split's scaler."""
    ranges = {"train": ("1990-01-01", "1998-12-31"), "holdout": ("1999-01-01", None)}
    p = panel(spark, sf)
    state = fit_scaler(ky.split_filter(p, "train", ranges), _SCALED)
    out = apply_scaler(ky.split_filter(p, "holdout", ranges), state, _SCALED)
    return tidy(out.select("sample_id", *[n for c in _SCALED for n in (c, f"{c}_present")]))
