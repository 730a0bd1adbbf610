"""Tables of a factor search: candidates, evaluations and runs, as an append-only log with a latest-row view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The newest row of each key; of equal times the one of the greater row hash."""
    others = [c for c in log.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.xxhash64(*others))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """current with the changes inserted or replaced by key: both logs together, seen at their latest rows."""
    return latest(current.unionByName(changes, allowMissingColumns=True), keys, at)


CANDIDATES_SQL = """
SELECT p_partkey AS candidate_id, p_brand AS family, 1 + p_partkey % 4 AS round_id,
       concat(p_brand, ':', CAST(1 + p_partkey % 4 AS VARCHAR(20))) AS run_id,
       CASE WHEN p_partkey >= 45 THEN p_partkey - 40 - p_partkey % 5 END AS parent_candidate_id,
       CASE WHEN p_partkey % 4 = 0 AND p_partkey < 40 THEN 'parent' ELSE 'candidate' END AS role,
       concat('llm.f', CAST(p_partkey AS VARCHAR(20))) AS factor_name,
       CASE p_partkey % 9
         WHEN 0 THEN concat('neg(ts_mean(', f, ', ', w, '))') WHEN 1 THEN concat('cs_rank(ts_std(', f, ', ', w, '))')
         WHEN 2 THEN concat('div(ema(', f, ', ', w, '), ts_std(', f, ', 20))') WHEN 3 THEN concat('mul(ts_corr(', f, ', volume, ', w, '), 2)')
         WHEN 4 THEN concat('where(gt(', f, ', delay(', f, ', ', w, ')), ', f, ', 0)') WHEN 5 THEN concat('ts_rank(div(', f, ', ts_std(', f, ', ', w, ')), 10)')
         WHEN 6 THEN concat('rel_volume(', w, ')') WHEN 7 THEN concat('sub(ts_mean(', f, ', 5), add(ts_mean(', f, ', 20), ts_mean(', f, ', 60)))')
         ELSE concat('decay_linear(cs_rank(', f, '), ', w, ')') END AS expression,
       CASE p_type WHEN 'ECONOMY' THEN 'model_a' WHEN 'STANDARD' THEN 'model_b' ELSE 'model_c' END AS source_model,
       CASE p_partkey % 11 WHEN 0 THEN 'research_winner' WHEN 1 THEN 'research_keep' WHEN 2 THEN 'research_keep' WHEN 3 THEN 'research_keep_exploratory'
            WHEN 4 THEN 'drop_redundant_parent' WHEN 5 THEN 'proposed' WHEN 6 THEN 'drop_redundant_family_exact' ELSE 'research_drop' END AS status,
       CASE p_partkey % 11 WHEN 4 THEN concat('redundant: corr with parent=0.', CAST(85 + p_size % 15 AS VARCHAR(20))) WHEN 6 THEN 'same expression as archived family factor'
            WHEN 7 THEN 'turnover too high' WHEN 8 THEN 'does not beat parent' WHEN 9 THEN 'evaluation failed' END AS reason,
       CASE WHEN p_partkey % 2 = 0 THEN 'raw_alpha' ELSE 'complementarity' END AS target_profile
FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'close' ELSE 'volume' END AS f, CAST(5 + 5 * (p_size % 4) AS VARCHAR(20)) AS w FROM part) AS p
"""
#: Metrics, the mean absolute correlation with styles, and correlations with three earlier factors.
EVALUATIONS_SQL = """
SELECT l_partkey AS candidate_id, round(avg(l_discount) - 0.05, 12) AS quick_rank_ic_mean,
       round(3 * (avg(l_discount) - 0.05) / NULLIF(stddev_samp(l_discount), 0), 12) AS quick_rank_icir,
       round((avg(l_tax) - 0.04) * 40, 12) AS net_ann_return,
       CASE WHEN l_partkey % 13 <> 0 THEN round((avg(l_tax) - avg(l_discount) * 0.8) * 8, 12) END AS net_excess_ann_return,
       round((avg(l_quantity) - 25) / 2 + 1, 12) AS net_sharpe, CASE WHEN l_partkey % 17 <> 0 THEN round(stddev_samp(l_quantity) / 40 - 0.1, 12) END AS mean_turnover,
       round(abs(corr(l_quantity, l_tax)), 9) AS avg_abs_style_corr,
       round(corr(l_extendedprice, l_extendedprice * (1 - 9 * l_discount)), 9) AS corr_net,
       round(corr(l_extendedprice, l_extendedprice * l_tax), 9) AS corr_fee,
       round(corr(l_quantity, l_extendedprice), 9) AS corr_size
FROM lineitem GROUP BY l_partkey
"""


#: A monthly series for each candidate's factor, made of its part's order lines.
SERIES_SQL = """
SELECT concat('llm.f', CAST(l_partkey AS VARCHAR(20))) AS name, date_trunc('month', l_shipdate) AS key, avg(l_extendedprice) AS value
FROM lineitem GROUP BY l_partkey, date_trunc('month', l_shipdate)
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, key (month), value of each candidate's factor."""
    return spark.sql(SERIES_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made of parts: id, family, round, run, parent, role, name, expression, model, status, reason, profile."""
    return spark.sql(CANDIDATES_SQL.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics a candidate, made of order lines.

    A part's lines are brought together and added up in the order of their values, so that equal lines give equal metrics
    to the last bit wherever they lie, and ties between candidates stay ties. They are shuffled as lines, not as partial moments.
    """
    values = ["l_discount", "l_tax", "l_quantity", "l_extendedprice"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", *values)
    ordered = lines.repartition("l_partkey").sortWithinPartitions("l_partkey", *values)
    return spark.sql(EVALUATIONS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=ordered)


TARGETS = ("net", "fee", "size")


def diagnosed(df: DataFrame) -> DataFrame:
    """Adds nearest_target, corr_to_nearest_target and avg_abs_target_corr from the correlations with the targets."""
    cells = F.filter(F.array(*[F.struct(F.abs(f"corr_{t}").alias("r"), F.lit(t).alias("t")) for t in TARGETS]), lambda x: x.r.isNotNull())
    best = F.array_max(cells)
    total = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x.r)
    return df.withColumns({"nearest_target": best.t, "corr_to_nearest_target": best.r, "avg_abs_target_corr": F.when(F.size(cells) > 0, total / F.size(cells))})


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their metrics (missing where not evaluated), neutral metrics (a fixed map of the raw ones) and nearest targets."""
    rows = candidates(spark, sf_dir).join(evaluations(spark, sf_dir), "candidate_id", "left")
    return diagnosed(rows.withColumns({f"neutral_{m}": F.col(m) * 0.6 - 0.1 for m in ("quick_rank_icir", "net_sharpe")}))
