"""Splits and exact metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import splits as S
from .registry import query
from .shape import rounded

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_MD5 = "CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 42)), 1, 8)) AS BIGINT) % 10000"


@query("i01_hash_split", uses="scored", sql=f"""
  SELECT CASE WHEN {_MD5} < 2000 THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS positive_share FROM scored GROUP BY 1""")
def _(t):
    x = t.scored.withColumn("part", F.when(S.split_flag(KEY, 0.2, 42), "test").otherwise("train"))
    return rounded(S.class_shares(x, "part", "y"))


@query("i01_stratified_split", uses="scored", sql=f"""
  WITH h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', {", ".join(KEY)}, '42')), 1, 15) AS BIGINT) AS h FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) AS k, count(*) OVER (PARTITION BY y) AS n FROM h)
  SELECT CASE WHEN k <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS positive_share FROM r GROUP BY 1""")
def _(t):
    """The same share of each class in both parts, to the row."""
    return rounded(S.class_shares(S.stratified_split(t.scored, KEY, "y", 0.2, 42), "part", "y"))


@query("i02_temporal_split", uses="slv_iz", sql="""
  WITH m AS (SELECT year_month, row_number() OVER (ORDER BY year_month DESC) AS r FROM (SELECT DISTINCT year_month FROM slv_iz WHERE year_month IS NOT NULL))
  SELECT s.visit_no, s.year_month, CASE WHEN r = 1 THEN 'test' WHEN r = 2 THEN 'valid' ELSE 'train' END AS split FROM slv_iz s JOIN m USING (year_month)""")
def _(t):
    x = t.iz.select("visit_no", F.date_format(F.col("reported").try_cast("timestamp"), "yyyy-MM").alias("year_month"))
    return S.temporal_split(x, "year_month").select("visit_no", "year_month", "split")


def _curve(score, group=""):
    """Cumulative class counts per distinct score, highest first."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""s AS (SELECT {g}{score} AS sc, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY {g}{score}),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS ({part}ORDER BY sc DESC ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT {g}CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, sum(neg * (tp + tp - pos) / 2) / (sum(pos) * sum(neg)) AS roc_auc,
    sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision,
    sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2) / sum(pos) AS pr_auc_trapezoid
    FROM c {f'GROUP BY {group}' if group else ''})"""


for _name, _score in (("ties", "p"), ("many", "p_many"), ("fine", "p_fine")):
    @query(f"i12_roc_auc_{_name}", uses="scored", sql=f"WITH {_curve(_score)} SELECT n, positives, round(roc_auc, 6) AS roc_auc FROM a")
    def _(t, s=_score):
        return rounded(M.curve_areas(t.scored, "y", s).select("n", "positives", "roc_auc"))


@query("i13_average_precision", uses="scored", sql=f"WITH {_curve('p')} SELECT round(average_precision, 6) AS average_precision FROM a")
def _(t):
    return rounded(M.curve_areas(t.scored, "y", "p").select("average_precision"))


@query("i14_pr_auc_trapezoid", uses="scored", sql=f"WITH {_curve('p_fine')} SELECT round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM a")
def _(t):
    return rounded(M.curve_areas(t.scored, "y", "p_fine").select("pr_auc_trapezoid"))


@query("i14_curve_points", uses="scored", sql=f"""WITH {_curve('p_fine')}
  SELECT sc AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(fp / (SELECT sum(neg) FROM s), 6) AS fpr, round(tp / (SELECT sum(pos) FROM s), 6) AS tpr,
    round(tp / (tp + fp), 6) AS precision FROM c""")
def _(t):
    return rounded(M.curve_points(t.scored, "y", "p_fine"))


_CELLS = """t AS (SELECT count(*) AS n, CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (p < 0.5 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (p < 0.5 AND y = 0) AS DOUBLE) AS tn, avg((p - y) * (p - y)) AS brier FROM scored)"""


@query("i15_point_metrics", uses="scored", sql=f"""WITH {_CELLS}
  SELECT n, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(brier, 6) AS brier_score FROM t""")
def _(t):
    return rounded(M.point_metrics(t.scored, "y", "p"))


@query("i16_expected_calibration_error", uses="scored", sql="""
  WITH b AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM scored GROUP BY 1)
  SELECT round(sum(CASE WHEN b < 10 THEN abs(a - c) * n ELSE 0 END) / sum(n), 6) AS expected_calibration_error FROM b""")
def _(t):
    return rounded(M.expected_calibration_error(t.scored, "y", "p"))


@query("i17_calibration_curve_8", uses="scored", sql="""
  SELECT CAST(floor(p_many * 8) AS INT) AS bin, count(*) AS n, round(avg(p_many), 6) AS mean_score, round(avg(y), 6) AS positive_share FROM scored WHERE p_many < 1 GROUP BY 1""")
def _(t):
    return rounded(M.calibration_bins(t.scored, "y", "p_many", 8))


@query("i17_calibration_curve_10_right", uses="scored", sql="""
  SELECT CAST(greatest(ceil(p * 10) - 1, 0) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS positive_share FROM scored GROUP BY 1""")
def _(t):
    return rounded(M.calibration_bins(t.scored, "y", "p", 10, right_closed=True))


@query("i18_confusion_matrix", uses="scored", sql="SELECT y AS actual, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def _(t):
    return M.confusion(t.scored, "y", "p")


@query("i18_class_report", uses="scored", sql=f"""WITH {_CELLS},
  k AS (SELECT '0' AS class, tn / (tn + fn) AS pr, tn / (tn + fp) AS re, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS su FROM t
    UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM t)
  SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(su AS BIGINT) AS support FROM k
  UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), n FROM t
  UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(su) AS BIGINT) FROM k
  UNION ALL SELECT 'weighted avg', round(sum(pr * su) / sum(su), 6), round(sum(re * su) / sum(su), 6), round(sum(f1 * su) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM k""")
def _(t):
    return rounded(M.class_report(t.scored, "y", "p"))


def _thresholds_sql(values, score):
    return f"""WITH g AS (SELECT unnest([{', '.join(values)}])::DOUBLE AS t),
  x AS (SELECT g.t, CAST(count(*) FILTER ({score} >= g.t) AS DOUBLE) AS fl, CAST(count(*) FILTER ({score} >= g.t AND y = 1) AS DOUBLE) AS tp, CAST(sum(y) AS DOUBLE) AS ps, count(*) AS n FROM scored, g GROUP BY g.t)
  SELECT t AS threshold, CAST(fl AS BIGINT) AS flagged, round(100 * fl / n, 6) AS flagged_pct, round(CASE WHEN fl > 0 THEN tp / fl ELSE 0 END, 6) AS precision,
    round(tp / ps, 6) AS recall, round(CASE WHEN fl + ps > 0 THEN 2 * tp / (fl + ps) ELSE 0 END, 6) AS f1 FROM x"""


@query("i19_threshold_table_16", uses="scored", sql=_thresholds_sql([str(i / 20) for i in range(2, 18)], "p"))
def _(t):
    return rounded(M.threshold_table(t.scored, "y", "p"))


@query("i19_threshold_table_8", uses="scored", sql=_thresholds_sql([str(i / 10) for i in range(1, 9)], "p_fine"))
def _(t):
    return rounded(M.threshold_table(t.scored, "y", "p_fine", tuple(i / 10 for i in range(1, 9))))


_FAIR = f"""WITH sx AS (WITH {_curve('p_fine', 'sex')} SELECT 'sex' AS dimension, sex AS group_value, * EXCLUDE (sex) FROM a),
  cy AS (WITH {_curve('p_fine', 'county_code')} SELECT 'county' AS dimension, CAST(county_code AS VARCHAR) AS group_value, * EXCLUDE (county_code) FROM a),
  f AS (SELECT * FROM sx UNION ALL SELECT * FROM cy)"""


def fairness(t):
    return M.group_fairness(t.scored, "y", "p_fine", {"sex": "sex", "county": "county_code"})


@query("i20_group_fairness", uses="scored", sql=_FAIR + """
  SELECT dimension, group_value, n, round(positives / n, 6) AS positive_rate, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM f WHERE n >= 3""")
def _(t):
    return rounded(fairness(t))


@query("i21_auc_gap", uses="scored", sql=_FAIR + """
  SELECT dimension, round(max(roc_auc) - min(roc_auc), 6) AS auc_gap, count(*) AS n_groups, CASE WHEN max(roc_auc) - min(roc_auc) <= 0.1 THEN 1 ELSE 0 END AS within_limit FROM f GROUP BY 1""")
def _(t):
    return rounded(M.fairness_gap(fairness(t)))


@query("f02_top_k_threshold", uses="scored", sql="""
  WITH r AS (SELECT p_many, row_number() OVER (ORDER BY p_many DESC) AS k, count(*) OVER () AS n FROM scored) SELECT p_many AS threshold FROM r WHERE k = greatest(1, CAST(floor(n * 0.2) AS BIGINT))""")
def _(t):
    return M.top_k_threshold(t.scored, "p_many", 0.2)


@query("f03_precision_at_share", uses="scored", sql="""
  WITH r AS (SELECT y, row_number() OVER (ORDER BY p DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER () AS n FROM scored)
  SELECT count(*) AS n_top, round(avg(y), 6) AS precision_at_share FROM r WHERE k <= greatest(1, CAST(floor(n * 0.2) AS BIGINT))""")
def _(t):
    return rounded(M.precision_at_share(t.scored, "y", "p", KEY))


@query("i33_deployment_gates", uses="scored", sql=f"""WITH c AS (WITH {_curve('p')} SELECT * FROM a),
  b AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM scored GROUP BY 1),
  e AS (SELECT sum(CASE WHEN b < 10 THEN abs(a - c) * n ELSE 0 END) / sum(n) AS ece FROM b),
  r AS (SELECT y, row_number() OVER (ORDER BY p DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER () AS n FROM scored),
  g AS ({_FAIR} SELECT max(gap) AS gap FROM (SELECT max(roc_auc) - min(roc_auc) AS gap FROM f GROUP BY dimension)),
  v AS (SELECT 'pr_auc' AS metric, average_precision AS value, 0.5::DOUBLE AS limit_value, 'min' AS kind FROM c
    UNION ALL SELECT 'roc_auc', roc_auc, 0.65, 'min' FROM c
    UNION ALL SELECT 'precision_at_20pct', avg(y), 0.4, 'min' FROM r WHERE k <= greatest(1, CAST(floor(n * 0.2) AS BIGINT))
    UNION ALL SELECT 'expected_calibration_error', ece, 0.15, 'max' FROM e
    UNION ALL SELECT 'auc_gap', gap, 0.1, 'max' FROM g)
  SELECT metric, round(value, 6) AS value, limit_value, kind, CASE WHEN kind = 'min' AND value >= limit_value OR kind = 'max' AND value <= limit_value THEN 1 ELSE 0 END AS passed FROM v""")
def _(t):
    """All five limits; the gap is the largest over the dimensions of the fairness table."""
    areas = M.curve_areas(t.scored, "y", "p").select(F.col("average_precision").alias("pr_auc"), "roc_auc")
    top = M.precision_at_share(t.scored, "y", "p", KEY).select("precision_at_share")
    gap = M.fairness_gap(fairness(t)).agg(F.max("auc_gap"))
    row = areas.withColumns({
        "expected_calibration_error": M.expected_calibration_error(t.scored, "y", "p").scalar(), "precision_at_20pct": top.scalar(), "auc_gap": gap.scalar()})
    return rounded(M.deployment_gates(row))
