"""Correlations and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import stats as S
from ..session import fresh_path
from ..sources.tables import layer
from .registry import query
from .shape import rounded

SPLIT = "1998-01-01"
FEATURES = ["price", "quantity", "discount", "even", "constant", "absent", "unit_price"]


def halves(t):
    """Reference rows, and later rows with higher prices."""
    old = t.features.filter(F.col("event_datetime") < SPLIT)
    new = t.features.filter(F.col("event_datetime") >= SPLIT).withColumn("price", F.col("price") + 50000)
    return old, new


_LONG = ", ".join(f"('{f}', CAST({f} AS DOUBLE))" for f in FEATURES)


def _fit_sql(bins):
    shares = ", ".join(f"{i}.0 / {bins}" for i in range(bins + 1))
    return f"""lo AS (SELECT u.f AS feature, u.v FROM features, LATERAL (SELECT unnest([{', '.join(f"{{'f': '{f}', 'v': CAST({f} AS DOUBLE)}}" for f in FEATURES)}], recursive := true)) u
      WHERE event_datetime < '{SPLIT}' AND u.v IS NOT NULL),
  nw AS (SELECT u.f AS feature, u.v FROM (SELECT * REPLACE (price + 50000 AS price) FROM features WHERE event_datetime >= '{SPLIT}') g,
      LATERAL (SELECT unnest([{', '.join(f"{{'f': '{f}', 'v': CAST({f} AS DOUBLE)}}" for f in FEATURES)}], recursive := true)) u WHERE u.v IS NOT NULL),
  st AS (SELECT feature, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, list_sort(list_distinct(quantile_cont(v, [{shares}]))) AS bins FROM lo GROUP BY 1
      HAVING count(*) >= 10 AND stddev_pop(v) >= 1e-8 AND count(DISTINCT v) >= {bins}),
  eg AS (SELECT feature, len(bins) - 1 AS nb, generate_subscripts(bins, 1) AS i, unnest(bins) AS e, bins FROM st),
  bn AS (SELECT feature, i, nb, e AS a, bins[i + 1] AS b FROM eg WHERE i <= nb),
  rc AS (SELECT bn.feature, bn.i, count(lo.v) AS c FROM bn LEFT JOIN lo ON lo.feature = bn.feature AND lo.v >= bn.a AND (lo.v < bn.b OR (bn.i = bn.nb AND lo.v = bn.b)) GROUP BY 1, 2),
  nc AS (SELECT bn.feature, bn.i, count(nw.v) AS c FROM bn LEFT JOIN nw ON nw.feature = bn.feature AND nw.v >= bn.a AND (nw.v < bn.b OR (bn.i = bn.nb AND nw.v = bn.b)) GROUP BY 1, 2)"""


_PSI = """,
  sh AS (SELECT rc.feature, greatest(rc.c / (sum(rc.c) OVER (PARTITION BY rc.feature)), 1e-6) AS o, greatest(nc.c / greatest(sum(nc.c) OVER (PARTITION BY rc.feature), 1), 1e-6) AS w
      FROM rc JOIN nc ON rc.feature = nc.feature AND rc.i = nc.i),
  ps AS (SELECT feature, greatest(sum((w - o) * ln(w / o)), 0) AS psi FROM sh GROUP BY 1),
  rp AS (SELECT ps.feature, ps.psi, CASE WHEN psi < 0.1 THEN 'GREEN' WHEN psi < 0.2 THEN 'AMBER' ELSE 'RED' END AS status, st.mean AS mean_train, m.mean_new,
      CASE WHEN psi >= 0.2 THEN 1 ELSE 0 END AS alert FROM ps JOIN st USING (feature) JOIN (SELECT feature, avg(v) AS mean_new, count(*) AS k FROM nw GROUP BY 1) m USING (feature) WHERE k >= 5)"""


@query("i25_psi_reference", uses="features", sql=f"""WITH {_fit_sql(8)}
  SELECT bn.feature, CAST(bn.i AS INT) AS bin, round(bn.a, 6) AS bin_from, round(bn.b, 6) AS bin_to, rc.c AS ref_count, round(st.mean, 6) AS mean, round(st.std, 6) AS std
  FROM bn JOIN rc ON bn.feature = rc.feature AND bn.i = rc.i JOIN st ON bn.feature = st.feature""")
def _(t):
    ref = D.fit_reference(halves(t)[0], FEATURES, 8)
    out = ref.select("feature", "bins", "mean", "std", F.posexplode("ref_counts").alias("i", "ref_count"))
    return rounded(out.select("feature", (F.col("i") + 1).alias("bin"), F.element_at("bins", F.col("i") + 1).alias("bin_from"),
                              F.element_at("bins", F.col("i") + 2).alias("bin_to"), "ref_count", "mean", "std"))


def report(t):
    """The reference is fitted once and saved, as a training run would; detection reads it."""
    old, new = halves(t)
    reference = layer(D.fit_reference(old, FEATURES, 8), fresh_path(t.spark, "reference") + ".parquet")
    return D.detect(new, reference, FEATURES)


@query("i26_psi_drift", uses="features", sql=f"""WITH {_fit_sql(8)}{_PSI}
  SELECT feature, round(psi, 6) AS psi, status, round(mean_train, 6) AS mean_train, round(mean_new, 6) AS mean_new, alert FROM rp""")
def _(t):
    return rounded(report(t))


@query("i27_label_shift", uses="features", sql=f"""
  WITH r AS (SELECT avg(y) FILTER (event_datetime < '{SPLIT}') AS a, avg(y) FILTER (event_datetime >= '{SPLIT}') AS b FROM features)
  SELECT round(a, 6) AS reference_rate, round(b, 6) AS current_rate, round(abs(b - a), 6) AS shift, CASE WHEN abs(b - a) > 0.1 THEN 1 ELSE 0 END AS shifted FROM r""")
def _(t):
    old, new = halves(t)
    return rounded(D.label_shift(old, new, "y"))


@query("f08_top_drift", uses="features", sql=f"WITH {_fit_sql(8)}{_PSI} SELECT feature, round(psi, 6) AS psi, status AS level FROM rp ORDER BY psi DESC, feature LIMIT 20")
def _(t):
    return rounded(D.top_drift(report(t)))


@query("f08_flagged_drift", uses="features", sql=f"""WITH {_fit_sql(8)}{_PSI}
  SELECT feature, round(mean_train, 6) AS mean_train, round(mean_new, 6) AS mean_new, round(psi, 6) AS psi FROM rp WHERE status = 'RED'""")
def _(t):
    return rounded(D.flagged_drift(report(t)))


@query("d37_drift_headline", uses="features", sql=f"""WITH {_fit_sql(8)}{_PSI}
  SELECT count(*) AS n_checks, count(*) FILTER (status = 'RED') AS n_flagged, count(*) FILTER (status <> 'RED') AS n_stable,
    CASE WHEN count(*) FILTER (status = 'RED') = 0 THEN 'ok' WHEN count(*) FILTER (status = 'RED') <= 3 THEN 'warning' ELSE 'error' END AS banner FROM rp""")
def _(t):
    return D.drift_headline(report(t))


_CORR = ["price", "quantity", "discount", "even", "constant", "absent", "unit_price"]


@query("i23_label_correlation", uses="features", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS n, round(corr(CAST({f} AS DOUBLE), y), 6) AS r_pb FROM features HAVING count({f}) >= 30 AND count(DISTINCT {f}) >= 2" for f in _CORR))
def _(t):
    return rounded(S.label_correlation(t.features, "y", _CORR, with_p=False))


@query("i23_label_correlation_p")
def _(t):
    """With p-values, which SQL has no function for; checked against known values in the tests."""
    return S.label_correlation(t.features, "y", _CORR).orderBy(F.abs("r_pb").desc(), "feature")


_MAT = ["price", "quantity", "discount", "constant", "even", "absent", "unit_price"]


@query("i24_correlation_matrix", uses="features", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("max(NULL::DOUBLE)" if {"constant", "absent"} & {a, b} else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)") + " AS r FROM features"
    for a in _MAT for b in _MAT))
def _(t):
    return rounded(S.correlation_matrix(t.features, _MAT))
