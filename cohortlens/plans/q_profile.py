"""Profiling queries (A*) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import PAIN_BINS, cut, cut_sql
from ..operators import profile as PR
from ..operators.outliers import handle_outliers
from ..sources.tables import read_table
from . import fixtures as FX
from .registry import register
from .sqlgen import iqr_cap, per_col, union

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ENC_COLS = [c for c, _ in FX.ENCOUNTER_EXPRS]
ENC = FX.with_views("encounters")
SC = FX.with_views("scored")


def li(spark, sf):
    return read_table(spark, sf, "lineitem")


register("a01_shape", "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols FROM lineitem",
         family="profile")(lambda s, d: PR.shape(li(s, d)))

register("a02_describe",
         per_col(LI, "SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
                 "CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
                 "quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"),
         doubles=["mean", "std", "min", "q25", "q50", "q75", "max"], family="profile")(
    lambda s, d: PR.describe(li(s, d), LI))


def _q_missing(s, d):
    from ..operators.missing import missing_report
    return missing_report(FX.encounters(s, d))


register("a03_missing_report",
         ENC + "SELECT *, CASE WHEN pct_null > 50 THEN 'Consider dropping this column' WHEN pct_null > 20 THEN "
         "'Impute using advanced methods (KNN, MICE)' ELSE 'Impute using median/mode' END AS advice FROM ("
         + per_col(ENC_COLS, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
                   "(count(*) - count({c})) * 100.0 / count(*) AS pct_null FROM encounters") + ") t WHERE n_null > 0",
         doubles=["pct_null"], family="profile")(_q_missing)

register("a04_class_distribution",
         ENC + "SELECT appendicitis, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct "
         "FROM encounters GROUP BY appendicitis", doubles=["pct"], family="profile")(
    lambda s, d: PR.class_distribution(FX.encounters(s, d), "appendicitis"))

A5 = ["age", "gender", "duration", "migration", "site", "us_finding", "appendicitis"]
register("a05_distinct_profile",
         ENC + per_col(A5, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, "
                       "count(DISTINCT {c}) / count(*) AS distinct_ratio, count(DISTINCT {c}) = 2 AS is_binary, "
                       "count(DISTINCT {c}) <= 2 AS target_candidate FROM encounters"),
         doubles=["distinct_ratio"], family="profile")(
    lambda s, d: PR.distinct_profile(FX.encounters(s, d), A5))

A7 = ["l_quantity", "l_discount", "l_tax"]
register("a07_mean_median_mode",
         per_col(A7, "SELECT '{c}' AS \"column\", avg({c}) AS mean, "
                 "(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) "
                 "ORDER BY n DESC, v ASC LIMIT 1) AS mode, median({c}) AS median FROM lineitem"),
         doubles=["mean", "mode", "median"], family="profile")(lambda s, d: PR.center_stats(li(s, d), A7))

PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _q_quant(s, d):
    from ..functions.ordering import quantiles
    return quantiles(li(s, d), LI, PROBS)


register("a08_exact_quantiles",
         union([f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, quantile_cont({c}, {p}) AS value "
                f"FROM lineitem" for c in LI for p in PROBS]),
         doubles=["prob", "value"], family="profile")(_q_quant)

register("a09_std_samp_pop",
         per_col(LI, "SELECT '{c}' AS \"column\", stddev_samp({c}) AS std_samp, stddev_pop({c}) AS std_pop FROM lineitem"),
         doubles=["std_samp", "std_pop"], family="profile")(lambda s, d: PR.stds(li(s, d), LI))

PAIRS = [(a, b) for i, a in enumerate(LI) for b in LI[i + 1:]]
register("a10_corr_matrix",
         union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM lineitem" for a, b in PAIRS]),
         doubles=["corr"], family="profile")(lambda s, d: PR.corr_pairs(li(s, d), LI))

FEATS = [c for c in FX.MODEL_FEATURES]
register("a11_target_corr",
         SC + per_col(FEATS, "SELECT '{c}' AS \"column\", corr({c}, appendicitis) AS corr, "
                      "abs(corr({c}, appendicitis)) AS abs_corr FROM scored"),
         doubles=["corr", "abs_corr"], family="profile")(
    lambda s, d: PR.target_correlations(FX.scored_encounters(s, d), FEATS, "appendicitis"))

FP = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
register("a12_high_corr_pairs",
         SC + "SELECT * FROM (" + union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM scored"
                                         for a, b in FP]) + ") t WHERE abs(corr) > 0.7",
         doubles=["corr"], family="profile")(lambda s, d: PR.high_corr_pairs(FX.scored_encounters(s, d), FEATS))

A13 = ["age", "duration"] + FX.LABS + ["alvarado_score"]
register("a13_group_means_by_label",
         SC + "SELECT appendicitis, " + ", ".join(f"avg({c}) AS {c}" for c in A13) + " FROM scored GROUP BY 1",
         doubles=A13, family="profile")(lambda s, d: PR.group_means(FX.scored_encounters(s, d), A13, "appendicitis"))

register("a14_crosstab",
         "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS n_F, count_if(o_orderstatus = 'O') AS n_O, "
         "count_if(o_orderstatus = 'P') AS n_P, count(*) AS n, count_if(o_orderstatus = 'P') * 100.0 / count(*) AS pct_P "
         "FROM orders GROUP BY 1", doubles=["pct_P"], family="profile")(
    lambda s, d: PR.crosstab(read_table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))

register("a15_binned_counts",
         ENC + f"SELECT {cut_sql('duration', *PAIN_BINS)} AS bin, count(*) AS n, count(*) / sum(count(*)) OVER () AS share "
         "FROM encounters GROUP BY 1", doubles=["share"], family="profile")(
    lambda s, d: PR.binned_counts(FX.encounters(s, d), cut("duration", *PAIN_BINS)))


def _q_probhist(s, d):
    from ..operators.features import rule_score
    return PR.prob_histogram(rule_score(FX.scored_encounters(s, d)), "rule_probability")


register("a16_probability_bands",
         SC + "SELECT CAST(least(floor(p * 5), 4) AS INTEGER) AS band, count(*) AS n FROM "
         "(SELECT least(greatest(alvarado_score / 10.0, 0.05), 0.95) AS p FROM scored) t GROUP BY 1",
         family="profile")(_q_probhist)

register("a23_equal_width_histogram",
         "SELECT CAST(least(floor((value - 0.0) / 100.0) + 1, 5) AS INTEGER) AS bin, count(*) AS n FROM events "
         "WHERE value IS NOT NULL GROUP BY 1", family="profile")(
    lambda s, d: PR.equal_width_hist(read_table(s, d, "events"), "value", 0.0, 500.0, 5))


def _box_sql(src: str, frame: str, cols) -> str:
    return union([
        f"SELECT '{frame}' AS frame, '{c}' AS \"column\", q1, median, q3, "
        f"CAST(min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) THEN {c} END) AS DOUBLE) AS whisker_lo, "
        f"CAST(max(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END) AS DOUBLE) AS whisker_hi, "
        f"count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers "
        f"FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, "
        f"quantile_cont({c}, 0.75) AS q3 FROM {src}) qq GROUP BY q1, median, q3" for c in cols])


def _q_box(s, d):
    enc = FX.encounters(s, d)
    capped, _ = handle_outliers(enc, FX.CONTINUOUS, "iqr", "cap")
    return PR.box_stats(enc, FX.CONTINUOUS, "original").unionByName(PR.box_stats(capped, FX.CONTINUOUS, "treated"))


register("a24_box_stats_before_after",
         ENC + f", capped AS ({iqr_cap('encounters', FX.CONTINUOUS)}) "
         + _box_sql("encounters", "original", FX.CONTINUOUS) + " UNION ALL " + _box_sql("capped", "treated", FX.CONTINUOUS),
         doubles=["q1", "median", "q3", "whisker_lo", "whisker_hi"], family="profile")(_q_box)

A25 = FX.SYMPTOM_FLAGS + FX.LABS + ["alvarado_score"]
register("a25_zero_density",
         SC + per_col(A25, "SELECT '{c}' AS \"column\", avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_zero, "
                      "avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) * 100 > 50 AS sparse_candidate FROM scored"),
         doubles=["pct_zero"], family="profile")(lambda s, d: PR.zero_density(FX.scored_encounters(s, d), A25))

A26 = ["l_extendedprice", "l_discount", "l_quantity"]
register("a26_decimal_places",
         per_col(A26, "SELECT '{c}' AS \"column\", CAST(max(length(split_part(CAST({c} AS VARCHAR), '.', 2))) AS INTEGER)"
                 " AS max_decimals FROM lineitem"), family="profile")(lambda s, d: PR.decimal_places(li(s, d), A26))

A27 = FEATS + ["appendicitis"]


def _dup_sql():
    types = {c: ("double" if c in ["age", "duration"] + FX.LABS else "int") for c in A27}
    parts = [f"SELECT '{b}' AS \"column\", '{a}' AS duplicate_of, {i} AS ai FROM scored "
             f"HAVING count_if({a} IS DISTINCT FROM {b}) = 0"
             for i, a in enumerate(A27) for b in A27[i + 1:] if types[a] == types[b]]
    return SC + "SELECT \"column\", arg_min(duplicate_of, ai) AS duplicate_of FROM (" + union(parts) + ") t GROUP BY 1"


register("a27_duplicate_columns", _dup_sql(), family="profile")(
    lambda s, d: PR.duplicate_columns(FX.scored_encounters(s, d), A27, "encounter_id"))


def _q_health(s, d):
    from ..operators.features import clinical_features
    return PR.feature_health(clinical_features(FX.scored_encounters(s, d)), A31)


A31 = ["symptom_count", "lab_composite_score", "absolute_neutrophils", "duration"]
register("a31_feature_health",
         SC + ", f AS (SELECT *, " + __import__("cohortlens.plans.sqlgen", fromlist=["x"]).CLINICAL_FEATURES_SQL
         + " FROM scored) " + per_col(A31, "SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, "
                                      "CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, stddev_pop({c}) AS std, "
                                      "abs(min({c})) > 10 OR abs(max({c})) > 10 AS extreme, "
                                      "stddev_pop({c}) < 0.01 AS near_constant FROM f"),
         doubles=["min", "max", "mean", "std"], family="profile")(_q_health)

register("a32_class_weights",
         ENC + "SELECT appendicitis, count(*) AS n_c, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight "
         "FROM encounters GROUP BY 1", doubles=["weight"], family="profile")(
    lambda s, d: PR.class_weights(FX.encounters(s, d), "appendicitis"))


# A8 with all digits: whole numbers beyond 2**53, decimals, times, and doubles with infinities
WIDE_EXPRS = [("wide", "9007199254740993 + encounter_id * 3"), ("price", "CAST(CAST(encounter_id * 7919 % 10007 AS DECIMAL(18,4)) / 16 AS DECIMAL(18,4))"),
              ("seen_us", "{micros}"), ("spread", "CASE encounter_id % 25 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN -CAST('Infinity' AS DOUBLE) ELSE age END")]
WIDE_PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


def _q_wide(s, d):
    from ..functions.ordering import exact_quantiles
    e = FX.encounters(s, d)
    t = e.selectExpr(*[f"{x.format(micros='seen_at')} AS {c}" for c, x in WIDE_EXPRS])
    out = exact_quantiles(t, [c for c, _ in WIDE_EXPRS], WIDE_PROBS, neighbours=True)
    ends = F.when(F.abs("value") == float("inf"), F.when(F.col("value") > 0, "above").otherwise("below"))
    return out.select("column", "prob", *[F.col(c).cast("decimal(30,4)").alias(c) for c in ("low", "high")], ends.alias("beyond"))


def _wide_sql():
    base = FX.with_views("encounters") + ", t AS (SELECT " + ", ".join(f"{x.format(micros='epoch_us(seen_at)')} AS {c}" for c, x in WIDE_EXPRS) + " FROM encounters)"
    parts = []
    for c, _ in WIDE_EXPRS:
        for p in WIDE_PROBS:
            at = f"(len(v) - 1) * CAST({p} AS DOUBLE)"
            low, high = f"v[CAST(floor({at}) AS BIGINT) + 1]", f"v[CAST(ceil({at}) AS BIGINT) + 1]"
            seen = ("CAST(NULL AS DECIMAL(30,4))",) * 2 if c == "spread" else (f"CAST({low} AS DECIMAL(30,4))", f"CAST({high} AS DECIMAL(30,4))")
            beyond = f"CASE WHEN {low} = 'Infinity' OR {high} = 'Infinity' THEN 'above' WHEN {low} = '-Infinity' THEN 'below' END" if c == "spread" else "NULL"
            parts.append(f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, {seen[0]} AS low, {seen[1]} AS high, {beyond} AS beyond "
                         f"FROM (SELECT list_sort(list({c})) AS v FROM t) q")
    return base + " " + " UNION ALL ".join(parts)


register("a08_exact_order_statistics", _wide_sql(), family="profile")(_q_wide)
