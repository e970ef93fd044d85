"""User-feedback analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantiles
from ..functions.scalar import to_number

# Concordance categories of the feedback analysis.
CONCORDANCE = [
    ("Élevé", "appendicite", "Vrai Positif"),
    ("Faible", "non_appendicite", "Vrai Négatif"),
    ("Élevé", "non_appendicite", "Faux Positif"),
    ("Faible", "appendicite", "Faux Négatif"),
]
UNDETERMINED = "Indéterminé"


def rating_summary(df: DataFrame, rating: str) -> DataFrame:
    """N, mean, median (exact), n ≤ 2 ('incorrect'), n ≥ 4."""
    x = to_number(rating).alias("r")
    t = df.select(x)
    s = t.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"),
              F.count_if(F.col("r") <= 2).alias("n_low"), F.count_if(F.col("r") >= 4).alias("n_high"))
    med = quantiles(t, ["r"], [0.5]).select(F.col("value").alias("median"))
    return s.crossJoin(med).select("n", "mean", "median", "n_low", "n_high")


def concordance_label(pred_col: str = "prediction_class", actual_col: str = "actual_diagnosis", mapping=CONCORDANCE):
    """The mapping's label of a prediction and an outcome, or undetermined."""
    fits = [F.when((F.col(pred_col) == p) & (F.col(actual_col) == a), F.lit(lab)) for p, a, lab in mapping]
    return F.coalesce(*fits, F.lit(UNDETERMINED))


def concordance(df: DataFrame, pred_col: str = "prediction_class", actual_col: str = "actual_diagnosis",
                mapping=CONCORDANCE) -> DataFrame:
    """TP/TN/FP/FN/undetermined counts; the label mapping is an argument."""
    return df.groupBy(concordance_label(pred_col, actual_col, mapping).alias("concordance")).agg(F.count(F.lit(1)).alias("n"))


def usefulness_report(df: DataFrame, x: str = "diagnostic_accuracy", y: str = "usefulness_rating") -> DataFrame:
    """B2 = A19 of y + A21 corr(x, y) + A22 least-squares trend y ~ x."""
    t = df.select(to_number(x).alias("x"), to_number(y).alias("y"))
    s = rating_summary(df, y)
    c = t.agg(F.corr("x", "y").alias("corr"), F.regr_slope("y", "x").alias("slope"),
              F.regr_intercept("y", "x").alias("intercept"))
    return s.crossJoin(c)


def rating_histogram(df: DataFrame, rating: str, bins: int = 5, lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    """Equal-width bins over [lo, hi] (top edge in the last bin)."""
    r = to_number(rating)
    b = F.least(F.floor((r - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(r.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def report_details(df: DataFrame, cols: list[str]) -> DataFrame:
    """Detail rows with 'N/A' defaults; B4 'other diagnosis' kept only
    when the outcome is 'autre'."""
    out = []
    for c in cols:
        if c == "other_diagnosis":
            out.append(F.coalesce(F.when(F.col("actual_diagnosis") == "autre", F.col(c)), F.lit("N/A")).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c))
    return df.select(*out)


def comment_samples(df: DataFrame, comments: str = "comments", order: str = "report_id", n: int = 5,
                    width: int = 100) -> DataFrame:
    """Non-blank comments, first n in report order, cut to ``width``
    characters + '...' (a distributed top-n)."""
    c = F.col(comments)
    t = df.where(c.isNotNull() & (F.trim(c) != "")).orderBy(order).limit(n)
    return t.select(order, F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("...")))
                    .otherwise(c).alias("comment"))
