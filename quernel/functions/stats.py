"""Score intervals for ratios, as Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import Z95


def wilson(ok: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval, within 0 and 1; both 0 without trials."""
    k = F.greatest(F.lit(0), F.least(ok, n)).cast("double")
    m = n.cast("double")
    p, z2 = k / m, z * z
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    radius = (z / (1 + z2 / m)) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - radius)), F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), centre + radius))


def ratio_summary(ok: Column, n: Column) -> Column:
    """n_ok, n, and percentages with one decimal: pct, ci_lo, ci_hi."""
    lo, hi = wilson(ok, n)
    pct = lambda v: F.round(100 * v, 1)
    return F.struct(F.when(n > 0, ok).otherwise(0).cast("long").alias("n_ok"), F.greatest(n, F.lit(0)).cast("long").alias("n"), F.when(n > 0, pct(ok.cast("double") / n)).otherwise(0.0).alias("pct"), pct(lo).alias("ci_lo"), pct(hi).alias("ci_hi"))


def format_ratio(s: Column) -> Column:
    """A ratio summary as text with a decimal comma."""
    return F.when(s["n"] == 0, "veri yok").otherwise(F.concat(s["n_ok"], F.lit("/"), s["n"], F.lit("  %"), F.translate(F.format_string("%.1f", s["pct"]), ".", ","), F.format_string("  (GA %%%.0f-%.0f)", s["ci_lo"], s["ci_hi"])))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Difference of two ratios with its interval in points: diff, lo, hi, significant."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = k1.cast("double") / n1, k2.cast("double") / n2
    none = (n1 <= 0) | (n2 <= 0)
    lo = p1 - p2 - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    hi = p1 - p2 + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    pts = lambda v: F.when(none, 0.0).otherwise(F.round(100 * v, 1))
    return F.struct(pts(p1 - p2).alias("diff"), pts(lo).alias("lo"), pts(hi).alias("hi"), F.when(none, False).otherwise(~((lo <= 0) & (hi >= 0))).alias("significant"))


def overlap(a: Column, b: Column) -> Column:
    """Do the intervals of two ratio summaries overlap; false where one is empty."""
    return (a["n"] > 0) & (b["n"] > 0) & (a["ci_lo"] <= b["ci_hi"]) & (b["ci_lo"] <= a["ci_hi"])
