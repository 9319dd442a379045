"""Drift of live scores: counts per window by Spark, exact binomial tests over the counts on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import binomial_cdf, clopper_pearson_lower, clopper_pearson_upper, exceedance_test

CHECKS = "window_start timestamp, head string, test string, live_count long, live_rows long, p_value double, alert boolean"


def window_counts(scores: DataFrame, threshold: float, floor: float, *, ts: str = "ts", score: str = "score", window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """(window_start, n, firing, review): rows, rows at the threshold and rows at the review floor per tumbling window.

    Works on batches and streams alike; with ``watermark`` late rows are taken up to that delay.  Null and NaN scores don't count.
    """
    rows = scores.filter(F.col(score).isNotNull() & ~F.isnan(score))
    if watermark:
        rows = rows.withWatermark(ts, watermark)
    g = rows.groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("firing"), F.count_if(F.col(score) >= floor).alias("review"))
    return g.select(F.col("window.start").alias("window_start"), "n", "firing", "review")


def drift_checks(live: tuple[int, int, int], reference: tuple[int, int, int], alpha: float = 0.01, firing_bound: float | None = None) -> list[dict]:
    """Four one-sided tests of (n, firing, review) counts against the reference's, alpha / 4 each.

    A bound estimated from the reference takes half of its test's share; a certified firing bound leaves it all to the test.
    """
    (n, *live_k), (m, *ref_k) = live, reference
    if not n or not m:
        raise ValueError("live and reference need rows")
    a, out = alpha / 4, []
    for name, k, kr in zip(("firing", "review"), live_k, ref_k):
        certified = name == "firing" and firing_bound is not None
        upper = firing_bound if certified else clopper_pearson_upper(kr, m, 1 - a / 2)
        p, alert = exceedance_test(k, n, upper, a if certified else a / 2)
        out.append({"test": f"{name}-up", "p_value": p, "alert": alert})
        down = binomial_cdf(k, n, clopper_pearson_lower(kr, m, 1 - a / 2))
        out.append({"test": f"{name}-down", "p_value": down, "alert": down <= a / 2})
    return out


def monitor(counts: DataFrame, reference: tuple[int, int, int], head: str = "head", alpha: float = 0.01, firing_bound: float | None = None) -> DataFrame:
    """Checks of every window: its counts (one row per window) are tested by a function over Arrow batches."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for c in drift_checks((r.n, r.firing, r.review), reference, alpha, firing_bound):
                    rows.append((r.window_start, head, c["test"], r.firing if c["test"].startswith("firing") else r.review, r.n, float(c["p_value"]), bool(c["alert"])))
            yield pd.DataFrame(rows, columns=["window_start", "head", "test", "live_count", "live_rows", "p_value", "alert"])

    return counts.mapInPandas(run, CHECKS)


def start_monitor(stream: DataFrame, threshold: float, floor: float, reference: tuple[int, int, int], sink: str, checkpoint: str, **options):
    """A streaming query that appends the checks of closed windows to a Parquet folder (an extension of the batch monitor)."""
    counts = window_counts(stream, threshold, floor, watermark=options.pop("watermark", "1 hour"), **options)

    def write(batch: DataFrame, _: int) -> None:
        monitor(batch, reference).write.mode("append").parquet(sink)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start()
