"""Evaluation of attempts: tolerance, pass@k, resuming, summaries, error shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

TOLERANCE = 1e-6


def within(predicted: Column, truth: Column, tolerance: float = TOLERANCE) -> Column:
    """Absolute difference at most the tolerance; a missing value fails."""
    return F.coalesce(F.abs(predicted - truth) <= tolerance, F.lit(False))


def pass_at_k(attempts: DataFrame, key: str, order: list[str], success: Column, k: int) -> DataFrame:
    """``attempts, success, first_success`` per key, where attempts stop at the first success or after k: the attempts
    made, whether one succeeded, and which (from 1)."""
    from pyspark.sql.window import Window

    at = attempts.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_i") <= k).withColumn("_ok", success)
    got = at.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.when(F.col("_ok"), F.col("_i"))).alias("first_success"))
    return got.select(key, F.coalesce("first_success", "_n").cast("long").alias("attempts"), F.col("first_success").isNotNull().alias("success"), F.col("first_success").cast("int").alias("first_success"))


def pending(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return samples.join(done.select(key), key, "left_anti")


def summary(results: DataFrame, by: list[str], success: Column, code_pass: Column, api_error: Column) -> DataFrame:
    """Totals and rates (in percent of all) by target and model."""
    n = F.count("*")
    return results.groupBy(*by).agg(
        n.alias("total"),
        F.count_if(success).alias("success"),
        F.count_if(code_pass).alias("code_pass"),
        F.count_if(api_error).alias("api_errors"),
        (100 * T.ratio(F.count_if(success).cast("double"), n)).alias("success_rate"),
        (100 * T.ratio(F.count_if(code_pass).cast("double"), n)).alias("code_pass_rate"),
    )


def error_shares(classified: DataFrame, name: str = "error", correct: str = "correct") -> DataFrame:
    """Count of each class, its share of all rows and (but for the correct) of the failures. The totals are taken from
    the counts, not from the rows."""
    n = classified.groupBy(name).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col(name) != correct, F.col("n")).otherwise(0)).alias("_bad"))
    got = n.join(F.broadcast(total), how="cross")  # one row
    return got.select(name, "n", (F.col("n") / F.col("_all")).alias("share"), F.when(F.col(name) != correct, F.col("n") / F.col("_bad")).alias("failure_share"))


def flag(value: Column) -> Column:
    """A reward counts as reached at 1 or more; anything that isn't a number doesn't."""
    return F.coalesce(value.cast("string").try_cast("double") >= 1, F.lit(False))


def final_statistics(results: DataFrame, success: Column, unsupported: Column, api_error: Column, by: list[str] = ()) -> DataFrame:
    """``total, evaluated, unsupported, successful, api_errors, accuracy``: samples without a usable ground truth count in
    neither the successes nor the share's denominator; the share of nothing is 0."""
    no = F.coalesce(unsupported, F.lit(False))
    ok, evaluated = F.count_if(success & ~no), F.count_if(~no)
    return results.groupBy(*by).agg(F.count("*").alias("total"), evaluated.alias("evaluated"), F.count_if(no).alias("unsupported"), ok.alias("successful"), F.count_if(api_error).alias("api_errors"), T.ratio(ok.cast("double"), evaluated).alias("accuracy"))


def inspect_run(outputs: dict[str, DataFrame]) -> DataFrame:
    """``output, rows`` of a run's tables, one scan each."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows") for name, df in sorted(outputs.items())]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def at_places(samples: DataFrame, place: str, start: int = 0, end: int | None = None, most: int | None = None) -> DataFrame:
    """The samples from place ``start`` to before ``end``, at most ``most`` of them in the order of their places."""
    got = samples.where(F.col(place) >= start)
    got = got if end is None else got.where(F.col(place) < end)
    return got if most is None else got.orderBy(place).limit(most)
