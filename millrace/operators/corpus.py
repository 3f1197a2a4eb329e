"""Training-corpus preparation: mixture files and statistics, shards, epoch shuffles, log metrics, conversion plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import numbered


def mixture(lines: DataFrame) -> DataFrame:
    """``weight, path`` of the lines of a mixture file (column ``value``): blanks and comments are skipped; a line
    whose weight can't be read is a path of weight 1."""
    s = F.trim("value")
    part = F.split(s, r"\s+", 2)
    w = F.get(part, F.lit(0)).try_cast("double")
    path = F.when(w.isNotNull() & (F.size(part) == 2), F.get(part, F.lit(1))).otherwise(s)
    return lines.where((s != "") & ~s.startswith("#")).select(F.when(F.size(part) == 2, F.coalesce(w, F.lit(1.0))).otherwise(1.0).alias("weight"), path.alias("path"))


def mixture_stats(sizes: DataFrame, weights: DataFrame, consumed: float) -> DataFrame:
    """Per path: weight share in percent, tokens consumed of the total, and epochs, of ``sizes(path, total_tokens,
    total_seqs)`` and ``weights(path, weight)``."""
    total = weights.agg(F.sum("weight").alias("_w"))
    share = F.col("weight") / F.col("_w")
    used = F.floor(share * consumed)
    got = sizes.join(weights, "path").join(F.broadcast(total), how="cross")  # one row
    return got.select("path", "total_tokens", "total_seqs", "weight", F.round(100 * share, 2).alias("weight_pct"), used.cast("long").alias("consumed_tokens_est"), F.when(F.col("total_tokens") > 0, F.round(used / F.col("total_tokens"), 2)).otherwise(0.0).alias("epochs_est"))


def shards(df: DataFrame, order: list, n: int, name: str = "shard") -> DataFrame:
    """Rows dealt in order to shards of floor(rows / n) rows each, the remainder making one more."""
    rows = numbered(df, *order, name="_n")
    gap = rows.count() // n
    if gap <= 0:
        raise ValueError(f"fewer rows than {n} shards")
    return rows.withColumn(name, F.floor(F.col("_n") / gap).cast("long")).drop("_n")


def epochs(ids: DataFrame, key: str, least: int, seed: str) -> DataFrame:
    """``epoch, id`` in training order (``position`` from 0): whole shuffled copies of the ids until there are at
    least ``least`` samples."""
    n = ids.count()
    copies = -(-least // n) if n else 0
    every = ids.select(F.col(key).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("epoch")) if copies else ids.select(F.col(key).alias("id"), F.lit(0).alias("epoch")).limit(0)
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("id").cast("string")), 256)
    return numbered(every.withColumn("_h", h), "epoch", "_h", "id", name="position").select("epoch", "id", "position")


def log_metrics(line: Column) -> list[Column]:
    """Iteration, loss, learning rate, throughput and gradient norm of a training log line; null where absent."""
    num = r"([0-9.]+(?:[Ee][+-]?[0-9]+)?)"
    got = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit("")).try_cast("double")
    return [
        got(r"iteration +([0-9]+)").cast("long").alias("iter"),
        got(rf"lm loss: +{num}").alias("lm_loss"),
        got(rf"learning rate: +{num}").alias("lr"),
        got(rf"throughput[^:]*: +{num}").alias("throughput"),
        got(rf"grad norm: +{num}").alias("grad_norm"),
    ]


def conversions(lines: DataFrame) -> DataFrame:
    """``name, input, output, workers, n_subs, log_interval`` of the lines of a conversion manifest, with defaults."""
    s = F.trim("value")
    p = F.split(s, r"\s+")
    opt = lambda i, d: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(d))
    return lines.where((s != "") & ~s.startswith("#") & (F.size(p) >= 3)).select(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("input"), F.get(p, F.lit(2)).alias("output"), opt(3, 8).alias("workers"), opt(4, 1).alias("n_subs"), opt(5, 1000).alias("log_interval"))


def index_map_name(prefix: str, split: str, samples: int, seed: int, padded: bool = False, shuffle: bool = True) -> str:
    return f"{prefix}_{split}_indexmap_{samples}ns_{seed}s{'_padded_samples' * padded}{'_shuffle' * shuffle}_decoder_packed_idx.npy"


def training_volume(docs: DataFrame, tokens: Column, sequence: int, batch: int, iterations: int) -> DataFrame:
    """``tokens, sequences, consumed, epochs``: of the data, and of a training run over it."""
    total = docs.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"), F.count("*").alias("sequences"))
    used = F.lit(batch * sequence * iterations).cast("long")
    return total.select("tokens", "sequences", used.alias("consumed"), F.when(F.col("tokens") > 0, F.round(used / F.col("tokens"), 2)).otherwise(0.0).alias("epochs"))
