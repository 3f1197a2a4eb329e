"""Sources and sinks: JSON lines, result lists, prompts, manifests, and tables that commit whole."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a bad line fails. A missing path gives no rows unless ``strict``."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    out = None
    for p in [paths] if isinstance(paths, str) else paths:
        try:
            df = reader.json(p)
        except AnalysisException as e:
            if strict or "PATH_NOT_FOUND" not in str(e):
                raise
            df = spark.createDataFrame([], schema)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with nulls kept; the directory appears with its last file."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_json_list(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """A whole-file JSON list, or an object that wraps one."""
    from pyspark.sql import functions as F

    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode(wrapper).alias("r")).select("r.*") if wrapper else df


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``path, data``: each JSON file as a variant; files that hold no object fail."""
    from pyspark.sql import functions as F

    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.parse_json("value").alias("data"))
    is_object = F.expr("schema_of_variant(data) like 'OBJECT%'")
    return df.where(F.assert_true(is_object, F.concat(F.lit("not an object: "), "path")).isNull())


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, append: bool = False) -> None:
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def manifest(one_row: DataFrame) -> str:
    """Pretty JSON of a one-row summary."""
    return json.dumps(one_row.first().asDict(recursive=True), ensure_ascii=False, indent=2, default=str) + "\n"


def markdown(df: DataFrame, percent: tuple[str, ...] = ()) -> str:
    """A small result as a Markdown table."""
    rows = [[f"{v:.2f}" if c in percent and v is not None else str(v) for c, v in zip(df.columns, r)] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, text`` of the lines (from 1) of JSON-lines files that hold no JSON; blank lines are fine."""
    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    return files.where(F.regexp_like("text", F.lit(r"\S")) & F.try_parse_json("text").isNull()).select("path", (F.col("at") + 1).alias("line"), "text")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def resolve_dataset(spark: SparkSession, path: str, split: str) -> str | None:
    """The file itself, else the first of a folder's usual names for the split; null if there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isFile():
        return path if fs.exists(p) else None
    names = ("OptiBench.json", f"{split}.json", f"{split}.jsonl", f"{split}.parquet")
    return next((f"{path}/{n}" for n in names if exists(spark, f"{path}/{n}")), None)


def read_dataset(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """A dataset of any known form: a JSON list, an object with a list ``data`` or ``records``, JSON lines, or Parquet."""
    from pyspark.sql import functions as F

    found = resolve_dataset(spark, path, split)
    if found is None:
        raise FileNotFoundError(f"no dataset {path} with split {split}")
    if found.endswith(".parquet"):
        return spark.read.parquet(found)
    if found.endswith(".jsonl"):
        return spark.read.option("mode", "FAILFAST").json(found)
    if not found.endswith(".json"):
        raise ValueError(f"unknown kind of dataset: {found}")
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(found)
    wrapper = next((w for w in ("data", "records") if w in df.columns and df.schema[w].dataType.typeName() == "array"), None)
    return df.select(F.explode(wrapper).alias("r")).select("r.*") if wrapper else df


def with_sample_id(df: DataFrame) -> DataFrame:
    """``df`` with a ``sample_id`` counting from 0 in file order, unless it has one."""
    from pyspark.sql import functions as F

    from millrace.functions.lineage import numbered

    return df if "sample_id" in df.columns else numbered(df.withColumn("_order", F.monotonically_increasing_id()), "_order", name="sample_id").drop("_order")


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap: the old one is kept until the new one is in place, and comes back on failure."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fs, target = _hadoop(spark, path)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{w}-{mark}") for w in ("new", "old"))
    df.write.parquet(new.toString())
    had = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not put the new table in place: {path}")
    if had:
        fs.delete(old, True)


def clear_outputs(spark: SparkSession, folder: str, names: list[str], resume: bool = False) -> None:
    """Delete a run's known outputs unless it resumes; nothing else in the folder is touched."""
    for n in [] if resume else names:
        fs, p = _hadoop(spark, f"{folder}/{n}")
        fs.delete(p, True)


def ready(spark: SparkSession, path: str) -> bool:
    """A table is ready when its last file, the success marker, is there."""
    return exists(spark, f"{path}/_SUCCESS")


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write a table unless it is ready; whether it was written."""
    if not overwrite and ready(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_json(one_row: DataFrame, path: str) -> None:
    """Pretty JSON of a one-row summary as a text file in its folder."""
    one_row.sparkSession.createDataFrame([(manifest(one_row).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_config(text: str) -> dict:
    """A run's settings: YAML of maps by indentation, lists (inline or by dashes), and scalars; comments are skipped."""

    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        if s in ("", "~", "null"):
            return None
        if s in ("true", "false"):
            return s == "true"
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    lines = [(n, x.split(" #")[0].rstrip()) for n, x in lines]

    def block(at: int, indent: int):
        if lines[at][1].startswith("- "):
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                out.append(scalar(lines[at][1][2:]))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"not a setting: {lines[at][1]}")
            at += 1
            deeper = at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- "))
            if not rest.strip() and deeper:
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = scalar(rest)
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"unexpected indentation: {lines[at][1]}")
        return out, at

    if not lines:
        return {}
    out, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"unexpected indentation: {lines[at][1]}")
    return out
