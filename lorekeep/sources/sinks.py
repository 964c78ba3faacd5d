"""Writing evaluation snapshots and metric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, label: str) -> None:
    """One JSON snapshot per run label."""
    (
        report.withColumn("run", F.lit(label))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .json(path)
    )


def number_text(value: Column) -> Column:
    """Whole numbers without a fraction, others with at most three places."""
    rounded = F.round(value, 3).cast("decimal(38,3)").cast("string")
    return F.regexp_replace(rounded, r"\.?0+$", "")


def _number(value: Column) -> Column:
    whole = value.cast("decimal(38,0)").cast("string")
    return F.when(value == F.floor(value), whole).otherwise(number_text(value))


def _label_text(labels: Column) -> Column:
    def one(entry: Column) -> Column:
        text = F.replace(entry["value"], F.lit("\\"), F.lit("\\\\"))
        text = F.replace(text, F.lit('"'), F.lit('\\"'))
        text = F.replace(text, F.lit("\n"), F.lit("\\n"))
        return F.concat(entry["key"], F.lit('="'), text, F.lit('"'))

    inner = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), one), ",")
    return F.when(F.size(labels) == 0, F.lit("")).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))


def exposition_samples(metrics: DataFrame) -> DataFrame:
    """Metric rows -> one row per sample line: name, label_key, part, line.

    ``metrics``: name, help, type, labels map, count, sum, bounds array, cumulative array (NULL for counters).
    """
    labels = _label_text(F.col("labels"))

    def sample(suffix: str, text: Column, value: Column, part: Column) -> Column:
        line = F.concat(F.col("name"), F.lit(suffix), text, F.lit(" "), value)
        return F.struct(part.alias("part"), line.alias("line"))

    def bucket(bound: Column, index: Column) -> Column:
        text = _label_text(F.map_concat("labels", F.create_map(F.lit("le"), _number(bound.cast("double")))))
        return sample("_bucket", text, F.get("cumulative", index).cast("string"), index + 1)

    count = F.col("count").cast("string")
    size = F.size("bounds")
    infinite = _label_text(F.map_concat("labels", F.create_map(F.lit("le"), F.lit("+Inf"))))
    histogram = F.concat(
        F.transform("bounds", bucket),
        F.array(
            sample("_bucket", infinite, count, size + 1),
            sample("_sum", labels, _number(F.col("sum").cast("double")), size + 2),
            sample("_count", labels, count, size + 3),
        ),
    )
    counter = F.array(sample("", labels, _number(F.col("sum").cast("double")), F.lit(1)))
    return metrics.select(
        "name",
        labels.alias("label_key"),
        F.explode(F.when(F.col("type") == "counter", counter).otherwise(histogram)).alias("sample"),
    ).select("name", "label_key", "sample.part", "sample.line")


def render_exposition(metrics: DataFrame) -> DataFrame:
    """Text lines of the metrics page with their order: name, label_key, part, line. Write with ``write.text``."""
    help_text = F.replace(F.replace(F.first("help"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit(" "))
    heads = metrics.groupBy("name").agg(
        F.array(
            F.struct(F.lit(-1).alias("part"), F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), help_text).alias("line")),
            F.struct(F.lit(0).alias("part"), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.first("type")).alias("line")),
        ).alias("heads")
    )
    head_rows = heads.select("name", F.lit("").alias("label_key"), F.explode("heads").alias("head")).select(
        "name", "label_key", "head.part", "head.line"
    )
    return head_rows.unionByName(exposition_samples(metrics)).orderBy("name", "label_key", "part")
