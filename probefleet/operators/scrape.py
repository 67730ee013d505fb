"""The text exposition format of metrics: lines to samples and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.functions.keyvalue import parse_float
from probefleet.functions.labels import label_block
from probefleet.functions.numbers import sample_text

_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]++|\\.)*+)"'


def parse_exposition(lines: DataFrame) -> DataFrame:
    """Samples of the lines (column ``value``): name, labels, value. Comments and broken lines give none.

    A line is cut at its first ``{`` and last ``}``, as neither can stand in a name or a number. The parts
    are put together and checked in one generated row, so that no pattern runs twice.
    """
    line = F.trim("value")
    block = line.contains("{")
    before = F.when(block, F.substring_index(line, "{", 1)).otherwise(F.substring_index(line, " ", 1))
    after = F.when(block, F.substring_index(line, "}", -1)).otherwise(F.substr(line, F.length(before) + 1))
    inside = F.when(
        block,
        F.substr(line, F.length(before) + 2, F.length(line) - F.length(before) - F.length(after) - 2),
    ).otherwise("")
    names = F.regexp_extract_all(F.col("_inside"), F.lit(_LABEL), F.lit(1))
    values = F.regexp_extract_all(F.col("_inside"), F.lit(_LABEL), F.lit(2))

    def unescape(text):
        hidden = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
        shown = F.replace(F.replace(hidden, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
        return F.when(text.contains("\\"), F.replace(shown, F.lit("\u0000"), F.lit("\\"))).otherwise(text)

    kept = [c for c in lines.columns if c != "value"]
    parts = lines.where(~F.col("value").startswith("#")).select(
        *kept,
        F.trim(before).alias("_name"),
        F.trim(inside).alias("_inside"),
        F.split(F.trim(F.translate(after, "\t", " ")), " +").alias("_after"),
    )
    found = F.struct(
        F.col("_name").alias("name"),
        names.alias("names"),
        values.alias("values"),
        parse_float(F.get("_after", F.lit(0))).alias("value"),
        F.regexp_replace("_inside", rf"\G{_LABEL}\s*(?:,\s*|$)", "").alias("rest"),
    )
    checked = F.filter(
        F.array(found),
        lambda f: f["value"].isNotNull()
        & (f["rest"] == "")
        & f["name"].rlike("^[a-zA-Z_:][a-zA-Z0-9_:]*$")
        & (F.size(F.array_distinct(f["names"])) == F.size(f["names"]))
        & ((F.size("_after") == 1) | ((F.size("_after") == 2) & F.get("_after", F.lit(1)).rlike("^-?[0-9]+$"))),
    )
    return parts.select(*kept, F.inline(checked)).select(
        *kept, "name", F.map_from_arrays("names", F.transform("values", unescape)).alias("labels"), "value"
    )


def histogram_samples(histogram: DataFrame, name: str, labels: dict[str, str]) -> DataFrame:
    """Samples of a histogram table: its buckets, sum and count. ``labels`` maps label to column."""
    base = [x for label, column in labels.items() for x in (F.lit(label), F.col(column).cast("string"))]
    plain, bucket = F.create_map(*base), F.create_map(*base, F.lit("le"), F.col("le"))
    last = F.col("le") == "+Inf"

    def sample(suffix, tags, value):
        return F.struct(F.lit(name + suffix).alias("name"), tags.alias("labels"), value.cast("double").alias("value"))

    none = F.array().cast("array<struct<name:string,labels:map<string,string>,value:double>>")
    totals = F.array(sample("_sum", plain, F.col("sum")), sample("_count", plain, F.col("count")))
    rows = F.concat(
        F.array(sample("_bucket", bucket, F.col("bucket_count"))), F.when(last, totals).otherwise(none)
    )
    return histogram.select(F.inline(rows))


def counter_samples(counter: DataFrame, name: str, labels: dict[str, str], value: str) -> DataFrame:
    """Samples of a counter table."""
    tags = [x for label, column in labels.items() for x in (F.lit(label), F.col(column).cast("string"))]
    tags = F.create_map(*tags) if tags else F.create_map().cast("map<string,string>")
    return counter.select(F.lit(name).alias("name"), tags.alias("labels"), F.col(value).cast("double").alias("value"))


def to_exposition(samples: DataFrame, prefix: str = "") -> DataFrame:
    """One text line per sample."""
    name = F.concat(F.lit(prefix), F.col("name"))
    return samples.select(
        name.alias("name"),
        F.concat(name, label_block(F.col("labels")), F.lit(" "), sample_text(F.col("value"))).alias("line"),
    )


def type_lines(samples: DataFrame, prefix: str = "") -> DataFrame:
    """``# HELP`` (where a text is known) and ``# TYPE`` of each metric, to stand before its samples, in this order."""
    family = F.regexp_replace(F.col("name"), r"_latency_(bucket|sum|count)$", "_latency")
    kind = F.when(family.endswith("_total"), "counter").when(family.endswith("_latency"), "histogram")
    texts = F.create_map(*[F.lit(x) for pair in C.METRIC_HELP.items() for x in pair])
    names = samples.select(
        F.concat(F.lit(prefix), family).alias("name"), F.coalesce(kind, F.lit("untyped")).alias("kind"), texts[family].alias("text")
    )
    lines = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat_ws(" ", F.lit("# HELP"), "name", "text").alias("line")),
        F.struct(F.lit(1).alias("rank"), F.concat_ws(" ", F.lit("# TYPE"), "name", "kind").alias("line")),
    )
    shown = F.when(F.col("text").isNull(), F.slice(lines, 2, 1)).otherwise(lines)
    return names.distinct().select("name", F.inline(shown))
