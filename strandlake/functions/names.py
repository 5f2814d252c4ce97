"""Labels, chromosome names and numbers in option strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of names is broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_NAMES = 1_000_000


def smart_label(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"^(.*[^.].*)\.[^.]*$", "$1")


def with_chr(chrom: Column) -> Column:
    return F.when(chrom == "MT", "chrM").when(F.startswith(chrom, F.lit("chr")), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_chr(chrom: Column) -> Column:
    return F.when(chrom == "chrM", "MT").otherwise(F.regexp_replace(chrom, "^chr", ""))


def rename_chroms(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Chromosomes by a table (chrom, name); rows of unknown ones go."""
    small = mapping.select("chrom", F.col("name").alias("_name"))
    small = F.broadcast(small) if small.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES else small
    return df.join(small, "chrom").select(*[F.col("_name").alias("chrom") if c == "chrom" else F.col(c) for c in df.columns])


def relabel(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """New labels for old ones; each label present needs one."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    new = F.try_element_at(F.create_map(*pairs), F.col(column).cast("string"))
    return df.withColumn(column, F.coalesce(new, F.raise_error(F.concat(F.lit("no label for "), F.col(column).cast("string")))))


def scale_factors(text: str) -> list[float]:
    """Factors written as a:b[:c...]."""
    return [float(x) for x in text.split(":")]


def axis_label(bases: int) -> str:
    """A distance in Kb, or Mb from 100,000 bases on."""
    unit, name = (1e3, "Kb") if abs(bases) < 100_000 else (1e6, "Mb")
    return f"{bases / unit:.1f}{name}" if bases else "0"
