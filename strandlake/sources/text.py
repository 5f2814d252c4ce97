"""Text formats: SAM, BED, bedGraph, GTF, FASTA, matrix files; readers give DataFrames, writers take them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.reads import aligned_blocks, aligned_end


def read_sam(spark: SparkSession, path: str, sample: str = "") -> DataFrame:
    """Alignments of a SAM text file; positions 0-based, mate names resolved, aligned blocks from the CIGAR."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    f = [F.col("f")[i] for i in range(11)]
    t = t.select(
        F.lit(sample).alias("sample"), f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("chrom"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mate_chrom"), (f[7].cast("long") - 1).alias("mate_pos"), f[8].cast("long").alias("tlen"), F.length(f[9]).alias("qlen"), F.monotonically_increasing_id().alias("read_id"),
    )
    return t.withColumn("end", aligned_end()).withColumn("blocks", aligned_blocks())


def sam_sizes(spark: SparkSession, path: str) -> DataFrame:
    h = spark.read.text(path).where(F.startswith("value", F.lit("@SQ")))
    return h.select(F.regexp_extract("value", r"SN:(\S+)", 1).alias("chrom"), F.regexp_extract("value", r"LN:(\d+)", 1).cast("long").alias("size"))


def read_bed(spark: SparkSession, path: str, group: str = "genes") -> DataFrame:
    """Regions; a line `#name` closes the group of the lines before it; names default to chrom:start-end.

    Line order comes from one ordered read of the file, as groups depend on it.
    """
    t = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).where(F.trim("value") != "")
    later = Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("group", F.coalesce(F.last(F.when(F.startswith("value", F.lit("#")), F.substring("value", 2, 1000)), True).over(later), F.lit(group)))
    t = t.where(~F.startswith("value", F.lit("#"))).withColumn("f", F.split("value", "\t"))
    field = lambda i: F.when(F.size("f") > i, F.col("f")[i])
    start, end = F.col("f")[1].cast("long"), F.col("f")[2].cast("long")
    name = F.coalesce(field(3), F.concat_ws("", F.col("f")[0], F.lit(":"), start, F.lit("-"), end))
    return t.select("group", F.col("_n").alias("region"), F.col("f")[0].alias("chrom"), start.alias("start"), end.alias("end"), name.alias("name"), field(4).cast("double").alias("score"), F.coalesce(field(5), F.lit(".")).alias("strand"))


def read_bedgraph(spark: SparkSession, path: str, sample: str = "") -> DataFrame:
    t = spark.read.text(path).where(F.trim("value").rlike(r"^[^#\s]+\s+\d+\s+\d+\s+\S+$")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return t.select(F.lit(sample).alias("sample"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.col("f")[3].cast("double").alias("value"))


def write_bedgraph(df: DataFrame, path: str) -> None:
    """chrom, start, end, value as tab-separated lines in genomic order, over as many files as there are partitions."""
    value = F.regexp_replace(F.format_string("%.6f", F.col("value").cast("double")), r"\.?0+$", "")
    df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), value).alias("value")).write.text(path)


def read_gtf(spark: SparkSession, path: str, transcript: str = "transcript", exon: str = "exon", designator: str = "transcript_id", group_attribute: str = "", group: str = "genes") -> DataFrame:
    """Transcripts with their exons as arrays of (start, end), 0-based half-open, in the group that an attribute names, else in `group`."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    named = F.regexp_extract(F.col("f")[8], group_attribute + r'\s+"([^"]*)"', 1) if group_attribute else F.lit("")
    label = F.when(named != "", named).otherwise(F.lit(group))
    t = t.select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("kind"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[6].alias("strand"), F.regexp_extract(F.col("f")[8], designator + r'\s+"([^"]*)"', 1).alias("region"), label.alias("group"))
    exons = t.where(F.col("kind") == exon).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return t.where(F.col("kind") == transcript).drop("kind").join(exons, "region", "left")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return t.select(F.regexp_extract(head, r"^(\S+)", 1).alias("chrom"), F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "").alias("seq"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a matrix file (its first line is a JSON header): (chrom, start, end, name, strand, bins)."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("f"))
    bins = F.transform(F.slice("f", F.lit(7), F.greatest(F.size("f") - 6, F.lit(0))), lambda x: F.when(x != "nan", x.cast("double")))
    return t.select(F.col("f")[0].alias("chrom"), F.col("f")[1].alias("start"), F.col("f")[2].alias("end"), F.col("f")[3].alias("name"), F.col("f")[5].alias("strand"), bins.alias("bins"))


def write_counts(df: DataFrame, path: str, labels: list[str]) -> None:
    """Long counts (chrom, start, end, sample, value) as a wide tab-separated table with a column for each label."""
    wide = df.groupBy("chrom", "start", "end").pivot("sample", labels).agg(F.first("value"))
    wide.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.csv(path, sep="\t", header=True)


def write_matrix(m: DataFrame, header: dict, path: str, order: tuple[str, ...] = ("group", "region")) -> None:
    """A gzip matrix file: a line with the JSON header, then chrom, start, end, name, score, strand and the bins.

    The format is one file, so one task writes it; its rows are sorted by Spark's external sorter and streamed.
    """
    bins = F.concat_ws("\t", F.transform("bins", lambda x: F.when(x.isNull(), "nan").otherwise(F.format_string("%.6f", x))))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "start", "end", "name", "score", "strand")]
    rows = m.select(F.lit(1).alias("_part"), *order, F.concat_ws("\t", *fields, bins).alias("value"))
    first = m.sparkSession.createDataFrame([(0, "@" + json.dumps(header))], "_part int, value string")
    lines = rows.unionByName(first, allowMissingColumns=True).repartition(1).sortWithinPartitions("_part", *order)
    lines.select("value").write.option("compression", "gzip").text(path)


def read_matrix_header(spark: SparkSession, path: str) -> dict:
    line = spark.read.text(path).where(F.startswith("value", F.lit("@"))).first()
    return json.loads(line.value[1:]) if line else {}


def write_bed12(regions: DataFrame, path: str, order: tuple[str, ...] = ("group", "region")) -> None:
    """Sorted regions with their exons as blocks (sizes and starts relative to the region) and their group in column 13."""
    e = F.coalesce("exons", F.array(F.struct("start", "end"))) if "exons" in regions.columns else F.array(F.struct("start", "end"))
    sizes = F.concat_ws(",", F.transform(e, lambda b: (b["end"] - b["start"]).cast("string")))
    starts = F.array_join(F.transform(e, lambda b: (b["start"] - F.col("start")).cast("string")), ",")
    fields = ["chrom", "start", "end", "name", F.coalesce(F.col("score").cast("string"), F.lit(".")).alias("score"), "strand", F.col("start").alias("t0"), F.col("end").alias("t1"), F.lit("0").alias("rgb"), F.size(e).alias("n"), sizes.alias("sizes"), starts.alias("starts"), "group"]
    regions.repartitionByRange(*order).sortWithinPartitions(*order).select(*fields).write.csv(path, sep="\t", header=False)


def write_profile(profile: DataFrame, path: str, statistic: str = "mean") -> None:
    """One line for each group with its values in order of the bins; missing ones stay empty."""
    cells = F.array_sort(F.collect_list(F.struct("bin", F.col(statistic).alias("v"))))
    values = F.array_join(F.transform("_cells", lambda c: F.coalesce(c["v"].cast("string"), F.lit(""))), "\t")
    lines = profile.groupBy("group").agg(cells.alias("_cells")).sort("group")
    lines.select(F.concat_ws("\t", F.col("group").cast("string"), values).alias("value")).write.text(path)


def split_by_group(regions: DataFrame, path: str) -> None:
    """A folder of tab-separated files for each group."""
    regions.write.partitionBy("group").csv(path, sep="\t")


def _four_digits(rows: DataFrame) -> DataFrame:
    """(_part, group, region, value): the bins as numbers of four significant digits, nan where missing."""

    def lines(frames):
        for f in frames:
            f["value"] = ["\t".join("%.4g" % (float("nan") if x is None else x) for x in b) for b in f["bins"]]
            yield f[["group", "region", "value"]]

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.select("group", "region", "bins").mapInPandas(lines, f"`group` {kind('group')}, region {kind('region')}, value string")


def write_matrix_values(m: DataFrame, header: dict, sample_bins: dict[str, int], path: str) -> None:
    """The values of a matrix as text: groups with their sizes, the zones, groups and a label for each bin, then a line a region.

    One file, so one task writes it; rows are ordered by group and region by Spark's external sorter.
    """
    sizes = [f"{r.group}:{r.n}" for r in m.groupBy("group").agg(F.count("*").alias("n")).orderBy("group").toLocalIterator()]
    zones = "\t".join(f"{k}:{header.get(k, 0)}" for k in ("downstream", "upstream", "body", "bin size", "unscaled 5 prime", "unscaled 3 prime"))
    labels = [s for s, n in sample_bins.items() for _ in range(n)]
    first = ["#" + "\t".join(sizes), "#" + zones, "\t".join(sizes + labels)]
    head = m.sparkSession.createDataFrame([(i, line) for i, line in enumerate(first)], "_part int, value string")
    rows = _four_digits(m).withColumn("_part", F.lit(len(first))).unionByName(head, allowMissingColumns=True)
    rows.repartition(1).sortWithinPartitions("_part", "group", "region").select("value").write.text(path)


def write_bedpe(reads: DataFrame, path: str, shift: int = 0) -> None:
    """chrom, start and end of the fragments of leftmost mates (tlen above 0), in genomic order."""
    t = reads.where("tlen > 0").select("chrom", (F.col("pos") + shift).cast("long").alias("start"), (F.col("pos") + shift + F.col("tlen")).cast("long").alias("end"))
    t.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end").write.csv(path, sep="\t", header=False)


def write_sam(reads: DataFrame, sizes: DataFrame, path: str) -> None:
    """Alignments as SAM text sorted by position, over as many files as partitions; the first file starts with the header.

    Bases are written where there is a column `seq`, qualities never.  Readers take the files in order of their names.
    """
    text = lambda c: F.col(c).cast("string")
    seq = F.coalesce(F.when(F.col("seq") != "", F.col("seq")), F.lit("*")) if "seq" in reads.columns else F.lit("*")
    mate = F.when((F.col("mate_chrom") == F.col("chrom")) & (F.col("chrom") != "*"), "=").otherwise(F.col("mate_chrom"))
    line = F.concat_ws("\t", "qname", text("flag"), "chrom", (F.col("pos") + 1).cast("string"), text("mapq"), F.coalesce("cigar", F.lit("*")), mate, (F.col("mate_pos") + 1).cast("string"), text("tlen"), seq, F.lit("*"))
    head = sizes.select(F.lit(0).alias("_part"), F.lit("").alias("_chrom"), F.lit(0).cast("long").alias("_pos"), F.format_string("@SQ\tSN:%s\tLN:%d", F.col("chrom"), F.col("size").cast("long")).alias("value"))
    rows = reads.select(F.when(F.col("chrom") == "*", 2).otherwise(1).alias("_part"), F.col("chrom").alias("_chrom"), F.col("pos").cast("long").alias("_pos"), line.alias("value"))
    order = ["_part", "_chrom", "_pos", "value"]
    head.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
