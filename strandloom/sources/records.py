"""FASTA, FASTQ, overlap-graph and drawing formats: parsing and rendering as columns, scans and sinks as text files.

Scans take Spark paths and globs, compressed or not. A record without a final
newline is read like any other. ``idx`` orders records within and across files
by file name and place; it is data, not partition order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


SCHEMA = "id string, seq string, qual string"


def _split(value: Column) -> Column:
    """Records of a file's text: FASTA (any number of lines) and FASTQ (four lines), told apart by their first character."""
    lines = F.filter(F.split(F.regexp_replace(value, "\r", ""), "\n"), lambda x: x != "")
    name = lambda h: F.regexp_extract(h, r"^.([^ \t]*)", 1)
    fastq = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / 4).cast("int") - 1), lambda i: F.struct(name(F.element_at(lines, i * 4 + 1)).alias("id"), F.element_at(lines, i * 4 + 2).alias("seq"), F.element_at(lines, i * 4 + 4).alias("qual")))
    blocks = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(value, "\r", "")), "\n>"), lambda x: x.rlike(r"\S"))
    fasta = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^([^ \t\n]*)", 1).alias("id"), F.regexp_replace(F.regexp_extract(b, r"(?s)^[^\n]*\n?(.*)$", 1), r"\s", "").alias("seq"), F.lit(None).cast("string").alias("qual")))
    return F.when(F.left(F.ltrim(value), F.lit(1)) == "@", F.when(F.size(lines) >= 4, fastq).otherwise(F.array().cast("array<struct<id:string,seq:string,qual:string>>"))).otherwise(fasta)


def parse(files: DataFrame, uppercase: bool = True) -> DataFrame:
    """idx, id, seq, qual of ``files`` (path, value), for files that fit a task; see ``scan_fasta`` for large ones."""
    order = F.row_number().over(Window.orderBy("path")) - 1
    rows = files.select("path", F.posexplode(_split(F.col("value"))).alias("n", "r"))
    starts = rows.groupBy("path").agg(F.count("*").alias("size"))
    before = starts.withColumn("file", order).withColumn("start", F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.join(before.select("path", F.coalesce("start", F.lit(0)).alias("start")), "path")
    seq = F.upper("r.seq") if uppercase else F.col("r.seq")
    return out.select((F.col("start") + F.col("n")).alias("idx"), "r.id", seq.alias("seq"), "r.qual")


def read_files(spark: SparkSession, path: str, uppercase: bool = True) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parse(files, uppercase)


def scan_fasta(spark: SparkSession, path: str, uppercase: bool = True) -> DataFrame:
    """id, seq, qual of large FASTA files: records are split off by Spark's reader, so one file makes many tasks."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>", "").alias("b")).filter(F.col("b").rlike(r"\S"))
    seq = F.regexp_replace(F.regexp_extract("b", r"(?s)^[^\n]*\n?(.*)$", 1), r"\s", "")
    return rows.select(F.regexp_extract("b", r"^([^ \t\n]*)", 1).alias("id"), (F.upper(seq) if uppercase else seq).alias("seq"), F.lit(None).cast("string").alias("qual"))


def interleaved(records: DataFrame) -> DataFrame:
    """pair_id, first and second records of idx 2n and 2n + 1."""
    half = lambda m, name: records.filter(F.col("idx") % 2 == m).select(F.floor(F.col("idx") / 2).alias("pair_id"), F.struct("id", "seq", "qual").alias(name))
    return half(0, "first").join(half(1, "second"), "pair_id")


def zipped(one: DataFrame, two: DataFrame) -> DataFrame:
    """pair_id, first and second records of equal idx of two scans."""
    return one.select(F.col("idx").alias("pair_id"), F.struct("id", "seq", "qual").alias("first")).join(two.select(F.col("idx").alias("pair_id"), F.struct("id", "seq", "qual").alias("second")), "pair_id")


def record(read_id: Column, seq: Column, qual: Column | None = None) -> Column:
    """FASTQ where there are qualities, else FASTA."""
    fasta = F.concat(F.lit(">"), read_id, F.lit("\n"), seq)
    if qual is None:
        return fasta
    return F.when(F.coalesce(F.length(qual), F.lit(0)) > 0, F.concat(F.lit("@"), read_id, F.lit("\n"), seq, F.lit("\n+\n"), qual)).otherwise(fasta)


def fastq_texts(read_id: pa.Array, seq: pa.Array, qual: pa.Array) -> pa.Array:
    """``record`` of reads that have qualities."""
    return pc.binary_join_element_wise(pc.binary_join_element_wise("@", read_id, ""), seq, "+", qual, "\n")


def fastq_records(value: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """id, seq, qual of all records of FASTQ texts, as ``_split`` has them."""
    lines = pc.split_pattern(pc.replace_substring(value, "\r", ""), "\n")
    sizes, lines = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False), lines.flatten()
    full = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    if not full.all():  # empty lines don't count
        ends = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(sizes)])]
        sizes, lines = np.diff(ends), lines.filter(pa.array(full))
    many = sizes // 4
    before = np.cumsum(many) - many
    first = np.repeat(np.cumsum(sizes) - sizes, many) + 4 * (np.arange(many.sum()) - np.repeat(before, many))
    name = pc.utf8_slice_codeunits(lines.take(pa.array(first)), 1)
    if pc.any(pc.match_substring_regex(name, "[ \t]")).as_py():
        name = pc.replace_substring_regex(name, r"(?s)[ \t].*", "")
    return name, lines.take(pa.array(first + 1)), lines.take(pa.array(first + 3))


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write(records: DataFrame, path: str, compressed: bool = True) -> None:
    qual = F.col("qual") if "qual" in records.columns else None
    records.select(record(F.col("id"), F.col("seq"), qual).alias("value")).write.text(path, compression="gzip" if compressed else "none")


def graph_lines(vertices: DataFrame, arcs: DataFrame, overlap: int, rate: float = 0.0) -> DataFrame:
    """kind, line of a graph file: a header, a line a vertex and a line an undirected edge. ``vertices``: v, id, seq; ``arcs``: one row an edge (a, b, size) with both lengths known from the vertices."""
    head = vertices.sparkSession.range(1).select(F.lit("HT").alias("kind"), F.lit(f"HT\tVN:i:1\tER:f:{rate:g}\tOL:i:{overlap}").alias("line"))
    body = vertices.select(F.lit("VT").alias("kind"), F.concat_ws("\t", F.lit("VT"), "id", "seq").alias("line"))
    side = lambda n: vertices.select(F.col("v").alias(f"v{n}"), F.col("id").alias(f"id{n}"), F.length("seq").alias(f"l{n}"))
    rows = arcs.select(F.shiftright("a", 1).alias("v0"), F.shiftright("b", 1).alias("v1"), (F.col("a") % 2).alias("s0"), (F.col("b") % 2).alias("s1"), "size").join(side(0), "v0").join(side(1), "v1")
    start0 = F.when(F.col("s0") == 0, F.col("l0") - F.col("size")).otherwise(0)
    start1 = F.when(F.col("s1") == 0, F.lit(0)).otherwise(F.col("l1") - F.col("size"))
    fields = F.concat_ws(" ", "id0", "id1", start0, start0 + F.col("size") - 1, "l0", start1, start1 + F.col("size") - 1, "l1", (F.col("s0") != F.col("s1")).cast("int"), F.lit(0))
    return head.unionAll(body).unionAll(rows.select(F.lit("ED").alias("kind"), F.concat(F.lit("ED\t"), fields).alias("line")))


def parse_graph(lines: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, vertices and edges of lines (column value); edges over less than ``least`` bases are left out."""
    parts = lines.select(F.split("value", "\t").alias("p"))
    tag = lambda name: F.regexp_extract(F.array_join("p", "\t"), rf"\b{name}:[iAZf]:([^\t]*)", 1)
    blank = lambda c: F.when(c != "", c)
    header = parts.filter(F.col("p")[0] == "HT").select(*[blank(tag(n)).cast(t).alias(n.lower()) for n, t in (("VN", "int"), ("ER", "float"), ("OL", "int"), ("IN", "string"), ("CN", "int"), ("TE", "int"))])
    vertices = parts.filter(F.col("p")[0] == "VT").select(F.get("p", F.lit(1)).alias("id"), F.get("p", F.lit(2)).alias("seq"), blank(tag("SS")).cast("int").alias("ss"))
    f = F.split(F.get("p", F.lit(1)), " ")
    names = (("id0", "string"), ("id1", "string"), ("s0", "int"), ("e0", "int"), ("l0", "int"), ("s1", "int"), ("e1", "int"), ("l1", "int"))
    edges = parts.filter(F.col("p")[0] == "ED").select(*[F.get(f, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)], (F.get(f, F.lit(8)) == "1").alias("is_rc"), F.get(f, F.lit(9)).cast("int").alias("num_diff"))
    return header, vertices, edges.filter(F.col("e0") - F.col("s0") + 1 >= least)


def contig_lines(contigs: DataFrame) -> DataFrame:
    """FASTA of v, seq, cov with length and coverage in the header."""
    head = F.concat_ws(" ", F.concat(F.lit(">contig-"), F.col("v").cast("string")), F.length("seq"), "cov")
    return contigs.select(F.concat(head, F.lit("\n"), "seq").alias("value"))


def dot_lines(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """Graphviz statements of vertices (v, seq) and arcs."""
    nodes = vertices.select(F.format_string('"%d" [ label="%d %d" ];', "v", "v", F.length("seq").cast("bigint")).alias("value"))
    links = arcs.select(F.format_string('"%d" -> "%d" [label="%d" color="%s"];', F.shiftright("a", 1), F.shiftright("b", 1), F.col("size").cast("bigint"), F.when(F.col("a") % 2 == 0, "black").otherwise("red")).alias("value"))
    return nodes.unionAll(links)
