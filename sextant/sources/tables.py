"""Typed views of the driver's tables under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYMBOL_KINDS = ("function", "class", "method", "constant", "type", "template", "import")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: id, name, kind, file, cyclomatic, summary, byte_length."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("file"),
        F.col("p_size").alias("cyclomatic"), F.concat_ws(" ", "p_name", "p_type").alias("summary"), F.floor(F.col("p_retailprice")).cast("long").alias("byte_length"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their distinct parts as commits and their files: sha, ts, author, subject, file."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("subject"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).distinct()
    return orders.join(files, "sha")


def part_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to part edges (src, dst) of all lines: the part on an order's next line, in the order of line numbers and parts; self-edges dropped."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return steps.where("src <> dst").distinct()


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the deliveries they came in, a supplier's lines of one day: file, name."""
    name = F.struct("l_suppkey", F.to_date("l_shipdate").alias("day"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), name.alias("name"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def runtime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trace rows: symbol_id, source, duration_ms, ts, event_id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), F.col("event_type").alias("source"), F.col("value").alias("duration_ms"), "ts", "event_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sections: id, doc_path (its source), content, title (first line)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_path"), F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("title"), "lang")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, target): hrefs of pages, by page and lower-cased path."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.explode(hrefs).alias("target"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as documents of nested sections: id, doc, turn, parent_id (each section holds two), level, title, content, byte_start, byte_end."""
    c, t = F.col("conv_id"), F.col("turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("id"), c.alias("doc"), t.alias("turn"), F.when(t > 0, c * 1000 + F.floor((t - 1) / 2)).alias("parent_id"), (F.floor(F.log2(t + 1.0 + 1e-9)) + 1).cast("int").alias("level"),
        F.concat_ws(" ", "role", t.cast("string")).alias("title"), F.col("text").alias("content"), (F.sum(size).over(w) - size).alias("byte_start"), F.sum(size).over(w).alias("byte_end"))
