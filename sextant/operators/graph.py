"""Graph analytics over edge tables: walks, ranks, components, communities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that loops keep no lineage."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:16]}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def invert(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: nodes reached from starts (node) and the fewest edges to them; starts have depth 0.

    Each round joins the frontier with the edges and leaves out what was
    reached; it ends with an empty frontier or at the depth.
    """
    edges = cut(edges.select("src", "dst").distinct())
    reached = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """node, rank: power iteration with the mass of nodes without edges spread evenly, until the L1 change is under the tolerance."""
    edges = edges.select("src", "dst").distinct()
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    links = cut(edges.join(out, F.col("src") == F.col("node")).select("src", "dst", "out"))
    base = cut(nodes.select("node").join(out, "node", "left"))
    ranks = base.select("node", "out", F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        loose = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")))
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        new = ranks.withColumnRenamed("rank", "old").join(given, "node", "left").join(loose)
        ranks = new.select("node", "out", "old", (F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if (i + 1) % every == 0 or i + 1 == rounds:
            ranks = cut(ranks)
            if ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                break
        ranks = ranks.drop("old")
    return ranks.select("node", "rank")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, scc: members of strongly connected components of two nodes and more, named by their least node.

    For graphs whose reachable pairs are too many. In each round every node
    takes the least node that reaches it; what reaches that node over nodes of
    the same name is its component, and goes. Edges between names go too.
    """
    live = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        n = live.count()
        while n:  # an edge on a cycle starts where another ends, and ends where another starts
            ends, starts = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
            live = cut(live.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"))
            if (m := live.count()) == n:
                break
            n = m
        if not n:
            break
        names = cut(live.select(F.col("src").alias("node")).distinct().withColumn("scc", F.col("node")))
        while True:
            heard = live.join(names, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("scc").alias("heard"))
            new = cut(names.join(heard, "node").select("node", "scc", F.least("scc", "heard").alias("least")))
            done = new.where("least <> scc").isEmpty()
            names = new.select("node", F.col("least").alias("scc"))
            if done:
                break
        named = live.join(names.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
        inner = cut(named.where("a = b").select("src", "dst", F.col("a").alias("scc")))
        reached = frontier = cut(names.where("node = scc"))
        while not frontier.isEmpty():
            step = inner.join(frontier.select(F.col("node").alias("dst"), "scc"), ["dst", "scc"]).select(F.col("src").alias("node"), "scc").distinct()
            frontier = cut(step.join(reached, ["node", "scc"], "left_anti"))
            reached = reached.unionByName(frontier)
        reached = cut(reached)
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("node")
        live = cut(inner.join(gone, inner.src == gone.node, "left_anti").join(gone, inner.dst == gone.node, "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    several = found.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(several, "scc", "left_semi").select("node", "scc")


def layer_violations(edges: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges from a node's layer to one that a rule forbids it. layers: (node, layer); rules: (layer, forbidden)."""
    src = layers.select(F.col("node").alias("src"), F.col("layer").alias("src_layer"))
    dst = layers.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"))
    ruled = rules.select(F.col("layer").alias("src_layer"), F.col("forbidden").alias("dst_layer"))
    return edges.join(src, "src").join(dst, "dst").join(ruled, ["src_layer", "dst_layer"]).select("src", "dst", "src_layer", "dst_layer")


def co_changes(commit_files: DataFrame, low: int = 2, high: int = 20) -> DataFrame:
    """a, b, together: files of the same commit, over commits of 2 to 20 files."""
    files = commit_files.select("sha", "file").distinct()
    sized = files.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sha"))).where(F.col("n").between(low, high))
    pairs = sized.alias("x").join(sized.alias("y"), (F.col("x.sha") == F.col("y.sha")) & (F.col("x.file") < F.col("y.file")))
    return pairs.groupBy(F.col("x.file").alias("a"), F.col("y.file").alias("b")).agg(F.count(F.lit(1)).alias("together"))


def share_of_max(edges: DataFrame, weight: str) -> DataFrame:
    """Undirected edges (a, b) weighed against the heaviest."""
    most = edges.agg(F.max(weight).alias("most"))
    return edges.join(F.broadcast(most)).select("a", "b", (F.col(weight) / F.col("most")).alias("share"))


def fuse_edges(structural: DataFrame, behavioural: DataFrame, temporal: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), least: float = 0.01) -> DataFrame:
    """a, b, weight of three edge tables (a, b, share), missing ones 0, light ones dropped."""
    parts = [p.select("a", "b", (F.lit(w) * F.col("share")).alias("part")) for p, w in zip((structural, behavioural, temporal), weights, strict=True)]
    fused = parts[0].union(parts[1]).union(parts[2]).groupBy("a", "b").agg(F.round(F.sum("part"), 6).alias("weight"))
    return fused.where(F.col("weight") > least)


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label: in each round every node takes the heaviest label around it, ties to the smallest; all at once, so reruns agree."""
    both = cut(edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select("node", F.col("best.label").alias("new"))
        new = cut(labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("new"), "label"))
        done = new.where("new <> label").isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if done:
            break
    return labels


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's undirected component."""
    both = cut(both_ways(edges))
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("label")))
    while True:
        heard = both.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        better = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("least"))
        new = cut(better.join(labels.select(F.col("node").alias("least"), F.col("label").alias("jump")), "least").select("node", "label", F.least("least", "jump").alias("new")))
        done = new.where("new <> label").isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if done:
            return labels


def plates(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community: size, anchor (its member with most weight inside), cohesion (weight inside over all of its weight)."""
    both = edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    named = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    per_node = named.groupBy(F.col("la").alias("label"), "a").agg(F.round(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)), 6).alias("inside"), F.round(F.sum("weight"), 6).alias("total"))
    per = per_node.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("inside")).alias("i"), "a")).alias("top"), F.sum("inside").alias("inside"), F.sum("total").alias("total"))
    return per.select("label", "size", F.col("top.a").alias("anchor"), F.when(F.col("total") > 0, F.round(F.col("inside") / F.col("total"), 4)).otherwise(0.0).alias("cohesion"))
