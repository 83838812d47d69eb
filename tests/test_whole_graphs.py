"""Graph queries over whole tables, by brute force."""

import random

import pyarrow.parquet as pq

from sextant.operators import graph
from sextant.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def steps():
    """Edges of every line of every order."""
    t = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"]).to_pydict()
    lines = sorted(zip(t["l_orderkey"], t["l_linenumber"], t["l_partkey"], strict=True))
    return {(x[2], y[2]) for x, y in zip(lines, lines[1:], strict=False) if x[0] == y[0] and x[2] != y[2]}


def components(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for a in after:
        seen, todo = set(), [a]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[a] = seen
    return {(a, min(b for b in reach[a] if a in reach.get(b, ()))) for a in reach if a in reach[a]}


def test_no_line_is_left_out(spark):
    edges = steps()
    got = [(r.src, r.dst) for r in QUERIES["import_edges"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == edges
    assert {(r.node, r.scc) for r in QUERIES["import_cycles"](spark, SF).collect()} == components(edges)


def test_strong_components(spark):
    rng = random.Random(3)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(75)) if a != b} | {(100 + i, 101 + i) for i in range(4)} | {(104, 100), (110, 111)}
    got = [(r.node, r.scc) for r in graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == components(edges) and len({s for _, s in got}) > 1
    assert graph.strong_components(spark.createDataFrame([(1, 2)], "src long, dst long")).collect() == []


def test_communities_are_of_fused_edges(spark):
    weights = {(r.a, r.b): r.weight for r in QUERIES["tectonic_edges"](spark, SF).collect()}
    assert {tuple(sorted(e)) for e in steps()} <= set(weights)  # 0.4 or 0.2 each, none is light
    near = {}
    for (a, b), w in weights.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {v: v for v in near}
    for _ in range(50):
        new = {}
        for v in near:
            votes = {}
            for u, w in near[v]:
                votes[label[u]] = votes.get(label[u], 0) + w
            new[v] = min(votes, key=lambda x: (-round(votes[x], 6), x))
        label, done = new, new == label
        if done:
            break
    sizes = {}
    for x in label.values():
        sizes[x] = sizes.get(x, 0) + 1
    assert {r.label: r["size"] for r in QUERIES["communities"](spark, SF).collect()} == sizes
