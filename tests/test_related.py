"""Symbols related by file, shared importers and words."""

from sextant.operators import composites


def test_shared_importers_count(spark):
    rows = [(1, "read file", "a"), (2, "open socket", "a"), (3, "parse tree", "b"), (4, "read tree", "c"), (5, "draw line", "d"), (6, "read line", "b")]
    importers = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("a", "z"), ("b", "z")], "file string, importer string")
    symbols = spark.createDataFrame(rows, "id long, name string, file string")
    got = [(r.id, r.score) for r in composites.related(symbols, 1, importers=importers).collect()]
    assert got == [(2, 3.0), (6, 2.0), (3, 1.5), (4, 0.5)]
