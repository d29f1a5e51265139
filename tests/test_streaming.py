"""Micro-batches of changes give the tables of one rebuild; a batch that runs twice changes nothing."""

from lodestone.operators import graph
from lodestone.streaming import changes


def rows(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_rebuild(spark, tmp_path):
    one = [("a.py", "def alpha_one(x):\n    return beta_two(x)\n", 1), ("b.py", "def beta_two(x):\n    return 1\n", 1), ("c.md", "# Title here\n\nalpha_one is used\n", 1)]
    two = [("b.py", "def gamma_three(x):\n    return 1\n", 2), ("b.py", "def beta_two(x):\n    return alpha_one(x)\n", 3), ("c.md", None, 1), ("d.py", "def delta_four():\n    return alpha_one(2)\n", 1)]
    index = changes.Index(spark, str(tmp_path / "tables"))
    for n, batch in enumerate((one, two)):
        spark.createDataFrame(batch, changes.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index.follow(str(tmp_path / "in"), str(tmp_path / "checkpoint")).awaitTermination()
    final = {"a.py": one[0][1], "b.py": two[1][1], "d.py": two[3][1]}
    chunks = changes.chunked(spark.createDataFrame(sorted(final.items()), "path string, content string"))
    assert rows(index.catalog.read("chunks").select("id", "path", "name")) == rows(chunks.select("id", "path", "name"))
    assert rows(index.catalog.read("mentions")) == rows(index._mentions(chunks))
    before = index.catalog.versions()
    index.apply(spark.createDataFrame(two, changes.SCHEMA), 1)
    assert index.catalog.versions() == before
    assert index.indegree().count() > 0
