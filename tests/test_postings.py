"""The stored index against scans of the texts, its upkeep against an index made anew, and block bounds against full scoring."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, text

QUERIES = ["alpha", "alpha beta", "alpha OR gamma", '"alpha beta"', "al*", "alpha NOT beta", "(alpha OR de*) NOT gamma", 'NEAR(alpha gamma, 3)', '"beta beta gamma"', "zzz", "alpha AND zzz"]


def corpus(n, seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "é", "x1"]
    rows = [(i, r.choice(["alpha", "Beta_Gamma", None, ""]), r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", ""), (n + 2, "alpha", "Alpha " * 300)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, content string")


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.fixture(scope="module")
def both(spark):
    df = table(spark, corpus(60, 1)).cache()
    return df, postings.build(df, block_size=7)


@pytest.mark.parametrize("weights", [{"content": 1.0}, {"name": 5.0, "content": 1.0}])
@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_a_scan(both, query, weights):
    df, index = both
    assert scores(postings.search(index, query, weights, None)) == scores(text.search(df, query, weights, None))


def test_other_shapes(both, spark):
    df, index = both
    for every in (True, False):
        assert scores(postings.bm25(index, ["alpha", "gamma"], every)) == scores(text.bm25(df, ["alpha", "gamma"], every))
    assert [r.id for r in postings.keyword_fill(index, ["alpha", "delta"], 9).collect()] == [r.id for r in text.keyword_fill(df, ["alpha", "delta"], 9).collect()]
    got, notes = postings.fts(index, "alpha (", top_k=None)
    assert notes and scores(got) == scores(text.bm25(df, ["alpha"], top_k=None))
    assert postings.fts_or_any(index, "alpha zzz")[1]
    none = postings.build(table(spark, []))
    assert postings.bm25(none, ["alpha"]).count() == 0 and none.sums["rows"] == 0


def test_bounds_leave_the_first_rows(spark, monkeypatch):
    monkeypatch.setattr(postings, "PRUNE_FROM", 2)
    monkeypatch.setattr(postings, "SEED_BLOCKS", 2)
    df = table(spark, corpus(150, 2))
    index = postings.build(df, block_size=4)
    assert index.sums["blocks"] > 20
    read = []
    real = postings._worth

    def worth(index, rows, *args):
        out = real(index, rows, *args)
        read.append((out.select("block").distinct().count(), rows.select("block").distinct().count()))
        return out

    monkeypatch.setattr(postings, "_worth", worth)
    for terms, every in ((["alpha"], True), (["alpha", "x1"], True), (["gamma", "delta"], False), (["zzz"], False)):
        assert scores(postings.bm25(index, terms, every, {"content": 1.0}, 5)) == scores(text.bm25(df, terms, every, {"content": 1.0}, 5))
    assert len(read) == 4 and any(a < b for a, b in read)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_update_equals_a_build(spark, seed):
    rows = corpus(50, seed)
    r = random.Random(seed)
    gone, changed = set(r.sample(range(53), 9)), {i: f"fresh alpha {i} " + r.choice(["beta", "gamma gamma"]) for i in r.sample(range(70), 8)}
    now = [(i, n, changed.get(i, t)) for i, n, t in rows if i not in gone and i not in changed] + [(i, "new", t) for i, t in changed.items()]
    index = postings.build(table(spark, rows), block_size=6)
    got = postings.update(index, spark.createDataFrame([(i,) for i in gone - set(changed)], "id long"), table(spark, [(i, "new", t) for i, t in changed.items()]))
    want = postings.build(table(spark, now), block_size=6)
    flat = lambda x: sorted(map(str, x.postings.select("term", F.explode("docs").alias("d")).select("term", "d.id", "d.tf_name", "d.tf_content", "d.at_name", "d.at_content", "d.n_name", "d.n_content").collect()))
    assert flat(got) == flat(want)
    assert sorted(got.terms.select("term", "df", "df_name", "df_content").collect()) == sorted(want.terms.select("term", "df", "df_name", "df_content").collect())
    assert {k: v for k, v in got.sums.items() if k != "blocks"} == {k: v for k, v in want.sums.items() if k != "blocks"}


def test_phrases_of_many_names(both, spark):
    df, index = both
    names = ["alpha", "alpha beta", "beta beta", "gamma alpha delta", "zzz", "alpha zzz", "", "Beta-Gamma"]
    got = {(r.name, r.id) for r in postings.phrases(index, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = set()
    for n in names:
        w = text.query_tokens(n)
        for r in df.collect():
            t = text.query_tokens(r.content or "")
            if w and any(t[i : i + len(w)] == w for i in range(len(t))):
                want.add((n, r.id))
    assert got == want


def test_a_query_reads_its_buckets_only(both):
    _, index = both
    plan = postings.bm25(index, ["alpha"], top_k=5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
