"""A stored inverted index, and ranked boolean search that reads nothing but it.

Documents fall into blocks by a hash of their id, BLOCK of them on average. A row of ``postings`` is one term in one
block: its documents with their lengths, counts and positions in each column, and beside them the largest count and the
least length, which bound what any document of the block can score. A term of many documents is many rows, so no term
is hot. Rows lie in ``bucket`` folders by a hash of their term and are sorted by term: a query reads the buckets of its
words. ``terms`` has each term's document counts, ``lengths`` each document's, ``stats`` the sums over all.

A query of plain words with a limit reads the bounds first: the most promising blocks are scored, and of the others only
those whose bound reaches the score of the last row wanted. The rows are those of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scratch import keep, sent
from .filters import first_then_fill
from .text import K1, LEAST_IDF, WEIGHTS, B, Query, leaves_of, parse, query_tokens, tokens

BLOCK, BUCKETS = 1024, 64
#: A block of long documents has about so many tokens instead; a task puts so many blocks together, one at a time.
BLOCK_TOKENS, BLOCKS_OF_A_TASK = 1 << 20, 8
#: Blocks that are scored first, and how many there must be for bounds to pay.
SEED_BLOCKS, PRUNE_FROM = 16, 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def block(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("long")


@dataclass
class Index:
    """The tables of an index over some columns of a table with ids."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    columns: tuple[str, ...] = ("name", "content")
    _one: dict = field(default_factory=dict, repr=False)

    @property
    def sums(self) -> dict:
        """rows, blocks and total_{column}, read once."""
        if not self._one:
            self._one.update(self.stats.first().asDict())
        return self._one

    def tables(self, prefix: str = "") -> dict[str, DataFrame]:
        return {f"{prefix}{n}": getattr(self, n) for n in ("postings", "terms", "lengths", "stats")}


def _schema(id_type: str, columns: tuple[str, ...]) -> str:
    """Columns of postings, but for the bucket."""
    doc = ", ".join([f"id: {id_type}", *[f"tf_{c}: int" for c in columns], *[f"at_{c}: array<int>" for c in columns], *[f"n_{c}: int" for c in columns]])
    counts = ", ".join([f"most_{c} int" for c in columns] + [f"least_{c} int" for c in columns] + ["df long"] + [f"df_{c} long" for c in columns])
    return f"term string, block long, docs array<struct<{doc}>>, {counts}"


def _tokenised(columns: tuple[str, ...]) -> list[Column]:
    return [tokens(F.col(c)).alias(c) for c in columns]


def _lengths(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select("id", *[F.size(tokens(F.col(c))).alias(f"n_{c}") for c in columns])


def _pairs(rows, columns: tuple[str, ...]):
    """An Arrow table of each term of each document (term and the fields of a doc) from rows of ids and tokens."""
    import pyarrow as pa

    ids, flat, doc, col, at, n = rows["id"].combine_chunks(), [], [], [], [], []
    for k, c in enumerate(columns):
        words = rows[c].combine_chunks()
        size = words.value_lengths().to_numpy(zero_copy_only=False)
        flat.append(words.flatten())
        doc.append(np.repeat(np.arange(len(size)), size))
        at.append(np.arange(len(doc[-1])) - np.repeat(np.cumsum(size) - size, size))
        col.append(np.full(len(doc[-1]), k))
        n.append(size)
    coded = pa.concat_arrays(flat).dictionary_encode()
    doc, col, at = np.concatenate(doc), np.concatenate(col), np.concatenate(at)
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(ids), 1) + doc
    order = np.argsort(key, kind="stable")  # within a pair by column, then place
    key, col, at = key[order], col[order], at[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    of = key[starts] % max(len(ids), 1)
    out = {"term": coded.dictionary.take(pa.array(key[starts] // max(len(ids), 1))), "id": ids.take(pa.array(of))}
    tf = [np.add.reduceat(col == k, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32) for k in range(len(columns))]
    out |= {f"tf_{c}": pa.array(tf[k]) for k, c in enumerate(columns)}
    out |= {f"at_{c}": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(tf[k])]).astype(np.int32), at[col == k].astype(np.int32)) for k, c in enumerate(columns)}
    return pa.table(out | {f"n_{c}": pa.array(n[k][of].astype(np.int32)) for k, c in enumerate(columns)})


def _rows(pairs, block: int, columns: tuple[str, ...], schema):
    """Rows of postings, as an Arrow table, from the pairs of a block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(pairs):
        return schema.empty_table()
    pairs = pairs.combine_chunks()
    one = lambda c: pairs[c].chunk(0)
    coded, known = one("term").dictionary_encode(), pc.unique(one("id"))
    rank = pc.index_in(one("id"), value_set=known.take(pc.sort_indices(known))).to_numpy()
    key = coded.indices.to_numpy().astype(np.int64) * len(known) + rank
    order = np.argsort(key, kind="stable")
    code, pairs = key[order] // len(known), pairs.take(pa.array(order)).combine_chunks()
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    fields = ["id", *[f"{x}_{c}" for x in ("tf", "at", "n") for c in columns]]
    docs = pa.StructArray.from_arrays([one(f) for f in fields], names=fields)
    out = [coded.dictionary.take(pa.array(code[starts])), pa.array(np.full(len(starts), block)), pa.ListArray.from_arrays(np.append(starts, len(code)).astype(np.int32), docs)]
    tf, n = ([one(f"{x}_{c}").to_numpy() for c in columns] for x in ("tf", "n"))
    out += [np.maximum.reduceat(x, starts) for x in tf] + [np.minimum.reduceat(x, starts) for x in n] + [np.diff(np.append(starts, len(code)))]
    out += [np.add.reduceat(x > 0, starts, dtype=np.int64) for x in tf]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=schema.names).cast(schema)


def _in_blocks(df: DataFrame, columns: tuple[str, ...], blocks: int) -> DataFrame:
    """postings of the documents of df. The texts are dealt out by block once, and each block is put together by itself."""
    made = _schema(dict(df.dtypes)["id"], columns)
    schema = to_arrow_schema(StructType.fromDDL(made))
    rows = df.select("id", block(F.col("id"), blocks).alias("block"), *columns).repartition(_tasks(blocks), "block").sortWithinPartitions("block")

    def whole(key, rows):
        return _rows(_pairs(rows, columns), key[0].as_py(), columns, schema)

    return rows.select("block", "id", *_tokenised(columns)).groupBy("block").applyInArrow(whole, made)


def _tasks(blocks: int) -> int:
    return -(-blocks // BLOCKS_OF_A_TASK)


def _whole(postings: DataFrame, lengths: DataFrame, blocks: int, columns: tuple[str, ...], name: str) -> Index:
    """The tables of postings, which are written as they lie: each task has its blocks' rows of all buckets."""
    counts = ["df", *[f"df_{c}" for c in columns]]
    laid = postings.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "block")
    postings = keep(laid, f"{name}-postings", "bucket")
    terms = keep(postings.groupBy("bucket", "term").agg(*[F.sum(c).alias(c) for c in counts]).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"), f"{name}-terms", "bucket")
    stats = lengths.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"total_{c}") for c in columns]).withColumn("blocks", F.lit(blocks).cast("long"))
    return Index(postings, terms, lengths, keep(stats, f"{name}-stats"), columns)


def build(df: DataFrame, columns: tuple[str, ...] = ("name", "content"), block_size: int = BLOCK, name: str = "index") -> Index:
    """The index of df (id, columns), written to the shared folder. A block has ``block_size`` documents on average, or BLOCK_TOKENS tokens."""
    lengths = keep(_lengths(df, columns), f"{name}-lengths")
    n, total = lengths.agg(F.count("*"), F.coalesce(F.sum(sum((F.col(f"n_{c}") for c in columns), F.lit(0)).cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // block_size), -(-total // BLOCK_TOKENS))
    return _whole(_in_blocks(df, columns, blocks), lengths, blocks, columns, name)


def update(index: Index, gone: DataFrame, fresh: DataFrame, name: str = "index") -> Index:
    """The index without the ids of ``gone`` and with the rows of ``fresh``; only blocks that these touch are put together anew.

    Equal to build() over the rows that are there now, but for the number of blocks, which stays.
    """
    columns, blocks = index.columns, int(index.sums["blocks"])
    out = gone.select("id").union(fresh.select("id")).distinct()
    stay = index.lengths.join(out, "id", "left_anti")
    lengths = keep(stay.unionByName(_lengths(fresh, columns)), f"{name}-lengths")
    touched = F.broadcast(keep(out.select(block(F.col("id"), blocks).alias("block")).distinct(), f"{name}-touched"))  # a row for each block
    made = _schema(dict(index.lengths.dtypes)["id"], columns)
    schema = to_arrow_schema(StructType.fromDDL(made))
    moved = ["id", *[f"{x}_{c}" for x in ("tf", "at") for c in columns]]  # lengths are known from their own table

    def anew(key, old, new):
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = {c: old[c].combine_chunks() for c in old.column_names if c not in ("block", "term")}
        terms = old["term"].combine_chunks().take(pa.array(np.repeat(np.arange(len(old)), flat["id"].value_lengths().to_numpy())))
        flat = {c: x.flatten() for c, x in flat.items()}
        lists = {f"at_{c}": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(flat[f"tf_{c}"].to_numpy())]).astype(np.int32), flat[f"at_{c}"]) for c in columns}
        pairs = pa.table([terms, *[lists[f] if f in lists else flat[f] for f in moved]], names=["term", *moved])
        known = new.filter(pc.invert(new["fresh"])).combine_chunks()
        of = pc.index_in(pairs["id"], value_set=known["id"].combine_chunks())
        pairs, of = pairs.filter(of.is_valid()), of.drop_null()
        for c in columns:
            pairs = pairs.append_column(f"n_{c}", known[f"n_{c}"].take(of))
        more = _pairs(new.filter(new["fresh"]), columns).select(pairs.column_names).cast(pairs.schema)
        return _rows(pa.concat_tables([pairs, more]), key[0].as_py(), columns, schema)

    fresh = fresh.select("id", F.lit(True).alias("fresh"), *columns).unionByName(stay.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
    fresh = fresh.withColumn("block", block(F.col("id"), blocks)).join(touched, "block", "left_semi").repartition(_tasks(blocks), "block")
    # plain arrays, which take a third of the room of arrays of documents
    plain = [F.flatten(F.col(f"docs.{f}")).alias(f) if f.startswith("at_") else F.col(f"docs.{f}").alias(f) for f in moved]
    old = index.postings.join(touched, "block", "left_semi").select("block", "term", *plain).repartition(_tasks(blocks), "block")
    now = old.groupBy("block").cogroup(fresh.select("block", "id", "fresh", *[f"n_{c}" for c in columns], *_tokenised(columns)).groupBy("block")).applyInArrow(anew, made)
    same = index.postings.join(touched, "block", "left_anti")
    return _whole(same.select(*now.columns).unionByName(now), lengths, blocks, columns, name)


# search


def _asked(leaves: list[Query]) -> Column:
    """Rows of the terms that the leaves need."""
    words = sorted({w for q in leaves if q.op != "prefix" for w in q.parts})
    asked = F.col("bucket").isin(*[bucket(F.lit(w)) for w in words]) & F.col("term").isin(*words) if words else F.lit(False)
    for q in leaves:
        if q.op == "prefix":
            asked = asked | F.col("term").startswith(q.parts[0])
    return asked


def _count(q: Query, c: str, at: dict[tuple[str, str], Column]) -> Column:
    """Occurrences of a phrase or a NEAR group, from the positions of its words in a column."""
    first = at[q.parts[0], c]
    if q.op == "phrase":
        follow = lambda p: reduce(lambda x, y: x & y, [F.array_contains(at[w, c], p + k) for k, w in enumerate(q.parts[1:], 1)])
        return F.size(F.filter(first, follow))
    close = lambda other: F.exists(first, lambda p: F.exists(other, lambda x: F.abs(x - p) <= q.distance))
    return reduce(lambda n, w: n * close(at[w, c]).cast("int"), q.parts[1:], F.size(first))


def _facts(rows: DataFrame, leaves: list[Query], columns: list[str]) -> DataFrame:
    """id, n (tokens of the columns) and tf{i}_{column} of each document in rows of postings."""
    rows = rows.select("term", F.explode("docs").alias("d"))
    by_place = sorted({w for q in leaves if q.op in ("phrase", "near") for w in q.parts})
    sums = []
    for i, q in enumerate(leaves):
        if q.op in ("term", "prefix"):
            is_ = F.col("term") == q.parts[0] if q.op == "term" else F.col("term").startswith(q.parts[0])
            sums += [F.sum(F.when(is_, F.col(f"d.tf_{c}")).otherwise(0)).alias(f"tf{i}_{c}") for c in columns]
    places = [F.first(F.when(F.col("term") == w, F.col(f"d.at_{c}")), ignorenulls=True).alias(f"at_{c}_{k}") for k, w in enumerate(by_place) for c in columns]
    n = sum((F.max(f"d.n_{c}") for c in columns), F.lit(0))
    got = rows.groupBy(F.col("d.id").alias("id")).agg(n.alias("n"), *sums, *places)
    none = F.array().cast("array<int>")
    at = {(w, c): F.coalesce(F.col(f"at_{c}_{k}"), none) for k, w in enumerate(by_place) for c in columns}
    counted = [_count(q, c, at).alias(f"tf{i}_{c}") if q.op in ("phrase", "near") else F.col(f"tf{i}_{c}") for i, q in enumerate(leaves) for c in columns]
    return got.select("id", "n", *counted)


def _holds(q: Query, at: dict[int, Column]) -> Column:
    """Whether a document holds, given whether each leaf (by identity) does."""
    if q.op in ("and", "or"):
        join = (lambda a, b: a & b) if q.op == "and" else (lambda a, b: a | b)
        return reduce(join, [_holds(p, at) for p in q.parts])
    if q.op == "not":
        return _holds(q.parts[0], at) & ~_holds(q.parts[1], at)
    return at[id(q)]


def _idf(rows: int, held: int) -> float:
    import math

    x = math.log((rows - held + 0.5) / (held + 0.5))
    return x if x > 0 else LEAST_IDF


def _gain(f: Column, n: Column, mean: float) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * n / F.lit(mean)))


def _document_counts(index: Index, leaves: list[Query], columns: list[str]) -> list[int]:
    """In how many documents each leaf occurs."""
    if all(q.op == "term" for q in leaves) and (len(columns) == 1 or len(columns) == len(index.columns)):
        kind = "df" if len(columns) > 1 or len(index.columns) == 1 else f"df_{columns[0]}"
        known = {r.term: r[kind] for r in index.terms.where(_asked(leaves)).select("term", kind).collect()}  # one row for each word
        return [known.get(q.parts[0], 0) for q in leaves]
    facts = _facts(index.postings.where(_asked(leaves)), leaves, columns)
    has = [F.count_if(F.greatest(*[F.col(f"tf{i}_{c}") for c in columns], F.lit(0)) > 0) for i in range(len(leaves))]
    return list(facts.agg(*[h.alias(f"df{i}") for i, h in enumerate(has)]).first())


def _worth(index: Index, rows: DataFrame, leaves: list[Query], idf: list[float], weights: dict[str, float], mean: float, every: bool, scored, top_k: int) -> DataFrame:
    """rows without the blocks that cannot hold one of the first top_k."""
    f = sum((F.col(f"most_{c}") * w for c, w in weights.items()), F.lit(0.0))
    n = sum((F.col(f"least_{c}") for c in weights), F.lit(0))
    of_term = F.create_map(*[x for q, i in zip(leaves, idf, strict=True) for x in (F.lit(q.parts[0]), F.lit(i))])
    heads = rows.select("block", "term", F.when(f > 0, F.element_at(of_term, F.col("term")) * _gain(f, n, mean)).otherwise(0.0).alias("bound"))
    bounds = keep(heads.groupBy("block").agg((F.sum("bound") * (1 + 1e-9)).alias("bound"), F.count("*").alias("n_terms")).where(F.col("n_terms") == len({q.parts[0] for q in leaves}) if every else F.lit(True)), "bounds")
    first = bounds.orderBy(F.desc("bound"), "block").limit(SEED_BLOCKS)
    best = scored(rows.join(F.broadcast(first.select("block")), "block", "left_semi")).orderBy("score").limit(top_k).collect()  # SEED_BLOCKS rows; top_k rows
    least = -best[-1].score if len(best) == top_k else 0.0
    return rows.join(bounds.where(F.col("bound") >= least).select("block"), "block", "left_semi")


def _ranked(index: Index, q: Query, weights: dict[str, float], top_k: int | None) -> DataFrame:
    """id and score (negative, the best first) of the documents that hold."""
    columns, leaves, every = list(weights), leaves_of(q), leaves_of(q, True)
    sums = index.sums
    mean = sum(sums[f"total_{c}"] for c in columns) / max(sums["rows"], 1) or 1.0
    idf = [_idf(sums["rows"], n) for n in _document_counts(index, leaves, columns)]
    own = [next(i for i, x in enumerate(every) if x is q_) for q_ in leaves]

    def scored(rows: DataFrame) -> DataFrame:
        facts = _facts(rows, every, columns)
        at = {id(x): F.greatest(*[F.col(f"tf{i}_{c}") for c in columns], F.lit(0)) > 0 for i, x in enumerate(every)}
        total = F.lit(0.0)
        for i, x in zip(own, idf, strict=True):
            f = sum((F.col(f"tf{i}_{c}") * w for c, w in weights.items()), F.lit(0.0))
            total = total + F.when(f > 0, F.lit(x) * _gain(f, F.col("n"), mean)).otherwise(0.0)
        return facts.where(_holds(q, at)).select("id", (-total).alias("score"))

    rows = index.postings.where(_asked(every))
    plain = q.op == "term" or (q.op in ("and", "or") and all(p.op == "term" for p in q.parts))
    if top_k and plain and sums["blocks"] >= PRUNE_FROM:
        rows = _worth(index, rows, leaves, idf, weights, mean, q.op == "and", scored, top_k)
    out = scored(rows)
    return out.orderBy("score", "id").limit(top_k) if top_k else out


def bm25(index: Index, terms: list[str], every: bool = True, weights: dict[str, float] = WEIGHTS, top_k: int | None = 20) -> DataFrame:
    """id and score of documents that hold all (or any) terms, the best first."""
    leaves = [Query("term", [t]) for t in terms]
    return _ranked(index, Query("and" if every else "or", leaves), weights, top_k)


def search(index: Index, query: str, weights: dict[str, float] = WEIGHTS, top_k: int | None = 20) -> DataFrame:
    """id and score for a query in the boolean language; its leaves, but those after NOT, count as terms of BM25."""
    return _ranked(index, parse(query), weights, top_k)


def fts(index: Index, query: str, **kw) -> tuple[DataFrame, list[str]]:
    """search(); where the syntax is bad, all its words are asked for instead, with a note."""
    try:
        return search(index, query, **kw), []
    except ValueError as e:
        return bm25(index, query_tokens(query), **kw), [f"read as plain words: {e}"]


def fts_or_any(index: Index, query: str, **kw) -> tuple[DataFrame, list[str]]:
    """All words, or any of them where no document has all."""
    words = query_tokens(query)
    got = bm25(index, words, **kw)
    return (got, []) if got.limit(1).count() else (bm25(index, words, every=False, **kw), ["no row has all words; any of them"])


def keyword_fill(index: Index, terms: list[str], top_k: int) -> DataFrame:
    """Documents with all terms by score, then documents with any."""
    return first_then_fill(bm25(index, terms, True, top_k=top_k), bm25(index, terms, False, top_k=top_k), [F.col("score"), F.col("id")], top_k)


# many phrases at once


def _matches(rows, names, schema):
    """An Arrow table of name and id: rows of a block's postings (term, id, at) in which the words (w) of names stand in a row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = pa.chunked_array([x.flatten() for x in rows["id"].chunks], rows.schema.field("id").type.value_type)
    known = pc.unique(ids)
    known = known.take(pc.sort_indices(known))
    of, keys, a = pc.index_in(ids, value_set=known).to_numpy(), {}, 0
    for term, lists in zip(rows["term"].to_pylist(), (x for c in rows["at"].chunks for x in c), strict=True):
        at, n = lists.values, len(lists.values)
        at_doc = np.repeat(of[a : a + n], at.value_lengths().to_numpy().astype(np.int64)).astype(np.int64)
        keys[term] = np.sort((at_doc << 32) | at.flatten().to_numpy())  # by document, then place
        a += n
    found_name, found_id = [], []
    for name, w in zip(names["name"].to_pylist(), names["w"].to_pylist(), strict=True):
        k = min(range(len(w)), key=lambda i: len(keys[w[i]]))  # the rarest word; the others are looked up beside it
        start = keys[w[k]]
        start = start[(start & 0xFFFFFFFF) >= k] - k
        for j, word in enumerate(w):
            if j != k and len(start):
                there = keys[word]
                start = start[there[np.minimum(np.searchsorted(there, start + j), len(there) - 1)] == start + j]
        docs = np.unique(start >> 32)
        found_id.append(docs)
        found_name += [name] * len(docs)
    found = np.concatenate(found_id).astype(np.int64) if found_id else np.zeros(0, np.int64)
    return pa.table([pa.array(found_name, pa.string()), known.take(pa.array(found))], names=schema.names).cast(schema)


def phrases(index: Index, names: DataFrame, column: str = "content") -> DataFrame:
    """name and id: documents that hold all words of a name (one column, ``name``) in a row, for any number of names.

    Of the postings only those of the names' words are moved, as they lie and once: to their block. There the places of a name's
    rarest word are held against those of its other words. A block is sent the names all of whose words it has.
    """
    words = names.select("name").distinct().withColumn("w", tokens(F.col("name"))).where(F.size("w") > 0)
    each = words.select("name", "w", F.explode("w").alias("term")).withColumn("bucket", bucket(F.col("term")))
    each = sent(keep(each, "phrase-words"), "name", "name", "term")
    held = index.postings.where(F.col(f"df_{column}") > 0)
    asked = held.select("bucket", "term", "block").join(each, ["bucket", "term"]).groupBy("name", "w", "block").agg(F.count("*").alias("n")).where(F.col("n") == F.size("w"))
    asked = keep(asked.select("block", "name", "w"), "phrase-names")
    some = held.join(each.select("bucket", "term"), ["bucket", "term"], "left_semi")
    rows = some.select("block", "term", F.col("docs.id").alias("id"), F.col(f"docs.at_{column}").alias("at"))
    made = StructType.fromDDL(f"name string, id {dict(index.lengths.dtypes)['id']}")
    schema = to_arrow_schema(made)

    def match(rows, names):
        return _matches(rows, names, schema)

    return rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(match, made)
