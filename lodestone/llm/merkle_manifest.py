"""A Merkle tree over a table of documents: one tree a language, one over the languages' roots, and a proof for each row.

H is the lower-case hex SHA-256 of its inputs, put together; digests go in as hex text. A leaf is H of the row's
fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Within a language the leaves ascend by
doc_id. While a tree has more than one node, every two neighbours become their H; a last node without a neighbour
becomes the H of itself alone.

The trees are walked in blocks of 2^BLOCK_LEVELS neighbours, aligned to that size. A block's nodes are one group: the
recursion returns a subtree's digest and, while it unwinds, appends the digest of each subtree's sibling to the proofs
of the leaves below it. The roots of the blocks are the nodes of the next, far smaller walk, until each tree has one
node. No task holds more than a block, so one language may hold all rows.

Places within a tree come from a range partitioning by (language, doc_id, leaf), whose rows are numbered as they lie;
the counts of (partition, language) are all that is summed over partitions.

Rows: a null language is a tree of its own, the first. A null doc_id comes before all others and is never tampered
with. Rows of equal doc_id are ordered by leaf; repeated rows are leaves of their own, and which of them stands first
is the same either way. Null and empty texts differ (``-`` and ``0:``). An empty table has no rows and no root. Other
columns, also of clashing names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, pick
from .decontaminate import _small as small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 12
#: Sides of a proof's steps: the sibling stands left, stands right, or there is none.
LEFT, RIGHT, NONE = b"L", b"R", b"-"


def _h(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The digest (binary) of a row of documents, with some fields given otherwise."""
    return F.unhex(F.sha2(F.concat(*[_field(instead.get(f, F.col(f))) for f in FIELDS]), 256))


def walk(digests: list[bytes], levels: int) -> tuple[bytes, list[bytearray], list[bytearray]]:
    """Root of a block after so many levels, and for each leaf its siblings from the lowest level up, put together, and their sides."""
    n = len(digests)
    siblings, sides = [bytearray() for _ in digests], [bytearray() for _ in digests]

    def visit(lo: int, level: int) -> bytes:
        if level == 0:
            return digests[lo]
        half = 1 << level - 1
        mid, end = lo + half, min(lo + 2 * half, n)
        left = visit(lo, level - 1)
        if mid >= n:
            for i in range(lo, n):
                sides[i] += NONE
            return _h(left)
        right = visit(mid, level - 1)
        for i in range(lo, mid):
            siblings[i] += right
            sides[i] += RIGHT
        for i in range(mid, end):
            siblings[i] += left
            sides[i] += LEFT
        return _h(left, right)

    return visit(0, levels), siblings, sides


def _walk_group(levels: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, [("pos", "ascending")]))
        n = block.column("n")[0].as_py()
        root, siblings, sides = walk(block.column("digest").to_pylist(), levels if n > 1 << levels else (n - 1).bit_length())
        top = [root] + [None] * (len(siblings) - 1)
        return pa.table(
            {
                **{c: block.column(c) for c in ("k", "pos", "n", "block", "row")},
                "siblings": pa.array([bytes(s) for s in siblings], pa.binary()),
                "sides": pa.array([bytes(s) for s in sides], pa.binary()),
                "top": pa.array(top, pa.binary()),
            }
        )

    return run


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with k) and pos, n: the place from 0 among rows of the same k, ascending by ``order`` with nulls first, and how many there are."""
    placed = rows.repartitionByRange("k", *order).sortWithinPartitions("k", *order).withColumn("at", F.monotonically_increasing_id())
    placed = keep(placed, "placed")  # 31 bits of partition, then 33 of the place in it
    parts = placed.groupBy("k", F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    tree = Window.partitionBy("k")  # at most a row for each partition
    parts = parts.select("k", "part", "first", F.sum("c").over(tree).alias("n"), F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = small(keep(parts, "parts"), F.octet_length("k"))
    placed = placed.withColumn("part", F.shiftright("at", 33)).join(parts, ["k", "part"])
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def proofs(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """row, siblings and sides of each of nodes (k, pos, n, digest, row), and what ``above`` adds to each tree's root.

    ``above`` takes k and digest of each tree and returns k, siblings and sides of the steps beyond, and other columns.
    """
    kind = nodes.schema["row"].dataType.simpleString()
    walked = nodes.select("k", "pos", "n", "digest", F.shiftright("pos", levels).alias("block"), "row").groupBy("k", "block")
    walked = walked.applyInArrow(_walk_group(levels), f"k string, pos long, n long, block long, row {kind}, siblings binary, sides binary, top binary")
    walked = keep(walked, "walked")
    tops = walked.where("top IS NOT NULL").select("k", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n"), F.col("top").alias("digest"))
    if tops.where("n > 1").isEmpty():
        beyond = above(tops.select("k", "digest")).withColumn("block", F.lit(0).cast("long"))
    else:
        beyond = proofs(tops.withColumn("row", F.col("pos")), above, levels).withColumnRenamed("row", "block")
    beyond = beyond.withColumnsRenamed({"siblings": "further", "sides": "further_sides"})
    beyond = small(keep(beyond, "beyond"), F.octet_length("k") + F.octet_length("further") + 100)
    both = walked.select("k", "block", "row", "siblings", "sides").join(beyond, ["k", "block"])
    rest = [c for c in beyond.columns if c not in ("k", "block", "further", "further_sides")]
    return both.select("k", "row", F.concat("siblings", "further").alias("siblings"), F.concat("sides", "further_sides").alias("sides"), *rest)


def build(docs: DataFrame, levels: int = BLOCK_LEVELS, **carry: Column) -> DataFrame:
    """doc_id, leaf, siblings, sides, subroot and root (binary) of each row, and columns computed from the row's fields.

    siblings are the proof's digests from the leaf up to the root, 32 bytes each; sides has a letter a level.
    """
    docs = pick(docs, *FIELDS).withColumn("leaf", leaf())
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))  # never null, and null first
    rows = docs.select(key.alias("k"), "doc_id", "leaf", *[c.alias(name) for name, c in carry.items()])
    rows = numbered(rows, "doc_id", "leaf").select("k", "pos", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", *carry).alias("row"))

    def languages(subroots: DataFrame) -> DataFrame:
        named = numbered(subroots.select(F.lit("").alias("k"), F.col("k").alias("tree"), "digest"), "tree")
        named = named.select("k", "pos", "n", "digest", F.struct("tree", "digest").alias("row"))
        end = lambda root: root.select("k", F.lit(b"").alias("siblings"), F.lit(b"").alias("sides"), F.col("digest").alias("root"))
        return proofs(named, end, levels).select(F.col("row.tree").alias("k"), "siblings", "sides", F.col("row.digest").alias("subroot"), "root")

    return proofs(rows, languages, levels).select("row.*", "siblings", "sides", "subroot", "root")


def fold(start: bytes, siblings: bytes, sides: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    digest, at = start, 0
    for side in sides:
        if side == NONE[0]:
            digest = _h(digest)
            continue
        other = siblings[at : at + 32]
        at += 32
        digest = _h(digest, other) if side == RIGHT[0] else _h(other, digest)
    return digest


def folded(proven: DataFrame, start: str) -> DataFrame:
    """With folded_root (binary): where the digest of the column ``start`` leads by the row's siblings and sides."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = map(fold, *(batch.column(c).to_pylist() for c in (start, "siblings", "sides")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(roots), pa.binary())], [*batch.schema.names, "folded_root"])

    return proven.mapInArrow(run, proven.withColumn("folded_root", F.lit(b"")).schema)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, with rows tampered with where 7 divides the CRC of doc_id."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = build(docs, found=F.when(chosen & F.col("n_chars").isNotNull(), leaf(n_chars=more)))
    got = folded(got.select("doc_id", "leaf", F.coalesce("found", "leaf").alias("found"), "siblings", "sides", "subroot", "root"), "found")
    text = lambda c: F.lower(F.hex(c))
    return got.select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
