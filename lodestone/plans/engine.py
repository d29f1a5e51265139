"""The engine over one project: indexes a tree of files and answers the catalogue of queries. Each answer comes with notes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.embed import Embedder, embedded, hashing_embedder, reranked
from ..operators import classmodel, edgeset, filters, fusion, graph, incremental, message, navigation, postings, report, segment, text, usages, vectors
from ..operators import research as research_
from ..sources import files as files_
from .requests import Search

CHUNKER = "1"


@dataclass
class Answer:
    rows: DataFrame
    notes: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, embedder_name: str = "hashing-64", code: tuple[str, ...] = ("python",)):
        self.spark, self.catalog, self.code = spark, files_.Catalog(spark, folder), code
        self.embedder, self.embedder_name = embedder or hashing_embedder(), embedder_name

    # writing

    def index(self, root: str, includes=(), excludes=(), force: bool = False) -> dict[str, int]:
        """Scans the tree, cuts and embeds what changed, drops what is gone, and refreshes the derived tables."""
        c = self.catalog
        found = graph.keep(files_.admitted(files_.scan(self.spark, root, includes, excludes)))
        first = force or not c.has("files")
        old = found.select("path", "content_hash").limit(0) if first else c.read("files").select("path", "content_hash")
        delta = graph.keep(incremental.changes(old, found.select("path", "content_hash")))
        counts = {r.change: r["count"] for r in delta.groupBy("change").count().collect()}
        if not counts and not first:
            return {}
        todo = found.join(delta.where("change <> 'delete'").select("path"), "path", "left_semi")
        fresh = segment.segment_files(todo.select("path", "content")).withColumn("id", X.chunk_id(F.col("path"), F.col("start_line"), F.col("content"))).dropDuplicates(["id"])
        fresh = fresh.withColumn("embed_text", X.embed_text(F.col("path"), F.col("name"), F.col("content"))).withColumn("text_hash", X.content_hash(F.col("embed_text")))
        stored = c.read("vectors") if c.has("vectors") and c.meta().get("embedding_model") == self.embedder_name else None
        if stored is not None:
            have, todo_ = incremental.reuse_vectors(fresh.select("id", "text_hash", "embed_text"), stored)
            vecs = have.select("id", "text_hash", "embedding").unionByName(embedded(todo_, self.embedder, "embed_text").select("id", "text_hash", "embedding"))
        else:
            vecs = embedded(fresh, self.embedder, "embed_text").select("id", "text_hash", "embedding")
        vecs, fresh = graph.keep(vecs), graph.keep(fresh.drop("embed_text", "text_hash"))
        if first:
            chunks = fresh
        else:
            chunks = graph.keep(c.read("chunks").join(delta.select("path"), "path", "left_anti").unionByName(fresh))
            vecs = graph.keep(c.read("vectors").join(chunks.select("id"), "id", "left_semi").join(vecs.select("id"), "id", "left_anti").unionByName(vecs))
        members = graph.keep(self._members(found, chunks))
        ids = chunks.select("id")
        now = vecs.where("embedding IS NOT NULL")
        new, total, meta, ranks = chunks.limit(0).select("id"), ids.count(), c.meta(), None
        if not first:
            was = c.read("vectors").where("embedding IS NOT NULL").select("id")
            new, gone = graph.keep(now.select("id").join(was, "id", "left_anti")), graph.keep(was.join(now.select("id"), "id", "left_anti"))
            changed = new.count() + gone.count()
        if first or incremental.full_rebuild(changed, total) or not all(c.has(t) for t in ("postings", "members", *edgeset.PARTS)):
            parts, how, index = edgeset.build(chunks, members), "built", postings.build(chunks)
            edges = graph.keep(edgeset.edges(parts))
            near, degree, stale = vectors.knn_graph(now), graph.indegree(edges), 0
        else:
            before = c.read("chunks")
            parts, edges, by_change = edgeset.refresh({t: c.read(t) for t in edgeset.PARTS}, c.read("edges"), before, chunks, (c.read("members"), members))
            how = "refreshed" if by_change else "built"
            gone_chunks = before.join(ids, "id", "left_anti").select("id")
            index = postings.update(self._index(), gone_chunks, chunks.join(before.select("id"), "id", "left_anti"))
            near = vectors.knn_incremental(c.read("neighbours"), now, new, gone)
            degree = incremental.indegree_refresh(c.read("indegree"), edges, graph.keep(incremental.edge_delta(c.read("edges"), edges).select("to_id").distinct()))
            stale, due = incremental.stale_after(int(meta.get("stale", 0)), changed, total)
            ranks = None if due else c.read("pagerank").join(ids, "id", "left_semi")  # new chunks have no score until it is due
        c.write(
            files=found.select("path", "size", "modified", "content_hash"), chunks=chunks, vectors=vecs, edges=edges, neighbours=near, indegree=degree, pagerank=graph.pagerank(edges, ids) if ranks is None else ranks,
            hierarchy=graph.hierarchy(found.select("path")), folders=report.folder_hash(chunks), symbols=segment.symbol_table(found.select("path", "content")),
            literals=chunks.select(F.col("id").alias("chunk_id"), F.explode("literals").alias("l")).select("chunk_id", "l.text", "l.line").withColumn("skeleton", X.skeleton(F.col("text"))),
            members=members, **parts, **index.tables(),
            meta=c.meta_table(chunker=files_.provenance(None if first else meta.get("chunker"), CHUNKER), embedding_model=self.embedder_name, indexed_root=root, literal_index="1", stale=str(stale), edges=how),
        )
        return counts

    @staticmethod
    def _members(files: DataFrame, chunks: DataFrame) -> DataFrame:
        """Members of classes with the chunk that holds their line."""
        at = chunks.where("name IS NOT NULL").select(F.col("path").alias("in_path"), F.col("id").alias("chunk_id"), "start_line", "end_line")
        m = classmodel.members(files.select("path", "content"))
        return m.join(at, (F.col("path") == F.col("in_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("chunk_id", *m.columns)

    def _index(self) -> postings.Index:
        return postings.Index(*(self._t(t) for t in ("postings", "terms", "lengths", "stats")))

    # reading

    def _t(self, name: str) -> DataFrame:
        return self.catalog.read(name)

    def _chunks(self, prefix: str = "", kind: str = "any") -> DataFrame:
        return filters.kind(filters.scope(self._t("chunks"), prefix), kind, self.code)

    def search(self, request: Search) -> Answer:
        chunks, notes = self._chunks(request.path_prefix, request.chunk_kind), []
        narrow = bool(request.path_prefix) or request.chunk_kind != "any"
        if request.path_prefix and not chunks.limit(1).count():
            near = [r.scope for r in filters.suggest_scopes(self._t("chunks"), request.path_prefix).collect()]
            notes.append(f"nothing under {request.path_prefix!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        inside = lambda hits: hits.join(chunks.select("id"), "id", "left_semi") if narrow else hits
        k, times = request.top_k, 4 if request.file_cap else 1
        if request.mode == "regex":
            return Answer(filters.regex(chunks, request.query, k).withColumn("score", F.lit(0.0)).select("id", "path", "name", "start_line", "score"), notes)
        vecs = self._t("vectors").where("embedding IS NOT NULL")
        if narrow:
            vecs = vecs.join(chunks.select("id"), "id", "left_semi")
        if request.mode == "fts":
            hits, more = postings.fts(self._index(), request.query, top_k=None if narrow else k * times)
            hits = inside(hits).orderBy("score", "id").limit(k * times).withColumn("score", -F.col("score"))
            notes += more
        else:
            query = self.embedder([request.query])[0]
            if request.mode == "semantic":
                hits = vectors.knn(vecs, query, k * times)
            else:
                words = text.query_tokens(request.query)
                sem = fusion.ranked(vectors.knn(vecs, query, 2 * k), F.desc("score"), "id")
                index = self._index()
                every = inside(postings.bm25(index, words, True, top_k=None)).orderBy("score", "id").limit(2 * k)
                any_ = None
                if every.count() < k:
                    any_ = fusion.ranked(inside(postings.bm25(index, words, False, top_k=None)).orderBy("score", "id").limit(fusion.OR_RANKS), "score", "id")
                    notes.append("few rows have all words; rows with any of them count where vectors find them too")
                hits = fusion.rrf(sem, fusion.ranked(every, "score", "id"), any_, k * times)
        if request.min_score is not None:
            hits = hits.where(F.col("score") >= request.min_score)
        rows = fusion.ranked(hits.join(chunks.select("id", "path", "name", "start_line"), "id"), F.desc("score"), "id")
        rows = fusion.file_cap(rows, request.file_cap, k) if request.file_cap else rows.where(F.col("rank") <= k)
        share = vectors.wall_share(rows.join(vecs.select("id", "embedding"), "id").select("id", "embedding", "rank"))
        if share is not None and share >= 0.6:
            notes.append(f"{share:.0%} of the results are near-duplicates of each other")
        return Answer(rows, notes)

    def rerank(self, answer: Answer, query: str, scorer) -> Answer:
        rows = answer.rows.join(self._t("chunks").select("id", "content"), "id")
        scored = reranked(rows, scorer, query)
        if not scored.where("rerank_score IS NOT NULL").limit(1).count():
            return Answer(answer.rows, [*answer.notes, "the reranker failed; own order"])
        second = fusion.ranked(scored.where("rerank_score IS NOT NULL").select("id", "rerank_score"), F.desc("rerank_score"), "id")
        return Answer(fusion.rerank_fuse(answer.rows, second).orderBy(F.desc("score"), "id"), answer.notes)

    def research(self, query: str, top_k: int = 20) -> research_.Result:
        try:
            vector = self.embedder([query])[0]
        except Exception:  # noqa: BLE001  without the embedder, words still find something; the result says so
            vector = None
        return research_.research(self._t("chunks"), self._t("vectors").where("embedding IS NOT NULL"), vector, text.query_tokens(query), self._t("edges"), self._t("neighbours"), top_k)

    def _symbols(self) -> DataFrame:
        return self._t("chunks").where("name IS NOT NULL").select(F.col("id").alias("chunk_id"), "path", "name", F.lit("definition").alias("kind"), "start_line", "end_line")

    def find_symbol(self, name: str, prefix: bool = False) -> Answer:
        hits = navigation.find_symbol(self._symbols(), name, prefix)
        return Answer(hits, [] if hits.limit(1).count() else [f"no symbol {name!r}"])

    def _targets(self, name: str) -> DataFrame:
        return navigation.find_symbol(self._symbols(), name).select(F.col("chunk_id").alias("id")).distinct()

    def find_usages(self, name: str, limit: int = 50) -> Answer:
        """Callers whose recorded references explain their edge into the name's definitions, the surest first."""
        targets = self._targets(name).select(F.lit(name).alias("query"), F.col("id").alias("to_id"))
        chunks = self._t("chunks")
        hits = usages.explained(self._t("edges"), targets, self._t("references"), self._t("members"), chunks.select("id", "name", "content"))
        hits = graph.keep(usages.collapsed(hits).drop("query"))
        notes = [f"{r.omitted} more by {r.edge_type}" for r in navigation.omitted(hits, limit).where("omitted > 0").collect()]
        if not hits.limit(1).count():
            scan = filters.word(chunks, name).join(self._targets(name), "id", "left_anti").select(F.col("id").alias("from_id"), F.lit("content").alias("edge_type"), F.lit(9).alias("rank"))
            return Answer(scan.orderBy("from_id").limit(limit), ["no edges; found by the word in the content"])
        return Answer(hits.join(chunks.select(F.col("id").alias("from_id"), "path", "start_line"), "from_id").orderBy("rank", ~F.col("verified"), "path", "start_line", "from_id").limit(limit), notes)

    def find_outgoing(self, name: str) -> Answer:
        return Answer(navigation.outgoing(self._t("edges"), self._targets(name)).join(self._t("chunks").select(F.col("id").alias("to_id"), "path", "name"), "to_id"))

    def impact(self, name: str, by: str = "pagerank_sum") -> Answer:
        got = navigation.impact(self._t("edges"), self._targets(name), self._t("chunks"), self._t("pagerank"))
        return Answer(got.orderBy(F.desc("pagerank_sum" if by == "pagerank_sum" else "n_edges"), "path"))

    def hubs(self, top_k: int = 20, types: list[str] | None = None, prefix: str = "") -> Answer:
        degrees = self._t("indegree")
        if prefix:
            degrees = degrees.join(self._chunks(prefix).select(F.col("id").alias("to_id")), "to_id", "left_semi")
        return Answer(graph.hubs(degrees, self._t("pagerank"), top_k, types).join(self._t("chunks").select("id", "path", "name"), "id"))

    def trace(self, start: str, goal: str, most: int = 6) -> tuple[list[str], list[str]]:
        a, b = self._targets(start), self._targets(goal)
        if a.join(b, "id").limit(1).count():
            return [a.join(b, "id").orderBy("id").first().id], ["both names are of one chunk"]
        ends = a.select(F.lit(0).alias("pair"), F.lit(0).alias("side"), "id").unionByName(b.select(F.lit(0).alias("pair"), F.lit(1).alias("side"), "id"))
        edges = self._t("edges").select("from_id", "to_id", "edge_type")
        found = graph.trace_pairs(edges, ends, most).first()
        if found is None:
            near = self._t("neighbours").select(F.col("id").alias("from_id"), F.col("neighbor_id").alias("to_id"), F.lit("semantic").alias("edge_type"))
            found = graph.trace_pairs(edges.unionByName(near), ends, most).first()
            return (list(found.path), ["by likeness too"]) if found else ([], ["no path"])
        return list(found.path), []

    def investigate(self, name: str) -> dict[str, Answer]:
        pieces = self._t("chunks").join(self._targets(name), "id", "left_semi").select("path", "name", "start_line", "end_line", "content")
        return {"definitions": self.find_symbol(name), "source": Answer(navigation.stitch(pieces)), "usages": self.find_usages(name), "outgoing": self.find_outgoing(name), "impact": self.impact(name)}

    def find_by_message(self, text_: str, limit: int = 20) -> Answer:
        rows, notes = message.find_by_message(self._t("literals").select("chunk_id", "text", "line"), self._t("chunks"), text_, limit)
        if self.catalog.meta().get("literal_index") != "1":
            notes.append("literals are not indexed in full")
        return Answer(rows, notes)

    def repomap(self, tokens: int = 1000, prefix: str = "") -> str:
        chunks = self._chunks(prefix)
        scores = self._t("pagerank")
        if prefix:
            ids = chunks.select("id")
            inner = self._t("edges").join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
            scores = graph.pagerank(inner, ids)
        return report.repomap(chunks, scores, tokens)

    def status(self) -> DataFrame:
        return report.vitals(self._t("chunks"))

    def doctor(self) -> list[str]:
        return report.doctor(self._t("chunks"), self._t("edges"), self._t("vectors").where("embedding IS NOT NULL"), self.catalog.meta(), {"chunker": CHUNKER, "embedding_model": self.embedder_name})

    def report(self) -> str:
        chunks = self._t("chunks")
        tops = self.hubs(15).rows.select("id", "path", "name", "in_degree").orderBy(F.desc("in_degree"), "id")
        return report.markdown("Index report", {"Vitals": report.vitals(chunks), "Languages": report.language_counts(chunks).orderBy(F.desc("n")), "Families": report.family_stats(chunks, self.code).orderBy(F.desc("n_chunks")), "Most referred to": tops})
