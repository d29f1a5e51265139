"""Reading a tree of files: rules of admission, hashes, change sets and the tables that sinks write."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X

DATA_LIMIT, HEAD, LONG_LINE = 256 * 1024, 64 * 1024, 500
# Extensions that are read, those of data among them, and those that may be minified.
LANGUAGES = {".c": "c", ".h": "cpp", ".hpp": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cs": "c_sharp", ".gd": "gdscript", ".hlsl": "hlsl", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".lua": "lua", ".py": "python"}
TEXT = [".html", ".vue", ".svelte", ".md", ".markdown", ".yaml", ".yml", ".toml", ".json"]
DATA = [".json", ".yaml", ".yml", ".toml"]
MINIFIED = [".js", ".mjs", ".cjs", ".css"]


def glob_pattern(glob: str) -> str:
    """A glob as a pattern: * and ? stay in a segment, ** does not; a match of a directory covers what is below it."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob.strip("/"))
    table = {"**/": r"(?:.*/)?", "**": r".*", "*": r"[^/]*", "?": r"[^/]"}
    return "^" + "".join(table.get(p, re.escape(p)) for p in parts) + "(?:/.*)?$"


def specificity(glob: str) -> tuple[int, int]:
    g = glob.strip("/")
    return g.count("/") + 1, len(re.sub(r"[*?]", "", g))


def allowed(path: Column, includes: list[str], excludes: list[str]) -> Column:
    """Whether the most specific entry that fits is not an exclude; an include must be strictly more specific to rescue."""
    best = lambda globs: F.greatest(F.lit(-1), *[F.when(path.rlike(glob_pattern(g)), specificity(g)[0] * 10_000 + specificity(g)[1]).otherwise(-1) for g in globs]) if globs else F.lit(-1)
    out, in_ = best(excludes), best(includes)
    return (out < 0) | (in_ > out)


def admitted(files: DataFrame) -> DataFrame:
    """Files (path, size, content) of known extensions, without large data and minified scripts; language is null for text."""
    ext = X.extension(F.col("path"))
    known = files.withColumn("language", X.lookup(LANGUAGES, ext, "")).where((F.col("language") != "") | ext.isin(*TEXT))
    head = F.substring("content", 1, HEAD)
    mean = F.char_length(head) / F.greatest(X.line_count(head), F.lit(1))
    small = ~(ext.isin(*DATA) & (F.col("size") > DATA_LIMIT)) & ~(ext.isin(*MINIFIED) & (F.col("size") > DATA_LIMIT) & (mean > LONG_LINE))
    return known.where(small).withColumn("language", F.nullif("language", F.lit("")))


def scan(spark: SparkSession, root: str, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """path (below root), size, modified, content (text) and content_hash of a tree's files. Names are filtered before contents are read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    below = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", base)) + "/", "")
    files = files.withColumn("path", below).where(allowed(F.col("path"), list(includes), list(excludes)))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def rebuilt(chunks: DataFrame) -> DataFrame:
    """Files put together again from their chunks' lines; of lines in several chunks the last chunk's counts."""
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    over = F.greatest(F.size(lines) - (F.col("end_line") - F.col("start_line") + 1), F.lit(0))
    own = chunks.select("path", "start_line", F.posexplode(F.slice(lines, over + 1, F.greatest(F.size(lines), F.lit(1)))).alias("at", "line"))
    one = own.groupBy("path", (F.col("start_line") + F.col("at")).alias("n")).agg(F.max_by("line", "start_line").alias("line"))
    return one.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("content"))


class Catalog:
    """Tables of one project in a folder; a write makes a new version, and the pointer file of the largest number names what holds.

    A pointer is written under another name, then renamed to a number of its own: at any moment there is a whole one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, ascending; the last holds."""
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.folder))]
        return sorted(int(m[1]) for m in (re.fullmatch(r"current-(\d+)\.json", n) for n in names) if m)

    def versions(self) -> dict[str, str]:
        at = self._pointers()
        return self._pointer(at[-1]) if at else {}

    def _pointer(self, number: int) -> dict[str, str]:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/current-{number}.json").collect()))

    def has(self, name: str) -> bool:
        return name in self.versions()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.versions()[name]}")

    def write(self, **tables: DataFrame) -> None:
        """Writes tables, then moves the pointer to all of them at once; readers see the old ones until then."""
        now = self.versions()
        for name, df in tables.items():
            now[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.partitionBy(*[x for x in ("bucket",) if x in df.columns]).parquet(f"{self.folder}/{now[name]}")
        fs, path = self._fs()
        fresh = path(f"{self.folder}/next-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        at = self._pointers()
        number = at[-1] + 1 if at else 1
        if not fs.rename(fresh, path(f"{self.folder}/current-{number}.json")):
            raise RuntimeError(f"another writer has moved the pointer of {self.folder}")
        for old in at[:-1]:  # the one before stays for readers that have just listed it
            fs.delete(path(f"{self.folder}/current-{old}.json"), False)

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.read("meta").collect()} if self.has("meta") else {}

    def meta_table(self, **values: str) -> DataFrame:
        """What is noted, with some values anew: to be written with the tables that they are about."""
        return self.spark.createDataFrame(sorted((self.meta() | values).items()), "key string, value string")

    def set_meta(self, **values: str) -> None:
        self.write(meta=self.meta_table(**values))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes table versions that none of the last ``keep`` pointers names, and returns them. Readers of older ones lose them."""
        fs, path = self._fs()
        held = {v for at in self._pointers()[-keep:] for v in self._pointer(at).values()}
        gone = []
        for table in fs.listStatus(path(self.folder)) if fs.exists(path(self.folder)) else []:
            if table.isDirectory():
                for version in fs.listStatus(table.getPath()):
                    name = f"{table.getPath().getName()}/{version.getPath().getName()}"
                    if version.isDirectory() and name not in held:
                        fs.delete(version.getPath(), True)
                        gone.append(name)
        return sorted(gone)


def provenance(old: str | None, new: str) -> str:
    """What a table was made with: one name, or both after a change."""
    if not old or old == new:
        return new
    first = old.removeprefix("mixed: ").split("+")[0]
    return f"mixed: {first}+{new}"
