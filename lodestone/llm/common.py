"""Column picking, shared-folder tables and model shipping used by all operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import forget, keep, shared_dir

__all__ = ["forget", "keep", "lengths", "map_arrow", "pick", "release", "shared_dir", "steps", "table"]

#: Bytes of text that one vectorised step handles at once; a longer document is handled alone, whole.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name first, else without case.

    Other columns, also those that repeat a name or differ from one by case, are left out.
    """
    cols = df.columns
    places = []
    for name in names:
        same = [i for i, c in enumerate(cols) if c == name] or [i for i, c in enumerate(cols) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name!r} in {cols}")
        places.append(same[0])
    return df.toDF(*[f"c{i}" for i in range(len(cols))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def steps(n_bytes: Iterable[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes together, one row at least."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(n_bytes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def lengths(column) -> list[int]:
    """Bytes of each text of a string column, 0 for null, without making Python strings."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


_trim = None


def release() -> None:
    """Gives back memory that a batch took; workers live on."""
    global _trim
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim is None:
        import ctypes

        _trim = getattr(ctypes.CDLL(None), "malloc_trim", False)  # glibc only
    if _trim:
        _trim(0)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow where ``f`` takes a RecordBatch of a bounded number of text bytes (the column ``text``) and returns a dict of columns."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(lengths(batch.column("text"))):
                got = f(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(got[c.name], c.type) for c in out], schema=out)
                del got
            del batch
            release()

    return df.mapInArrow(run, schema)
