"""What the operators of this subpackage share: the shared scratch folder, Arrow helpers, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import PLAIN_READS, shared_folder

#: White space of the word contract: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Letters of scripts that put no white space between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han. For a class of a pattern.
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return shared_folder(spark, name)


def fresh(name: str, taken: list[str]) -> str:
    """name with as many underscores before it as make it begin no name in taken."""
    while any(t.lower().startswith(name) for t in taken):
        name = f"_{name}"
    return name


_open = threading.local()


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    Within passing() the table goes at its end; with keep it is one of the surrounding passing(), or stays.
    """
    path = scratch(df.sparkSession, name)
    scopes = getattr(_open, "scopes", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.options(**PLAIN_READS).schema(df.schema).parquet(path)


#: Has Spark delete the shuffle files of an execution at its end; stages that are asked for again are run again.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, so nothing may read them later; shuffle files go with the execution they serve."""
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    _open.scopes.append([])
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
        for path in _open.scopes.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow; at its end the worker, which Spark uses again, gives unused memory back to the machine."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to give back by hand
            pass

    return run


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): rows (id, component), component the least id of each.

    Alternating large-star and small-star contraction. Each round is two aggregations and two joins on
    (node, least neighbour) rows, so a hub's neighbours are never gathered; the edge set is written to the
    shared folder after each round. Rounds grow with the logarithm of the longest chain. Links that are
    repeated, reversed or loops are allowed; ids without a link get no row.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        # large-star: every larger neighbour of u links to the least neighbour of u, u itself included
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small-star: u and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = written(small, "edges")
        if _same(edges, after):
            edges = after
            break
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _same(a: DataFrame, b: DataFrame) -> bool:
    digest = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return digest(a) == digest(b)
