"""What the operators of this subpackage share: table access and cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one key that a task of a salted join takes.
HOT = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one below the warehouse,
    which its one process shares with itself; on a cluster that would lose data, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return named


#: For tables whose rows have up to some MB: parts of a file that are written and read as a whole have about 8 MB, whatever their number of rows.
LARGE_ROWS = {"parquet.block.size": str(1 << 23), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


def materialise(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back, so that a lost executor never
    repeats the work above it and values that depend on row order stay as they were. The table goes when the driver's process ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/webloom/{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``materialise`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def one_text_an_id(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of ``wanted`` (doc_id once each, few enough to send to all executors) of the documents that it names: one row an id,
    however many rows have it, of different texts that of the least hash. So the rows are as bounded as the ids."""
    own = [c for c in wanted.columns if c != "doc_id"]
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return found.groupBy("doc_id", *own).agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.text", *own)


def hot_keys(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The keys of ``counted`` with more than HOT rows, and in how many more slices each is to be dealt. At most a HOT-th of the rows."""
    return materialise(counted.where(F.col(n) > HOT).select(*keys, F.floor(F.col(n) / HOT).alias("__slices")))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``. A key with more than HOT rows in ``many`` is dealt to a task for every HOT of them, with
    its rows of ``few`` sent to each. Without ``hot``, ``many`` is counted first, so it should be a written table."""
    if hot is None:
        hot = hot_keys(many.groupBy(*keys).agg(F.count("*").alias("__n")), keys, "__n")
    dealt = many.join(hot, keys, "left").withColumn("__slice", F.pmod(F.xxhash64(*own_columns(many)), F.coalesce("__slices", F.lit(0)) + 1)).drop("__slices")
    sent = few.join(hot, keys, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__slices", F.lit(0))))).drop("__slices")
    return dealt.join(sent, [*keys, "__slice"], how).drop("__slice")


def own_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` by quoted name, whatever they are called."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


def small_batches(df: DataFrame, rows: int = 1000, size: int | None = None) -> DataFrame:
    """``df``, with Arrow batches of its session held to ``rows`` rows and about ``size`` bytes, so that a Python worker, and the executor's memory outside its heap, hold
    few texts at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size is not None:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def trim() -> None:
    """Gives memory that this Python worker has freed back to the system: an idle worker keeps it else for as long as its executor lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := ctypes.CDLL(None)) and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)



def light_slices(batch: pa.RecordBatch, text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts (column ``text``) have about ``most`` bytes together, or one longer text, so that what a worker
    makes of texts at once is bounded by bytes, not by rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)
