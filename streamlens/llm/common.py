"""What the corpus operators share: shared scratch tables, input projection, packed integers, Arrow batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator handles, and returns, at a time; keeps a worker's buffers small whatever Arrow batch Spark hands over.
SLICE_ROWS = 256


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). One is set only where none is and all run in one process, as in
    tests; on a cluster the lack of one is an error, since no local folder would do."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and the executors share")
    own = tempfile.TemporaryDirectory(prefix="streamlens-")
    atexit.register(own.cleanup)
    spark.sparkContext.setCheckpointDir(f"file://{own.name}")
    return scratch(spark)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage so that a lost executor costs a reread, not a recomputation."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/streamlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash with what an operator adds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def hash_bucket(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus; a null id falls into the bucket of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bits of the filter below: a table of 2**24 / 64 rows at most, so it can be broadcast whatever the data.
FILTER_BITS = 1 << 24


def split_by_ids(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, rows whose id is not), by a bitmap of hashed ids; nothing of df is shuffled.

    Before a join that needs few rows' texts, this keeps the others' out of the exchange. The more ids, the more rows may pass: the
    filter saves work and never loses a row. A null id is not among ids. The bitmap is written, so that both results use one."""
    spot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS))
    marks = ids.toDF("_id").filter("_id is not null").select(spot(F.col("_id")).alias("_spot"))
    words = marks.groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot % 64 as int))")).alias("_bits"))
    words = F.broadcast(shared_table(words, "id-filter"))  # at most FILTER_BITS / 64 rows of two numbers
    at = spot(df[f"`{id_col}`"])
    hit = (F.shiftright(at, 6) == words["_word"]) & (F.call_function("shiftrightunsigned", words["_bits"], (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1) & df[f"`{id_col}`"].isNotNull()
    return df.join(words, hit, "left_semi"), df.join(words, hit, "left_anti")


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df.mapInArrow with fn applied to slices of SLICE_ROWS rows; a slice without result is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


