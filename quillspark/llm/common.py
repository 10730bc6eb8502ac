"""What the operators of this package share: scratch tables, blocks of documents, packed key exchange."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: maximal runs without ASCII white space (bytes.split() cuts the same way).
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where there is one machine, a folder of our
    own stands in for it; on a cluster an unset folder is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{tempfile.gettempdir()}/quillspark-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, read many times without recomputing.

    Once it is written, Spark drops the shuffle files of the job: the table stands in for them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, as (id, text); every other column, whatever its name, stays out of the operator."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def row_key(id_col: str, text_col: str) -> Column:
    """A key for a row from its id and text, never null: rows share it that are equal in both."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return F.xxhash64(i.isNull(), F.coalesce(i, F.lit(0)), t.isNull(), F.coalesce(t, F.lit("")))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): the two columns and each row's key."""
    return df.select(row_key(id_col, text_col).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def sized(keys: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A table of 64-bit keys, marked for broadcast if it has at most max_rows rows (counted; 8 MB); more are joined by shuffle."""
    return F.broadcast(keys) if keys.limit(max_rows + 1).count() <= max_rows else keys


def rows_without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, once: DataFrame | None = None) -> DataFrame:
    """df without the rows whose key is in gone (row); of rows whose key is in once (row) one stays. All columns as they are."""
    name = "row_key"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    as_is = [F.col(f"`{c}`") for c in df.columns]
    left = df.select(*as_is, row_key(id_col, text_col).alias(name)).join(sized(gone.select(F.col("row").alias(name)).distinct()), name, "left_anti")
    if once is not None and once.limit(1).count():
        once = sized(once.select(F.col("row").alias(name)))
        left = left.join(once, name, "left_anti").unionByName(left.join(once, name, "left_semi").dropDuplicates([name]))
    return left.select(*as_is)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """big joined with a lookup table that has one row a key.

    Counted first: up to max_rows rows are broadcast. A larger lookup table is joined by shuffle, with its rows repeated
    under each salt and the rows of big dealt over the salts, so that a hot key is split."""
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in on] or on), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def n_blocks(df: DataFrame, block_bytes: int) -> int:
    """Blocks of about block_bytes of text (its bytes are summed on the cluster)."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def block_of(n: int, *keys: str) -> Column:
    """The block of a row, from its id and text alone: the same in every pass, whatever executor is lost in between; rows without an
    id, and those that share one, are dealt like all others."""
    return F.pmod(F.xxhash64(*(keys or ("id", "text"))), F.lit(n)).cast("int")


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of each element (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_arrow(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow with make(list of column lists) -> dict of columns, batch by batch."""
    names = df.columns

    def run(batches):
        for b in batches:
            out = make(*[b.column(n).to_pylist() for n in names])
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    arrow_schema = to_arrow(schema, df.sparkSession)
    return df.mapInArrow(run, schema)


def to_arrow(schema: str, spark: SparkSession) -> pa.Schema:
    """Arrow's form of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte plane by byte plane: the high planes are nearly all zeros and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """64-bit counts byte plane by byte plane: the high planes are all zeros and compress away."""
    return counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_counts(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def bits_for(bytes_total: int, each: int = 16 << 20) -> int:
    """Bits of a key that choose its bucket, so that a bucket holds about `each` of bytes_total."""
    return max(3, int(max(1, bytes_total / each) - 1).bit_length())


def by_bucket(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The stretches of ascending 64-bit keys that share their first bits, with the bucket these name."""
    if not len(keys):
        return []
    of = keys >> np.uint64(64 - bits)
    first = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(keys)]]).tolist()
    return [(int(of[a]), slice(a, b)) for a, b in zip(first, first[1:])]
