"""Helpers shared by the operators: shared scratch space and narrow reads."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words and is stripped from lines.
SPACE = " \t\n\x0b\x0c\r"


def tidy(f):
    """Gives memory back to the system when a worker's function ends.

    Workers outlive their tasks; without this each keeps the most it ever used.
    """

    @functools.wraps(f)
    def run(*batches):
        import pyarrow as pa

        try:
            yield from f(*batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library has it
                pass

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Where that is unset, a temporary folder is made and set, but only if driver
    and executors are one process on one machine (tests); on a cluster each
    would write to a folder of its own, and that is an error.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="treeloom-")
        sc.setCheckpointDir(place)
        place = sc.getCheckpointDir()
    return place.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/treeloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)  # only what exists can be marked
    fs.deleteOnExit(where)
    return f"{path}/data"


#: Where the tables that :func:`written` made lie, for as long as their frames live.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This cuts lineage: losing an executor later loses none of these rows, and
    a row keeps the values it was written with even if ``df`` isn't
    deterministic.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def released(*frames: DataFrame) -> None:
    """Deletes the tables of frames that :func:`written` gave, once nothing reads them any more."""
    for df in frames:
        if path := _places.pop(df, None):
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns, so that nothing else is read or can clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fresh(label: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while label.lower() in taken:
        label += "_"
    return label


def looked_up(big: DataFrame, small: DataFrame, key: str, value: str, rows: str, total: int, spread: str, parts: int = 1000) -> DataFrame:
    """``big`` with the column ``value`` of ``small`` (left join on ``key``, null equals null).

    ``small`` has each key once and in ``rows`` how many rows of ``big`` have
    it. Keys with more than ``total / parts`` rows are broadcast: by arithmetic
    they are fewer than ``parts``. Their rows in ``big`` then carry a salt made
    from ``spread`` through the shuffle join that finds the other keys, so none
    of them meets the others of its key in one task.
    """
    hot_key, hot_value, salt, cold_key, cold_value, cold_salt = (f"__{value}_{n}" for n in ("hk", "hv", "salt", "ck", "cv", "cs"))
    is_hot = F.col(rows) > F.lit(total / parts)
    hot = F.broadcast(small.where(is_hot).select(F.col(key).alias(hot_key), F.struct(value).alias(hot_value)))
    cold = small.where(~is_hot).select(F.col(key).alias(cold_key), F.col(value).alias(cold_value), F.lit(0).alias(cold_salt))
    marked = big.join(hot, F.col(key).eqNullSafe(F.col(hot_key)), "left").withColumn(
        salt, F.when(F.col(hot_value).isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0)
    )
    both = marked.join(cold, F.col(key).eqNullSafe(F.col(cold_key)) & (F.col(salt) == F.col(cold_salt)), "left")
    return both.withColumn(value, F.coalesce(F.col(hot_value)[value], F.col(cold_value))).drop(hot_key, hot_value, salt, cold_key, cold_value, cold_salt)
