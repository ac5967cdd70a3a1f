"""Tables written to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one is made and set, but only on a local master; on a
    cluster no machine-local folder would do, so there the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="framespan-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = "file://" + made
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``names``, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns ``names`` of ``df``, whatever characters are in them."""
    return [df["`" + n.replace("`", "``") + "`"] for n in names]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended: what is left is in the folder that the cluster names
        pass


class Workspace:
    """A folder of its own below the shared one, for the tables of one run of an operator.

    A result reads from it lazily, so it lives as long as the driver's process; tables that
    no result reads are dropped as soon as they have been used.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[tuple[DataFrame, str]] = []
        atexit.register(_clear, spark, self.path)

    def new_path(self, label: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:02d}-{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it again."""
        path = self.new_path(label)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that ``write`` returned and nothing will read again."""
        for df in tables:
            k = next(k for k, (t, _) in enumerate(self._tables) if t is df)
            _delete(self.spark, self._tables.pop(k)[1])


#: A table is broadcast up to this size in memory; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: A key is hot from so many rows on, or from this part of all rows if that is more.
HOT_ROWS, HOT_PART = 2_000, 5_000


def hot_from(rows: int) -> int:
    """Rows from which a key of a table of ``rows`` rows is hot; so there are at most ``HOT_PART`` hot keys."""
    return max(HOT_ROWS, rows // HOT_PART)


def join_dealt(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, most: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` with the rows of hot keys dealt over several tasks.

    ``hot`` has (*on, copies) of the keys with more than ``most`` rows in ``left``, ``most`` being
    ``hot_from`` its rows, so it has at most ``HOT_PART`` rows and is broadcast. Rows of such a key
    get one of ceil(copies / most) salts, and the rows of ``right`` are copied to each.
    """
    salts, salt = unused([*left.columns, *right.columns], "salts", "salt")
    parts = F.broadcast(hot.select(*on, F.ceil(F.col("copies") / F.lit(most)).cast("int").alias(salts)))
    dealt = left.join(parts, on, "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(salts)).cast("int"), F.lit(0))).drop(salts)
    copied = right.join(parts, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(salts)
    return dealt.join(copied, [*on, salt], how).drop(salt)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to a written table ``right`` of about ``row_bytes`` a row: broadcast if it is small, else with hot keys of ``left`` dealt."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    counted = left.groupBy(*on).agg(F.count("*").alias("copies"))
    most = hot_from(left.count())
    return join_dealt(left, right, on, counted.where(F.col("copies") > most), most, how)
