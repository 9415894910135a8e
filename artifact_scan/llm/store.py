"""Tables in, intermediate tables out.

Intermediate results that several steps read are written as Parquet below the folder
that the cluster names in ``spark.checkpoint.dir``, which every executor sees; a lost
executor then costs one re-read, not the lineage.  ``drop_scratch`` removes them once
the results that read them have been written, ``drop`` those of one step.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_NUMBER = itertools.count()
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is set and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _ROOTS:
            _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
            spark.sparkContext.setCheckpointDir(_ROOTS[app])
        root = _ROOTS[app]
    return root


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/scratch-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{next(_NUMBER)}-{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes all intermediate tables of the session."""
    _delete(spark, _scratch(spark))


def mark() -> int:
    """How many intermediate tables there are, for ``paths_since``."""
    return len(_WRITTEN)


def paths_since(since: int) -> list[str]:
    """The intermediate tables written since ``mark()``."""
    return _WRITTEN[since:]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes intermediate tables that nothing will read again."""
    for path in paths:
        _delete(spark, path)


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint where it is counted to have ``rows`` rows at most, else as it is.

    Without the hint the join shuffles, and adaptive execution splits skewed keys.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


CELLS = 1 << 21


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it: for columns of a step's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may occur in ``ids``: all that do, and few others while ids are few.

    Keys are hashed to ``CELLS`` cells and the cells in use are broadcast, which is at most
    ``CELLS`` numbers whatever the data.  Run before a shuffled join, it spares the shuffle rows
    that cannot join; with very many ids it lets everything pass.
    """
    from pyspark.sql import functions as F

    name = free(df, "_cell")
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    used = ids.select(cell.alias(name)).distinct()
    return df.withColumn(name, cell).join(F.broadcast(used), name, "left_semi").drop(name)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``ids``; null keys stay.

    Only rows that ``maybe_among`` lets pass are shuffled.  ``ids`` should be a written table,
    as it is read twice.
    """
    from pyspark.sql import functions as F

    name, flag = free(df, "_cell"), free(df, "_used")
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    used = ids.select(cell.alias(name), F.lit(True).alias(flag)).distinct()
    marked = df.withColumn(name, cell).join(F.broadcast(used), name, "left").drop(name)
    clear = marked.where(F.col(flag).isNull()).drop(flag).select(*df.columns)
    rest = marked.where(F.col(flag)).drop(flag).select(*df.columns)
    # Not an anti join: the optimizer would take it to all rows first, before the cells have spared any.
    found = ids.select(key).distinct().withColumn(flag, F.lit(True)).hint("merge")
    return clear.unionByName(rest.join(found, key, "left").where(F.col(flag).isNull()).select(*df.columns))
