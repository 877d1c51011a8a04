"""Session helpers.

Library code never creates its own session: it uses the one it is handed.
``local_session`` exists for tests, benchmarks and examples only.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on and the UI off (tests and bench only)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("equitext")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of this application.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used
    as is; without it a cluster run stops here, since a local folder of the
    driver is not visible to executors.  Only a local master, where driver and
    executors are one process, gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="equitext-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet below the shared checkpoint folder and
    return a DataFrame reading it back.

    This cuts lineage like ``checkpoint()`` but computes the plan exactly
    once (an eager reliable checkpoint runs it a second time to write the
    files unless persisted), stores it columnar, and the files outlive any
    executor.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


#: intermediate tables of this application that ``release`` may delete
_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far and returns their
    number.  Call it when no DataFrame derived from them is needed any more,
    e.g. after each result has been stored."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def read_if_exists(spark: SparkSession, path: str):
    """The Parquet table at ``path``, or None where there is no such path.
    Any other failure (permission, network, a broken file) is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def file_mark(spark: SparkSession, path: str) -> str:
    """A fingerprint of the files at ``path`` (names, lengths, modification
    times).  Spark lists them and reads no row, on any file system."""
    from pyspark.sql import functions as F

    # without its content column this source reads the listing alone
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", F.unix_micros("modificationTime").alias("t"))
    r = files.agg(F.bit_xor(F.xxhash64("path", "length", "t")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{path}:{r['x']}:{r['n']}"


def derived_table(spark: SparkSession, name: str, inputs: list[str], build):
    """S4 for a table derived from Parquet inputs: read if this application
    has it for the current files (path, size and modification time), else
    built and written below the checkpoint folder."""
    marks = [file_mark(spark, path) for path in inputs]
    key = hashlib.sha256("\n".join(marks).encode()).hexdigest()[:24]
    path = scratch_path(spark, f"{name}-{key}")
    found = read_if_exists(spark, path)
    if found is None:
        build().write.parquet(path)
        found = spark.read.parquet(path)
    return found


def literal_table(spark: SparkSession, rows, schema: str):
    """A small constant table built in the JVM (``range(1)`` + ``inline`` of
    literal structs).  ``createDataFrame`` on a Python list goes through a
    Python RDD and starts Python workers for a handful of rows.

    ``schema`` is ``"name type, name type"``.
    """
    from pyspark.sql import functions as F

    cols = [c.strip().split() for c in schema.split(",")]
    rows = list(rows)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in cols])
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(cols, row)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
