"""Session helpers: building a local session, reading tables, shared scratch tables."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "lodestitch") -> SparkSession:
    """A session for tests and benches. On a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_OWN_DIRS: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it.

    The archive is written to the shared folder, not to a folder of this machine.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # already imported from an archive
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    target = f"{shared_dir(spark).rstrip('/')}/lodestitch-{uuid.uuid4().hex}.zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data.getvalue()))
    out.close()
    Scratch._live.add(target)
    sc.addPyFile(target)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a versioned directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) is a folder of our own made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestitch-")
    _OWN_DIRS.append(own)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


@atexit.register
def _remove_own_dirs() -> None:
    for path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Intermediate tables written to the shared folder, which cuts lineage and survives lost executors.

    ``keep(df)`` writes and reads back; ``drop(df)`` deletes a table that nothing reads any more. What is
    still there when the process ends is deleted then.
    """

    _live: set[str] = set()

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        Scratch._live.add(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)
            Scratch._live.discard(path)


_PUBLISHED: dict[tuple[str, str, str], DataFrame] = {}


def published(spark: SparkSession, directory: str, name: str, build, partition_by: list[str] | None = None) -> DataFrame:
    """A derived table of a versioned directory, built and written once an application and read by every query.

    ``build`` gives the DataFrame; with ``partition_by`` rows are range-partitioned and sorted by these columns, so
    that a point lookup reads the row groups of its key only. The tables lie in the shared folder.
    """
    key = (spark.sparkContext.applicationId, directory, name)
    if key not in _PUBLISHED:
        df = build()
        if partition_by:
            df = df.repartitionByRange(*partition_by).sortWithinPartitions(*partition_by)
        _PUBLISHED[key] = Scratch(spark, f"published-{name}").keep(df)
    return _PUBLISHED[key]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_live() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(Scratch._live):
        plain = path.removeprefix("file://")
        if os.path.isfile(plain):
            os.remove(plain)
        elif os.path.isabs(plain):
            shutil.rmtree(plain, ignore_errors=True)
        elif spark is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone already
                pass
