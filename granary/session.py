"""Session helpers: shared scratch folder, code shipping, table reading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(app: str = "granary", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the Parquet folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Largest table, in bytes as Spark estimates them, that read_spread deals out anew.
SPREAD_BYTES = 1 << 30


def read_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table (all if none is named) for work that costs far more than reading: a small table is dealt to as many tasks as the
    session has cores, because a file of one row group is one task however many cores wait. Large tables are read as they are."""
    df = read_table(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES and df._jdf.rdd().getNumPartitions() <= cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="granary-"), "granary_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("granary", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one is set only where there is none and all runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="granary-checkpoint-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


_open: dict[str, "Scratch"] = {}


@atexit.register
def _clean() -> None:
    """Results may read their scratch tables as long as the driver lives; what is left goes with it."""
    for scratch in list(_open.values()):
        try:
            scratch.close()
        except Exception:  # the session is gone already
            return


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors. They are deleted when closed or at the driver's end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/granary/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _open[self.root] = self

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write `df` and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._granary_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            self._delete(t._granary_path)

    def close(self, keep: DataFrame | None = None) -> None:
        """Delete all tables but `keep`."""
        if keep is None:
            _open.pop(self.root, None)
            self._delete(self.root)
            return
        kept = keep._granary_path.rsplit("/", 1)[1]
        fs, path = self._fs(self.root)
        for status in fs.listStatus(path):
            if status.getPath().getName() != kept:
                fs.delete(status.getPath(), True)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names not yet used in `df`, whatever their case."""
    used = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, n = base, 0
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out.append(name)
    return out
