"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def local_session(cpus: str = "*", app: str = "repoloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_LOCAL_ROOTS: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it gets a fresh
    temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="repoloom-")
    return _LOCAL_ROOTS[app]


def stage(df: DataFrame, label: str, by: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` as a Parquet table under the shared folder and read it back.

    The written table survives executor loss, cuts the lineage of iterative
    jobs, and gives later joins real size statistics. ``metrics`` are
    aggregates collected while writing, so loops need no extra count job.
    ``by`` is a column by which the table is laid out in folders.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    found: dict = {}
    if metrics:
        obs = Observation()
        df = df.observe(obs, *[c.alias(n) for n, c in metrics.items()])
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    if metrics:
        found = obs.get
    return spark.read.schema(schema).parquet(path), found


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Settings for folders of very many small files, put back at the end.

    Spark lists with a task for each of up to 10000 folders and counts every
    file as 4 MB, so that scheduling takes longer than reading. Here a few
    tasks per core list, and small files share tasks. File streams look the
    settings up in each batch, so they are to hold until a stream ends.
    """
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(max(32, 4 * spark.sparkContext.defaultParallelism)),
        "spark.sql.files.openCostInBytes": "64k",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class StagedLevels:
    """A staged table in folders by level, so that one level is read without the others."""

    def __init__(self, df: DataFrame | None, by: str, label: str, like: str | None = None, spark: SparkSession | None = None) -> None:
        self.spark, self.by = spark or df.sparkSession, by
        self.path = f"{stage_root(self.spark)}/{self.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        self.schema = like or df.schema
        self.top: int | None = None
        self.levels: set[int] = set()
        if df is not None:
            self.add(df)

    def add(self, df: DataFrame) -> None:
        """Append rows; the levels they have are noted while writing."""
        obs = Observation()
        seen = F.array_join(F.collect_set(F.col(self.by).cast("string")), ",")
        df.observe(obs, seen.alias("seen")).write.mode("append").partitionBy(self.by).parquet(self.path)
        self.levels.update(int(at) for at in (obs.get["seen"] or "").split(",") if at)
        self.top = max(self.levels, default=None)

    def level(self, at: int) -> DataFrame:
        if at not in self.levels:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/{self.by}={at}")
