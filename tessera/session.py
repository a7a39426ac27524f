"""Sessions: what the library needs of one."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Give the library's code to the Python workers of a session, once, wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_tessera_shipped", False):
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(here.rglob("*.py")):
                z.write(path, str(Path(here.name) / path.relative_to(here)))
        context.addPyFile(str(target))
        context._tessera_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, which the session names in ``spark.checkpoint.dir``.

    Where it names none, a session on one machine gets a temporary one; a cluster has no such folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir: a folder that the driver and all executors share is needed")
        path = tempfile.mkdtemp(prefix="tessera-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """A frame as a table in the shared folder: rounds of a loop don't carry the plans of those before."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tessera-rounds/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where its files give fewer parts than there are cores.

    Work that costs far more than moving the rows (parsing, splitting texts into words) gains by it. Tables of
    many parts stay where they lie, so nothing large is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan.rdd.getNumPartitions()
    return scan if parts >= cores else scan.repartition(cores)


#: Rows that a task is dealt, about.
ROWS_A_TASK = 1 << 18


def parts(*frames: DataFrame) -> int:
    """Into how many parts rows have to be dealt so that a task's share doesn't grow with the tables.

    Adaptive execution joins parts by their compressed bytes, of which few may be very many rows; it leaves a number that
    is asked for as it is.
    """
    cores = frames[0].sparkSession.sparkContext.defaultParallelism
    return max(cores, *[-(-f.count() // ROWS_A_TASK) for f in frames])


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
