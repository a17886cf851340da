"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that parts words.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text, maximal runs without SPACES; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


OWN: dict[str, str] = {}  # folders of local applications whose session names none, as in tests
#: Folders of the working tables that written() made and nobody has dropped, by application.
LEFT: dict[str, list[str]] = {}
#: Tables of at most so many rows are broadcast by few().
FEW = 1 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where all run in one process a temporary
    folder does where it is unset; on a cluster that is an error, as executors wouldn't see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not is_one_process(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = OWN[app] = OWN.get(app) or tempfile.mkdtemp(prefix="tideframe-")
    return where.rstrip("/")


def is_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of each query when the query has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage is cut, lost executors don't matter, and the shuffle
    files that led to it are gone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideframe/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in LEFT:
        LEFT[app] = []
        atexit.register(at_end, spark, app)
    LEFT[app].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = LEFT.get(spark.sparkContext.applicationId, [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in left:
            left.remove(path)


def left(spark: SparkSession) -> list[str]:
    """Folders of the working tables of this application that are still there."""
    return list(LEFT.get(spark.sparkContext.applicationId, []))


def at_end(spark: SparkSession, app: str) -> None:
    """What is left goes with the driver, unless the application has ended before it."""
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        with suppress(Py4JError, OSError):  # its JVM may be gone
            remove(spark, list(LEFT[app]))


def drop_written(*tables: DataFrame) -> None:
    """Remove the files of tables made by written()."""
    for df in tables:
        spark = df.sparkSession
        found = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}
        remove(spark, [p for p in LEFT.get(spark.sparkContext.applicationId, []) if p.rsplit("/", 1)[1] in found])


def few(df: DataFrame) -> DataFrame:
    """df, a written table, marked for broadcasting if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freeing(each: Batches, drop: Callable[[], None] | None = None) -> Batches:
    """each for mapInArrow, such that a task leaves no memory behind: Spark's Python workers stay for the tasks of later stages, whose
    own memory would come on top. drop forgets what the worker holds besides."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            if drop is not None:
                drop()
            give_back()

    return task


def give_back() -> None:
    """Free memory of this process goes back to the system, as far as its allocators can tell."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # of glibc
        ctypes.CDLL(None).malloc_trim(0)


def rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, one Python tuple at a time."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in cols)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 on division by 5: never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
