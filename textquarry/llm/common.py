"""Shared helpers of the training-data operators: scratch tables, bounded Arrow batches, text hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts of some 100,000 characters then still make batches of tens of MB at most.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset the checkpoint folder that the session has. With neither, one of our own under a local master (tests); a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if not folder:
        if context.getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
        return context.getCheckpointDir().get()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths of the tables that this process has written.
_scratch: list[str] = []


def release(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Deletes the tables that written() has made in this process (from number since on, without those named in but); results that read them can't be read any more."""
    for name in [p for p in _scratch[since:] if p not in but]:
        _scratch.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A number for release(): the tables that are written from now on."""
    return len(_scratch)


def newest() -> tuple[str, ...]:
    """The table that was written last, for release() to spare."""
    return tuple(_scratch[-1:])


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textquarry/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application, so that Python workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_textquarry_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="textquarry-")) / "textquarry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._textquarry_shipped = True


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of so many rows at most, unless the session already asks for less; and workers that find this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns whatever else the table has: doc_id long, text string (null: empty)."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def crc_mod(id_column: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % m


def map_batches(df: DataFrame, setup, schema: str) -> DataFrame:
    """mapInArrow where setup() runs once a task and gives RecordBatch -> RecordBatch | None."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = setup()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Bits of the filter that parts rows by id: 8 MB, whatever the data.
FILTER_BITS, BITMAP = 1 << 26, 8 * 4096


def parted_by_id(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose doc_id is certainly not among ids (a column id), and the others. A bitmap of the ids' hashes is broadcast, bits / 8 bytes at most; so the first part needs no join and doesn't move. The more ids, the larger the second part, which callers join exactly."""
    spot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)) + 1
    at = ids.select(spot(F.col("id")).alias("spot")).select(F.bitmap_bucket_number("spot").alias("__bucket"), F.bitmap_bit_position("spot").alias("bit"))
    maps = F.broadcast(at.groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits")))
    own = spot(docs["doc_id"])
    position = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(maps["__bits"], (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    met = docs.join(maps, F.bitmap_bucket_number(own) == maps["__bucket"], "left")
    return met.filter(~inside).select(columns), met.filter(inside).select(columns)


def without(docs: DataFrame, doubtful: DataFrame, keyed) -> DataFrame:
    """docs, with all their columns, without the rows that go. doubtful: id, digest, some: keys that lose rows; where some, one row stays (the most code points, then the first), else none. keyed: rows (row, id, text) -> row, id, digest, n.

    Only rows whose id may be doubtful are numbered, written and joined; the columns of docs travel in one struct, so no name of theirs can clash.
    """
    clear, others = parted_by_id(docs, doubtful.select("id"))
    held = written(others.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "doubtful-rows")
    keys = keyed(held.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text")))
    d = doubtful.select(F.col("id").alias("of"), F.col("digest").alias("mark"), "some")
    met = written(keys.join(d, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("mark"))).select("row", "id", "digest", "n", "some"), "doubtful-keys")
    best = met.filter("some").groupBy("id", "digest").agg(F.min(F.struct((-F.col("n")).alias("n"), "row")).alias("best")).select("best.row")
    gone = met.select("row").join(best, "row", "left_anti")
    stay = held.join(gone, "row", "left_anti")
    return clear.union(stay.select(*[F.col("doc")[c].alias(c) for c in docs.columns]))


def lists(values, counts, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


class Recent(dict):
    """A cache of a pure function of a string: at most twice limit entries, those that are asked again outlive those that aren't; keys longer than longest are not kept."""

    def __init__(self, function, limit: int, longest: int):
        super().__init__()
        self.function, self.limit, self.longest, self.old = function, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_kept: dict = {}


def kept(key, make):
    """make() once in a process: what a Python worker keeps from task to task. Only what was asked for last is kept, so that operators which follow each other don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
