"""What the operators share: tables in the shared folder, words, exact joins that bear hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space is what these six ASCII characters are; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Files of a table whose paths are broadcast (some 10 MB); beyond it paths and rows meet in a shuffle.
BROADCAST_FILES = 100_000
#: A row's number is its file's number and, in these lower bits, its place in the file.
PLACE_BITS = 36


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs in one process (tests), a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it read from there: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that stored() wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_rows(docs: DataFrame, name: str = "row", **columns: str) -> DataFrame:
    """The named columns of docs, renamed (all, as _0, _1, ..., if none is named), and a number of each row.

    The number is the same in every scan, however the scan is split: it is made of the file, by the order of all
    paths, and the place in the file.  docs has to come straight from files (filters and projections may follow,
    joins and explodes not); any other table is written to the shared folder first.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        paths = docs.select(meta["file_path"].alias("file")).distinct()
    except AnalysisException:
        plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
        kept = stored(plain.select(*[plain[f"_{_place(docs, old)}"].alias(new) for new, old in columns.items()]) if columns else plain, "rows")
        return with_rows(kept, name, **{c: c for c in kept.columns})
    # one row a file: a table that is as small as the list of files that Spark itself keeps
    numbers = stored(paths.select(F.col("file").alias("_file"), (F.row_number().over(W.orderBy("file")) - 1).cast("long").alias("_number")), "files")
    if numbers.count() <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    wanted = [docs[old].alias(new) for new, old in columns.items()] if columns else [docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)]
    told = docs.select(*wanted, meta["file_path"].alias("_file"), meta["row_index"].alias("_place")).join(numbers, "_file")
    return told.withColumn(name, F.shiftleft("_number", PLACE_BITS) + F.col("_place")).drop("_file", "_number", "_place")


def _place(docs: DataFrame, column: str) -> int:
    return [c.lower() for c in docs.columns].index(column.lower())


def plain(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names, of rows that with_rows() made of docs."""
    return rows.select(*[rows[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)])


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: later columns cannot clash with others that docs has."""
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns of these names, in any case: an operator's own columns take their place."""
    lowered = {n.lower() for n in names}
    return docs.select(*[docs[c] for c in docs.columns if c.lower() not in lowered])


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one row per key in groups, where a few keys may hold most rows.

    Groups of at least a ten-thousandth of ``total`` (and 100 rows) are 10,000 at most, so those are
    broadcast; the remaining keys are small enough to be dealt out by a shuffle.
    """
    least = max(100, total // 10_000 + 1)
    hot = groups.filter(F.col(size) >= least)
    if hot.isEmpty():
        return rows.join(groups, key)
    cold = groups.filter(F.col(size) < least)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cold, key))


def wide(table: DataFrame) -> DataFrame:
    """A table of wide rows, to be joined by shuffle and sort: it grows with the input and is never broadcast, however little of it there is at hand."""
    return table.hint("merge")


def join_dealt(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int = 1000, sizes: DataFrame | None = None) -> DataFrame:
    """join_hot() for groups that are too wide to broadcast: a group is copied once for every ``most`` of its rows, and the rows are dealt out over the copies.

    groups has one row per key, unless sizes has: then groups may have several, that agree on size.
    """
    told = join_hot(rows, (groups if sizes is None else sizes).select(key, F.ceil(F.col(size) / most).cast("int").alias("_copies"), F.col(size).alias("_size")), key, "_size", total)
    told = told.withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), F.col("_copies")).cast("int")).drop("_copies", "_size")
    copies = groups.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / most).cast("int") - 1)))
    return told.join(wide(copies), [key, "_copy"]).drop("_copy")
