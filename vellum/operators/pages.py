"""Edits of ordered pages and recovery of sessions.

Order is a column: an edit computes new sort keys and numbers pages anew within their session, so nothing but a
session's own pages has to meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range that is sorted in one task, and ranges at most.
RANGE_ROWS, MOST_RANGES = 200_000, 1_000


def renumbered(pages: DataFrame, session: str, order: Column) -> DataFrame:
    return pages.withColumn("place", F.row_number().over(W.partitionBy(session).orderBy(order)).cast("long"))


def in_given_order(pages: DataFrame, wish: DataFrame, session: str, key: str, position: str) -> DataFrame:
    """Pages in the order of a list of keys (one row each); keys without a page go, repeated keys stay."""
    return renumbered(wish.join(pages, [session, key]), session, F.col(position))


def moved(pages: DataFrame, session: str, number: str, old: Column, new: Column) -> DataFrame:
    """A page taken out at ``old`` and put in at ``new``: between them, pages move up by one."""
    n = F.col(number)
    without = F.when(n > old, n - 1).otherwise(n)
    return pages.withColumn("place", F.when(n == old, new).when(without >= new, without + 1).otherwise(without).cast("long"))


def block_replaced(pages: DataFrame, old: DataFrame, new: DataFrame, session: str, key: str, number: str) -> DataFrame:
    """``old`` pages go and ``new`` ones (with sub, their order) come in where the first of them was; sessions without old pages stay."""
    anchor = old.groupBy(session).agg(F.min(number).alias("anchor"))
    kept = pages.join(old.select(session, key), [session, key], "left_anti").select(session, key, F.col(number).alias("anchor"), F.lit(0).alias("sub"))
    return renumbered(kept.unionByName(new.join(anchor, session).select(session, key, "anchor", "sub")), session, F.struct("anchor", "sub"))


def unreferenced(removed: DataFrame, remaining: DataFrame, *files: str) -> DataFrame:
    """Files that removed pages name and no remaining page does; names that differ in case are the same file."""

    def named(pages: DataFrame) -> DataFrame:
        return pages.select(F.explode(F.array(*files)).alias("file")).filter(F.col("file").isNotNull()).withColumn("name", F.lower("file"))

    return named(removed).join(named(remaining).select("name").distinct(), "name", "left_anti").select("file").distinct()


def display_path(scanner: Column, original: Column, completed: Column, raw: Column, corrected: Column, enhanced: Column, edited: Column) -> Column:
    """The picture that stands for a page: of a scanner's page the edited one; else the enhanced one if there is and is wanted."""
    plain = F.coalesce(corrected, raw)
    return F.when(scanner, F.coalesce(edited, raw)).when(original, plain).when(completed, F.coalesce(enhanced, plain)).otherwise(plain)


def unique_name(base: Column, order: WindowSpec, extension: str) -> Column:
    number = F.row_number().over(order)
    return F.concat(base, F.when(number == 1, "").otherwise(F.concat(F.lit("_"), number.cast("string"))), F.lit(f".{extension}"))


def first_free(pages: DataFrame, session: str, number: str, start: int) -> DataFrame:
    """The first number from ``start`` on that is not taken: ``start``, or one after a taken number, by an anti join."""
    tries = pages.select(session, F.explode(F.array(F.lit(start).cast("long"), F.col(number) + 1)).alias(number)).filter(F.col(number) >= start).distinct()
    return tries.join(pages.select(session, number), [session, number], "left_anti").groupBy(session).agg(F.min(number).alias("free"))


PAGE = "array<struct<page_no: long, raw_key: long, rotation: long>>"


def to_json(pages: DataFrame, session: str, number: str) -> DataFrame:
    """One nested document a session, its pages in order."""
    items = F.array_sort(F.collect_list(F.struct(number, *[c for c in pages.columns if c not in (session, number)])))
    return pages.groupBy(session).agg(items.alias("pages")).select(session, F.to_json(F.struct(F.col(session).alias("id"), "pages")).alias("json"))


def from_json(documents: DataFrame, session: str) -> DataFrame:
    """Pages of the documents that are whole: one page with a missing number, key or an odd rotation rejects its document."""
    parsed = documents.select(session, F.from_json("json", f"id long, pages {PAGE}").alias("d")).filter(F.size("d.pages") > 0)
    whole = F.forall("d.pages", lambda p: p["page_no"].isNotNull() & (p["page_no"] >= 1) & p["raw_key"].isNotNull() & p["rotation"].isin(0, 90, 180, 270))
    return parsed.filter(F.coalesce(whole, F.lit(False))).select(session, F.explode("d.pages").alias("p")).select(session, "p.*")


def recovered(files: DataFrame, session: str, name: str, modified: Column) -> DataFrame:
    """Sessions as their raw files tell: created with the first of them; a session without any has 0 pages."""
    raw = F.regexp_extract(name, r"^raw_([0-9]+)\.jpg$", 1) != ""
    return files.groupBy(session).agg(F.coalesce(F.min(F.when(raw, modified)), F.lit(0)).alias("created"), F.count_if(raw).alias("pages"))


def meta_or_raw(meta: DataFrame, raw: DataFrame, session: str) -> DataFrame:
    m, r = meta.alias("m"), raw.alias("r")
    both = r.join(m, session, "left")
    return both.select(session, *[F.coalesce(F.col(f"m.{c}"), F.col(f"r.{c}")).alias(c) for c in ("created", "pages")])


def numbered(df: DataFrame, newest: str, tie: str, name: str) -> DataFrame:
    """df with the place of each row, from 1, by a whole number (the largest first) and a key that breaks ties.

    Rows are cut into ranges of about RANGE_ROWS by quantiles of the number; a range is sorted in one task, and what the
    ranges before it hold is added.  Quantiles only say where to cut, so no place depends on how exact they are.
    """
    rows = df.count()
    cuts = min(MOST_RANGES, rows // RANGE_ROWS)
    bounds = sorted({v for v in df.approxQuantile(newest, [i / (cuts + 1) for i in range(1, cuts + 1)], 0.0005)}) if cuts else []
    group = F.lit(0) if not bounds else F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col(newest)))
    ranged = df.withColumn("_range", group)
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(F.desc(newest), tie))
    return ranged.withColumn(name, place).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def recovered_state(state: Column, has_file: Column) -> Column:
    return F.when((state == "processing") | ((state == "completed") & ~has_file), "failed").otherwise(state)


def scan_folder(spark, pattern: str) -> DataFrame:
    """Files under a folder, as recovery reads them: path, time and size, without the content."""
    return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")


def imported_pages(files: DataFrame, first: int = 1) -> DataFrame:
    """Names (page_001.jpg and on, by path) of scanned pictures that are taken into a session; none at all if one of them is no whole JPEG.

    Files: path, length and content as binaryFile gives them, session, and expected (bytes that were announced).
    """
    start, end = F.substring("content", 1, 2), F.expr("substring(content, length(content) - 1, 2)")
    whole = (F.col("length") == F.col("expected")) & (F.col("length") > 4) & (start == F.unhex(F.lit("FFD8"))) & (end == F.unhex(F.lit("FFD9")))
    by_session = W.partitionBy("session")
    told = files.select("session", "path", "length", whole.alias("whole")).withColumns({"all": F.min("whole").over(by_session), "place": F.row_number().over(by_session.orderBy("path"))})
    return told.filter("all").select("session", "path", F.concat(F.lit("page_"), F.lpad((F.col("place") + first - 1).cast("string"), 3, "0"), F.lit(".jpg")).alias("name"))


def valid_pdf(files: DataFrame) -> DataFrame:
    """Whether each of binaryFile's rows is a PDF: eight bytes or more, with its header."""
    return files.select("path", ((F.col("length") >= 8) & (F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8"))).alias("valid"))
