"""Reports of what was done to a page, merged from its events, and the log's records taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of stages, categories and fields, and the words that stand for nothing
STAGES = ("raw", "perspective", "curved", "enhanced")
NOTHING = ("none", "n/a", "")
#: Field of a record, its type, and the names that it has in the log, by shape of record.
FIELDS = (
    ("page", "bigint", ("page",)), ("mode", "string", ("mode",)), ("side", "string", ("pageSide",)), ("passed", "boolean", ("success", "accepted", "splitterInvoked")),
    ("status", "string", ("refinedStatus", "classification", "opencvCropSource")), ("reason", "string", ("failureReason", "rejectReason", "reason")),
    ("share", "double", ("maskCoverage", "refinedAreaRatio", "splitConfidence", "enhanced")), ("total_ms", "bigint", ("totalMs", "totalRefineMs")),
)


def merged_reports(events: DataFrame, page: str) -> DataFrame:
    """One row a page with a struct for each of its stages, from events (page, at, stage, source, output).

    An event tells what a stage was given and what it gave.  The last event of a stage counts; what a perspective was given is the raw
    stage, and what an enhancement was given stands for the perspective of pages that have none, the first such staying.  Events of other
    stages or without a time are left out; a stage that a page has not is null.
    """
    told = events.filter(F.col("stage").isin("perspective", "curved", "enhanced") & F.col("at").isNotNull())

    def last(stage: str, what: str) -> Column:
        here = F.col("stage") == stage
        return F.max_by(F.when(here, F.col(what)), F.when(here & F.col(what).isNotNull(), F.col("at")))

    given = (F.col("stage") == "enhanced") & F.col("source").isNotNull()
    stand_in = F.min_by("source", F.when(given, F.col("at")))
    return told.groupBy(page).agg(
        last("perspective", "source").alias("raw"), F.coalesce(last("perspective", "output"), stand_in).alias("perspective"), last("curved", "output").alias("curved"), last("enhanced", "output").alias("enhanced")
    )


def report_line(page: str, metrics: tuple[str, ...]) -> Column:
    """A report as one line of the log: for each stage its size and metrics, n/a for what there is not."""

    def told(stage: str, metric: str) -> Column:
        return F.coalesce(F.col(f"{stage}.{metric}").cast("string"), F.lit("n/a"))

    parts = [F.concat(F.lit("page="), F.col(page).cast("string"))]
    parts += [F.concat(F.lit(f"{s}Resolution="), told(s, "width"), F.lit("x"), told(s, "height")) for s in STAGES]
    parts += [F.concat(F.lit(f"{s}{m[0].upper()}{m[1:]}="), told(s, m)) for m in metrics for s in STAGES]
    return F.concat_ws(" ", *parts)


def records(lines: DataFrame, line: str) -> DataFrame:
    """lines with the category, fields and flags of each record, whatever its shape: ``[time][category] key=value ... flag``.

    A field is null where a record has none, none that can be read, or a word for nothing; of a key that comes twice the last
    counts, and of several names of one field the first that the record has.  Words without a value are flags.  A line of another form has null in all.
    """
    head = r"^\[[^\]]*\]\[([^\]]*)\] ?(.*)$"
    body = lines.withColumn("category", F.nullif(F.regexp_extract(line, head, 1), F.lit("")))
    body = body.withColumn("_words", F.filter(F.split(F.regexp_extract(line, head, 2), " +"), lambda w: F.length(w) > 0))
    body = body.withColumn("_pairs", F.transform("_words", lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_extract(w, "=(.*)$", 1).alias("v"), F.contains(w, F.lit("=")).alias("p"))))

    def value(name: str) -> Column:
        found = F.try_element_at(F.filter("_pairs", lambda x: x["p"] & (x["k"] == name)), F.lit(-1))["v"]
        return F.when(~found.isin(*NOTHING), found)

    fields = {name: F.coalesce(*[value(n) for n in names]).try_cast(kind) for name, kind, names in FIELDS}
    flags = F.transform(F.filter("_pairs", lambda x: ~x["p"]), lambda x: x["k"])
    return body.withColumns(fields).withColumn("flags", F.when(F.col("category").isNotNull(), flags)).drop("_words", "_pairs")
