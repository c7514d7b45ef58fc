"""Session folders as tables, in batches and as a stream.

A session is a folder of pictures with a ``session.json`` beside them.  The source ``session_folder`` lists folders and reads what describes them, one row a
session; the codec below, which is made of Columns, tells the pages.  Folders can be in any store that pyarrow's file systems reach.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionFolder)
    pages(spark.read.format("session_folder").load("hdfs://.../scan_sessions"))
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

METADATA = "session.json"
#: Folders of a partition.
FOLDERS = 500


@dataclass
class Folders(InputPartition):
    """Names of session folders that one task reads."""

    names: list[str]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def folder_names(path: str) -> list[str]:
    store, root = opened(path)
    infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(i.base_name for i in infos if i.type == fs.FileType.Directory)


def parts(names: list[str]) -> list[Folders]:
    return [Folders(names[i : i + FOLDERS]) for i in range(0, len(names), FOLDERS)]


def rows_of(path: str, names: list[str]) -> Iterator[tuple]:
    """(session_id, metadata, files) of each folder that is still there; metadata is null if there is no such file or it is no text."""
    store, root = opened(path)
    for name in names:
        folder = f"{root.rstrip('/')}/{name}"
        infos = {i.path[len(folder) + 1 :]: i for i in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File}
        if not infos and store.get_file_info(folder).type != fs.FileType.Directory:
            continue
        text = None
        if METADATA in infos:
            try:
                with store.open_input_stream(f"{folder}/{METADATA}") as file:
                    text = file.read().decode()
            except (UnicodeDecodeError, OSError):
                text = None
        yield name, text, sorted((n, i.size, (i.mtime_ns or 0) // 1_000_000) for n, i in infos.items())


class SessionFolder(DataSource):
    """Options: path; settleMs, for streams: how long a folder is left alone after its last change, 1000 if not set."""

    @classmethod
    def name(cls) -> str:
        return "session_folder"

    def schema(self) -> str:
        return "session_id string, metadata string, files array<struct<name: string, length: long, modified_ms: long>>"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - name of the interface
        return FolderStream(self.options["path"], int(self.options.get("settleMs", "1000")))


class FolderReader(DataSourceReader):
    """Reads the folders of wanted sessions only, if the query names them."""

    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("session_id",):
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[Folders]:
        return parts(folder_names(self.path) if self.wanted is None else sorted(n for n in self.wanted if n and "/" not in n and n not in (".", "..")))

    def read(self, partition: Folders) -> Iterator[tuple]:
        return rows_of(self.path, partition.names)


class FolderStream(DataSourceStreamReader):
    """Sessions as they appear and whenever a file of theirs changes.  The offset is a time: a batch has the folders whose newest file is after the
    last offset and not after its own, which is never nearer to the present than the settling time."""

    def __init__(self, path: str, settle_ms: int) -> None:
        self.path, self.settle_ms = path, settle_ms

    def changed(self) -> dict[str, int]:
        """When each folder changed last: the newest of its files, and of itself if it has none."""
        store, root = opened(self.path)
        newest = {}
        for i in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = i.path[len(root.rstrip("/")) + 1 :].split("/")[0]
            if i.type == fs.FileType.Directory and i.base_name == name or i.type == fs.FileType.File and "/" in i.path[len(root.rstrip("/")) + 1 :]:
                newest[name] = max(newest.get(name, 0), (i.mtime_ns or 0) // 1_000_000)
        return newest

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until_ms": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        settled = int(time.time() * 1000) - self.settle_ms
        return {"until_ms": max([t for t in self.changed().values() if t <= settled], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return parts(sorted(n for n, t in self.changed().items() if start["until_ms"] < t <= end["until_ms"]))

    def read(self, partition: Folders) -> Iterator[tuple]:
        return rows_of(self.path, partition.names)


# fixed values: names of each field's choices, the first is what unknown ones count as (null where there is no such default)
CHOICES = {
    "captureMode": ("single", "spread"),
    "sourceType": ("scana", "mlKit", "mlKitSpread"),
    "correctionStatus": ("none", "processing", "completed", "failed"),
    "correctionType": ("perspective", "curved"),
    "correctionOutcome": ("none", "completed", "nearlyFlat", "lowConfidence", "unsafeDeformation", "notImproved"),
    "enhancementMode": ("scanColor", "originalColor", "grayscale", "blackWhite"),
    "enhancementStatus": ("none", "processing", "completed", "failed"),
}
OPTIONAL = {"mlKitLayout": ("single", "spread", "uncertain"), "spreadSide": ("left", "right")}
CURVATURES = ("none", "flat", "mildCurve", "strongCurve", "unreliable")
POINT = "struct<x: double, y: double>"
CORNERS = f"struct<topLeft: {POINT}, topRight: {POINT}, bottomRight: {POINT}, bottomLeft: {POINT}>"
BOUNDARY = f"struct<top: array<{POINT}>, right: array<{POINT}>, bottom: array<{POINT}>, left: array<{POINT}>, confidence: double, stability: double, sourceWidth: int, sourceHeight: int, timestamp: string, spineSide: string, clippingEvidence: double>"
PAGE = (
    "struct<pageNo: int, rawImageFile: string, createdTime: string, rotation: int, sourceType: string, mlKitLayout: string, originalSourceFile: string, parentSpreadId: string, spreadSide: string, splitX: int, "
    f"splitConfidence: double, editedImageFile: string, documentCorners: {CORNERS}, pageBoundary: {BOUNDARY}, correctedImageFile: string, correctionStatus: string, correctionType: string, correctionOutcome: string, "
    "perspectiveApplied: boolean, curvatureState: string, curvedApplied: boolean, enhancedImageFile: string, enhancementMode: string, enhancementStatus: string, enhancementApplied: boolean>"
)
SESSION = f"id string, createdTime string, captureMode string, suggestedTitle string, ocrSourcePageNo int, pages array<{PAGE}>"


def choice(value: Column, names: tuple[str, ...], default: Column | None = None) -> Column:
    """The value if it is one of the names, else the default (null if none)."""
    return F.when(value.isin(*names), value).otherwise(F.lit(None).cast("string") if default is None else default)


def safe_file(path: Column, folders: bool) -> Column:
    """Whether a path stays within the folder: relative, without ``..``; a plain file name if ``folders`` is not set."""
    inside = (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|\\|\x00") & ~F.exists(F.split(path, "/"), lambda part: part.isin("..", ".", ""))
    return inside if folders else inside & ~path.contains("/")


def finite(point: Column) -> Column:
    return point.isNotNull() & point["x"].isNotNull() & point["y"].isNotNull() & (F.abs(point["x"]) < float("inf")) & (F.abs(point["y"]) < float("inf"))


def sound_boundary(b: Column) -> Column:
    edges = [F.size(b[e]) >= 2 for e in ("top", "right", "bottom", "left")] + [F.forall(b[e], finite) for e in ("top", "right", "bottom", "left")]
    rest = [b[f].isNotNull() for f in ("confidence", "stability", "sourceWidth", "sourceHeight")] + [b["sourceWidth"] > 0, b["sourceHeight"] > 0, F.try_to_timestamp(b["timestamp"]).isNotNull()]
    ok = edges[0]
    for test in edges[1:] + rest:
        ok = ok & test
    return F.coalesce(ok, F.lit(False))


def state_after(state: Column, has_file: Column, needs_file: Column) -> Column:
    """A state after a restart: what was running has failed, and so has what is done but whose file is gone."""
    return F.when((state == "processing") | ((state == "completed") & needs_file & ~has_file), "failed").otherwise(state)


def present(name: Column, files: Column) -> Column:
    return F.coalesce(F.array_contains(files, name), F.lit(False))


def whole_page(p: Column, files: Column) -> Column:
    """Whether a page of the metadata holds; one that does not rejects its session."""
    tests = [
        p["pageNo"].isNotNull(), p["rawImageFile"].isNotNull(), safe_file(p["rawImageFile"], True), F.try_to_timestamp(p["createdTime"]).isNotNull(), p["rotation"].isin(0, 90, 180, 270),
        p["originalSourceFile"].isNull() | safe_file(p["originalSourceFile"], True), p["editedImageFile"].isNull() | safe_file(p["editedImageFile"], True),
        p["splitX"].isNull() | (p["splitX"] >= 1), p["splitConfidence"].isNull() | p["splitConfidence"].between(0, 1),
        p["documentCorners"].isNull() | (finite(p["documentCorners"]["topLeft"]) & finite(p["documentCorners"]["topRight"]) & finite(p["documentCorners"]["bottomRight"]) & finite(p["documentCorners"]["bottomLeft"])),
        p["pageBoundary"].isNull() | sound_boundary(p["pageBoundary"]),
        p["correctedImageFile"].isNull() | safe_file(p["correctedImageFile"], False), p["enhancedImageFile"].isNull() | safe_file(p["enhancedImageFile"], False),
        present(p["rawImageFile"], files), p["originalSourceFile"].isNull() | present(p["originalSourceFile"], files),
    ]
    ok = tests[0]
    for test in tests[1:]:
        ok = ok & test
    return F.coalesce(ok, F.lit(False))


def decoded(p: Column, files: Column) -> list[Column]:
    """The columns of a page: choices with their defaults, states as they are after a restart, files only where they are there."""
    value = {n: choice(p[n], names, F.lit(names[0])) for n, names in CHOICES.items() if n != "captureMode"} | {n: choice(p[n], names) for n, names in OPTIONAL.items()}
    has = {n: p[n].isNotNull() & present(p[n], files) for n in ("editedImageFile", "correctedImageFile", "enhancedImageFile")}
    status = state_after(value["correctionStatus"], has["correctedImageFile"], F.lit(True))
    enhanced = state_after(value["enhancementStatus"], has["enhancedImageFile"], value["enhancementMode"] != "originalColor")
    done, curved = value["correctionStatus"] == "completed", value["correctionType"] == "curved"
    file = {n: F.when(h, p[n]) for n, h in has.items()}
    return [
        p["pageNo"].alias("page_no"), p["rawImageFile"].alias("raw_file"), F.try_to_timestamp(p["createdTime"]).alias("page_created"), p["rotation"].alias("rotation"), value["sourceType"].alias("source_type"),
        value["mlKitLayout"].alias("layout"), value["spreadSide"].alias("spread_side"), p["parentSpreadId"].alias("parent_spread"), file["editedImageFile"].alias("edited_file"),
        file["correctedImageFile"].alias("corrected_file"), status.alias("correction_status"), value["correctionType"].alias("correction_type"),
        F.when((value["correctionOutcome"] == "none") & (status == "completed"), "completed").otherwise(value["correctionOutcome"]).alias("correction_outcome"),
        F.coalesce(p["perspectiveApplied"], done).alias("perspective_applied"), choice(p["curvatureState"], CURVATURES, F.when(curved, "strongCurve").otherwise("none")).alias("curvature"),
        F.coalesce(p["curvedApplied"], curved & done).alias("curved_applied"), file["enhancedImageFile"].alias("enhanced_file"), value["enhancementMode"].alias("enhancement_mode"), enhanced.alias("enhancement_status"),
        (F.coalesce(p["enhancementApplied"], value["enhancementStatus"] == "completed") & (enhanced == "completed")).alias("enhancement_applied"),
    ]


def pages(sessions: DataFrame) -> DataFrame:
    """Pages of sessions (session_id, metadata, files): from the metadata if all of it holds, else from the raw files' names (origin ``raw``).

    A session without pages has one row with a null page_no.  session_created is that of the metadata, else the earliest raw file's time.
    """
    read = sessions.withColumns({"m": F.from_json("metadata", SESSION), "names": F.col("files.name")})
    title_ok = F.col("m.suggestedTitle").isNull() | (F.trim("m.suggestedTitle") != "")
    number_ok = F.col("m.ocrSourcePageNo").isNull() | (F.col("m.ocrSourcePageNo") > 0)
    whole = (F.col("m.id") == F.col("session_id")) & F.col("m.pages").isNotNull() & F.try_to_timestamp(F.col("m.createdTime")).isNotNull() & title_ok & number_ok & F.forall("m.pages", lambda p: whole_page(p, F.col("names")))
    raw = F.transform(F.filter("files", lambda f: f["name"].rlike(r"^raw_[0-9]{1,9}\.jpg$")), lambda f: F.struct(F.regexp_extract(f["name"], "([0-9]+)", 1).cast("int").alias("page_no"), f["name"].alias("raw_file"), f["modified_ms"].alias("modified_ms")))
    told = read.withColumns({"whole": F.coalesce(whole, F.lit(False)), "raws": F.array_sort(raw)})
    by_meta = told.filter("whole").select("session_id", F.try_to_timestamp("m.createdTime").alias("session_created"), choice(F.col("m.captureMode"), CHOICES["captureMode"], F.lit(CHOICES["captureMode"][0])).alias("capture_mode"), F.col("m.suggestedTitle").alias("title"), "names", F.explode_outer("m.pages").alias("p"))
    by_meta = by_meta.select("session_id", F.lit("metadata").alias("origin"), "session_created", "capture_mode", "title", *decoded(F.col("p"), F.col("names")))
    by_raw = told.filter("NOT whole").select("session_id", F.lit("raw").alias("origin"), F.timestamp_millis(F.array_min("raws.modified_ms")).alias("session_created"), F.lit("single").alias("capture_mode"), F.explode_outer("raws").alias("r"))
    by_raw = by_raw.select("session_id", "origin", "session_created", "capture_mode", "r.page_no", "r.raw_file", F.timestamp_millis("r.modified_ms").alias("page_created"), F.lit(0).alias("rotation"))
    return by_meta.unionByName(by_raw, allowMissingColumns=True)

