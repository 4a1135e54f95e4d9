"""Registry and chart files: a data source that reads folders of small JSON files, and the sinks that write them.

Under a folder, ``registry/seed/*.json`` and ``registry/user/*.json`` (or ``patients.json`` and ``patients_user.json``)
hold {"patients": [...]}, ``charts/<patient>/documents.json`` holds {"documents": [...]}, and
``charts/<patient>/uploads/*.json`` one document each. The source lists the folder once, deals the files out in groups
of about GROUP_BYTES or GROUP_FILES, and each task reads its group. Every row has its ordinal: (source, file, position),
seed before user and documents before uploads, so the order that files were listed or read in never shows.

Defined results: a file that is no JSON object, or whose list is no list, is one row with ``error`` and nothing else, as
is an entry that is no object; ``registry`` and ``documents`` leave these out and ``unreadable`` counts them; an object
without its list has no entries; a value that is no text where a text is due is given as JSON; missing fields are null;
an empty or missing folder gives no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from carefold.operators.identity import numbered

GROUP_FILES = 512
GROUP_BYTES = 32 << 20
BATCH = 1000

SEED, USER = 0, 1
_PLACE = [("source", pa.int32()), ("file", pa.string()), ("position", pa.int64()), ("error", pa.string())]
KINDS = {
    "registry": [*_PLACE, *((c, pa.string()) for c in ("patient_id", "mrn", "name", "dob", "sex", "summary"))],
    "documents": [
        *_PLACE, ("patient_id", pa.string()), *((c, pa.string()) for c in ("doc_id", "date", "type", "author", "title", "text")),
        ("entered_in_error", pa.bool_()), ("uploaded", pa.bool_()), ("asserts", pa.string()),
    ],
}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}


def _what(path: str) -> tuple[str, int, str | None, str | None] | None:
    """(kind, source, name of the list or None for one document, patient) of a file by its path in the folder."""
    match path.split("/"):
        case ["patients.json"]:
            return "registry", SEED, "patients", None
        case ["patients_user.json"]:
            return "registry", USER, "patients", None
        case ["registry", ("seed" | "user") as source, _]:
            return "registry", USER if source == "user" else SEED, "patients", None
        case ["charts", patient, "documents.json"]:
            return "documents", SEED, "documents", patient
        case ["charts", patient, "uploads", _]:
            return "documents", USER, None, patient
    return None


class Group(InputPartition):
    def __init__(self, files: list[tuple[str, tuple]]):
        self.files = files


class ChartFiles(DataSource):
    """Options: path, kind (registry or documents)."""

    @classmethod
    def name(cls) -> str:
        return "chart_files"

    def schema(self) -> str:
        return ", ".join(f"{c} {_SQL[kind]}" for c, kind in KINDS[self.options["kind"]])

    def reader(self, schema) -> ChartReader:
        return ChartReader(self.options["path"], self.options["kind"])


class ChartReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.rstrip("/"), kind

    def partitions(self) -> list[Group]:
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        listed = files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True))
        groups, size = [Group([])], 0
        for info in sorted(listed, key=lambda i: i.path):
            name = info.path[len(folder) :].lstrip("/")
            what = _what(name) if info.is_file and name.endswith(".json") else None
            if what and what[0] == self.kind:
                if groups[-1].files and (len(groups[-1].files) == GROUP_FILES or size + info.size > GROUP_BYTES):
                    groups.append(Group([]))
                    size = 0
                groups[-1].files.append((name, what[1:]))
                size += info.size
        return groups

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        rows = []
        for name, (source, listed, patient) in partition.files:
            with files.open_input_file(f"{folder}/{name}") as opened:
                data = opened.read()
            for position, entry in enumerate(entries(data, listed)):
                rows.append(self._row(source, name, position, entry, patient))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    def _row(self, source: int, name: str, position: int, entry: dict | str, patient: str | None) -> dict:
        place = {"source": source, "file": name, "position": position}
        if isinstance(entry, str):
            return place | {"error": entry}
        own = {} if patient is None else {"patient_id": patient}
        return {c: _as(entry.get(c), kind) for c, kind in KINDS[self.kind][len(_PLACE) :]} | own | place

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = KINDS[self.kind]
        return pa.record_batch([pa.array([r.get(c) for r in rows], kind) for c, kind in kinds], [c for c, _ in kinds])


def _as(value: object, kind: pa.DataType) -> object:
    if kind == pa.bool_():
        return value if isinstance(value, bool) else None
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def entries(data: bytes, listed: str | None) -> list[dict | str]:
    """The objects of a file; what can't be read is a text that says why."""
    try:
        read = json.loads(data.decode())
    except ValueError as e:
        return [f"no JSON: {type(e).__name__}"]
    if not isinstance(read, dict):
        return ["no object"]
    if listed is None:
        return [read]
    found = read.get(listed, [])
    if not isinstance(found, list):
        return [f"{listed} is no list"]
    return [x if isinstance(x, dict) else "an entry is no object" for x in found]


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All rows of a kind, errors included; a value of ``path`` is a folder with its file system."""
    spark.dataSource.register(ChartFiles)
    return spark.read.format(ChartFiles.name()).option("kind", kind).load(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, file, position, patient_id, mrn, name, dob, sex, summary), numbered in the registry's order from 1."""
    rows = read(spark, path, "registry").filter("error IS NULL").drop("error")
    return numbered(rows, "source", "file", "position").withColumnRenamed("n", "ord")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all charts; ``place`` counts a patient's from 1 by the text of their dates, then in files' order."""
    rows = read(spark, path, "documents").filter("error IS NULL").drop("error")
    order = Window.partitionBy("patient_id").orderBy(F.coalesce("date", F.lit("")), "source", "file", "position")
    return rows.withColumn("place", F.row_number().over(order))


def document_by_id(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``asked`` (doc_id and any columns) with the document of that id from whatever chart has it: of several the one of
    the least (patient_id, place), with its patient; nulls where there is none."""
    rest = [c for c in docs.columns if c != "doc_id"]
    first = docs.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("patient_id", "place")).alias("d"))
    return asked.join(first, "doc_id", "left").select(*asked.columns, *[F.col(f"d.{c}").alias(c) for c in rest if c not in asked.columns])


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(kind, source, n): how many files or entries could not be read."""
    each = [read(spark, path, kind).filter("error IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "source", "n") for kind in KINDS]
    return each[0].unionByName(each[1])


def write_files(contents: DataFrame, to: str) -> int:
    """Write each row's ``content`` to the file ``path`` under the folder ``to``; returns how many there were.

    A file is written beside its name and renamed when it is whole, so a task that runs again leaves the same files and
    a reader sees no half ones. Rows that repeat a path leave one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(to)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = f"{folder}/{path}"
                inside, _, last = name.rpartition("/")
                if inside not in made:
                    files.create_dir(inside)
                    made.add(inside)
                attempt = f"{inside}/.{last}.{uuid.uuid4().hex}"
                with files.open_output_stream(attempt, compression=None) as out:
                    out.write((content or "").encode())
                files.move(attempt, name)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return contents.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def as_registry(people: DataFrame, source: str, file: str = "file") -> DataFrame:
    """(path, content) of registry files: ``people`` with the registry's columns and the number of the file of each."""
    of = F.array_sort(F.collect_list(F.struct("patient_id", "mrn", "name", "dob", "sex", "summary")))
    rows = people.groupBy(file).agg(F.to_json(F.struct(of.alias("patients"))).alias("content"))
    return rows.select(F.format_string(f"registry/{source}/part-%09d.json", F.col(file)).alias("path"), "content")


def as_documents(docs: DataFrame) -> DataFrame:
    """(path, content) of charts' own documents, those of a patient in one file: ``docs`` with patient_id and document."""
    rows = docs.groupBy("patient_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("document")).alias("documents"))).alias("content"))
    return rows.select(F.concat(F.lit("charts/"), "patient_id", F.lit("/documents.json")).alias("path"), "content")


def as_uploads(docs: DataFrame) -> DataFrame:
    """(path, content) of uploaded documents, a file each: ``docs`` with patient_id and document, which has a doc_id."""
    path = F.concat(F.lit("charts/"), "patient_id", F.lit("/uploads/"), F.col("document.doc_id"), F.lit(".json"))
    return docs.select(path.alias("path"), F.to_json("document").alias("content"))
