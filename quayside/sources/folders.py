"""Submitted files as a data source (S2): folders are dealt into partitions, tasks list the files.

    spark.dataSource.register(PaperworkFolders)
    spark.read.format("paperwork_folders").load(path)

The files stand as ``path``/<shipment>/<A or B>/<file>.  The driver lists the shipments' folders alone, one name each; a filter on
``shipment_id`` by value names them without any listing, and a filter on ``side`` opens that folder only.  The file system is one that
pyarrow reaches; for others there is ``intake.read_manifest``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quayside.sources.intake import submitted

SCHEMA = "shipment_id long, side string, file_name string, mime string, size_bytes long"
SIDES = ("A", "B")
#: Folders of shipments in a partition.
FOLDERS = 512
#: A shipment's folder is its id in plain decimal digits; files of other folders have a null id.
_ID = re.compile(r"0|-?[1-9][0-9]{0,18}")


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return files.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


def id_of(folder: str) -> int | None:
    found = int(folder) if _ID.fullmatch(folder) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def listed(fs: files.FileSystem, path: str, kind: files.FileType) -> Iterator[files.FileInfo]:
    """What Spark's own readers would see of a folder, in order of names: nothing that starts with a dot or an underscore."""
    found = fs.get_file_info(files.FileSelector(path, allow_not_found=True))
    return iter(sorted((x for x in found if x.type == kind and x.base_name[:1] not in "._"), key=lambda x: x.base_name))


@dataclass
class Folders(InputPartition):
    names: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, path: str, folders: int) -> None:
        self.path, self.folders = path, folders
        self.ids: set[int] | None = None
        self.sides = set(SIDES)
        self.bounds: list[tuple[type[Filter], int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take equality and ranges of ``shipment_id`` and equality of ``side``; Spark applies the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("shipment_id",) and values is not None:
                self.ids = values if self.ids is None else self.ids & values
            elif column == ("side",) and values is not None:
                self.sides &= values
            elif column == ("shipment_id",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.bounds.append((type(f), f.value))
            else:
                yield f

    def wanted(self, shipment: int | None) -> bool:
        tests = {GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}
        return not self.bounds if shipment is None else all(tests[kind](shipment, value) for kind, value in self.bounds)

    def partitions(self) -> list[Folders]:
        if not self.sides:
            return [Folders([])]
        if self.ids is None:
            fs, root = opened(self.path)
            if fs.get_file_info(root).type != files.FileType.Directory:
                raise FileNotFoundError(f"no folder {self.path}")
            names = [x.base_name for x in listed(fs, root, files.FileType.Directory) if self.wanted(id_of(x.base_name))]
        else:
            names = [str(i) for i in sorted(i for i in self.ids if i is not None and self.wanted(i))]
        return [Folders(names[at : at + self.folders]) for at in range(0, len(names), self.folders)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        for folder in partition.names:
            for side in sorted(self.sides & set(SIDES)):
                found = list(listed(fs, f"{root}/{folder}/{side}", files.FileType.File))
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_of(folder)] * n, pa.int64()), pa.array([side] * n), pa.array([x.base_name for x in found]), pa.nulls(n, pa.string()), pa.array([x.size for x in found], pa.int64())],
                        names=["shipment_id", "side", "file_name", "mime", "size_bytes"],
                    )


class PaperworkFolders(DataSource):
    """Options: ``folders``, how many shipments a partition lists."""

    @classmethod
    def name(cls) -> str:
        return "paperwork_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(self.options["path"], int(self.options.get("folders", FOLDERS)))


def folder_files(spark: SparkSession, path: str, folders: int = FOLDERS) -> DataFrame:
    """All files under ``path``, empty ones too; filters on the result reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaperworkFolders)
    return spark.read.format(PaperworkFolders.name()).option("folders", folders).load(path)


def read_folders(spark: SparkSession, path: str, folders: int = FOLDERS) -> DataFrame:
    """Submitted files under ``path``, as ``intake.read_manifest`` gives them."""
    return submitted(folder_files(spark, path, folders))


def lay_out(rows: DataFrame, path: str) -> None:
    """Write (shipment_id, side, file_name, content) as files under ``path``; a file that is there already is replaced."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        for batch in batches:
            for shipment, side, name, content in zip(*(batch.column(c).to_pylist() for c in ("shipment_id", "side", "file_name", "content")), strict=True):
                at = f"{root}/{shipment}/{side}"
                fs.create_dir(at, recursive=True)
                with fs.open_output_stream(f"{at}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("shipment_id", "side", "file_name", "content").mapInArrow(put, "n long").agg({"n": "sum"}).collect()
