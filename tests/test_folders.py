"""The data source of submitted files: what it lists, and which filters reach the listing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from quayside.sources.folders import FolderReader, folder_files, id_of, lay_out, read_folders
from quayside.sources.intake import read_manifest

FILES = [(1, "A", "b.docx", b"12"), (1, "A", "a.pdf", b"1"), (1, "A", "empty.pdf", b""), (1, "B", "d é.xlsx", b"123"), (-7, "B", "x.png", b"1"), (20, "A", "y", None), (300, "A", "z.pdf", b"1" * 5000)]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("paperwork")
    lay_out(spark.createDataFrame(FILES, "shipment_id long, side string, file_name string, content binary"), str(root))
    for name in ("007/A/early.pdf", "draft/B/none.pdf", "1/C/other.pdf", "1/A/_hidden.pdf", "1/B/.dot", "_tmp/A/f.pdf", "2/stray.pdf"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"1")
    return str(root)


def rows(df):
    return sorted(map(str, df.collect()))


def test_same_files_as_the_general_reader(spark, tree):
    found = rows(read_folders(spark, tree))
    assert found == rows(read_manifest(spark, tree)) == rows(read_folders(spark, f"file:{tree}", 1))
    assert len(found) == 7 and sum("shipment_id=None" in r for r in found) == 2
    assert {r["file_name"]: r["doc_seq"] for r in read_folders(spark, tree).where("shipment_id = 1 and side = 'A'").collect()} == {"a.pdf": 0, "b.docx": 1}


def test_filters_give_the_same_rows(spark, tree):
    every = [tuple(r) for r in folder_files(spark, tree).collect()]
    for condition, holds in [
        (F.col("shipment_id") == 1, lambda r: r[0] == 1), (F.col("shipment_id").isin(1, 300, 999), lambda r: r[0] in (1, 300)), (F.col("shipment_id") > 1, lambda r: r[0] is not None and r[0] > 1),
        (F.col("shipment_id").isNull(), lambda r: r[0] is None), ((F.col("side") == "B") & (F.col("shipment_id") <= 1), lambda r: r[1] == "B" and r[0] is not None and r[0] <= 1),
        ((F.col("side") == "A") & (F.col("side") == "B"), lambda r: False), (F.col("size_bytes") > 2, lambda r: r[4] > 2), (F.col("side") == "C", lambda r: False),
    ]:
        assert sorted(map(str, (tuple(r) for r in folder_files(spark, tree).where(condition).collect()))) == sorted(str(r) for r in every if holds(r))


def test_filters_reach_the_listing(tree, tmp_path):
    def planned(*filters, path=tree, folders=2):
        reader = FolderReader(path, folders)
        left = list(reader.pushFilters(list(filters)))
        return left, [p.names for p in reader.partitions()]

    shipment = ("shipment_id",)
    assert planned() == ([], [["-7", "007"], ["1", "2"], ["20", "300"], ["draft"]])
    assert planned(EqualTo(shipment, 20), path="/nowhere") == ([], [["20"]])  # named without a listing
    assert planned(In(shipment, (1, 20, 300)), GreaterThan(shipment, 1)) == ([], [["20", "300"]])
    assert planned(LessThanOrEqual(shipment, 1)) == ([], [["-7", "1"]])
    assert planned(EqualTo(("side",), "C")) == ([], [[]])
    assert len(planned(IsNotNull(shipment), EqualTo(("size_bytes",), 1))[0]) == 2
    with pytest.raises(FileNotFoundError):
        planned(path=str(tmp_path / "none"))
    assert planned(path=str(tmp_path)) == ([], [[]])


def test_ids_of_folders():
    assert [id_of(x) for x in ("0", "-0", "12", "-3", "012", "1.0", " 1", "9223372036854775807", "9223372036854775808", "x", "")] == [0, None, 12, -3, None, None, None, (1 << 63) - 1, None, None, None]
