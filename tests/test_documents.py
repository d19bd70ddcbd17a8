"""Documents at their own paths: what is there, what is replaced, what a failed job leaves."""

from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from newsgrid.sources.documents import PENDING, write_documents

LINES = "path string, line int, value string"


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file()}


def test_documents_stand_at_their_paths(spark, tmp_path):
    rows = [("feeds/us/latest.json", 1, "b"), ("feeds/us/latest.json", 0, "a"), ("s/é x.json", 0, "c"), *[("big.json", i, str(i)) for i in range(5000)]]
    write_documents(spark.createDataFrame(rows, LINES).repartition(7), str(tmp_path))
    want = {"feeds/us/latest.json": "a\nb\n", "s/é x.json": "c\n", "big.json": "".join(f"{i}\n" for i in range(5000))}
    assert files(tmp_path) == want
    write_documents(spark.createDataFrame([("feeds/us/latest.json", 0, "new")], LINES), str(tmp_path))
    assert files(tmp_path) == {**want, "feeds/us/latest.json": "new\n"}
    write_documents(spark.createDataFrame([], LINES), str(tmp_path / "none"))


def test_a_failed_job_leaves_no_parts(spark, tmp_path):
    for bad in ("../out.json", "/abs.json", "a/../../b", ""):
        with pytest.raises(PySparkException):
            write_documents(spark.createDataFrame([("ok.json", 0, "x"), (bad, 0, "y")], LINES), str(tmp_path))
    assert not any(PENDING in f for f in files(tmp_path)) and not (tmp_path.parent / "out.json").exists()
