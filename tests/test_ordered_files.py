import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.sources import csv_files as CS
from gristmill.sources import ordered_files as O


def table(spark, n=500):
    return spark.range(n).select(F.concat(F.lit("a/b "), (F.col("id") % 3).cast("string")).alias("f"), "id", F.concat(F.lit("row\n,"), F.col("id").cast("string")).alias("t")).repartition(7)


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(O.committed(path)) for f in fs if f.startswith("part-"))


def test_files_hold_the_pieces_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    O.write_ordered(table(spark), path, F.col("f"), ["id"], F.col("t"), separator="\n\n---\n\n", header="# head\n", end="\n", extension="md")
    back = O.read_ordered(spark, path).collect()
    for k in range(3):
        own = sorted((r for r in back if r.file == f"a/b {k}"), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and [r.piece for r in own] == [f"row\n,{i}" for i in range(k, 500, 3)]
    texts = [open(f).read() for f in files(path)]
    assert all(t.startswith("# head\n") and t.endswith("\n") for t in texts)
    assert sum(t.count("\n\n---\n\n") for t in texts) == 500 - len(texts)
    # the folders of the files can be read by any reader
    seen = spark.read.text(O.committed(path) + "/*", wholetext=True).select(O.file_of(F.col("_metadata.file_path")).alias("f")).distinct()
    assert {r.f for r in seen.collect()} == {"a/b 0", "a/b 1", "a/b 2"}


def test_a_failed_write_leaves_the_earlier_result(spark, tmp_path):
    path = str(tmp_path / "out")
    O.write_ordered(table(spark, 30), path, F.col("f"), ["id"], F.col("t"))
    first = files(path)
    broken = table(spark, 60).withColumn("t", F.when(F.col("id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception):
        O.write_ordered(broken, path, F.col("f"), ["id"], F.col("t"))
    assert O.read_ordered(spark, path).count() == 30 and files(path) == first
    O.write_ordered(table(spark, 60), path, F.col("f"), ["id"], F.col("t"))
    assert O.read_ordered(spark, path).count() == 60 and len([d for d in os.listdir(path) if d.startswith("run-")]) == 1


def test_repeated_attempts_and_killed_runs_leave_one_result(tmp_path):
    path = str(tmp_path / "out")
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "y", None]), pa.array(["1", None, "", "4"])], ["f", "t"])
    killed = O.Writer({"path": path})
    killed.write_task(iter([batch]), 0, 1)
    writer = O.Writer({"path": path})
    writer.write_task(iter([batch]), 0, 1)

    def dies():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write_task(dies(), 1, 2)
    messages = [writer.write_task(iter([batch]), 0, 3), writer.write_task(iter([]), 1, 4), None]
    writer.commit(messages)
    reader = O.Reader(path)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert rows == [("x", 0, 0, "1"), ("x", 0, 1, ""), ("y", 0, 0, ""), (None, 0, 0, "4")]
    assert len([d for d in os.listdir(path) if d.startswith("run-")]) == 1


def test_empty_tables_and_bytes(spark, tmp_path):
    path = str(tmp_path / "none")
    O.write_ordered(table(spark).limit(0), path, F.col("f"), ["id"], F.col("t"))
    assert O.read_ordered(spark, path).count() == 0
    path = str(tmp_path / "raw")
    O.write_ordered(table(spark, 3), path, F.col("f"), ["id"], F.encode(F.col("t"), "UTF-16LE"), end="", extension="csv")
    assert sorted(open(f, "rb").read().decode("utf-16le") for f in files(path)) == [f"row\n,{i}" for i in range(3)]


def test_files_of_different_layouts_are_recoded_by_groups(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_bytes('Handle;Title;Title\n"x;1";"é ""q"""\n\n;;\ny;"two\nlines";z\n'.encode("iso-8859-1"))
    (folder / "b.csv").write_bytes("﻿Title,Vendor\nplain,Ann\nshort\n".encode())
    (folder / "c.csv").write_bytes("﻿Title,Vendor\nwide,Bob\n".encode("utf-16le"))
    (folder / "d.csv").write_bytes(b"Title,Vendor\nlast,Eve")
    (folder / "e.csv").write_bytes(b"Title,Vendor\n")
    rows = CS.csv_recode(spark, str(folder))
    assert set(rows.columns) == {"file_id", "row_no", "Handle", "Title", "Title (2)", "Vendor"}
    got = {(r.file_id[-5:], r.row_no, r.Handle, r.Title, r["Title (2)"], r.Vendor) for r in rows.collect()}
    assert got == {
        ("a.csv", 2, "x;1", 'é "q"', None, None), ("a.csv", 3, "y", "two\nlines", "z", None), ("b.csv", 2, None, "plain", None, "Ann"), ("b.csv", 3, None, "short", None, None),
        ("c.csv", 2, None, "wide", None, "Bob"), ("d.csv", 2, None, "last", None, "Eve")}
    CS.write_lines(rows, out, F.substring("file_id", -5, 5), ["row_no"], ["Title", "Vendor"])
    back = {(r.file, r.position, r.Title, r.Vendor) for r in CS.read_lines(spark, out, ["Title", "Vendor"]).collect()}
    assert back == {("a.csv", 0, 'é "q"', ""), ("a.csv", 1, "two\nlines", ""), ("b.csv", 0, "plain", "Ann"), ("b.csv", 1, "short", ""), ("c.csv", 0, "wide", "Bob"), ("d.csv", 0, "last", "Eve")}
    assert all(open(f, "rb").read().startswith(b'"Title","Vendor"\n') for f in files(out))
