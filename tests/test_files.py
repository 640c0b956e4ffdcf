"""Folders listed in pages, and documents that change as a whole."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandwork.sources import files


def test_listing(spark, tmp_path):
    """Folders within folders, a page that ends with a folder, an empty file, a large one, hidden ones, other endings."""
    made = {f"{d}{k:02d}.png": os.urandom(k) for d in ("", "a/", "a/b/", "c d/") for k in range(7)}
    made["a/large.png"] = os.urandom(3 * files.PIECE + 5)
    for key, body in {**made, "a/note.txt": b"x", ".hidden.png": b"y", "empty/.x": b""}.items():
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(body)
    files.register(spark)
    for size in (1, 7, 1000):
        rows = spark.read.format("paged_listing").option("path", str(tmp_path)).option("page_size", size).option("suffix", ".png").load().collect()
        assert {(r.key, r.size, r.md5) for r in rows} == {(k, len(b), hashlib.md5(b).hexdigest()) for k, b in made.items()} and len(rows) == len(made)
        per_page = [sum(r.token == t for r in rows) for t in {r.token for r in rows}]
        assert max(per_page) <= size
    nothing = spark.read.format("paged_listing").option("path", f"file://{tmp_path}/absent").load()
    assert nothing.collect() == []


def test_written_files(spark, tmp_path):
    rows = [("x/1.bin", b"one"), ("x/y/2.bin", b""), ("3.bin", None)]
    assert files.write_files(spark.createDataFrame(rows, "key string, content binary"), f"file://{tmp_path}/out") == 3
    found = spark.read.format("paged_listing").option("path", f"{tmp_path}/out").load().collect()
    assert {(r.key, r.size) for r in found} == {("x/1.bin", 3), ("x/y/2.bin", 0), ("3.bin", 0)}


def test_versions(spark, tmp_path):
    """A reader sees a whole version or the one before; drafts leave nothing; nothing written is no line."""
    files.register(spark)
    place = str(tmp_path / "doc")
    read = lambda **o: sorted(r.value for r in spark.read.format("versioned_document").options(path=place, **o).load().collect())
    write = lambda df: df.write.format("versioned_document").mode("append").save(place)
    assert read() == []
    lines = lambda n: spark.range(n).repartition(3).select(F.concat(F.lit('{"k": "é'), F.col("id").cast("string"), F.lit('"}')).alias("value"))
    write(lines(5))
    assert files.versions(place) == ["v00000001"] and len(read()) == 5
    bad = lines(40).withColumn("value", F.when(F.col("value").contains("17"), F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        write(bad)
    assert files.versions(place) == ["v00000001"] and len(read()) == 5 and not [n for n in os.listdir(place) if n.startswith(".draft")]
    large = spark.range(3).select(F.repeat(F.lit("y"), files.PIECE).alias("value"))
    write(large)
    write(lines(0))
    assert read() == [] and read(version=2) == ["y" * files.PIECE] * 3 and len(read(version=1)) == 5


def test_small_pages(tmp_path, monkeypatch):
    """Folders are listed once, be their pages one or many, and small pages share a task."""
    for k in range(900):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}" / f"{k:04d}.png").write_bytes(b"x" * (k % 5))
    reader = files.ListingReader({"path": str(tmp_path), "page_size": "2"})
    listed, names = [], reader._names
    monkeypatch.setattr(reader, "_names", lambda folder: listed.append(folder) or names(folder))
    parts = reader.partitions()
    rows = [row for part in parts for row in reader.read(part)]
    assert len({r[0] for r in rows}) == len(rows) == 900 and len({r[3] for r in rows}) == 450
    assert listed == ["", "d0", "d1", "d2"] and 4 <= len(parts) <= 8
    (tmp_path / "d0" / "0000.png").unlink()
    assert len([row for part in parts for row in reader.read(part)]) == 899
