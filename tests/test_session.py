from __future__ import annotations

from pyspark.sql import functions as F

from runloom import session
from runloom.session import clear_scratch, scratch_path, shared_root, stored


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named or spark.conf.get("runloom.shared.dir"))
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(f"{shared_root(spark)}/runloom/{spark.sparkContext.applicationId}/x-")


def test_stored_counts_while_writing(spark):
    df, (n, top) = stored(spark.range(100).where("id < 7"), "t", F.count(F.lit(1)), F.max("id"))
    assert (n, top, df.count()) == (7, 6, 7)
    empty, (none,) = stored(spark.range(0), "t", F.count(F.lit(1)))
    assert none == 0 and empty.columns == ["id"] and empty.count() == 0


def test_clear_scratch(spark, tmp_path, monkeypatch):
    other = tmp_path / "runloom" / "another-application" / "t"
    other.mkdir(parents=True)
    monkeypatch.setattr(session, "shared_root", lambda _: f"file://{tmp_path}")
    assert not clear_scratch(spark)
    stored(spark.range(3), "t")
    assert clear_scratch(spark) and [p.name for p in (tmp_path / "runloom").iterdir()] == ["another-application"]
    assert other.exists()
