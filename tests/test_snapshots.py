"""Edits that are whole or not there, and undone."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import progress, snapshots


def texts(spark, root):
    return {r.doc_id: r.text for r in snapshots.read(spark, str(root)).collect()}


@pytest.fixture
def root(tmp_path):
    for name, text in (("a", "one two one"), ("b", "nothing"), ("c.v2", "One"), ("é +%41 x", "")):
        (tmp_path / f"{name}.txt").write_text(text)
    return tmp_path


FIRST = {"a": "one two one", "b": "nothing", "c.v2": "One", "é +%41 x": ""}


def test_versions(spark, root):
    assert texts(spark, root) == FIRST and not snapshots.undo(spark, str(root))
    assert snapshots.replace_all(spark, str(root), "none of them", "x") == {"files": 0, "replacements": 0}
    assert snapshots.current(spark, str(root)) == str(root) and len(os.listdir(root)) == 4
    assert snapshots.replace_all(spark, str(root), "one", "1") == {"files": 2, "replacements": 3}
    second = {"a": "1 two 1", "b": "nothing", "c.v2": "1", "é +%41 x": ""}
    assert texts(spark, root) == second and (root / "a.txt").read_text() == FIRST["a"]
    linked = os.stat(f"{snapshots.current(spark, str(root))}/b.txt")
    assert linked.st_ino == os.stat(root / "b.txt").st_ino
    assert snapshots.replace_all(spark, str(root), r"(\w+) two", r"\1 2", use_regex=True) == {"files": 1, "replacements": 1}
    assert texts(spark, root)["a"] == "1 2 1"
    assert snapshots.undo(spark, str(root)) and texts(spark, root) == second
    assert snapshots.undo(spark, str(root)) and texts(spark, root) == FIRST and not snapshots.undo(spark, str(root))
    with pytest.raises(ValueError):
        snapshots.replace_all(spark, str(root), "(", "", use_regex=True)
    assert texts(spark, root) == FIRST
    snapshots.replace_all(spark, str(root), "two", "2")
    assert sum(x.is_dir() for x in root.iterdir()) == 1  # what was undone is gone


def test_broken_off(spark, root, monkeypatch):
    """Stopped before the switch, or by a file that can't be written: the texts are those before, never a mixture."""
    with monkeypatch.context() as m:
        m.setattr(snapshots, "write_text", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            snapshots.replace_all(spark, str(root), "one", "1")
    assert texts(spark, root) == FIRST and sum(x.is_dir() for x in root.iterdir()) == 1
    with monkeypatch.context() as m:

        def failing(old, new):
            if "b.txt" in new:
                raise OSError("no room")

        m.setattr(snapshots, "_place", failing)
        with pytest.raises(Exception, match="no room"):
            snapshots.replace_all(spark, str(root), "one", "1")
    assert texts(spark, root) == FIRST
    assert snapshots.replace_all(spark, str(root), "one", "1")["files"] == 2
    assert texts(spark, root)["a"] == "1 two 1" and sum(x.is_dir() for x in root.iterdir()) == 1


def test_reporting(spark, monkeypatch):
    """Tasks that are done are told of while the others run."""
    monkeypatch.setattr(progress, "LOOK", 0.1)
    said = []

    @F.udf("int")
    def slow(i):
        time.sleep(0.15)
        return i

    with progress.reporting(spark, "slow", said.append):
        spark.range(24, numPartitions=12).select(slow("id")).collect()
    assert (said[-1].index, said[-1].total, said[-1].failed) == (12, 12, 0)
    assert len({p.index for p in said if p.index < 12}) >= 2
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    spark.range(3).collect()
    assert said[-1].total == 12
