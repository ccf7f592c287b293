"""The page sink: commits, aborts, and counts against page_plan."""

import json

import pytest
from pyspark.sql import functions as F

from siltworks.operators import cache
from siltworks.sources.pages import write_pages


def frame(spark, pages):
    return spark.createDataFrame([(p, t, f"h{t}") for p, t in pages.items()], "page_id string, content string, inputs string").repartition(3)


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and p.name != ".state.json"}


def test_actions_are_page_plans(spark, tmp_path):
    root, old = tmp_path / "w", {}
    for new in ({"index": "a", "modules/x": "b", "modules/y": "c"}, {"index": "a", "modules/x": "B", "new": "d"}, {}, {"index": "z"}):
        told = write_pages(frame(spark, new), str(root))
        plan = cache.page_plan(frame(spark, old).select("page_id", "inputs"), frame(spark, new).select("page_id", "inputs"))
        want = {"written": [], "kept": [], "removed": []}
        for r in plan.orderBy("page_id").collect():
            want[r.action].append(r.page_id)
        assert told == want
        assert tree(root) == {f"{p}.md": t for p, t in new.items()}
        old = new
    (root / "index.md").unlink()
    assert write_pages(frame(spark, old), str(root))["written"] == ["index"]
    assert write_pages(frame(spark, old), str(root), full=True)["written"] == ["index"]


def test_failed_export_leaves_the_old_pages(spark, tmp_path):
    root = tmp_path / "w"
    write_pages(frame(spark, {"a": "1", "b": "2"}), str(root))
    before, state = tree(root), json.loads((root / ".state.json").read_text())
    broken = frame(spark, {"a": "changed", "c": "new", "d": "x"}).withColumn("content", F.when(F.col("page_id") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        write_pages(broken, str(root))
    assert tree(root) == before and json.loads((root / ".state.json").read_text()) == state and not (root / ".drafts").exists()
    with pytest.raises(Exception, match="outside"):
        write_pages(frame(spark, {"../x": "1"}), str(root))
    assert tree(root) == before
