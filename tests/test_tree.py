"""Listing a tree level by level, and as a stream."""

import os

from siltworks.sources import tree


def test_ten_thousand_files(spark, tmp_path, monkeypatch):
    """Only the workers list: the driver's own scandir and walk are never called."""
    want = set()
    for i in range(500):
        folder = tmp_path / f"a{i % 25}" / f"b{i}"
        folder.mkdir(parents=True)
        for j in range(20):
            (folder / f".f{j}" if j % 7 == 0 else folder / f"_f{j}.py").write_text(str(j) if j else "")
            want.add(f"a{i % 25}/b{i}/" + (f".f{j}" if j % 7 == 0 else f"_f{j}.py"))
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/x").write_text("no")
    (tmp_path / "p.egg-info").mkdir()
    (tmp_path / "p.egg-info/x").write_text("no")
    os.symlink(tmp_path / "a0", tmp_path / "link")
    monkeypatch.setattr(os, "walk", lambda *a, **k: (_ for _ in ()).throw(AssertionError("the driver walks")))
    monkeypatch.setattr(os, "scandir", lambda *a: (_ for _ in ()).throw(AssertionError("the driver lists")))
    found = tree.list_tree(spark, str(tmp_path), ("skip",)).collect()
    assert len(found) == len(want) == 10_000 and {r.path for r in found} == want
    rows = tree.read_tree(spark, str(tmp_path), skipDirs="skip").collect()
    assert {r.path for r in rows} == want and all(r.size == len(r.raw) for r in rows)


def test_empty_tree(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).collect() == []


def test_second_batch_holds_what_changed(spark, tmp_path):
    root, seen = tmp_path / "in", []
    (root / "d").mkdir(parents=True)
    for n in ("a.py", "d/b.py", "d/c.py"):
        (root / n).write_text(n)

    def run():
        seen.append([])
        stream = tree.stream_tree(spark, str(root), filesPerTask=2)
        query = stream.writeStream.foreachBatch(lambda df, _: seen[-1].extend((r.path, bytes(r.raw).decode()) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    run()
    (root / "d/b.py").write_text("changed")
    (root / "d/new.py").write_text("new")
    run()
    run()
    assert [sorted(s) for s in seen] == [[("a.py", "a.py"), ("d/b.py", "d/b.py"), ("d/c.py", "d/c.py")], [("d/b.py", "changed"), ("d/new.py", "new")], []]
