"""Listing and reading a tree in tasks: the rows are those of the listing on the driver."""

from __future__ import annotations

import os
import random

import pytest

from lodeseek.sources import scan, tree
from tests.test_running import tree as project  # noqa: F401


def both(spark, root, options=scan.ScanOptions()):
    old = {tuple(r) for r in scan.scan(spark, str(root), options).collect()}
    new = [tuple(r) for r in tree.scan_tree(spark, str(root), options).collect()]
    assert len(new) == len(set(new))
    return old, set(new)


def test_rows_are_those_of_the_driver(spark, project):  # noqa: F811
    old, new = both(spark, project)
    assert old == new and len(new) == 7


@pytest.mark.parametrize("options", [scan.ScanOptions(extensions=[".py"]), scan.ScanOptions(exclude=["pkg/"]), scan.ScanOptions(use_defaults=False), scan.ScanOptions(ignore_files=())])
def test_options(spark, project, options):  # noqa: F811
    old, new = both(spark, project, options)
    assert old == new and new


def test_random_trees(spark, tmp_path):
    rng = random.Random(3)
    names = ["a", "b c", "node_modules", "build", "_x", ".d", "gen", "ä", "100%", "q?"]
    for i in range(150):
        folder = tmp_path.joinpath("r", *rng.choices(names, k=rng.randint(0, 5)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / rng.choice([f"f{i}.py", f"_g{i}.ts", f".h{i}.go", "k.pem", f"n{i}.txt", f"e{i} é.md"])).write_bytes(rng.randbytes(rng.randint(0, 50)))
    (tmp_path / "r" / ".gitignore").write_text("gen/\n!gen/keep.py\n_x/_g*\n")
    old = {(p, rel, size, ms) for p, rel, size, ms in scan.list_files(spark, str(tmp_path / "r")).files}
    entries = tree.list_tree(spark, str(tmp_path / "r"))
    assert {(r.path, r.rel_path, r.size, r.modified) for r in entries.where("kept").collect()} == old
    stats, was = tree.tree_stats(entries).first(), scan.list_files(spark, str(tmp_path / "r"))
    assert (stats.total_files, stats.excluded_files, stats.unreadable_folders) == (was.total_files, was.excluded_files, 0)
    got = {r.rel_path: r.content for r in tree.read_tree(entries.where("kept"), scan.located(spark, str(tmp_path / "r"))).collect()}
    assert got == {rel: (tmp_path / "r" / rel).read_bytes() for _, rel, *_ in old}


def test_empty_missing_and_vanished(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert tree.scan_tree(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="not exist"):
        tree.scan_tree(spark, str(tmp_path / "missing"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.py").write_text("a = 1\n")
    (tmp_path / "one" / "b.py").write_text("b = 1\n")
    files = tree.list_tree(spark, str(tmp_path / "one")).where("kept")
    os.remove(tmp_path / "one" / "b.py")
    assert [r.rel_path for r in tree.read_tree(files, scan.located(spark, str(tmp_path / "one"))).collect()] == ["a.py"]


def test_paths_of_stores():
    store, place = tree.open_store("file:/tmp/a b")
    assert place("file:/tmp/a b/c%20d") == "/tmp/a b/c%20d" and tree.scheme_of("/tmp/x:y") == "file" and tree.scheme_of("s3a://b/c") == "s3a"
