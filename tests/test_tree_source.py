"""Changes of a tree as a stream: restarts repeat and lose nothing, batches that are done again have the same rows."""

from __future__ import annotations

import os
import random

import pytest

from lodeseek.streaming import tree_source
from lodeseek.streaming.watcher import differences


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 + len(text), 1_700_000_000 + len(text)))


class Watch:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.heard = spark, folder, options, []

    def go(self, fail=False):
        """One run from the checkpoint; what it reported."""
        def step(batch, epoch):
            rows = [(r.event, r.path) for r in batch.collect()]
            if fail:
                raise RuntimeError(f"lost {len(rows)}")
            self.heard += rows

        self.heard = []
        changes = tree_source.watch_tree(self.spark, str(self.folder / "tree"), f"file:{self.folder}/state", **self.options)
        changes.writeStream.option("checkpointLocation", str(self.folder / "check")).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
        return sorted(self.heard, key=lambda x: x[1])


def test_restarts_and_failures(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a.py", "b c/ä.py", "node_modules/x.js", "_d/e.log", "f.txt"):
        put(root, name, "1")
    watch = Watch(spark, tmp_path, ignore_initial=False)
    assert watch.go() == [("added", "a.py"), ("added", "b c/ä.py"), ("added", "f.txt")]
    assert watch.go() == []
    put(root, "a.py", "22")
    os.remove(root / "f.txt")
    put(root, "g.md", "1")
    with pytest.raises(Exception, match="lost 3"):
        watch.go(fail=True)
    put(root, "late.py", "1")  # after the batch that failed was planned: that one is done again as it was, this comes next
    assert watch.go() == [("changed", "a.py"), ("deleted", "f.txt"), ("added", "g.md")]
    assert watch.go() == [("added", "late.py")] and watch.go() == []


def test_what_is_there_at_first_can_be_left_out(spark, tmp_path):
    put(tmp_path / "tree", "a.py", "1")
    watch = Watch(spark, tmp_path)
    assert watch.go() == []
    put(tmp_path / "tree", "b.py", "1")
    assert watch.go() == [("added", "b.py")]
    with pytest.raises(Exception, match="not exist"):
        tree_source.watch_tree(spark, str(tmp_path / "missing"), f"file:{tmp_path}/s")


def reader(tmp_path, **options):
    return tree_source.TreeReader({"path": f"file:{tmp_path}/tree", "state": f"file:{tmp_path}/state", "stable_s": "0", **options})


def rows(source, start, end):
    out = []
    for part in source.partitions(start, end):
        for batch in source.read(part):
            out += list(zip(batch.column("event").to_pylist(), batch.column("path").to_pylist()))
    return sorted(out, key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_versions_as_by_comparing_dictionaries(tmp_path, buckets):
    rng, root, seen = random.Random(buckets), tmp_path / "tree", {}
    root.mkdir()
    source = reader(tmp_path, buckets=str(buckets), ignore_initial="false")
    offsets, states = [source.initialOffset()], [{}]
    for _ in range(6):
        for _ in range(rng.randint(0, 12)):
            name = f"{rng.choice(['', 'p/', 'p/q/'])}f{rng.randint(0, 9)}.py"
            if name in seen and rng.random() < 0.4:
                os.remove(root / name)
                del seen[name]
            else:
                put(root, name, "x" * rng.randint(1, 40))
                seen[name] = str((root / name).stat().st_size)
        offsets.append(source.latestOffset())
        states.append(dict(seen))
    for i in range(len(offsets)):
        for j in range(i, len(offsets)):
            assert rows(source, offsets[i], offsets[j]) == differences(states[i], states[j])
    source.commit(offsets[-2])
    assert rows(source, offsets[-2], offsets[-1]) == differences(states[-2], states[-1])


def test_files_that_are_written_to_wait(tmp_path):
    (tmp_path / "tree").mkdir()
    source = reader(tmp_path, stable_s="3600", ignore_initial="false")
    put(tmp_path / "tree", "old.py", "1")
    (tmp_path / "tree" / "new.py").write_text("1")
    first = source.latestOffset()
    assert rows(source, {"version": 0}, first) == [("added", "old.py")]
    (tmp_path / "tree" / "old.py").write_text("22")  # it keeps its old entry until it has kept still
    assert source.latestOffset() == first
    os.utime(tmp_path / "tree" / "old.py", (1_700_000_500, 1_700_000_500))
    assert rows(source, first, source.latestOffset()) == [("changed", "old.py")]
