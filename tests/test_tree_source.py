"""The tree source against os.walk, its pruning, and hashes of files whose sizes repeat."""

import hashlib
import os

from pyspark.sql import functions as F

from atheneum.operators import audit
from atheneum.sources import tree


def make(root):
    for path, content in {"top.md": "x", "a/one.pdf": "hello", "a/b/two.PDF": "world", "a/b/c/d/three.py": "12345", "e/.git/config": "no", "e/f/x.tmp": "no", "e/f/y.xlsx": "a longer one", "e/__pycache__/z.py": "no", "g/empty.md": ""}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)


def test_scan(spark, tmp_path):
    make(tmp_path)
    rows = {r.path: r for r in tree.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"top.md", "a/one.pdf", "a/b/two.PDF", "a/b/c/d/three.py", "e/f/y.xlsx", "g/empty.md"}
    assert rows["top.md"].folder == "." and rows["a/b/c/d/three.py"].folder == "a/b/c/d" and rows["a/one.pdf"].size_bytes == 5
    assert abs(rows["a/one.pdf"].modified_at.timestamp() - os.path.getmtime(tmp_path / "a/one.pdf")) < 1
    hashes = {r.path: r.content_hash for r in tree.content_hashes(tree.scan(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert hashes == {p: hashlib.sha256((tmp_path / p).read_bytes()).hexdigest() for p in ("a/one.pdf", "a/b/two.PDF", "a/b/c/d/three.py")}


def test_filters_cut_the_listing(spark, tmp_path):
    make(tmp_path)
    (tmp_path / "e").chmod(0)  # would give nothing even so; the reader is asked directly what it lists
    reader = tree.TreeReader(str(tmp_path))
    list(reader.pushFilters([tree.StringStartsWith(("path",), "a/b"), tree.EqualTo(("folder",), "a/b/c/d")]))
    (tmp_path / "e").chmod(0o755)
    assert [(p.path, p.deep) for p in reader.partitions()] == [("", False), ("a", False), ("a/b", True)]
    df = tree.scan(spark, str(tmp_path))
    assert sorted(r.path for r in df.where(F.col("path").startswith("a/b")).collect()) == ["a/b/c/d/three.py", "a/b/two.PDF"]
    assert [r.path for r in df.where("folder in ('e/f', 'nowhere')").collect()] == ["e/f/y.xlsx"]
    assert [r.path for r in df.where("folder = '.'").collect()] == ["top.md"] and df.where("folder = 'a/b/c'").count() == 0


def test_snapshots_follow_changes(spark, tmp_path):
    make(tmp_path)
    scan = lambda: {r.path: r for r in audit.snapshots(tree.scan(spark, str(tmp_path)), samples=1).collect()}
    before = scan()
    assert set(before) == {".", "a", "a/b", "a/b/c", "a/b/c/d", "e", "e/f", "g"} and before["a/b/c"].file_count == 0 and before["."].child_count == 3
    assert before["a"].parent == "." and before["a/b"].depth == 2 and before["."].parent is None and before["a/b/c/d"].has_code and before["g"].total_bytes == 0
    assert before["a"].extensions == {".pdf": 1} and before["e/f"].categories == {"spreadsheet": 1} and before["a"].largest.path == "a/one.pdf"
    (tmp_path / "a/b/c/new.md").write_text("n")
    os.utime(tmp_path / "g/empty.md", (0, 86_400))
    after = scan()
    assert {p for p in before if before[p].signature != after[p].signature} == {"a/b/c", "g"}
