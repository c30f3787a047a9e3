"""The folder source on a real tree, and the table that upserts commit to."""

import os
import random

from quillgraph.operators import store
from quillgraph.sources import folder


def walked(root, depth):
    """Known files of a walk by name, links left out."""
    out = []
    for base, dirs, names in os.walk(root):
        level = 0 if base == root else os.path.relpath(base, root).count(os.sep) + 1
        dirs[:] = [d for d in dirs if level < depth and not os.path.islink(os.path.join(base, d))]
        out += [os.path.join(base, n) for n in names if n.rpartition(".")[2].lower() in folder.KNOWN and "." in n and not os.path.islink(os.path.join(base, n))]
    return sorted(out, key=lambda p: os.path.relpath(p, root).split(os.sep))


def test_tree(spark, tmp_path):
    r = random.Random(3)
    places = [tmp_path]
    for k in range(40):
        p = r.choice(places) / f"d{k}.x"
        p.mkdir()
        places.append(p)
    for k in range(150):
        f = r.choice(places) / f"f{k}.{r.choice(['md', 'TXT', 'pdf', 'exe', 'html', 'tar.gz'])}"
        f.write_text("x" * k)
        os.utime(f, (1_700_000_000 + r.randint(0, 50), 1_700_000_000 + k % 9))
    (tmp_path / "noext").write_text("")
    os.symlink(places[3], tmp_path / "linked")
    os.symlink(next(tmp_path.rglob("*.md")), tmp_path / "link.md")
    os.symlink(tmp_path, places[5] / "round")
    root = str(tmp_path)
    for depth, limit in ((5, 10_000), (0, 10_000), (1, 10_000), (2, 10_000), (3, 17)):
        got = folder.scan(spark, root, depth, limit).collect()
        want = walked(root, depth)[:limit]
        assert sorted(x.path for x in got) == sorted(want)
        assert [x.modified for x in got] == sorted((x.modified for x in got), reverse=True)
        assert all(x.size == os.stat(x.path).st_size and x.depth == os.path.relpath(x.path, root).count(os.sep) for x in got)
    assert max(x.depth for x in folder.scan(spark, root).collect()) >= 3
    assert folder.scan(spark, f"{root}/not_there").count() == 0


def test_upserts_commit_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    of = lambda *rows: spark.createDataFrame(rows, "id long, v string, seq long")
    for rows in ([(1, "a", 1), (2, "b", 2), (2, "c", 3)], [(2, "d", 9), (3, "e", 1)], [], [(1, "f", 0)]):
        store.sink_upsert(of(*rows) if rows else of((0, "", 0)).where("false"), path, "id", "seq")
    assert {(x.id, x.v) for x in store.latest_version(spark, path).collect()} == {(1, "f"), (2, "d"), (3, "e")}
    assert sorted(os.listdir(path)) == ["v2", "v3"]
    os.makedirs(f"{path}/v4")  # a version that was never finished
    assert store.latest_version(spark, path).count() == 3
