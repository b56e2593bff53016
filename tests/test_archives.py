"""Members of nested and broken archives, by plain listings."""

import io
import tarfile
import zipfile

import pytest
import zstandard

from repolens.sources import archives as A
from repolens.sources import readers as R


def tar(names, mode):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode=mode) as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    return buf.getvalue()


def packed(entries, level=zipfile.ZIP_DEFLATED):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", level) as z:
        for n, data in entries.items():
            z.writestr(n, data)
    return buf.getvalue()


CONDA = packed({"metadata.json": "{}", "pkg-a.tar.zst": zstandard.ZstdCompressor().compress(tar(["site/a.py", "site/b.py"], "w"))}, zipfile.ZIP_STORED)
WHEEL = packed({"lib/": "", "lib/a.py": "x"})
FILES = {"lib-1.0.0-py3-none-any.whl": WHEEL, "lib-1.0.0.tar.gz": tar(["lib/a.py"], "w:gz"), "lib-1.0.0-py_0.tar.bz2": tar(["a"], "w:bz2"),
         "lib-1.0.0.tgz": tar(["package/x.js"], "w:gz"), "lib-1.0.0-py_0.conda": CONDA}
LISTED = {("wheel", "lib/"), ("wheel", "lib/a.py"), ("sdist", "lib/a.py"), ("conda1", "a"), ("npm", "package/x.js"),
          ("conda", "metadata.json"), ("conda", "site/a.py"), ("conda", "site/b.py")}


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_plain_and_nested_archives(spark, tmp_path, size):
    (tmp_path / "deep").mkdir()
    for name, data in FILES.items():
        (tmp_path / "deep" / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    got = R.read_archive_members(spark, str(tmp_path), partition_bytes=size)
    assert {(r.format, r.member) for r in got.collect()} == LISTED and got.count() == len(LISTED)
    assert R.read_archive_members(spark, str(tmp_path), "*.whl").count() == 2
    outer = {f"dist/{n}": d for n, d in FILES.items()} | {"log.txt": "x", "inner.zip": packed(FILES)}
    (tmp_path / "out.zip").write_bytes(packed(outer))
    rows = R.read_archive_members(spark, str(tmp_path), "*.zip", partition_bytes=size).collect()
    top = [r for r in rows if "!" not in r.path]
    assert {r.member for r in top} == set(outer) and {(r.format, r.archive) for r in top} == {("zip", "out.zip")}
    once = [r for r in rows if "!/dist/" in r.path]
    assert {(r.format, r.member) for r in once} == LISTED
    assert {r.path.split("!/")[1] for r in once} == {f"dist/{n}" for n in FILES}
    twice = [r for r in rows if r.path.count("!") == 2]
    assert {(r.format, r.member) for r in twice} == LISTED and {r.archive for r in twice} == set(FILES)


def test_bad_archives_say_why_and_spare_their_neighbours(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"cut-{name}").write_bytes(data[:len(data) // 2])
        (tmp_path / f"empty-{name}").write_bytes(b"")
    (tmp_path / "out.zip").write_bytes(packed({"cut.whl": WHEEL[:40], "good.whl": WHEEL}))
    rows = R.read_archive_members(spark, str(tmp_path), bad_archives="status").collect()
    bad = {r.archive for r in rows if r.status != "ok"}
    assert bad == {f"{p}-{n}" for p in ("cut", "empty") for n in FILES} | {"cut.whl"}
    assert all(r.member is None for r in rows if r.status != "ok")
    assert {(r.format, r.member) for r in rows if r.archive in FILES} == LISTED
    assert {r.member for r in rows if r.archive == "good.whl"} == {"lib/", "lib/a.py"}
    with pytest.raises(Exception, match="not a whole archive: .*cut"):
        R.read_archive_members(spark, str(tmp_path)).collect()


def test_partitions_are_balanced_by_bytes():
    files = [(100, "a"), (60, "b"), (50, "c"), (40, "d"), (30, "e"), (1, "f")]
    parts = A.balanced(files, 100)
    sizes = dict((p, s) for s, p in files)
    assert sorted(p for part in parts for p in part) == list("abcdef") and len(parts) == 3
    assert max(sum(sizes[p] for p in part) for part in parts) <= 101
    assert A.balanced([], 100) == [[]] and A.balanced([(0, "x")], 100) == [["x"]]
