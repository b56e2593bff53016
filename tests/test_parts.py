"""Changelogs in parts: bytes, order, manifests, damaged files."""

import os

from repolens.operators import changelog as CL
from repolens.sources import sinks as K

PRS = "repo string, number bigint, title string, author string, merged_at timestamp_ntz"


def inputs(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    prs = [("r", i, f"{['fix', 'docs', 'enh', 'odd'][i % 4]}: change é {i}", f"user{i % 23}", at + dt.timedelta(hours=i)) for i in range(1, 400)]
    tags = [("r", "v1.0/é", at, None, False), ("r", "v2.0", at + dt.timedelta(hours=300, minutes=1), None, False),
            ("r", "v3.0", at + dt.timedelta(hours=300, minutes=5), None, False), ("one", "a", at, None, False), ("one", "b", at + dt.timedelta(days=9), None, False)]
    prs.append(("one", 1, "fix: only", "solo", at + dt.timedelta(days=1)))
    return (spark.createDataFrame(prs, PRS).repartition(4),
            spark.createDataFrame(tags, "repo string, tag string, pr_merged_at timestamp_ntz, committed_at timestamp_ntz, prerelease boolean"))


def test_parts_are_the_document(spark, tmp_path):
    prs, tags = inputs(spark)
    want = {tuple(r)[:3]: r.changelog for r in CL.changelog_document(prs, tags, maintainer="user3").collect()}
    assert len(want) == 3 and any("No contributors found." in t for t in want.values())
    folder = str(tmp_path / "parts")
    K.write_changelog_parts(CL.changelog_pieces(prs, tags, maintainer="user3"), folder, part_bytes=700)
    rows = sorted(K.read_changelog_parts(spark, folder).collect(), key=lambda r: (r.repo, r.from_tag, r.part))
    assert {r.status for r in rows} == {"ok"}
    for key, text in want.items():
        parts = [r for r in rows if (r.repo, r.from_tag, r.to_tag) == key]
        assert "".join(r.content for r in parts) == text
        end = 0
        for r in parts:
            assert r.start == end and r.bytes == len(r.content.encode())
            end += r.bytes
    assert max(r.bytes for r in rows) < 1000 and len(rows) > 20
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".md"))
    os.remove(files[0])
    with open(files[1], "a", encoding="utf-8") as f:
        f.write("x")
    status = [r.status for r in K.read_changelog_parts(spark, folder).collect()]
    assert sorted(s for s in status if s != "ok") == ["changed", "missing"]
