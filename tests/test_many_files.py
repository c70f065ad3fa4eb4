"""Many files of mixed settings in one scan: the rows of reading each by itself, in a fixed number of jobs."""

from parcelwise.sources.delimited import read_aliased
from parcelwise.sources.many import file_settings, scan_aliased

SOURCES = {"account": ("acct", "account_id"), "owner": ("owner", "Owner_Name"), "site": ("site",)}


def make(folder, n):
    folder.mkdir()
    want = []
    for i in range(n):
        sep, coding = "\t|,"[i % 3], ("utf-8", "latin-1", "cp1252")[i % 7 % 3]
        head = ["ACCT", "owner", "x"] if i % 2 else ["Owner_Name", "account_id", "y", "site"]
        rows = [[f"{i}-{k}", {"utf-8": "Müller ©", "latin-1": "MUÑOZ \"A\"", "cp1252": "O\x92Neil €"}[coding].replace("\x92", "’"), "z"] for k in range(4)]
        out = [head]
        for k, (a, o, z) in enumerate(rows):
            o = None if k == 2 and coding != "cp1252" else o
            out.append([a, o or "", z] if i % 2 else [o or "", a, z, "s", "surplus"][: 5 - k])
            want.append((a, o, None if i % 2 or k > 1 else "s"))
        text = "\n".join(sep.join(r) for r in out[:3]) + "\n\n" + "\n".join(sep.join(r) for r in [out[0], *out[3:]]) + "\n"
        (folder / f"f{i:03d}.txt").write_bytes(text.encode(coding))
    (folder / "empty.txt").write_bytes(b"")
    (folder / "head.txt").write_bytes(b"acct\towner\n")
    (folder / "mark.txt").write_bytes("﻿acct|owner|z\n1|2|3\n".encode())
    want.append(("1", "2", None))
    return want


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_mixed_files(spark, tmp_path):
    counts = []
    for n in (3, 60):
        want = make(tmp_path / f"in{n}", n)
        run = lambda: scan_aliased(spark, [str(tmp_path / f"in{n}")], SOURCES).select(*SOURCES).collect()  # noqa: B023, E731
        got, used = jobs(spark, f"scan{n}", run)
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        counts.append(used)
    assert counts[0] == counts[1]


def test_same_as_file_by_file(spark, tmp_path):
    make(tmp_path / "in", 6)
    paths = sorted(str(p) for p in (tmp_path / "in").glob("f00[1-5].txt"))
    head = lambda df: [tuple(r) for r in df.orderBy("pos").select(*SOURCES).collect() if r["account"] and r["account"].lower() not in ("acct", "account_id")]
    assert head(scan_aliased(spark, paths, SOURCES)) == head(read_aliased(spark, paths, SOURCES))


def test_settings(spark, tmp_path):
    make(tmp_path / "in", 9)
    found = {r["path"].rsplit("/", 1)[1]: r for r in file_settings(spark, [str(tmp_path / "in")]).collect()}
    assert "empty.txt" not in found and list(found["mark.txt"]["names"]) == ["acct", "owner", "z"]
    assert found["f004.txt"]["encoding"] == "latin-1" and found["f005.txt"]["encoding"] == "cp1252" and found["f003.txt"]["encoding"] == "utf-8"
    assert [found[f"f00{i}.txt"]["delimiter"] for i in range(3)] == ["\t", "|", ","]
