import pytest

from fenloom.sources import delimited as L, hierarchy as H, sequences as S


@pytest.fixture()
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_equal_file_names_in_two_folders(spark, tmp_path, tiny_splits):
    reads = {}
    for folder, n in (("s1", 40), ("s2", 37)):
        text = ""
        for i in range(n):
            reads[f"{folder}r{i}"] = ("ACGT" * (i % 7 + 1), "@I+" * (i % 7 + 1))
            text += f"@{folder}r{i} x\n{'ACGT' * (i % 7 + 1)}\n+\n{'@I+' * (i % 7 + 1)}\n"
        _put(tmp_path / folder / "reads.fastq", text)
    got = S.read_fastq(spark, f"{tmp_path}/*/reads.fastq")
    assert got.rdd.getNumPartitions() >= 1
    assert {r.read_id: (r.seq, r.qual) for r in got.collect()} == reads
    assert {r.path.split("/")[-2] for r in got.collect()} == {"s1", "s2"} and got.select("file").distinct().count() == 1


def test_hierarchies_of_one_name(spark, tmp_path, tiny_splits):
    for folder in ("a", "b"):
        _put(tmp_path / folder / "h.txt", "+D\n" + "".join(f"A<b>{folder}{i}</b>\nB  x{i}\nC  y\nD  z{i}\nD  w{i}\n" for i in range(30)))
    got = H.read_htext(spark, f"{tmp_path}/*/h.txt").collect()
    assert sorted((r.L1, r.L2, r.L4) for r in got) == sorted(
        (f"{f}{i}", f"x{i}", f"{leaf}{i}") for f in "ab" for i in range(30) for leaf in "zw")


def test_bins_of_one_name(spark, tmp_path):
    for folder in ("a", "b"):
        _put(tmp_path / folder / "bin.1.fa", f">{folder}c1 d\nACGT\n>{folder}c2\nAC\nGT\n")
    got = S.contigs_to_bin(spark, f"{tmp_path}/*/*.fa", "m", r"([^/]+)/bin").collect()
    assert sorted((r.contig, r.bin) for r in got) == [("ac1", "a"), ("ac2", "a"), ("bc1", "b"), ("bc2", "b")]
    with pytest.raises(ValueError, match="bin.1"):
        S.contigs_to_bin(spark, f"{tmp_path}/*/*.fa", "m")


def test_headers_count(spark, tmp_path):
    _put(tmp_path / "x" / "one.csv", "﻿b,a\r\n1,2\r\n")
    _put(tmp_path / "y" / "two.csv", "a,c,b\n3,q,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        L.read_table(spark, f"{tmp_path}/x/one.csv", "a int, b int").collect()
    got = L.read_many(spark, f"{tmp_path}/*/*.csv", "a int, b int", pattern=r"([^/]+)/[^/]*$").collect()
    assert sorted((r.file, r.a, r.b) for r in got) == [("x", 2, 1), ("y", 3, 4)]
    with pytest.raises(ValueError, match="two.csv|one.csv"):
        L.read_many(spark, f"{tmp_path}/*/*.csv", "a int, z int")


def test_headers_of_many_files(spark, tmp_path, tiny_splits):
    rows = []
    for i in range(30):
        names = [["a", "b"], ["b", "a"], ["c", "b", "a"]][i % 3]
        lines = [{"a": i, "b": j, "c": 9} for j in range(50)]  # several splits each
        rows += [(f"f {i}%20", i, j) for j in range(50)]
        _put(tmp_path / f"f {i}%20" / "t.csv", "\n".join([",".join(names), *(",".join(str(x[n]) for n in names) for x in lines)]) + "\n")
    _put(tmp_path / "none" / "t.csv", "")
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, group)
    got = L.read_many(spark, f"{tmp_path}/*/*.csv", "a int, b int", pattern=r"([^/]+)/[^/]*$")
    assert len(tracker.getJobIdsForGroup(group)) < 15
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(r[1:] for r in rows) and got.select("file").distinct().count() == 30
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_tails_after_a_call_on_the_driver(spark):
    from fenloom.functions import tails

    want = float(tails.t_two_sided(2.0, 5)), float(tails.f_upper(3.0, 2, 9))
    row = spark.range(1).selectExpr("2.0D AS t", "5.0D AS d", "3.0D AS f", "2.0D AS a", "9.0D AS b").select(
        tails.t_pvalue("t", "d"), tails.f_pvalue("f", "a", "b"), tails.normal_upper("t")).first()
    assert row[0] == pytest.approx(want[0]) and row[1] == pytest.approx(want[1]) and row[2] == pytest.approx(0.0227501, abs=1e-6)
