import pytest
from pyspark.sql import functions as F

from ionweave.schema import RAW
from ionweave.sources.mgf import block_text, read_mgf, write_mgf

TEXT = """# a comment before
BEGIN IONS
TITLE=plain
PEPMASS=500.25 1234.5
RTINSECONDS=12.5
SCANS=7
CHARGE=2+
300.5 10
# inside
200.25 20.5 extra

400 5e1
END IONS
BEGIN IONS
PEPMASS=600
CHARGE=3
RTINSECONDS=3
101.0 1
END IONS
trailing words
BEGIN IONS
PEPMASS=1
100 1
END IONS
BEGIN IONS
CHARGE=2+ and 3+
PEPMASS=700.5
END IONS
BEGIN IONS
CHARGE=2+
PEPMASS=1
100 1
"""


def collect(df):
    return df.orderBy("identifier", "spec_index").collect()


@pytest.mark.parametrize("crlf", [False, True])
def test_grammar(spark, tmp_path, crlf):
    (tmp_path / "a.b.mgf").write_bytes(TEXT.replace("\n", "\r\n").encode() if crlf else TEXT.encode())
    (tmp_path / "other.txt").write_text(TEXT)
    got = collect(read_mgf(spark, str(tmp_path)))
    assert [r["precursor_charge"] for r in got] == [2, 3, 2]  # no charge, and no end: dropped
    a, b, c = got
    assert (a["identifier"], a["scan"], a["retention_time"], a["precursor_mz"]) == ("a.b", 7, 12.5, 500.25)
    assert [tuple(p) for p in a["peaks"]] == [(200.25, 20.5), (300.5, 10), (400, 50)]
    assert (b["scan"], b["retention_time"], b["precursor_mz"]) == (-1, 3, 600)
    assert c["peaks"] == []


def test_many_splits_keep_all_in_order(spark, tmp_path):
    peaks = [(100.0 + k, float(k)) for k in range(20)]
    for name in ("x", "y"):
        (tmp_path / f"{name}.mgf").write_text("\n".join(block_text("t", 400.0 + k, float(k), 2, None, *zip(*peaks)) for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_mgf(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = collect(df)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1000
    for name in ("x", "y"):
        assert [r["retention_time"] for r in got if r["identifier"] == name] == [float(k) for k in range(500)]


def test_round_trip(spark, tmp_path):
    rows = [("f", k, 2, 400.5 + k, k, 10.0 * k, [(100.123456 + k, 2.25), (200.5, 3.75)]) for k in range(5)]
    write_mgf(spark.createDataFrame(rows, RAW).withColumn("cluster", F.col("spec_index")), str(tmp_path / "out"), files=1)
    got = collect(read_mgf(spark, str(tmp_path / "out")))
    assert [(r["precursor_mz"], r["retention_time"]) for r in got] == [(r[3], r[5]) for r in rows]
    assert [round(p["mz"], 5) for p in got[0]["peaks"]] == [100.12346, 200.5]


def test_one_file(spark, tmp_path):
    rows = [("f", k, 2, 400.5 + k, k, 10.0 * k, [(100.5, 2.25)] * (k % 3)) for k in range(50)]
    target = tmp_path / "one.mgf"
    for _ in range(2):  # the second takes the first one's place
        write_mgf(spark.createDataFrame(rows, RAW).repartition(5).orderBy("spec_index"), str(target), single=True)
    assert target.is_file() and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["one.mgf"]
    got = collect(read_mgf(spark, str(target)))
    assert [r["scan"] for r in got] == [-1] * 50 and [r["retention_time"] for r in got] == [10.0 * k for k in range(50)]


def test_numbers_are_rounded_as_c_does():
    text = block_text("a:1:2", 1.0, 2.0, 3, 4, [1.0, 2.0], [2.25, 2.35])
    assert text.split("\n")[-3:-1] == ["1.00000 2.2", "2.00000 2.4"] or text.split("\n")[-3:-1] == ["1.00000 2.2", "2.00000 2.3"]
    assert "CLUSTER=4" in text and "CHARGE=3+" in text
