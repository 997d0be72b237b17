import io

import pytest
from test_mgf import TEXT

from ionweave.sources.mgf import read_mgf, write_mgf
from ionweave.sources.mgf_format import MgfWriter, blocks_of, register_mgf, spectrum_of

COLUMNS = ["identifier", "precursor_charge", "precursor_mz", "scan", "retention_time", "peaks"]


@pytest.fixture(scope="module")
def mgf(spark):
    return register_mgf(spark)


def in_order(df):
    rows = [tuple(r) for r in df.orderBy("identifier", "spec_index").select(*COLUMNS).collect()]
    return rows


def many(n):
    return "".join(f"BEGIN IONS\nPEPMASS={400 + k / 7}\nSCANS={k}\nCHARGE={k % 3 + 1}+\n" + "".join(f"{100 + j}.5 {j * k}\n" for j in range(k % 9)) + "END IONS\n" for k in range(n))


@pytest.mark.parametrize("split", [150, 1000, 1 << 25])
@pytest.mark.parametrize("crlf", [False, True])
def test_reads_what_read_mgf_does(mgf, tmp_path, split, crlf):
    text = TEXT + many(12)
    for name in ("a.b.mgf", "c.mgf"):
        (tmp_path / name).write_bytes(text.replace("\n", "\r\n").encode() if crlf else text.encode())
    (tmp_path / "other.txt").write_text(TEXT)
    got = mgf.read.format("mgf").option("split", str(split)).load(str(tmp_path))
    assert in_order(got) == in_order(read_mgf(mgf, str(tmp_path)))
    assert got.select("identifier", "spec_index").distinct().count() == got.count()
    assert got.rdd.getNumPartitions() == 2 * -(-len((tmp_path / "c.mgf").read_bytes()) // split)


def test_odd_values(mgf, tmp_path):
    block = "BEGIN IONS\nCHARGE=2\nSCANS=99999999999\nRTINSECONDS=x\nPEPMASS=5e2\n1 2\n 3.5\t4 5\n.5 1.\n1 2x\n-1 +2\n1\nnan 1\n1e39 1\nEND IONS\nBEGIN IONS\nCHARGE=300\nEND\nBEGIN IONS\nCHARGE=-2\nEND\n"
    (tmp_path / "x.mgf").write_text(block)
    assert in_order(mgf.read.format("mgf").load(str(tmp_path))) == in_order(read_mgf(mgf, str(tmp_path)))
    assert spectrum_of(b"CHARGE=2\n") is None


@pytest.mark.parametrize("text", ["", "BEGIN", "BEGIN IONS", "xBEGIN IONSBEGIN IONSy", "aaBEGIN IONSbBEGIN BEGIN IONScBEGIN ION"])
def test_every_split_of_a_file_gives_each_block_once(text):
    raw = text.encode()
    want = list(blocks_of(io.BytesIO(raw), 0, len(raw)))
    assert [x for _, x in want] == raw.split(b"BEGIN IONS")[1:]
    for size in range(1, len(raw) + 1):
        assert [x for at in range(0, len(raw), size) for x in blocks_of(io.BytesIO(raw), at, min(at + size, len(raw)))] == want


def test_writes_what_write_mgf_does(mgf, tmp_path):
    (tmp_path / "a.mgf").write_text(many(60))
    rows = read_mgf(mgf, str(tmp_path / "a.mgf")).repartition(3)
    write_mgf(rows, str(tmp_path / "one"))
    rows.write.format("mgf").mode("append").save(str(tmp_path / "two"))
    blocks = lambda p: sorted(b for f in p.glob("*.mgf") for b in f.read_text().split("BEGIN IONS\n")[1:])
    assert blocks(tmp_path / "one") == blocks(tmp_path / "two")
    assert not [x for x in (tmp_path / "two").iterdir() if x.name.startswith("_")]
    rows.limit(5).write.format("mgf").mode("append").save(str(tmp_path / "two"))
    assert mgf.read.format("mgf").load(str(tmp_path / "two")).count() == 65
    rows.limit(7).write.format("mgf").mode("overwrite").save(str(tmp_path / "two"))
    assert mgf.read.format("mgf").load(str(tmp_path / "two")).count() == 7


def test_a_write_that_fails_leaves_nothing(mgf, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a.mgf").write_text(many(60))
    rows = read_mgf(mgf, str(tmp_path / "a.mgf")).repartition(3)
    bad = rows.withColumn("scan", F.when(F.col("scan") == 37, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("scan")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("mgf").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_a_task_that_ran_twice_counts_once(mgf, tmp_path):
    """What an attempt wrote that Spark doesn't name in the commit goes."""
    writer = MgfWriter({"path": str(tmp_path / "out")}, False)
    hidden = tmp_path / "out" / writer.hidden
    hidden.mkdir(parents=True)
    (hidden / "first").write_text("half")
    (hidden / "second").write_text("whole")
    from ionweave.sources.mgf_format import Written

    writer.commit([Written(str(hidden / "second"), 1, 0), None])
    assert [x.read_text() for x in (tmp_path / "out").iterdir()] == ["whole"]
