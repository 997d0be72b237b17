from dataclasses import replace

import numpy as np
import pytest

from ionweave.config import Settings
from ionweave.plans.pipeline import metrics, run
from ionweave.schema import CLUSTERED
from ionweave.sources.mgf import block_text, read_mgf


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three kinds of spectra, some noise, two files."""
    top = tmp_path_factory.mktemp("spectra")
    rng = np.random.RandomState(2)
    kinds = [(np.sort(rng.rand(30) * 1200 + 150), rng.rand(30) * 1000 + 50) for _ in range(3)]
    for name in ("a", "b"):
        blocks = []
        for k in range(60):
            mz, y = kinds[k % 3]
            blocks.append(block_text("t", 600.0 + 10 * (k % 3) + rng.rand() * 0.001, float(k), 2 + k % 2, None, mz + rng.rand(30) * 0.001, y * (1 + rng.rand(30) * 0.05)))
        (top / f"{name}.mgf").write_text("\n".join(blocks) + "\n")
    return top


def test_run_finds_the_kinds_and_resumes(spark, folder, tmp_path):
    s = Settings(input_filepath=str(folder), output_filename=str(tmp_path / "out"), eps=0.3, checkpoint=str(tmp_path / "ckp"), representative_mgf=True)
    out = run(spark, s)
    assert out.schema.names == CLUSTERED.names and out.count() == 120
    m = {r["precursor_charge"]: r for r in metrics(out).collect()}
    assert m[2]["clusters"] == m[3]["clusters"] == 3 and m[2]["representatives"] == 3
    reps = read_mgf(spark, f"{s.output_filename}.mgf")
    assert reps.count() == 6
    rows = sorted(map(tuple, out.collect()))
    again = run(spark, replace(s, output_filename=str(tmp_path / "again")))
    assert sorted(map(tuple, again.collect())) == rows
    direct = run(spark, replace(s, checkpoint=None, output_filename=str(tmp_path / "direct")))
    assert sorted(map(tuple, direct.collect())) == rows
    one = run(spark, replace(s, cluster_charges=(3,), output_filename=str(tmp_path / "one")))
    assert {r["precursor_charge"] for r in one.collect()} == {3}
    with pytest.raises(ValueError, match="other settings"):
        run(spark, replace(s, hd_dim=1024))


def test_single_files_in_order(spark, folder, tmp_path):
    s = Settings(input_filepath=str(folder), output_filename=str(tmp_path / "one"), eps=0.3, representative_mgf=True, single_files=True)
    rows = run(spark, s).collect()
    assert (tmp_path / "one.parquet").is_file() and (tmp_path / "one.mgf").is_file()
    key = [(r["precursor_charge"], r["bucket"]) for r in rows]
    assert len(rows) == 120 and key == sorted(key)
    assert read_mgf(spark, str(tmp_path / "one.mgf")).count() == 6


def test_compat_runs(spark, folder, tmp_path):
    s = Settings(input_filepath=str(folder), output_filename=str(tmp_path / "c"), eps=0.3, compat=True, representative_mgf=True, cluster_alg="hc_average")
    assert run(spark, s).count() == 120


def test_stream_encodes_new_files_once(spark, folder, tmp_path):
    import shutil

    from ionweave.operators.clean import clean
    from ionweave.operators.encode import encode
    from ionweave.streaming.ingest import encode_stream

    top = tmp_path / "in"
    top.mkdir()
    s = Settings(input_filepath=str(top))
    for k, name in enumerate(("a.mgf", "b.mgf")):
        shutil.copy(folder / name, top / name)
        encode_stream(spark, s, str(tmp_path / "hv"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "hv")).count() == 60 * (k + 1)
    key = lambda df: sorted((r["identifier"], r["spec_index"], tuple(r["hv"])) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "hv"))) == key(encode(clean(read_mgf(spark, str(folder)), s), s))


def test_a_resumed_run_shuffles_no_vectors(spark, folder, tmp_path):
    from ionweave.operators.cluster import local_labels, parted
    from ionweave.plans.pipeline import encoded_spectra
    from ionweave.sources.checkpoints import load_checkpoint

    s = Settings(input_filepath=str(folder), output_filename=str(tmp_path / "out"), eps=0.3, checkpoint=str(tmp_path / "ckp"))
    first = sorted(map(tuple, encoded_spectra(spark, s).collect()))
    found = load_checkpoint(spark.newSession(), s.checkpoint, s)  # a session whose catalogue doesn't have the table
    assert sorted(map(tuple, found.collect())) == first
    rows, placed = parted(load_checkpoint(spark, s.checkpoint, s), s)
    plan = local_labels(rows, s, placed)._jdf.queryExecution().executedPlan().toString()
    assert placed and "Exchange" not in plan and "Bucketed: true" in plan


def test_a_checkpoint_without_buckets_is_read(spark, folder, tmp_path):
    import json

    from ionweave.plans.pipeline import encoded_spectra
    from ionweave.sources.checkpoints import load_checkpoint

    s = Settings(input_filepath=str(folder), output_filename=str(tmp_path / "out"), eps=0.3)
    encoded = encoded_spectra(spark, s)
    encoded.write.parquet(str(tmp_path / "old" / "spectra"))
    spark.createDataFrame([(json.dumps(s.signature()),)], "value string").coalesce(1).write.text(str(tmp_path / "old" / "settings"))
    assert load_checkpoint(spark, str(tmp_path / "old"), s).count() == encoded.count() == 120
    assert load_checkpoint(spark, str(tmp_path / "none"), s) is None


def test_counts_are_logged_without_more_jobs(spark, folder, tmp_path, caplog):
    import logging

    from ionweave.plans.pipeline import Counts

    counts = Counts()
    df = counts.of("odd", counts.of("all", spark.range(10)).filter("id % 2 = 1"))
    assert df.count() == 5
    assert counts.tell() == {"odd": {"rows": 5}, "all": {"rows": 10}} and counts.tell() == counts.told
    s = Settings(input_filepath=str(folder), output_filename=str(tmp_path / "out"), eps=0.3, cluster_charges=(2, 3), checkpoint=str(tmp_path / "ckp"))
    with caplog.at_level(logging.INFO, logger="ionweave"):
        run(spark, s)
    told = [r.getMessage() for r in caplog.records]
    assert "spectra read: rows 120" in told and "spectra kept by cleaning: rows 120" in told and "spectra encoded: rows 120" in told
    assert "spectra clustered: rows 120, charge 2 60, charge 3 60, representatives 6" in told
    caplog.clear()
    with caplog.at_level(logging.INFO, logger="ionweave"):
        run(spark, s)
    assert not [r for r in caplog.records if r.getMessage().startswith("spectra read")]
