import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.config import Settings
from ionweave.operators import codebook as B
from ionweave.operators.encode import encode, encode_arrays, encode_relational
from ionweave.schema import CLEAN

S = Settings(hd_dim=64, max_mz=300.0)


def test_codebook_shape_and_chain():
    book = B.build(Settings(hd_dim=256))
    levels = np.unpackbits(book.levels, axis=1).astype(int)
    assert levels.shape == (17, 256) and levels[0].sum() == 128
    assert np.abs(levels[16] - levels[0]).sum() == 128
    apart = [np.abs(levels[k] - levels[0]).sum() for k in range(17)]
    assert apart == sorted(apart)
    bins = np.unpackbits(book.bins[:50], axis=1).astype(int)
    assert (np.abs(np.diff(bins, axis=0)).sum(axis=1) <= 128).all()
    fine = B.build(Settings(hd_dim=256, mz_binning="fragment_tol"))
    assert (len(book.bins), len(fine.bins)) == (1501, 27981)
    assert (fine.bins[:1501] == book.bins).all() and (fine.levels == book.levels).all()


def test_last_places_of_unit_binning_have_vectors():
    assert len(B.build(Settings(hd_dim=64, fragment_tol=1.0)).bins) == 1501


def test_tie_is_zero_and_order_does_not_matter():
    book = B.build(S)
    one = encode_arrays(np.array([3, 3]), np.array([5, 5]), np.array([2]), book)
    assert (one == (~(book.levels[3] ^ book.bins[5]))).all()
    levels, bins = np.array([1, 5, 9, 16]), np.array([10, 20, 30, 40])
    a = encode_arrays(levels, bins, np.array([4]), book)
    assert (a == encode_arrays(levels[::-1], bins[::-1], np.array([4]), book)).all()
    two = encode_arrays(np.array([0, 0]), np.array([1, 2]), np.array([2]), book)
    x = [np.unpackbits(book.levels[0] ^ book.bins[k]) for k in (1, 2)]
    assert (np.unpackbits(two[0]) == ((x[0] + x[1]) == 0)).all()
    assert encode_arrays(np.array([], int), np.array([], int), np.array([0, 0]), book).tolist() == [[0] * 8] * 2


def test_both_encoders_agree(spark):
    rng = np.random.RandomState(5)
    rows = []
    for k in range(60):
        n = rng.randint(1, 12)
        mz = np.sort(rng.rand(n) * 199 + 101)
        v = rng.rand(n)
        v /= np.sqrt((v**2).sum())
        rows.append(("f", k, 2, 500.0, k, 1.0, [(float(a), float(b)) for a, b in zip(mz, v)], 7))
    clean = spark.createDataFrame(rows, CLEAN)
    book = B.build(S)
    got = {r["spec_index"]: r["hv"] for r in encode(clean, S, book).collect()}
    table = lambda m, name: spark.createDataFrame([(k, d, 1 if bit else -1) for k, row in enumerate(np.unpackbits(m, axis=1)) for d, bit in enumerate(row)], f"{name} int, dim int, sign int")
    peaks = clean.select("spec_index", F.explode("peaks").alias("p")).select("spec_index", F.col("p.mz").cast("int").alias("bin"), (F.col("p.intensity") * 16).cast("int").alias("level"))
    want = {}
    for r in encode_relational(peaks, table(book.levels, "level"), table(book.bins[:301], "bin"), ["spec_index"]).collect():
        want.setdefault(r["spec_index"], {})[r["dim"]] = r["bit"]
    for k, bits in want.items():
        word = sum(b << (63 - d) for d, b in bits.items())
        assert got[k] == [word - 2**64 if word >= 2**63 else word]


def test_bad_dimension():
    with pytest.raises(ValueError, match="64"):
        Settings(hd_dim=100)
