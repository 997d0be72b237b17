"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.config import Settings
from ionweave.functions import peaks as P
from ionweave.operators import clean as C
from ionweave.operators.cluster import cluster, component_labels, medoids_by_ones
from ionweave.operators.codebook import Codebook, pack
from ionweave.operators.encode import encode, encode_relational
from ionweave.operators.pairs import pairs, precursor_blocks
from ionweave.operators.prefix import totals_before
from ionweave.operators.tiles import distance_counts, near_pairs
from ionweave.plans import adapters as A
from ionweave.plans.pipeline import representative_spectra
from ionweave.session import cut
from ionweave.sources.mgf import START, mgf_blocks, parse_blocks

Query = Callable[[SparkSession, str], DataFrame]

#: Limits that cut something of the driver's spectra.
SETTINGS = Settings(max_peaks_used=20, min_intensity=0.3, precursor_tol=(200.0, "ppm"), eps=0.45)
#: Signatures at most so many of 64 bits apart are linked.
NEAR = 24


def long(c: str, name: str | None = None):
    return F.col(c).cast("long").alias(name or c)


def _count_and_sum(peaks, name: str = "mz", digits: int = 2):
    total = F.aggregate(P._col(peaks), F.lit(0.0), lambda a, p: a + p[name])
    return F.size(peaks).cast("long").alias("n"), F.round(total, digits).alias("total")


def mz_range(spark, d):
    return A.spectra(spark, d).withColumn("p", P.mz_range("peaks", 101.0, 1500.0)).select(long("spec_index", "id"), *_count_and_sum("p"))


def valid_spectra(spark, d):
    return A.spectra(spark, d).withColumn("p", P.mz_range("peaks", 101.0, 1500.0)).filter(P.is_valid("p", 20, 1300.0)).select(long("spec_index", "id"))


def precursor_removed(spark, d):
    p = P.remove_precursor("peaks", "precursor_mz", "precursor_charge", 25.0)
    return A.spectra(spark, d).withColumn("p", p).select(long("spec_index", "id"), *_count_and_sum("p"))


def topk_intensity(spark, d):
    return A.spectra(spark, d).withColumn("p", P.most_intense("peaks", 20, 0.3)).select(long("spec_index", "id"), *_count_and_sum("p", "intensity"))


def _scaled(scaling: str) -> Query:
    def query(spark, d):
        p = P.scale(P.most_intense("peaks", 20, 0.3), scaling, 20)
        return A.spectra(spark, d).withColumn("p", p).select(long("spec_index", "id"), *_count_and_sum("p", "intensity", 4))

    return query


def scale_to_top(spark, d):
    """Roots of the strongest peaks, so that the highest is 1000."""
    p = P.scale(P.most_intense("peaks", 20, 0.3), "root", 20, max_intensity=1000.0)
    return A.spectra(spark, d).withColumn("p", p).select(long("spec_index", "id"), *_count_and_sum("p", "intensity", 3))


def precursor_removed_ppm(spark, d):
    """Peaks farther than 20,000 ppm from the precursor and its first two isotopes at every charge."""
    p = A.spectra(spark, d).withColumn("p", P.remove_precursor("peaks", "precursor_mz", "precursor_charge", 20000.0, "ppm", isotope=2))
    return p.select(long("spec_index", "id"), *_count_and_sum("p"))


def l2_norm(spark, d):
    p = A.spectra(spark, d).withColumn("p", P.unit_norm("peaks"))
    return p.select(long("spec_index", "id"), F.round(F.array_max("p.intensity"), 6).alias("top"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["intensity"] * x["intensity"]), 6).alias("norm"))


def bucket_index(spark, d):
    return A.spectra(spark, d).select(long("spec_index", "id"), P.bucket("precursor_mz", "precursor_charge", 1).cast("long").alias("bucket"))


def _bucketed(spark, d):
    return A.spectra(spark, d).withColumn("bucket", P.bucket("precursor_mz", "precursor_charge", 1))


def bucket_sizes(spark, d):
    return C.bucket_sizes(_bucketed(spark, d)).select(long("precursor_charge"), long("bucket"), long("size"))


def bucket_histogram(spark, d):
    return C.size_histogram(_bucketed(spark, d), (0, 2, 4, 8, 16, 1000000)).select(long("bin"), long("buckets"), F.round("share", 4).alias("share"))


def charge_filter(spark, d):
    return C.charges(A.spectra(spark, d), (3,)).groupBy("precursor_charge").agg(F.count("*").alias("n")).select(long("precursor_charge"), long("n"))


def distinct_charges(spark, d):
    return A.spectra(spark, d).select(long("precursor_charge")).distinct()


def mass_diff(spark, d):
    s = A.spectra(spark, d).select("spec_index", F.col("precursor_mz").cast("double").alias("m"))
    return s.select(long("spec_index", "id"), F.round(P.mass_diff(F.col("m"), F.lit(950.0), "Da"), 4).alias("da"), F.round(P.mass_diff(F.col("m"), F.lit(950.0), "ppm"), 2).alias("ppm"))


def clean_summary(spark, d):
    """Clean spectra by charge and bucket: how many, their peaks, the mean of their highest normalised intensity."""
    c = C.clean(A.spectra(spark, d), SETTINGS)
    by = c.groupBy("precursor_charge", "bucket").agg(F.count("*").alias("spectra"), F.sum(F.size("peaks")).alias("n_peaks"), F.avg(F.array_max("peaks.intensity")).alias("top"))
    return by.select(long("precursor_charge"), long("bucket"), long("spectra"), long("n_peaks"), F.round("top", 4).alias("top"))


def _levels(spark, d):
    c = C.clean(A.spectra(spark, d), SETTINGS).select("spec_index", F.explode("peaks").alias("p"))
    return c.select(F.col("spec_index").alias("id"), P.mz_bin("p.mz").alias("bin"), P.level(F.col("p.intensity"), 16).alias("level"))


def bin_level(spark, d):
    return _levels(spark, d).groupBy("bin", "level").agg(F.count("*").alias("n")).select(long("bin"), long("level"), long("n"))


def encode_small(spark, d):
    """Hypervectors of 64 dimensions from codebooks that are an arithmetic rule: their ones, and the sum of the ones' places."""
    dims = spark.range(64).select(F.col("id").cast("int").alias("dim"))
    sign = lambda ok: F.when(ok, 1).otherwise(-1).alias("sign")
    levels = spark.range(17).select(F.col("id").cast("int").alias("level")).join(dims).select("level", "dim", sign((F.col("level") * 37 + F.col("dim") * 101) % 97 < 48))
    bins = spark.range(1501).select(F.col("id").cast("int").alias("bin")).join(dims).select("bin", "dim", sign((F.col("bin") * 7919 + F.col("dim") * 104729) % 1009 < 504))
    bits = encode_relational(_levels(spark, d), levels, bins, ["id"])
    return bits.groupBy("id").agg(F.sum("bit").alias("ones"), F.sum(F.col("bit") * F.col("dim")).alias("places")).select(long("id"), long("ones"), long("places"))


def _near_pairs(spark, d, **how):
    found = near_pairs(A.signatures(spark, d), "id", NEAR / 64, None, keys=("bucket",), **how)
    return found.select(long("bucket"), long("i"), long("j"), F.rint(F.col("dist") * 64).cast("long").alias("bits"))


def sig_pairs(spark, d):
    return _near_pairs(spark, d)


def hamming_hist(spark, d):
    return distance_counts(A.signatures(spark, d), "id", keys=("bucket",)).select("bits", long("n"))


def _precursors(spark, d):
    rows = A.precursors(spark, d).withColumn("bucket", P.bucket("precursor_mz", "precursor_charge", 1))
    return rows.select(F.col("spec_index").alias("id"), "precursor_charge", "bucket", "precursor_mz", F.array(F.col("spec_index")).alias("hv"))


def masked_pairs(spark, d):
    p = pairs(_precursors(spark, d), "id", 200.0, "ppm", words=1)
    return p.select(long("precursor_charge"), long("bucket"), long("i"), long("j"), F.rint(F.col("dist") * 64).cast("long").alias("bits"))


def precursor_blocks_(spark, d):
    b = precursor_blocks(_precursors(spark, d), 200.0, "ppm")
    return b.select(long("id"), long("precursor_charge"), long("bucket"), long("block"))


def _components(spark, d):
    return cut(component_labels(A.signatures(spark, d), "id", NEAR / 64, None, keys=("bucket",)), "components")


def dbscan_components(spark, d):
    return _components(spark, d).filter("component is not null").select(long("id"), long("component"))


def hc_single_components(spark, d):
    return component_labels(A.signatures(spark, d), "id", NEAR / 64, None, keys=("bucket",), noise=False).select(long("id"), long("component"))


def cluster_sizes(spark, d):
    return dbscan_components(spark, d).groupBy("component").agg(F.count("*").alias("n")).select("component", long("n"))


def label_base(spark, d):
    """For each bucket, in order, how many labels those before it take: components, and noise rows one each."""
    rows = _components(spark, d).join(A.signatures(spark, d).select("id", "bucket"), "id")
    by = rows.groupBy("bucket").agg(F.count_distinct("component").alias("found"), F.count_if(F.col("component").isNull()).alias("noise"))
    by = by.withColumn("precursor_charge", F.lit(0)).withColumn("labels", F.col("found") + F.col("noise"))
    return totals_before(by, "labels", "base").select(long("bucket"), long("found"), long("noise"), "base")


def bucket_ranges(spark, d):
    return C.bucket_ranges(_bucketed(spark, d)).select(long("precursor_charge"), long("bucket"), long("size"), "first", "last")


def _rule(n: int, a: int, b: int, m: int, least: int) -> np.ndarray:
    """Signs of n vectors of 64 dimensions by the rule of ``encode_small``."""
    return np.where((np.arange(n)[:, None] * a + np.arange(64) * b) % m < least, 1, -1)


def encode_arrow(spark, d):
    """``encode_small`` by the packed encoder."""
    book = Codebook(pack(_rule(17, 37, 101, 97, 48)), pack(_rule(1501, 7919, 104729, 1009, 504)), 64)
    rows = encode(C.clean(A.spectra(spark, d), SETTINGS), replace(SETTINGS, hd_dim=64), book)
    return rows.select(long("spec_index", "id"), *_ones_and_places())


def _ones_and_places():
    """The ones of a vector of 64 dimensions, and the sum of their places."""
    bit = lambda k: F.shiftrightunsigned(F.get("hv", F.lit(0)), 63 - k).bitwiseAND(F.lit(1).cast("long"))
    places = sum((bit(k) * k for k in range(1, 64)), F.lit(0).cast("long"))
    return F.bit_count(F.get("hv", F.lit(0))).cast("long").alias("ones"), places.alias("places")


def encode_fragment(spark, d):
    """``encode_arrow`` with bins of 5 Da from the lowest m/z instead of whole units."""
    s = replace(SETTINGS, hd_dim=64, mz_binning="fragment_tol", fragment_tol=5.0)
    book = Codebook(pack(_rule(17, 37, 101, 97, 48)), pack(_rule(P.bin_count(101.0, 1500.0, 5.0), 7919, 104729, 1009, 504)), 64)
    rows = encode(C.clean(A.spectra(spark, d), s), s, book)
    return rows.select(long("spec_index", "id"), *_ones_and_places())


def _signature_clusters(algorithm: str, **how) -> Query:
    """Clusters of signatures by the code that clusters spectra: kernels, labels and representatives."""

    def query(spark, d):
        rows = A.signatures(spark, d).select(
            F.lit("v").alias("identifier"), long("id", "spec_index"), F.lit(2).cast("byte").alias("precursor_charge"), F.lit(500.0).cast("float").alias("precursor_mz"),
            F.col("id").cast("int").alias("scan"), F.lit(0.0).cast("float").alias("retention_time"), F.col("bucket").cast("int").alias("bucket"), "hv",
        )
        s = replace(SETTINGS, cluster_alg=algorithm, eps=NEAR / 64, refine=False, **how)
        return cluster(rows, s).select(long("spec_index", "id"), long("bucket"), "cluster", "is_representative")

    return query


def tiled_pairs(spark, d):
    """``sig_pairs`` by tiles of 32 vectors."""
    return _near_pairs(spark, d, tile=32)


def refined(spark, d):
    """Clusters of vectors that are all alike, so that refinement by mass and time alone parts them; each is named by its first row."""
    rows = A.read(spark, d, "part").select(
        F.lit("p").alias("identifier"), long("p_partkey", "spec_index"), F.lit(2).cast("byte").alias("precursor_charge"), F.col("p_retailprice").cast("float").alias("precursor_mz"),
        F.col("p_size").cast("int").alias("scan"), (F.col("p_size") * 60).cast("float").alias("retention_time"), (F.col("p_partkey") % 5).cast("int").alias("bucket"),
        F.array(F.lit(0).cast("long")).alias("hv"),
    )
    out = cluster(rows, replace(SETTINGS, cluster_alg="dbscan", precursor_tol=(2.0, "Da"), rt_tol=600.0))
    named = F.min("spec_index").over(Window.partitionBy("cluster"))
    return out.select(long("spec_index", "id"), long("bucket"), named.cast("long").alias("first"))


def representatives(spark, d):
    """Raw spectra of representatives: here, of every fifth part."""
    raw = A.spectra(spark, d)
    clustered = raw.select("identifier", "spec_index", "precursor_charge", "scan", "precursor_mz", "retention_time", (F.col("spec_index") % 7).alias("cluster"), (F.col("spec_index") % 5 == 0).alias("is_representative"))
    found = representative_spectra(raw, clustered)
    return found.select(long("spec_index", "id"), long("cluster"), "title", *_count_and_sum("peaks"))


def representatives_compat(spark, d):
    """Raw spectra of representatives by the five values of the result: without scans, all rows that have those of one."""
    raw = A.spectra(spark, d).withColumn("scan", F.lit(-1))
    five = ["identifier", "precursor_charge", "scan", "precursor_mz", "retention_time"]
    clustered = raw.filter(F.col("spec_index") % 5 == 0).select(*five, (F.col("spec_index") % 7).alias("cluster"), F.lit(True).alias("is_representative"))
    found = representative_spectra(raw, clustered, compat=True)
    return found.select(long("spec_index", "id"), long("cluster"), *_count_and_sum("peaks"))


def medoid(spark, d):
    members = dbscan_components(spark, d).withColumnRenamed("component", "cluster").join(A.signatures(spark, d).select("id", "hv"), "id")
    return medoids_by_ones(members).select(long("cluster"), long("id"))


def rep_join(spark, d):
    reps = medoid(spark, d)
    vectors = A.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return vectors.join(reps, "id").select(long("id"), long("label"), long("cluster"), F.round("x", 5).alias("x"))


def mgf_lines(spark, d):
    return mgf_blocks(A.spectra(spark, d).withColumn("title", F.concat(F.lit("part "), F.col("spec_index").cast("string"))))


def mgf_round_trip(spark, d):
    """Blocks written and parsed again: peaks of each spectrum and their sum."""
    blocks = mgf_blocks(A.spectra(spark, d)).select(F.regexp_replace("value", f"^{START}", "").alias("value")).withColumn("title", F.regexp_extract("value", "(?m)^TITLE=[^:]*:([0-9]+)", 1).cast("long"))
    return parse_blocks(blocks).select(long("title", "id"), long("precursor_charge"), *_count_and_sum("peaks", "mz", 2))


def _clustered(algorithm: str, rt_tol: float | None = None) -> Query:
    def query(spark, d):
        s = replace(SETTINGS, cluster_alg=algorithm, rt_tol=rt_tol)
        out = cluster(encode(C.clean(A.spectra(spark, d), s), s), s)
        return out.select(long("spec_index", "id"), long("bucket"), long("precursor_charge"), "cluster", "is_representative")

    return query


def queries() -> dict[str, Query]:
    own = (mz_range, valid_spectra, precursor_removed, topk_intensity, l2_norm, bucket_index, bucket_sizes, bucket_histogram, charge_filter, distinct_charges, mass_diff, clean_summary, bin_level, encode_small)
    own += (sig_pairs, hamming_hist, masked_pairs, dbscan_components, hc_single_components, cluster_sizes, label_base, medoid, rep_join, mgf_lines, mgf_round_trip)
    scaled = {f"scale_{s}": _scaled(s) for s in ("root", "log", "rank")}
    own += (bucket_ranges, encode_arrow, representatives, tiled_pairs, refined)
    own += (scale_to_top, precursor_removed_ppm, encode_fragment, representatives_compat)
    kinds = ("dbscan", "hc_single", "hc_complete", "hc_average")
    signed = {f"signatures_{a}": _signature_clusters(a) for a in kinds}
    # groups of more than 16 go in tiles of 24, as groups of more than 8,000 go in tiles of 2,048
    signed |= {f"tiled_{a}": _signature_clusters(a, max_group=16, tile=24) for a in kinds}
    whole = signed | {f"cluster_{a}": _clustered(a) for a in ("dbscan", "hc_single", "hc_complete", "hc_average")}
    return {f.__name__: f for f in own} | scaled | {"precursor_blocks": precursor_blocks_} | whole | {"cluster_with_times": _clustered("hc_complete", 600.0)}


_PEAKS = """raw AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size % 2 + 2 AS BIGINT) AS z, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS pmz, CAST(p_size * 60 AS DOUBLE) AS rt,
  CAST(50 AS DOUBLE) + CAST((l_orderkey * 7919 + l_linenumber * 104729) % 150000 AS DOUBLE) / 100 AS mz, CAST(l_extendedprice AS DOUBLE) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey),
spectra AS (SELECT DISTINCT id, z, pmz, rt FROM raw),
bucketed AS (SELECT *, CAST(floor(round_even((pmz - CAST(1.00794 AS DOUBLE)) * z / CAST(1.0005079 AS DOUBLE), 0)) AS BIGINT) AS bucket FROM spectra)"""
_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y DESC, mz) AS nth, max(y) OVER (PARTITION BY id) AS most FROM {src}),
top AS (SELECT * FROM ranked WHERE nth <= 20 AND y > CAST(0.3 AS DOUBLE) * most)"""
_NEAR_PRECURSOR = "EXISTS (SELECT 1 FROM (VALUES (1), (2), (3)) AS c(c) WHERE c.c <= r.z AND abs(r.mz - ((r.pmz - CAST(1.007825 AS DOUBLE)) * r.z / c.c + CAST(1.007825 AS DOUBLE))) <= {tol})"
_CLEAN = f"""one AS (SELECT * FROM raw WHERE mz BETWEEN 101 AND 1500),
ok1 AS (SELECT id FROM one GROUP BY id HAVING count(*) >= 5 AND max(mz) - min(mz) >= 250),
two AS (SELECT r.* FROM one AS r JOIN ok1 USING (id) WHERE NOT {_NEAR_PRECURSOR.format(tol="CAST(1.5 AS DOUBLE)")}),
ok2 AS (SELECT id FROM two GROUP BY id HAVING count(*) >= 5 AND max(mz) - min(mz) >= 250),
three AS (SELECT two.* FROM two JOIN ok2 USING (id)),
{_TOP.format(src="three")},
ok3 AS (SELECT id FROM top GROUP BY id HAVING count(*) >= 5 AND max(mz) - min(mz) >= 250),
clean AS (SELECT id, mz, y / sqrt(sum(y * y) OVER (PARTITION BY id)) AS v FROM top JOIN ok3 USING (id))"""
_SIGNS = """sig AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS bucket, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
near AS (SELECT a.bucket, a.id AS i, b.id AS j, CAST(list_sum(list_transform(list_zip(a.s, b.s), lambda t: CASE WHEN t[1] <> t[2] THEN 1 ELSE 0 END)) AS BIGINT) AS bits
  FROM sig AS a JOIN sig AS b ON a.bucket = b.bucket AND a.id < b.id)"""
_COMPONENTS = f"""links AS (SELECT i AS a, j AS b FROM near WHERE bits <= {NEAR} UNION ALL SELECT j, i FROM near WHERE bits <= {NEAR}),
reach(id, o) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.id, l.b FROM reach AS r JOIN links AS l ON r.o = l.a),
comp AS (SELECT id, min(o) AS component FROM reach GROUP BY id)"""


def _linkage(value: str) -> str:
    """Clusters by rounds of mutual nearest neighbours among pairs of clusters whose ``value`` is NEAR at most; the first of equals is nearest."""
    return f"""walk(id, c, step) AS (
  SELECT id, id, 0 FROM sig
  UNION ALL
  SELECT * FROM (WITH two AS (SELECT least(a.c, b.c) AS lo, greatest(a.c, b.c) AS hi, {value} AS v FROM near AS n JOIN walk AS a ON a.id = n.i JOIN walk AS b ON b.id = n.j
      WHERE a.c <> b.c GROUP BY 1, 2 HAVING {value} <= {NEAR}),
    best AS (SELECT c, min({{'v': v, 'o': o}}) AS x FROM (SELECT lo AS c, hi AS o, v FROM two UNION ALL SELECT hi, lo, v FROM two) AS t GROUP BY c),
    met AS (SELECT a.c AS lo, b.c AS hi FROM best AS a JOIN best AS b ON a.x.o = b.c AND b.x.o = a.c AND a.c < b.c)
    SELECT w.id, coalesce(m.lo, w.c), w.step + 1 FROM walk AS w LEFT JOIN met AS m ON m.hi = w.c WHERE EXISTS (SELECT 1 FROM met)) AS t),
comp AS (SELECT id, c AS component FROM walk WHERE step = (SELECT max(step) FROM walk))"""


#: Groups of neighbours by mass and by time in each block: the closest two neighbouring groups of a round merge, as far as their span allows.
_REFINED = """WITH RECURSIVE rows AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 5 AS BIGINT) AS bucket, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS mz, CAST(p_size * 60 AS DOUBLE) AS rt FROM part),
gaps AS (SELECT *, CASE WHEN mz - lag(mz) OVER w >= 2 THEN 1 ELSE 0 END AS cut FROM rows WINDOW w AS (PARTITION BY bucket ORDER BY mz, id)),
blocks AS (SELECT *, sum(cut) OVER (PARTITION BY bucket ORDER BY mz, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM gaps),
twofold AS (SELECT id, bucket, block, 'mz' AS kind, mz AS v, CAST(2 AS DOUBLE) AS tol FROM blocks UNION ALL SELECT id, bucket, block, 'rt', rt, CAST(600 AS DOUBLE) FROM blocks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket, block, kind ORDER BY v, id) AS nth FROM twofold),
walk(id, bucket, block, kind, v, tol, g, step) AS (
  SELECT id, bucket, block, kind, v, tol, nth, 0 FROM ranked
  UNION ALL
  SELECT * FROM (WITH spans AS (SELECT bucket, block, kind, g, min(v) AS lo, max(v) AS hi, min(tol) AS tol FROM walk GROUP BY bucket, block, kind, g),
    edges AS (SELECT *, lead(g) OVER w AS nextg, lead(hi) OVER w - lo AS gap FROM spans WINDOW w AS (PARTITION BY bucket, block, kind ORDER BY g)),
    sided AS (SELECT *, lag(gap) OVER w AS before, lead(gap) OVER w AS after FROM edges WINDOW w AS (PARTITION BY bucket, block, kind ORDER BY g)),
    met AS (SELECT * FROM sided WHERE gap <= tol AND (before IS NULL OR gap < before) AND (after IS NULL OR gap <= after))
    SELECT w.id, w.bucket, w.block, w.kind, w.v, w.tol, coalesce(m.g, w.g), w.step + 1 FROM walk AS w LEFT JOIN met AS m ON m.bucket = w.bucket AND m.block = w.block AND m.kind = w.kind AND m.nextg = w.g
    WHERE EXISTS (SELECT 1 FROM met)) AS t),
ended AS (SELECT * FROM walk WHERE step = (SELECT max(step) FROM walk)),
keyed AS (SELECT m.id, m.bucket, m.block, m.g AS gm, t.g AS gt FROM ended AS m JOIN ended AS t ON m.id = t.id AND m.kind = 'mz' AND t.kind = 'rt')
SELECT id, bucket, min(id) OVER (PARTITION BY bucket, block, gm, gt) AS first FROM keyed"""


_ENCODED = """{levels}, dims AS (SELECT unnest(range(64)) AS dim),
bits AS (SELECT id, dim, CASE WHEN sum((CASE WHEN (level * 37 + dim * 101) % 97 < 48 THEN 1 ELSE -1 END) * (CASE WHEN (bin * 7919 + dim * 104729) % 1009 < 504 THEN 1 ELSE -1 END)) > 0 THEN 1 ELSE 0 END AS bit FROM levels, dims GROUP BY id, dim)
SELECT id, CAST(sum(bit) AS BIGINT) AS ones, CAST(sum(bit * dim) AS BIGINT) AS places FROM bits GROUP BY id"""


def _scaled_sql(value: str) -> str:
    return f"WITH {_PEAKS}, {_TOP.format(src='raw')} SELECT id, count(*) AS n, round(sum({value}), 4) AS total FROM (SELECT *, count(*) OVER (PARTITION BY id) AS size, row_number() OVER (PARTITION BY id ORDER BY y DESC, mz) AS r FROM top) AS t GROUP BY id"


def _numbered(alone: bool) -> str:
    """Labels by bucket and first member, with or without noise (after the others of its bucket), and medoids: of up to two the first, of
    more the one with the least total distance to the others."""
    return f"""named AS (SELECT s.bucket, s.id, coalesce(c.component, s.id) AS component, c.component IS NULL AND NOT {alone} AS noise FROM sig AS s LEFT JOIN comp AS c ON s.id = c.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY noise, component) AS nth FROM (SELECT DISTINCT bucket, component, noise FROM named) AS k),
labelled AS (SELECT n.*, r.nth FROM named AS n JOIN ranked AS r ON n.bucket = r.bucket AND n.component = r.component AND n.noise = r.noise),
per AS (SELECT bucket, max(nth) AS k FROM ranked GROUP BY bucket),
bases AS (SELECT bucket, coalesce(sum(k) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM per),
sides AS (SELECT i AS id, j AS o, bits FROM near UNION ALL SELECT j, i, bits FROM near),
totals AS (SELECT a.id, sum(s.bits) AS total FROM labelled AS a JOIN sides AS s ON s.id = a.id JOIN labelled AS b ON b.id = s.o AND a.component = b.component GROUP BY a.id),
placed AS (SELECT l.*, row_number() OVER (PARTITION BY bucket, component ORDER BY CASE WHEN size > 2 THEN total ELSE 0 END, id) AS place
  FROM (SELECT l.*, t.total, count(*) OVER (PARTITION BY l.bucket, l.component) AS size FROM labelled AS l LEFT JOIN totals AS t ON l.id = t.id) AS l)
SELECT id, p.bucket, CAST(base + nth - 1 AS BIGINT) AS cluster, place = 1 AS is_representative FROM placed AS p JOIN bases AS b ON p.bucket = b.bucket"""


def oracle_sql() -> dict[str, str]:
    clean = f"WITH {_PEAKS}, {_CLEAN}"
    levels = f"{clean}, levels AS (SELECT id, CAST(floor(mz) AS BIGINT) AS bin, CAST(floor(v * 16) AS BIGINT) AS level FROM clean)"
    sig = f"WITH {_SIGNS}"
    comp = f"WITH RECURSIVE {_SIGNS}, {_COMPONENTS}"
    complete = f"WITH RECURSIVE {_SIGNS}, {_linkage('max(n.bits)')}"
    average = f"WITH RECURSIVE {_SIGNS}, {_linkage('CAST(sum(n.bits) AS DOUBLE) / count(*)')}"
    within = f"""{comp}, sides AS (SELECT i AS id, j AS o, bits FROM near UNION ALL SELECT j, i, bits FROM near),
totals AS (SELECT c.component AS cluster, s.id, sum(s.bits) AS total FROM sides AS s JOIN comp AS c ON s.id = c.id JOIN comp AS e ON s.o = e.id AND c.component = e.component GROUP BY c.component, s.id),
medoids AS (SELECT cluster, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total, id) AS nth FROM totals) AS t WHERE nth = 1)"""
    return {
        "mz_range": f"WITH {_PEAKS} SELECT id, sum(CASE WHEN mz BETWEEN 101 AND 1500 THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(CASE WHEN mz BETWEEN 101 AND 1500 THEN mz ELSE 0 END), 2) AS total FROM raw GROUP BY id",
        "valid_spectra": f"WITH {_PEAKS} SELECT id FROM raw WHERE mz BETWEEN 101 AND 1500 GROUP BY id HAVING count(*) >= 20 AND max(mz) - min(mz) >= 1300",
        "precursor_removed": f"WITH {_PEAKS}, kept AS (SELECT r.id, r.mz, NOT {_NEAR_PRECURSOR.format(tol='25')} AS stays FROM raw AS r) SELECT id, sum(CASE WHEN stays THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(CASE WHEN stays THEN mz ELSE 0 END), 2) AS total FROM kept GROUP BY id",
        "topk_intensity": f"WITH {_PEAKS}, {_TOP.format(src='raw')} SELECT id, count(*) AS n, round(sum(y), 2) AS total FROM top GROUP BY id",
        "scale_root": _scaled_sql("sqrt(y)"),
        "scale_log": _scaled_sql("ln(1 + y) / ln(2)"),
        "scale_rank": _scaled_sql("CAST(20 - (r - 1) AS DOUBLE)"),
        "scale_to_top": f"WITH {_PEAKS}, {_TOP.format(src='raw')} SELECT id, count(*) AS n, round(sum(sqrt(y)) * 1000 / max(sqrt(y)), 3) AS total FROM top GROUP BY id",
        "precursor_removed_ppm": f"""WITH {_PEAKS}, targets AS (SELECT id, ((pmz - CAST(1.007825 AS DOUBLE)) * z + i.i * CAST(1.003355 AS DOUBLE)) / c.c + CAST(1.007825 AS DOUBLE) AS t
  FROM spectra, (VALUES (1), (2), (3)) AS c(c), (VALUES (0), (1), (2)) AS i(i) WHERE c.c <= z),
kept AS (SELECT r.id, r.mz, NOT EXISTS (SELECT 1 FROM targets AS t WHERE t.id = r.id AND abs((r.mz - t.t) / t.t * 1000000) <= 20000) AS stays FROM raw AS r)
SELECT id, sum(CASE WHEN stays THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(CASE WHEN stays THEN mz ELSE 0 END), 2) AS total FROM kept GROUP BY id""",
        "representatives_compat": f"""WITH {_PEAKS}, sums AS (SELECT id, count(*) AS n, round(sum(mz), 2) AS total FROM raw GROUP BY id)
SELECT a.id, b.id % 7 AS cluster, s.n, s.total FROM spectra AS a JOIN spectra AS b ON b.id % 5 = 0 AND a.z = b.z AND a.pmz = b.pmz AND a.rt = b.rt JOIN sums AS s ON s.id = a.id""",
        "l2_norm": f"WITH {_PEAKS} SELECT id, round(max(y) / sqrt(sum(y * y)), 6) AS top, CAST(1 AS DOUBLE) AS norm FROM raw GROUP BY id",
        "bucket_index": f"WITH {_PEAKS} SELECT id, bucket FROM bucketed",
        "bucket_sizes": f"WITH {_PEAKS} SELECT z AS precursor_charge, bucket, count(*) AS size FROM bucketed GROUP BY z, bucket",
        "bucket_histogram": f"""WITH {_PEAKS}, sizes AS (SELECT count(*) AS size FROM bucketed GROUP BY z, bucket),
bins AS (SELECT CASE WHEN size < 2 THEN 0 WHEN size < 4 THEN 1 WHEN size < 8 THEN 2 WHEN size < 16 THEN 3 ELSE 4 END AS bin FROM sizes)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS buckets, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM bins), 4) AS share FROM bins GROUP BY bin""",
        "charge_filter": f"WITH {_PEAKS} SELECT z AS precursor_charge, count(*) AS n FROM spectra WHERE z = 3 GROUP BY z",
        "distinct_charges": f"WITH {_PEAKS} SELECT DISTINCT z AS precursor_charge FROM spectra",
        "mass_diff": f"WITH {_PEAKS} SELECT id, round(pmz - 950, 4) AS da, round((pmz - 950) / 950 * 1000000, 2) AS ppm FROM spectra",
        "clean_summary": f"""{clean}, each AS (SELECT id, count(*) AS n, max(v) AS top FROM clean GROUP BY id)
SELECT b.z AS precursor_charge, b.bucket, count(*) AS spectra, CAST(sum(e.n) AS BIGINT) AS n_peaks, round(avg(e.top), 4) AS top FROM each AS e JOIN bucketed AS b USING (id) GROUP BY b.z, b.bucket""",
        "bin_level": f"{levels} SELECT bin, level, count(*) AS n FROM levels GROUP BY bin, level",
        "encode_arrow": _ENCODED.format(levels=levels),
        "encode_fragment": _ENCODED.format(levels=levels.replace("floor(mz)", "floor((mz - 101) / 5)")),
        "encode_small": _ENCODED.format(levels=levels),
        "sig_pairs": f"{sig} SELECT bucket, i, j, bits FROM near WHERE bits <= {NEAR}",
        "hamming_hist": f"{sig} SELECT bits, count(*) AS n FROM near GROUP BY bits",
        "masked_pairs": f"""WITH {_PEAKS} SELECT a.z AS precursor_charge, a.bucket, a.id AS i, b.id AS j, CAST(bit_count(xor(a.id, b.id)) AS BIGINT) AS bits
FROM bucketed AS a JOIN bucketed AS b ON a.z = b.z AND a.bucket = b.bucket AND a.id < b.id AND abs(a.pmz - b.pmz) * 1000000 < b.pmz * 200""",
        "precursor_blocks": f"""WITH {_PEAKS}, gaps AS (SELECT *, CASE WHEN (pmz - lag(pmz) OVER w) * 1000000 >= pmz * 200 THEN 1 ELSE 0 END AS cut FROM bucketed WINDOW w AS (PARTITION BY z, bucket ORDER BY pmz, id))
SELECT id, z AS precursor_charge, bucket, CAST(sum(cut) OVER (PARTITION BY z, bucket ORDER BY pmz, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM gaps""",
        "dbscan_components": f"{comp} SELECT id, component FROM comp",
        "hc_single_components": f"{comp} SELECT s.id, coalesce(c.component, s.id) AS component FROM sig AS s LEFT JOIN comp AS c ON s.id = c.id",
        "cluster_sizes": f"{comp} SELECT component, count(*) AS n FROM comp GROUP BY component",
        "label_base": f"""{comp}, per AS (SELECT s.bucket, count(DISTINCT c.component) AS found, sum(CASE WHEN c.component IS NULL THEN 1 ELSE 0 END)::BIGINT AS noise FROM sig AS s LEFT JOIN comp AS c ON s.id = c.id GROUP BY s.bucket)
SELECT bucket, found, noise, CAST(coalesce(sum(found + noise) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM per""",
        "bucket_ranges": f"""WITH {_PEAKS}, sizes AS (SELECT z, bucket, count(*) AS size FROM bucketed GROUP BY z, bucket),
places AS (SELECT *, sum(size) OVER (PARTITION BY z ORDER BY bucket) AS upto FROM sizes)
SELECT z AS precursor_charge, bucket, size, CAST(upto - size AS BIGINT) AS first, CAST(upto - 1 AS BIGINT) AS last FROM places""",
        "signatures_dbscan": f"{comp}, {_numbered(False)}",
        "signatures_hc_single": f"{comp}, {_numbered(True)}",
        "signatures_hc_complete": f"{complete}, {_numbered(True)}",
        "signatures_hc_average": f"{average}, {_numbered(True)}",
        "tiled_dbscan": f"{comp}, {_numbered(True)}",
        "tiled_hc_single": f"{comp}, {_numbered(True)}",
        "tiled_hc_complete": f"{complete}, {_numbered(True)}",
        "tiled_hc_average": f"{average}, {_numbered(True)}",
        "tiled_pairs": f"{sig} SELECT bucket, i, j, bits FROM near WHERE bits <= {NEAR}",
        "refined": _REFINED,
        "representatives": f"""WITH {_PEAKS} SELECT id, id % 7 AS cluster, 'parts:' || id || ':' || id AS title, count(*) AS n, round(sum(mz), 2) AS total FROM raw WHERE id % 5 = 0 GROUP BY id""",
        "medoid": f"{within} SELECT cluster, id FROM medoids",
        "rep_join": f"{within} SELECT m.id, CAST(e.label AS BIGINT) AS label, m.cluster, round(CAST(e.embedding[1] AS DOUBLE), 5) AS x FROM medoids AS m JOIN embeddings AS e ON e.vec_id = m.id",
        "mgf_lines": f"""WITH {_PEAKS} SELECT 'BEGIN IONS' || chr(10) || 'TITLE=part ' || id || chr(10) || printf('PEPMASS=%f', pmz) || chr(10) || printf('RTINSECONDS=%f', rt) || chr(10) || 'CHARGE=' || z || '+' || chr(10)
|| string_agg(printf('%.5f %.1f', mz, y), chr(10) ORDER BY mz, y) || chr(10) || 'END IONS' AS value FROM raw GROUP BY id, z, pmz, rt""",
        "mgf_round_trip": f"WITH {_PEAKS} SELECT id, z AS precursor_charge, count(*) AS n, round(sum(CAST(CAST(mz AS FLOAT) AS DOUBLE)), 2) AS total FROM raw GROUP BY id, z",
    }
