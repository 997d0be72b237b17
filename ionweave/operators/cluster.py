"""Clustering of encoded spectra: group, cluster in each group, number the clusters of a charge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.config import Settings
from ionweave.operators import kernels, tiles
from ionweave.operators.components import components
from ionweave.operators.pairs import precursor_blocks
from ionweave.operators.prefix import totals_before
from ionweave.session import cut, discard, ship

BLOCK = ["precursor_charge", "bucket", "block"]
GROUP = [*BLOCK, "part"]
ORDER = ["identifier", "spec_index"]
_LOCAL = (
    "precursor_charge byte, bucket int, block int, part string, identifier string, spec_index long, precursor_mz float, scan int, "
    "retention_time float, local long, is_representative boolean"
)


def grouped(encoded: DataFrame, s: Settings) -> DataFrame:
    """``encoded`` with the block of each row. A threshold that even disagreeing precursors meet, and the live choice of
    representatives, which counts places in a bucket, need whole buckets."""
    if _whole(s):
        return encoded.withColumn("block", F.lit(0))
    return precursor_blocks(encoded, *s.precursor_tol)


def _whole(s: Settings) -> bool:
    return s.eps >= kernels.FAR or s.compat


def parted(encoded: DataFrame, s: Settings) -> tuple[DataFrame, bool]:
    """``encoded``, a stored table, with columns ``block``, ``part`` and ``known``, and whether groups are whole in their partitions already.

    A part is empty but for blocks of more than ``max_group`` rows. These are clustered in tiles, over as many tasks as they need; there a
    part is a cluster, which ``known`` says, and a task only refines it. Sizes come from narrow columns; vectors of other blocks are shuffled
    once, by bucket.
    """
    blocked = grouped(encoded, s)
    whole = blocked.withColumn("part", F.lit("")).withColumn("known", F.lit(False))
    if _whole(s):
        return whole, False
    sizes = grouped(encoded.select("precursor_charge", "bucket", "precursor_mz"), s).groupBy(*BLOCK).agg(F.count("*").alias("_n"))
    large = cut(sizes.filter(F.col("_n") > s.max_group).drop("_n"), "large")
    if large.isEmpty():
        return whole, True
    place = F.row_number().over(Window.partitionBy(*BLOCK).orderBy(*ORDER)).cast("long")
    rows = cut(blocked.join(large, BLOCK, "left_semi").withColumn("place", place), "rows")
    # parts are in the order of their clusters' first rows
    found = large_clusters(rows, s).withColumn("part", F.lpad(F.col("cluster").cast("string"), 19, "0")).withColumn("known", F.lit(True)).drop("cluster")
    return whole.join(large, BLOCK, "left_anti").unionByName(rows.join(found, [*BLOCK, "place"]).drop("place")), False


def large_clusters(rows: DataFrame, s: Settings, finish: int | None = None) -> DataFrame:
    """(block, place, cluster) of the rows of large blocks, whose ``place`` is their number in order; a cluster is named by its first."""
    method = s.cluster_alg.removeprefix("hc_")
    if method in ("complete", "average"):
        return tiles.linkage(rows, BLOCK, method, s.eps, *s.precursor_tol, tile=s.tile, finish=tiles.FINISH if finish is None else finish)
    # a name for each row that is in order within its block
    uid = F.concat_ws(":", *BLOCK, F.lpad(F.col("place").cast("string"), 19, "0"))
    named = rows.select(*BLOCK, "place", "precursor_mz", "hv", uid.alias("_uid"))
    if s.precursor_tol[0] <= 0:
        links = tiles.forest(named, "_uid", s.eps, *s.precursor_tol, keys=tuple(BLOCK), tile=s.tile)
    else:
        # rows alike in vector and precursor are linked: one of them meets the others, which are linked to it
        alike = cut(named.groupBy(*BLOCK, "precursor_mz", "hv").agg(F.min("_uid").alias("_uid")), "alike")
        apart = tiles.forest(alike, "_uid", s.eps, *s.precursor_tol, keys=tuple(BLOCK), tile=s.tile)
        to = alike.withColumnRenamed("_uid", "b")
        copies = named.join(to, [*BLOCK, "precursor_mz", "hv"]).filter("_uid <> b").select(F.col("_uid").alias("a"), "b")
        links = cut(apart.unionByName(copies), "links")
        discard(alike, apart)
    found = cut(linked := components(links), "found")
    discard(links, linked)
    first = F.coalesce(F.substring_index("component", ":", -1).cast("long"), F.col("place"))
    return named.join(found, F.col("_uid") == F.col("id"), "left").select(*BLOCK, "place", first.alias("cluster"))


def local_labels(blocked: DataFrame, s: Settings, placed: bool = False) -> DataFrame:
    """Labels in each group (-1: noise) and representatives. A group is in one task, as linkage needs it; ``placed`` tells that
    the rows' partitions have whole groups already, so that they need no shuffle.

    Groups are mostly small and many, so they stream through a task in order, one batch of rows at a time, rather than one
    data frame each: a task holds a batch and the group that the batch ends in.
    """
    ship(blocked.sparkSession)
    algorithm, eps, tol, unit, rt_tol, do_refine, compat = s.cluster_alg, s.eps, *s.precursor_tol, s.rt_tol, s.refine, s.compat
    columns = [*GROUP, *ORDER, "precursor_mz", "scan", "retention_time"]
    sided = "ppm" if compat else unit

    def labelled(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The rows of whole groups, which begin at ``starts``, with their labels."""
        ends = np.append(starts[1:], len(rows))
        local, flags = np.full(len(rows), -1, dtype=np.int64), np.ones(len(rows), dtype=bool)
        hv = rows.column("hv").combine_chunks()
        words = hv.flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        mz, rt = (rows.column(c).to_numpy().astype(np.float64) for c in ("precursor_mz", "retention_time"))
        known = rows.column("known").to_numpy()
        for k in np.flatnonzero(ends - starts > 1):
            own = slice(starts[k], ends[k])
            if known[starts[k]]:
                local[own], flags[own] = kernels.settled_group(words[own], mz[own], rt[own], tol, sided, rt_tol, do_refine)
            else:
                local[own], flags[own] = kernels.cluster_group(words[own], mz[own], rt[own], algorithm, eps, tol, unit, rt_tol, do_refine, compat)
        done = rows.select(columns).append_column("local", pa.array(local)).append_column("is_representative", pa.array(flags))
        return done.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the batches of the group that the last one ended in; they are joined when it has ended
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, held[-1] if held else None)
            if held and not starts.size:
                held.append(batch)
                continue
            if len(starts) > 1 or (held and starts.size):
                rows = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
                before = sum(b.num_rows for b in held)
                at = before + starts[:-1]
                yield labelled(rows, np.concatenate([[0], at[at > 0]]))
            held = [batch.slice(starts[-1])]
        if held:
            yield labelled(pa.Table.from_batches(held), np.zeros(1, dtype=np.int64))

    blocked = blocked if "known" in blocked.columns else blocked.withColumn("known", F.lit(False))
    rows = blocked.select(*columns, "hv", "known")
    rows = rows if placed else rows.repartition(*GROUP)
    return rows.sortWithinPartitions(*GROUP, *ORDER).mapInArrow(run, _LOCAL)


def _starts(rows: pa.RecordBatch, before: pa.RecordBatch | None = None) -> np.ndarray:
    """Where groups begin in ordered rows; the first row begins one unless it goes on with the last of ``before``."""
    fresh = np.zeros(len(rows), dtype=bool)
    fresh[0] = before is None
    for c in GROUP:
        column = rows.column(c)
        fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        if before is not None:
            fresh[0] |= column[0] != before.column(c)[before.num_rows - 1]
    return np.flatnonzero(fresh)


def unique_labels(local: DataFrame) -> DataFrame:
    """Adds ``cluster``: labels without gaps over all groups of a charge, noise rows as clusters of their own after the others
    of their group. Running totals are over groups, not rows, and over ranges of them; rows meet their group's in a join."""
    sizes = local.groupBy(*GROUP).agg((F.greatest(F.max("local"), F.lit(-1)) + 1).alias("found"), F.count_if(F.col("local") < 0).alias("noise"))
    sizes = cut(sizes.withColumn("labels", F.col("found") + F.col("noise")), "sizes")
    bases = totals_before(sizes, "labels", "base", ("block", "part")).select(*GROUP, "found", "base")
    nth = F.row_number().over(Window.partitionBy(*GROUP, F.col("local") < 0).orderBy(*ORDER)) - 1
    rows = local.withColumn("_nth", nth).join(bases, GROUP)
    own = F.when(F.col("local") >= 0, F.col("local")).otherwise(F.col("found") + F.col("_nth"))
    return rows.withColumn("cluster", (F.col("base") + own).cast("long")).drop("base", "found", "_nth", "local")


def cluster(encoded: DataFrame, s: Settings, stored: bool = False) -> DataFrame:
    """CLUSTERED rows, with ``spec_index`` beside them. All charges go in one job. ``stored`` tells that ``encoded`` is a table."""
    # stored, as it is read for the sizes of blocks and again for their rows; so are the labels, for groups and rows
    rows = encoded if stored else cut(encoded, "encoded")
    local = cut(local_labels(*_labelled(rows, s)), "local")
    if not stored:
        discard(rows)
    out = unique_labels(local)
    return out.select("bucket", "precursor_charge", "precursor_mz", "identifier", "scan", "retention_time", "cluster", "is_representative", "spec_index")


def _labelled(encoded: DataFrame, s: Settings) -> tuple[DataFrame, Settings, bool]:
    rows, placed = parted(encoded, s)
    return rows, s, placed


def component_labels(
    encoded: DataFrame, id_col: str, eps: float, tolerance: float | None, unit: str = "ppm", keys: tuple[str, ...] = ("precursor_charge", "bucket"), noise: bool = True
) -> DataFrame:
    """(id, component) by distributed components, for DBSCAN and single linkage where a group is too large for a task. Groups are compared
    in tiles, which send the edges of spanning forests.

    A component is named by its smallest id. Lone rows have a null component, or their own id without ``noise``.
    """
    found = tiles.forest_components(encoded, id_col, eps, tolerance, unit, keys).withColumnRenamed("id", "_id")
    rows = encoded.select(id_col).join(found, F.col(id_col) == F.col("_id"), "left").drop("_id")
    return rows if noise else rows.withColumn("component", F.coalesce("component", id_col))


def representatives(clustered: DataFrame) -> DataFrame:
    return clustered.filter("is_representative")


def medoid_by_pairs(members: DataFrame, distances: DataFrame, id_col: str = "id", cluster_col: str = "cluster") -> DataFrame:
    """(cluster, id) of the member with the least mean distance to the others, by (i, j, dist) rows; the smallest id of ties."""
    both = distances.select(F.col("i").alias(id_col), F.col("j").alias("_other"), "dist").unionByName(distances.select(F.col("j").alias(id_col), F.col("i").alias("_other"), "dist"))
    other = members.select(F.col(id_col).alias("_other"), F.col(cluster_col).alias("_c"))
    within = both.join(members.select(id_col, cluster_col), id_col).join(other, "_other").filter(F.col(cluster_col) == F.col("_c"))
    means = within.groupBy(cluster_col, id_col).agg(F.sum("dist").alias("total"))
    return means.groupBy(cluster_col).agg(F.min(F.struct("total", id_col)).alias("x")).select(cluster_col, F.col(f"x.{id_col}").alias(id_col))



def medoids_by_ones(members: DataFrame, id_col: str = "id", cluster_col: str = "cluster", hv: str = "hv") -> DataFrame:
    """``medoid_by_pairs`` of clusters whose precursors all agree, from their vectors and without pairs: a row's total distance follows from the
    cluster's ones in each dimension. Counts combine before they shuffle, so the work grows with the rows."""
    words = members.select(cluster_col, id_col, F.posexplode(hv).alias("_w", "_word"))
    bit = [F.shiftrightunsigned("_word", k).bitwiseAND(F.lit(1).cast("long")) for k in range(64)]
    ones = words.groupBy(cluster_col, "_w").agg(F.count("*").alias("_n"), F.array(*(F.sum(b) for b in bit)).alias("_ones"))
    met = words.join(ones.withColumnRenamed(cluster_col, "_c").withColumnRenamed("_w", "_v"), (F.col(cluster_col) == F.col("_c")) & (F.col("_w") == F.col("_v")))
    # a one differs from the zeros of its dimension, a zero from the ones
    apart = sum((F.when(b == 1, F.col("_n") - F.get("_ones", F.lit(k))).otherwise(F.get("_ones", F.lit(k))) for k, b in enumerate(bit)), F.lit(0).cast("long"))
    totals = met.groupBy(cluster_col, id_col).agg(F.sum(apart).alias("total"))
    return totals.groupBy(cluster_col).agg(F.min(F.struct("total", id_col)).alias("x")).select(cluster_col, F.col(f"x.{id_col}").alias(id_col))
