"""Schemas of the stages."""

from __future__ import annotations

from pyspark.sql import types as T

PEAK = T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])

META = [
    T.StructField("identifier", T.StringType()),
    T.StructField("spec_index", T.LongType()),
    T.StructField("precursor_charge", T.ByteType()),
    T.StructField("precursor_mz", T.FloatType()),
    T.StructField("scan", T.IntegerType()),
    T.StructField("retention_time", T.FloatType()),
]

#: What the reader gives: one row for each spectrum, peaks by ascending m/z. -1 stands for a missing scan or time.
RAW = T.StructType([*META, T.StructField("peaks", T.ArrayType(PEAK))])
#: RAW after cleaning, with its mass bucket.
CLEAN = T.StructType([*RAW.fields, T.StructField("bucket", T.IntegerType())])
#: CLEAN with a binary hypervector, 64 dimensions a long, instead of peaks.
ENCODED = T.StructType([*META, T.StructField("bucket", T.IntegerType()), T.StructField("hv", T.ArrayType(T.LongType()))])
#: The result.
CLUSTERED = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("precursor_charge", T.ByteType()),
        T.StructField("precursor_mz", T.FloatType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("scan", T.IntegerType()),
        T.StructField("retention_time", T.FloatType()),
        T.StructField("cluster", T.LongType()),
        T.StructField("is_representative", T.BooleanType()),
    ]
)
