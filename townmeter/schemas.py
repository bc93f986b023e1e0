"""Schemas of the inputs, declared rather than inferred."""

from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])

RAW_PLACE = T.StructType([
    T.StructField("nom", T.StringType()), T.StructField("code", T.StringType()), T.StructField("codeDepartement", T.StringType()),
    T.StructField("codeEpci", T.StringType()), T.StructField("population", T.LongType()), T.StructField("centre", _POINT), T.StructField("mairie", _POINT),
])

_NUMBERS = T.ArrayType(T.DoubleType())
SERIES = T.StructType([
    T.StructField("meta", T.StructType([
        T.StructField("insee", T.StringType()), T.StructField("name", T.StringType()), T.StructField("dept", T.StringType()),
        T.StructField("requested", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("elevationM", T.DoubleType())])),
        T.StructField("grid", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("elevation", T.DoubleType())])),
    ])),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())), T.StructField("temperature_2m_max", _NUMBERS),
        T.StructField("temperature_2m_min", _NUMBERS), T.StructField("precipitation_sum", _NUMBERS),
    ])),
])
