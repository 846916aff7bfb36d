"""Odd rows that every operator must take."""

from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = "Lorem ipsum dolor sit amet consetetur sadipscing elitr " * 40_000  # 2.2 MB
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest at night"


def odd_rows():
    return [(1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", None), (2, PROSE, "en", "a", None), (3, None, None, None, None), (4, "", "de", "b", 0),
            (5, " \t\n ", "de", "b", 4), (None, "no id at all here", "en", None, 17), (6, LONG, "la", "c", len(LONG)), (7, "word", "en", "a", 4),
            (8, "Öl & ÄRGER <|endoftext|> 日本語 😀 ok", "de", "b", 30), (9, PROSE.upper() + "!", "en", "a", 99)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3, "lang")


def clashing(df):
    """More columns, named like the operators' own."""
    from pyspark.sql import functions as F
    for name in ("fp", "fp_0", "score", "part", "node", "hit_words", "key", "h", "level", "target", "label", "spare", "size", "content", "message", "value", "q", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def empty(spark):
    return spark.createDataFrame([], DOCS)


__all__ = ["DOCS", "LONG", "PROSE", "Row", "clashing", "empty", "odd_docs", "odd_rows", "rows"]
