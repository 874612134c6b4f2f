import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, short, long, repeated and copied texts, and columns with clashing names."""
    long = " ".join(f"word{i % 900}x{i // 7}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "hello"), (5, long), (6, long), (7, "The MIT License applies here, ok"), (7, "The MIT License applies here, ok"), (8, "é" * 3000), (None, "no id at all, some words here"), (9, " ".join(["same"] * 500)), (10, long.replace("word5x", "w5x"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "class", "rep", "n", "word", "row", "band", "start", "place"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
