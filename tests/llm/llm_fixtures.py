import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = ("The quiet river runs past the old mill and under the stone bridge where children fish in summer while "
         "their parents talk about the harvest and the price of wool at the market in the next town over the hill.")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, equal rows, equal ids, and clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE.replace("wool", "corn"), None, "b", None),
        (3, PROSE.replace("wool", "corn"), None, "b", None), (4, None, None, None, None), (None, PROSE, "en", None, 2),
        (None, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n\x0b\x0c\r", "en", "b", 6), (7, long, "en", "c", 1),
        (8, long, "en", "c", 1), (9, "one two", "en", "c", 1), (10, "one two", "en", "c", 1), (11, "Élan   Ñandú\x1fΣΑΣ", "xx", "d", 1),
        (-5, "same words " * 40, "en", "d", 1), (12, "!!! ??? ###", "en", "e", 1), (13, "a\n" * 50, "en", "e", 1),
    ]
    df = spark.createDataFrame(rows, DDL)
    for name in ("size", "rate", "copies", "k", "key", "node", "keys", "text_hash", "_text", "_words", "_gone", "_k", "value",
                 "n", "count", "kind", "part", "start", "component", "_mix_size", "target"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
