import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("id", "rk", "place", "words", "hashes", "row", "fp", "key", "hash", "target", "bucket", "item", "n", "owner", "uses", "lines")


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def build(rows, source="s"):
        extra = "".join(f", {c} string" for c in CLASHING)
        return spark.createDataFrame([(i, t, "en", source, len(t) if t else 0, *("x" for _ in CLASHING)) for i, t in rows], DOCS + extra)

    return build
