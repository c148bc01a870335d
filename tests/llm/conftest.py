import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with columns whose names the operators use themselves."""

    def make(rows, lang="en", source="s", partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else source, 1.5, True) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score double, kept boolean").repartition(partitions)

    return make
