import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) with further columns of clashing names."""

    def make(rows, extra=False):
        filled = [(*row, *(None,) * (4 - len(row)))[:4] for row in rows]
        df = spark.createDataFrame(
            [(*row, len(row[1]) if row[1] else 0) for row in filled], DOCUMENTS
        )
        if extra:
            for name in ("score", "n", "key", "size", "token", "held_out", "component"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make

