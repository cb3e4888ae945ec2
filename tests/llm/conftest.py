import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents of texts, or of (doc_id, text); ids count from 1."""

    def make(items, extra=None):
        rows = [(i + 1, t) if t is None or isinstance(t, str) else t for i, t in enumerate(items)]
        rows = [(k, t, "en", "src0", None if t is None else len(t)) for k, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:  # columns with names that the operators use themselves
            from pyspark.sql import functions as F

            for name in extra:
                df = df.withColumn(name, F.lit(7))
        return df

    return make


#: Texts that every operator must bear: null, empty, blank, no letter, long, repeated.
ODD = [None, "", " \n\t ", "!!! 123 ...", "word " * 6000, "x" * 30000, "naïve Größe ñandú 🙂 漢字", "same text here", "same text here"]
CLASH = ["word", "digest", "fp", "score", "start", "tokens", "id", "y", "h", "n", "idx", "rep", "key", "mask", "cuts", "hot", "at", "cold", "nth", "nth_", "part", "bits", "__doc", "__cut", "__keep", "__nth", "__id", "__text"]
