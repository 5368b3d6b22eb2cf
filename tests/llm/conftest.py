import random

import pytest
from llm_helpers import prose

#: Columns that the operators use inside, as extra columns of the input.
EXTRA = "th string, rid int, word string, score string, h string, fp string, held_out string, n_tokens string, n_lines string, n_dropped string, spans string, x string, `_id` string, `_drop` string, lang_pred string"


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty and blank texts, a null id, repeated rows, repeated ids, a very long word and odd characters."""
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "some text without an id"), (None, None), (4, "Twice the same row, word for word."), (4, "Twice the same row, word for word."), (4, "Another text of the same id"), (5, "x" * 20_000), (6, prose(rng, 5000)), (7, "naïve ÉCOLE ſtraße 日本語 😀 \x00\x1c end"), (8, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = [c.split()[0].strip("`") for c in EXTRA.split(", ")]
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names} | {"lang": F.when(F.col("doc_id") > 4, "en"), "source": F.lit("s")}), rows


@pytest.fixture(scope="session")
def no_docs(edge):
    return edge[0].limit(0)
