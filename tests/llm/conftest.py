import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    heads = ["the", "of", "and", "river", "stone", "garden", "window", "paper", "morning", "letter", "winter", "copper", "market", "island", "signal", "forest"]
    return " ".join(rnd.choice(heads) + rnd.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(5)
    out = []
    for k in range(120):
        text = prose(rnd, rnd.randint(60, 120)) + ".\n" + prose(rnd, 40) + "."
        out.append((k, text, rnd.choice(["en", "de"]), rnd.choice(["a", "b", "c"]), len(text)))
    base = out[0][1]
    out += [(200 + k, base, "en", "a", len(base)) for k in range(30)]  # exact copies
    out += [(300 + k, base.replace("river", f"river{k}", 1), "en", "a", 0) for k in range(10)]  # near copies
    out += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, None, "en", None, 0), (None, "a null id", "en", "a", 9), (403, " \n\t ", "en", "b", 4)]
    out += [(404, prose(rnd, 40_000), "en", "b", 0), (405, "x" * 150_000, "en", "b", 150_000), (406, "é ñ 日本 😀 ß\n\x0b end", "fr", "ü", 20)]
    out += [out[5], out[5], out[5]]  # repeated rows
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names occur inside the operators."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("size", "score", "target", "copies", "row_index", "fp", "rep", "g", "h", "y", "component_id", "token_ids", "source_size", "_part", "n_words", "node"):
        df = df.withColumn(name, df["n_chars"])
    return df.persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
