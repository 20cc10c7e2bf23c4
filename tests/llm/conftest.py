import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, node string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def passage(seed, length):
    """Words in an order that the seed decides."""
    return " ".join(WORDS[(seed * 7 + k * k * (seed % 5 + 1) + 3 * k) % len(WORDS)] + str((seed + k * 13) % 17) for k in range(length))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    base = passage(1, 120)
    texts = {
        1: base, 2: base, 3: base + " one more", 4: passage(2, 80), 5: passage(2, 80), 6: "", 7: None, 8: "  \t\n ", 9: "One Two", 10: "one two", 11: passage(3, 40) + " Ünï ß 漢字 😀 ​", 12: passage(4, 30_000), 13: "a" * 120_000,
        14: "Mail joe.x@mail.example.com or +1 (269) 555-3296 4524132264652876 at 10.0.0.1.", 15: "x@y x@@y.z 1.2.3.4.5 999.1.1.1 +12", 16: passage(5, 60), 17: passage(5, 60) + " tail",
    }
    rows = [(i, t, "en" if i % 3 else None, ("s1", "s2", None)[i % 3], len(t or ""), i, "k", "n") for i, t in texts.items()]
    rows += [rows[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    return folder


#: Names that operators use for columns of their own, other spellings of them, and names that need quotes.
HELPERS = (
    "__digest", "__row", "__keep", "__frequent", "__key", "__size", "__copies", "__copy", "__run", "__RUN", "__score", "__host", "__path", "__evidence", "__prior", "__host_prior", "__id", "__node",
    "__text_node", "__salt", "__hot", "__place", "__part", "__target", "__source_size", "row", "Row", "digest", "tie", "place", "keep_id", "id", "text_node", "node", "w", "found", "score", "n", "a.b", "`tick`", "a`b",
)


@pytest.fixture(scope="session")
def clashing_docs(spark):
    """Documents with a column of every helper's name, each holding doc_id and the name."""
    from pyspark.sql import functions as F

    rows = [(k, passage(k % 5, 60 + k % 3), ("en", None)[k % 2], ("s1", "s2", None)[k % 3]) for k in range(1, 25)] + [(30, None, "en", "s1"), (31, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = {}
    for name in HELPERS:
        if name.lower() not in names:
            names[name.lower()] = name
    return docs.select("*", *[F.concat(F.col("doc_id").cast("string"), F.lit(":" + name)).alias(name) for name in names.values()], F.struct("doc_id", "lang").alias("__struct")).cache()
