import pytest

CLASHES = "size fp node bucket rank n line words host length start k range at stays score entities n_lines removed d_id d_hash text_hash shard slot key kept own held_out offset".split()
LONG = " ".join(f"w{k % 977}" for k in range(40_000))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    clean = "The quick brown fox jumps over the lazy dog while the small grey cat sleeps near the old stone wall all day long."
    rows = [
        (1, clean, "en", "a"), (1, clean, "en", "a"), (1, "Another text under the same id, long enough to count as words go here.", "en", "a"), (2, None, "en", "a"), (None, clean, None, None),
        (3, "", "en", None), (4, " \n\t ", None, "b"), (5, clean + "\n" + clean, "en", "b"), (6, LONG, "en", "b"), (7, "x" * 100_000, "en", "b"), (8, "\n".join(["line " + str(k) for k in range(3000)]), "en", "c"),
        (None, None, None, None), (9, "née ÀÉ ß İ Σας ﬁ \x1c 　 ½ ²", "fr", "c"), (10, "one", "en", "c"), (11, "one two", "en", "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        frame = frame.withColumn(name, frame.doc_id.cast("string"))
    return frame


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
