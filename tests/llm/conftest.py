import pytest

BASE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old stone tower near the river. "
LONG = "".join(f"Sentence number {k} tells of a {w} that nobody saw before. " for k, w in enumerate(("boat", "lamp", "coin", "tree", "gate", "drum", "book", "rope", "star", "fern")))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, ties, other columns whose names the operators use themselves."""
    rows = [
        (1, BASE, "en", "src0", 5),
        (2, BASE, "en", "src0", 5),
        (2, BASE, "en", "src0", 5),
        (3, None, None, None, None),
        (4, "", "de", "src1", 0),
        (5, " \n\t ", "en", "src0", 4),
        (None, BASE, "en", "src0", 5),
        (None, None, "fr", "src2", None),
        (6, LONG, "en", "src0", 9),
        (7, "Before it all. " + LONG, "en", "src1", 9),
        (8, LONG + "And after that the end.", "en", "src1", 9),
        (9, "aaaa" * 400, "en", "src1", 9),
        (10, "\n".join([BASE.strip()] * 3 + ["short"]), "en", "src0", 9),
        (11, "Übung macht den Meister, sagt man; 漢字 und ñandú stehen hier.", "de", "src2", 9),
        (12, LONG * 40, "en", "src3", 9),
        (13, "ab\x00cd \x0b\x0c x" * 50, "xx-YY", "src3", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("keep_id", "rest", "gid", "n", "rep", "component", "language", "mix", "raw", "ats", "length", "part", "bits", "toxic", "k1", "_doc", "_n"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
