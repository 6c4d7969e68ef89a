import pytest

PROSE = "the cat sat on the mat and then it ran off to the far hill where other cats had been all day"
#: Nulls, empty, blank, long, tied and repeated rows, and columns whose names clash with working names.
AWKWARD = [
    (1, "Hello, world! It's 2 o'clock.\nHello, world!", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b\f\r ", "en", "a"),
    (5, "Hello,world! It's 2 o'clock. Hello, world!", "en", "b"),
    (5, "Hello,world! It's 2 o'clock. Hello, world!", "en", "b"),
    (7, "naïve  Straße\r\n\r\nÉté 🙂 　 x" + "\x1c" + "y <|endoftext|> z", "fr", None),
    (8, " ".join(f"w{i % 977}" for i in range(9000)), "de", "a"),
    (9, "a" * 30_000 + " " + "!?" * 500, "de", "a"),
    (None, PROSE, "en", "a"),
    (11, PROSE.replace(" ", "  "), "en", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, "x", 1, "y") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, n long, `a.b` string").coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
