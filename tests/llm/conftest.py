import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls everywhere, empty and very long texts, copies, repeated rows, and extra
    columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    para = "the quick brown fox jumps over the lazy dog near the old stone bridge at noon"
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, para), (7, para), (7, para),
            (8, para + " again"), (None, para), (None, None), (9, "12 34 !!"), (10, "é" * 70 + "日本" * 40),
            (11, "one"), (12, "a<|endoftext|>b"), (13, para + "\n" + para), (14, "x" * 49), (15, "x" * 51)]
    rows = [(d, t, "en" if t else None, "s", len(t or ""), 5, "part", 1.5, 0) for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "length int, part string, lot double, slot int")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
