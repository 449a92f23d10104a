import random

from sylvaq.llm.tokens import TokenCounter, token_counts


def test_equals_encoding():
    c = TokenCounter()
    rng = random.Random(1)
    parts = ["a", "B", "é", "ä", "1", "²", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'", "-", " ", " ", "​", "漢", "😀", " the", "٣", "\x85", "."]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert c.count(t) == len(c.encode(t)), repr(t)
    long = "The old mill was rebuilt in 1849.\n" * 20_000
    assert c.count(long) == len(c.encode(long))


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "Title\nThe text.", "x"), (2, None, "x"), (3, "", "x"), (None, "one", "x"), (1, "Title\nThe text.", "x")], "k bigint, text string, tokens string")
    got = rows(token_counts(df, "k", "text"))
    assert got == sorted([(1, 5, 1), (1, 5, 1), (2, 0, 0), (3, 0, 0), (None, 1, 1)], key=repr)
    assert token_counts(df.limit(0), "k", "text").count() == 0
