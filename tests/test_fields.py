import random

import pytest

from sylvaq.operators.fields import split_field, split_values


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []),
        ("", []),
        ("  \t\n ", []),
        (";", []),
        ("Sa", ["Sa"]),
        (" Sa ;Mr,,Tä/ S+H |Ka\tsa\nta", ["Sa", "Mr", "Tä", "S+H", "Ka", "sa", "ta"]),
        ('"S+H, löyhä" / Sa', ["S+H, löyhä", "Sa"]),
        ("'Sa; pehmeä'|Mr", ["Sa; pehmeä", "Mr"]),
        ('"Tä ""vanha"" täyttö",Ka', ['Tä "vanha" täyttö', "Ka"]),
        ('"Ka, ""lohkare"""', ['Ka, "lohkare"']),
        ('"";" "', ["", " "]),
        ('"open, Sa', ['"open', "Sa"]),
        ("it's, Sa", ["it's", "Sa"]),
        ("Sa (0,5 m), Mr", ["Sa (0,5 m)", "Mr"]),
        ("Sa (0,5 m, Mr", ["Sa (0", "5 m", "Mr"]),
        ("a [b, (c, d)], e", ["a [b, (c, d)]", "e"]),
        (r"a\, b, c", ["a, b", "c"]),
        ('"a"b c , d', ["ab c", "d"]),
        ("Sa,Sa, Sa", ["Sa", "Sa", "Sa"]),
    ],
)
def test_tokenizer(text, values):
    assert split_field(text) == values


def test_round_trip_of_quoted_values():
    rng = random.Random(3)
    for _ in range(500):
        values = ["".join(rng.choices("ab ,;|/\t\"'()\\", k=rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        text = rng.choice([",", ";", " | "]).join('"' + v.replace('"', '""') + '"' for v in values)
        assert split_field(text) == values


def test_very_long_field():
    assert len(split_field(",".join(["Sa"] * 200_000))) == 200_000
    assert split_field("(" * 50_000 + ",a") == ["(" * 50_000, "a"]


def test_rows(spark, rows):
    df = spark.createDataFrame(
        [(1, "Sa,Mr", "x", 0), (2, None, "x", 0), (3, "", "x", 0), (4, "Ka", "x", 0), (1, "Sa,Mr", "x", 0), (None, "a;b", "x", 0)], "row_id bigint, soil string, v string, k0 int"
    )
    got = rows(split_values(df, "soil", ["row_id"], value="soil_value", min_values=2))
    assert got == sorted([(1, 1, "Sa"), (1, 2, "Mr"), (1, 1, "Sa"), (1, 2, "Mr"), (None, 1, "a"), (None, 2, "b")], key=repr)
    assert rows(split_values(df.where("row_id = 4"), "soil", ["row_id", "v"])) == [(4, "x", 1, "Ka")]
    assert split_values(df.limit(0), "soil", ["row_id"]).count() == 0
