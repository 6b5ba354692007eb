import pytest

LONG = ("Lorem ipsum dolor sit amet " * 4000) + "\n" + "x" * 30000 + "   \t\n  " * 50
TEXTS = [
    None, "", " \n\t ", "one", "One", "ONE", "a b c d", "a B c D", LONG, LONG.upper(), "É è ß ñ Ñ Œuvre", "é è ß Ñ ñ Œuvre", "日本語 テスト　ok", "12 34 !!",
    "trash idiot trash", "<|endoftext|> a <|endoftext|>", "don't I'LL we're", "  two  spaces \n\n and lines\r\n", "a\x1cb \x85 c d", "Σίσυφος ΣΊΣΥΦΟΣ İI",
]
#: Names that the operators use for columns of their own.
CLASHES = "norm chunks recipe whole id h n texts keep_id kept block words place ids i size mark lane position taken slot rank rep digest node component class_id copies sketch _id y score predicted held_out lang_pred base_score c first w part offset start __mark __id _mark _copy _place times last stretches _source held".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows and clashing columns."""
    rows = [(i, t, None if i % 5 == 0 else ("en", "de", "fr")[i % 3], None if i % 4 == 0 else f"src{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[6], (None, "one", "en", "src1"), (None, None, None, None)]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, 1, *["z"] * len(CLASHES)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
