import random

import pytest

pytest.importorskip("tessera.llm")

#: Names that the operators use inside; a table may have columns of these names too.
CLASHING = ("score", "label", "component_id", "n_words", "q_n_words", "row", "stratum", "kept", "key_id", "found", "part", "fragment", "payload", "m_tokens", "rate", "held_out", "text_hash", "repository")


def prose(dice, n, words=400):
    return " ".join(f"{dice.choice('abcdefghij')}{dice.choice('aeiou')}{dice.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and clashing columns."""
    dice = random.Random(5)
    base = prose(dice, 120)
    texts = [None, "", " \n\t", "one", "one two three", base, base, base.replace(" ", "  "), base + " tail end here", prose(dice, 60_000), "é ñ ß " * 30, "word " * 200, base.upper()]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "src0", 1), (None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], kinds)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, None, 1), (None, 1, 0), (11, 0, None), (999, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def no_labels(odd_labels):
    return odd_labels.where("false")
