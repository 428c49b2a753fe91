import random

import pytest

WORDS = "the of and to in is was for on that ing tion ed er ha st en re nd th ou ea le an or".split()


def prose(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(draw.choice(WORDS) for _ in range(draw.choice((1, 1, 1, 2, 2, 3))))
        out.append(w + (".\n" if i % 17 == 16 else "," if i % 9 == 8 else ""))
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, cell string, component_id string, words string, size string, key string"


def document(i, text, lang="en", source="a"):
    # columns whose names the operators use inside, with other types
    return (i, text, lang, source, len(text or ""), 1, "x", "y", "z", "w", "k")


@pytest.fixture(scope="session")
def docs(spark):
    """Plain, near, equal, empty, null and very long texts; repeated rows; null ids, languages and sources."""
    base = prose(1, 300)
    near = base.replace("tion", "tion", 1).split(" ")
    near[150] = "changed"
    rows = [document(i, prose(100 + i, 20 + 13 * i), "en" if i % 3 else "fr", "ab"[i % 2]) for i in range(40)]
    rows += [document(50, base), document(51, base), document(52, " ".join(near)), document(53, "", "de", "c"), document(54, None, None, None), document(55, " \t\n", "de", "c")]
    rows += [document(56, prose(7, 20_000), "en", "hot"), document(57, "one"), document(57, "one"), document(None, prose(9, 80)), document(58, "Ünïcode 😀 wörds " * 30, None, None)]
    rows += [document(59, "is is is " * 200), document(60, "A!! B!! C### | D*** " * 60), document(61, "All rights reserved.\n" * 3 + base)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
