import random

import pytest
from llm_prose import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs."""

    def build(rows, **extra):
        schema = SCHEMA + "".join(f", `{k}` string" for k in extra)
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *extra.values()) for i, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) pairs with copies, near copies, a shared passage, blanks, nulls and a very long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(60, 250))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(3)]
    for i in range(3, 8):
        words = rows[i][1].split()
        words[10] = "changed"
        rows.append((100 + i, " ".join(words)))
    passage = prose(rng, 60)
    rows += [(200 + i, prose(rng, 50) + " " + passage + " " + prose(rng, 40 + i)) for i in range(4)]
    rows += [(300, ""), (301, " \n\t "), (302, None), (303, "One."), (304, prose(rng, 30_000)), (None, rows[0][1]), (None, None), (305, "é" * 500), (306, "x" * 20_000)]
    return rows
