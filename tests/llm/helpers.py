"""Small tables for the tests of the training-data operators."""

import random

EXTRA = "note string, _id string, h long, n long, block string"


def prose(seed: int, words: int, vocabulary: int = 5000) -> str:
    """Reproducible text with a full stop every nine words or so."""
    r = random.Random(seed)
    out = []
    for i in range(words):
        word = "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) if r.random() < 0.5 else f"w{r.randrange(vocabulary)}x"
        out.append(word + ("." if r.random() < 0.11 else ""))
    return " ".join(out)


def documents(spark, rows):
    """(doc_id, text) with columns whose names clash with those the operators use inside."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", "y", 1, 2, "z") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


ODD = [(None, None), (None, "a text without an id"), (7, ""), (8, "   \n\t "), (9, None), (10, "one"), (10, "one"), (11, "x" * 50_000), (12, "wörd ünïcode 漢字 " * 3000), (13, "\x85\u2003odd\u00a0spaces")]
