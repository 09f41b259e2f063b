from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, `key` string, n_lines long, piece_ids string, id long, `__text` string, posterior string, accepted string, `a.b` string, segment string"

OTHERS = (4, "t", "q", "r", "dot", "s")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns that clash with the operators' own."""
    long_text = " ".join(f"word{k % 977} other{k}" for k in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from the angry farmer who owns the field near the old mill"
    rows = [
        (1, base, "en", "a.com"),
        (2, base, "en", "a.com"),
        (2, base, "en", "a.com"),
        (3, base + " today", "en", None),
        (4, None, None, None),
        (5, "", "en", "a.com"),
        (6, "   \n\t ", "en", "a.com"),
        (7, "one", "en", "b.de"),
        (None, base, "en", "a.com"),
        (None, None, None, None),
        (8, long_text, "en", "b.de"),
        (9, "Zeile eins ist lang genug\nkurz\nZeile zwei ist lang genug", "de", "b.de"),
        (10, "  zeile EINS ist lang genug \r\nkurz\n\nZeile drei ist auch lang", "de", "b.de"),
        (11, "éàü 日本語 🙂 ñ", "fr", "c.fr"),
    ]
    return spark.createDataFrame([(i, t, a, s, None if t is None else len(t), "x", None, 7, "p", *OTHERS) for i, t, a, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
