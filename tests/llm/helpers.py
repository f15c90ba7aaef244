"""Small tables with every awkward case, and plain versions of shared rules."""

from __future__ import annotations

import re
import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: columns whose names the operators use inside, to see that they pass through
CLASH = "size bigint, kept boolean, score double, fp bigint, _k1 bigint, row string, place int, fit string, rate double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward_docs(spark, clash: bool = False):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties."""
    long = " ".join(f"word{i % 977} and more" for i in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
        (2, "THE quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
        (None, "the quick brown fox jumps over the lazy dog again and again today", None, None, None),
        (3, None, "en", "a", None),
        (4, "", "en", None, 0),
        (5, " \t\n\x0b\f\r ", None, "b", 7),
        (6, long, "de", "b", len(long)),
        (7, "one", "fr", "c", 3),
        (8, "Ünïcode   wörds 漢字 🎉\nÜnïcode   wörds 漢字 🎉\n# * $ % & | < >", "fr", "c", 50),
        (None, None, None, None, None),
    ]
    if not clash:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, 1, True, 0.5, 2, 3, "x", 4, "y", 1.0) for r in rows], f"{DOCS}, {CLASH}")


def many_docs(spark, n: int = 600, seed: int = 5):
    """Invented prose in two languages and three sources, one of them with a third of the rows."""
    import random

    rng = random.Random(seed)
    parts = {"en": "the of and to ing er th an re on at en nd".split(), "de": "der die und ein ich sch ung keit ver ge".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        p = parts[lang]
        text = " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 160)))
        rows.append((i, text, lang, "hot" if i % 3 == 0 else f"s{i % 2}", len(text)))
    return spark.createDataFrame(rows, DOCS)


def crc(doc_id, of: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of
