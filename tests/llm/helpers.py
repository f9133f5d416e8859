"""Small tables with every awkward case, and brute-force versions of the kernels."""

import random
import re
from collections import Counter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use inside.
CLASH = ["zr", "zi", "zs", "n", "a", "b", "keep", "bits", "id", "th", "t", "h", "rn", "k", "zt", "zl", "x.y"]


def docs_of(spark, rows, extra=False):
    """A table of (doc_id, text, lang, source); with columns of clashing names on request."""
    full = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"extra-{c}").alias(c) for c in CLASH if c not in df.columns])
    return df


def words_of(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m.group().lower(), text or ""))


def shingle_bag(text, n=2):
    w = words_of(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "be", "co", "du", "er", "fi", "go", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


AWKWARD = [
    (None, "no id here", "en", "s1"), (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "   \n\t\n ", None, None), (4, "One line.\nTwo lines.\nOne line.", "en", None),
    (5, "One line.\nTwo lines.\nOne line.", "de", "s2"), (5, "One line.\nTwo lines.\nOne line.", "de", "s2"), (5, "other text of the same id", "de", "s2"), (6, "word", None, "s2"),
    (7, "!!! ??? ...", "en", "s1"), (8, "ÉCOLE élève 日本語 😀 don't", "fr", "s1"), (9, "long " * 30000, "en", "s1"), (10, "x" * 100000, "en", "s1"), (None, None, None, None), (-1, "negative id", "en", "s1"),
]
