"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, bands string, _id int, rank int, word string"
LANGS = {"aa": "banokitu", "bb": "grelmsopw"}


def words(text):
    return WORD.findall(text or "")


def sentence(rng, lang, n):
    letters = LANGS[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(n=60, seed=3):
    """Rows with nulls, empty and blank texts, one very long text, exact and near copies, repeated rows, a hot source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, sentence(rng, lang, rng.randint(55, 160)), lang, "hot" if i % 3 else f"s{i % 7}"))
    base = rows[5][1].split(" ")
    near = " ".join(base[:-1] + ["zz"])
    rows += [(n, rows[5][1], "aa", "hot"), (n + 1, near, "aa", "s1"), (n + 2, None, None, None), (n + 3, "", "aa", None), (n + 4, " \n\t ", None, "s2"), (n + 5, "one two", "aa", "hot")]
    rows += [(n + 6, sentence(rng, "aa", 20_000), "aa", "hot"), (n + 7, "###&&& %%% ***", "bb", "s1"), (None, "no id here", "aa", "s1"), rows[7], rows[7]]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", 1, 2, "z") for i, t, lang, s in rows]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
