"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and river stone light winter garden letter window morning silver quiet paper mountain house".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", str(rng.randrange(30))]) for _ in range(n)) + "."


def texts(n: int = 30, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["\n".join(sentence(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def documents(spark, seed: int = 1):
    """doc_id, text and columns that have the names of results."""
    plain = texts(24, seed)
    passage = "\n".join(texts(6, 99))
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(40, None), (41, ""), (42, "  \n\t "), (43, "one"), (44, plain[3]), (44, plain[3]), (45, plain[3] + " x"),
             (46, passage + " first"), (47, "second " + passage), (48, "é́ ΣΑΣ <|endoftext|> a  b 　c\x00d"),
             (49, " ".join(texts(120, 5))), (50, "日本語" * 400), (None, plain[5]), (51, "a" * 5000)]
    values = [(i, t, "en", "s", -1, 0.5, "f", 7, False) for i, t in rows]
    return spark.createDataFrame(values, "doc_id long, text string, lang string, source string, n_chars long, score double, "
                                         "fingerprint string, component_id long, held_out boolean")


def empty(df):
    return df.where("1 = 0")
