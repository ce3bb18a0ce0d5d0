from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that clash with those in use, in case and out of it.
EXTRA = ", TEXT string, Doc_ID long, k long, h long, fp long, `__text` string, c0 string"


def long_text(seed: int, words: int = 30_000) -> str:
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(["the", "of", "alpha", "beta", "gamma", "ünder", "x1", "stone,"]) + str(r.randrange(900)) for _ in range(12)) for _ in range(words // 12))


def rows() -> list[tuple]:
    r = random.Random(7)
    vocabulary = [a + b for a in ("ba", "ko", "mi", "stra", "ünd", "or") for b in ("n", "ter", "la", "dis", "é", "go", "x.", "p,")]
    prose = lambda n: " ".join(r.choice(vocabulary) + ("\n" if r.random() < 0.1 else "") for _ in range(n))
    shared = " ".join(f"shared{i}" for i in range(60))
    base = prose(120)
    texts = [prose(80) for _ in range(12)]
    texts += [base, base, base + " more", base.replace("ban", "kon", 1), f"{prose(40)} {shared} {prose(40)}", f"{prose(30)}\n{shared}\n{prose(10)}"]
    texts += ["l one\nl two\nl three\nl four\nown line a", "own line b\nl one\n\n  l two\nl three\nl four", "same\n" * 9, "a a a a a a a a a a a a", "you idiot, worthless scum", "", " \n\t ", "1", "zwei drei"]
    out = [(i, t, r.choice(["en", "de"]), r.choice(["s1", "s2"]), len(t)) for i, t in enumerate(texts)]
    out += [(3, texts[3], "en", "s1", 1), (3, texts[3], "en", "s1", 1), (None, base, None, None, None), (None, None, None, "s1", None), (40, None, "en", None, 0)]
    return [*out, (41, long_text(1), "en", "s1", 9), (42, long_text(1), "en", "s2", 9), (43, long_text(2), "fr", "s3", 9)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(*x, "no", -1, 5, 6, 7, "no", "no") for x in rows()], DOCS + EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(str(r[c]) for c in names) for r in df.collect()))
