"""Odd rows that every operator has to take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names the operators use inside.
CLASHES = {"row": "1L", "n": "2L", "v": "'x'", "comp": "3", "size": "4L", "score": "0.5D", "copies": "7", "target": "1D", "node": "5L", "ids": "array(1)", "rank": "9", "tag": "6L", "digest": "'d'", "found": "1"}


def prose(rng, words, stems):
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "ing", "ed"]) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    en = ["the", "house", "walk", "river", "green", "table", "think", "window", "market", "yellow"]
    fr = ["le", "maison", "être", "rivière", "vert", "chaise", "penser", "fenêtre", "marché", "jaune"]
    out = []
    for i in range(60):
        lang, stems = ("en", en) if i % 3 else ("fr", fr)
        out.append((i, prose(rng, 30 + i, stems), lang, f"s{i % 4}", 0))
    base = out[1][1].split()
    for i in range(60, 70):
        copy = list(base)
        copy[i % len(base)] = "changed"
        out.append((i, " ".join(copy), "en", "s1", 0))
    out += [(70, out[2][1].upper(), None, None, None), (71, None, "en", "s0", None), (72, "", "en", "s0", 0), (73, " \t\n", None, None, 3), (74, "one", "en", None, 3), (75, "one two", "en", "s2", 7)]
    out += [(76, "x" * 300_000, "en", "s3", 300_000), (77, prose(rng, 60_000, en), "en", "s3", 0), (None, out[3][1], "en", "s1", 0), (None, None, None, None, None)]
    out += [out[4], out[4], (5, "another text under the same id " * 8, "en", "s1", 0), (78, "12 34 ▁   \x00 é 𝔘", "de", "s2", 0), (-3, "negative ids are ids too", "en", "s0", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.selectExpr("*", *[f"{v} as `{k}`" for k, v in CLASHES.items()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(frame):
    return sorted(map(repr, map(tuple, frame.collect())))
