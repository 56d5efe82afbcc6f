import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import prose  # noqa: E402


@pytest.fixture(scope="session")
def tricky():
    """Texts by id: nulls, blanks, ties, copies, near copies, shared passages, a long one and other scripts."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(2, 60)
    docs = {
        0: None,
        1: "",
        2: " \n\t ",
        3: base,
        4: base,
        5: " ".join(near),
        6: prose(3, 40) + "\n" + shared + "\n" + prose(4, 30),
        7: prose(5, 10) + " " + shared,
        8: "one two",
        9: "One TWO",
        10: "same " * 400,
        11: "same " * 300,
        12: "日本語 テキスト é̂ 🎉 " * 30,
        13: "\x00 control \x0b vertical \x0c form",
        14: prose(6, 20_000),
        15: prose(6, 20_000)[: 60_000],
        16: "a" * 5000,
        17: "b" + "a" * 4000,
    }
    return docs


@pytest.fixture(scope="session")
def docs(spark, tricky):
    """The texts with repeated rows, a row without id, and columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2, "k", -1) for i, t in tricky.items()]
    rows += [rows[3], rows[6], (None, "no id here " * 30, "x", 1, 2, "k", -1)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, removed string, n_words int, bucket int, key string, kind int").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
