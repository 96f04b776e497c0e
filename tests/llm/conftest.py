from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, source string, score double, row long, n long"


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: copies, near copies, shared passages, nulls, blanks, one long text, repeated rows and ids."""
    random.seed(11)
    words = ["".join(random.choice("abcdeéß") for _ in range(random.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage, line = make(60), make(6)
    rows = [(i, f"{line}\n{make(random.randint(1, 120))}") for i in range(40)]
    base = make(90)
    for i in range(40, 52):
        near = base.split(" ")
        near[random.randrange(90)] = "Other"
        rows.append((i, " ".join(near) if i % 3 else base.replace(" ", "\t ")))
    rows += [(i, f"{make(20)} {passage} {make(15)}") for i in range(52, 60)]
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "one two three"), (64, "One  two THREE"), (65, make(4000)), (66, line)]
    rows += [(67, "x" * 300), (68, "x" * 300), (69, "mail a.b@c.de or +1 (017) 555-7713, 10.0.0.1 or 4111 1111 1111 1111.")]
    rows += [(70, "a  b  c　d   e'll 12 34!!\r\n\x0b"), (71, "😀😀 \U0001f600 é"), (5, rows[5][1]), (5, "another five"), (None, base)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """As a table of files with columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(i, t, f"s{(i or 0) % 2}", 0.5, 7, 9) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)
