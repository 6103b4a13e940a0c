import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta omega zeta kappa sigma theta lambda rho tau".split()


@pytest.fixture(scope="session")
def spark():
    from ragtide.session import get_session

    return get_session(master="local[4]")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source, n_chars, row, doc, token): nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(7)
    shared = "This very line stands in many documents and is long enough."
    passage = sentence(rng, 40)
    texts = [None, "", "   \n\t ", "one", "two words", sentence(rng, 4000)]
    texts += [sentence(rng, 30) + "\n" + shared + "\n" + sentence(rng, 10) for _ in range(8)]
    base = sentence(rng, 60).split()
    for k in range(6):  # near copies
        copy = list(base)
        copy[k * 7] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3  # exact copies
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(4)]
    texts += ["naïve œuvre straße 日本語 " * 10, "x" * 300, "ab" * 200, shared, shared]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), f"r{i}", i, "tok") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, texts[7], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, doc long, token string"


@pytest.fixture(scope="session")
def odd(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


#: Names that operators might use inside, and a type that can't be ordered.
CLASHING = "_hits _n_words _keep _doc _id _row _row1 _row2 _score _one key root first kept_0 kept_1 s n h low salt piece data ids count".split()


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with such columns beside them."""
    from pyspark.sql import functions as F

    out = odd.withColumn("a_map", F.create_map(F.lit("k"), F.col("row")))
    for i, name in enumerate(CLASHING):
        out = out.withColumn(name, F.lit(f"c{i}"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
