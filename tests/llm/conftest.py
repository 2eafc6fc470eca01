import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, row int, length string, " \
        "budget long, sequence_id string, _id string, tail double, epoch string, rows int, band int, label string, ids int"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def tricky_texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and
    long texts, repeated rows and ids, odd white space."""
    passage = prose("passage", 60)
    base = prose("base", 200)
    near = base.split()
    near[50] = "changed"
    far = list(near)
    far[10], far[90], far[150] = "x1", "x2", "x3"
    long = prose("long", 30_000)
    out = [(10, base), (11, base), (3, base.replace(" ", "\n\t", 5)), (12, " ".join(near)), (13, " ".join(far)),
           (20, prose(1, 80) + " " + passage + " " + prose(2, 50)), (21, prose(3, 20) + "\n" + passage), (19, passage + "  " + prose(4, 30)),
           (30, None), (31, ""), (32, " \t\n "), (33, "one"), (34, "one"), (35, "one two three four"), (36, "one two three four"),
           (37, "one two three four five"), (38, "One two three four five"),
           (40, long), (41, long[:-3]), (42, "same " * 3000), (43, "same " * 40), (44, "a" * 100_000),
           (50, prose(5, 100)), (50, prose(5, 100)), (51, prose(6, 100)), (51, prose(7, 100)),
           (None, base), (None, prose(8, 40)), (None, None), (60, "naïve café — 漢字 ¡olé! <|endoftext|> don't   x　y  z \n\n q"), (61, "tab\tand\x0bvt"),
           (62, "İstanbul Σας é \x1c odd")]
    out += [(100 + k, " ".join(w if j % 37 != k % 37 else f"v{k}" for j, w in enumerate(base.split()))) for k in range(40)]
    out += [(200 + k, "copy of many words that all agree with one another in each and every single word") for k in range(60)]
    return out


@pytest.fixture(scope="session")
def texts():
    return tricky_texts()


def frame(spark, rows):
    extra = [True, "d", 1, "l", 5, "s", "i", 0.5, "e", 2, 3, "b", 4]
    full = [(i, t, ["en", "de", None][k % 3], ["src0", "src1", "src0", "odd", None][k % 5], None if t is None else len(t), *extra)
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, KINDS).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
