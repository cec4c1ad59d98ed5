"""Small document frames with the awkward cases, shared by the operator tests."""

import random

WORDS = "ka lo mi nu pe ra so ti vu wa xe yo zi bam dol fen gir hul jep".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


LONG = prose(1, 30_000)
ROWS = [
    (1, prose(2, 150)), (2, prose(2, 150)), (2, prose(2, 150)), (3, None), (None, prose(3, 120)), (4, ""),
    (5, prose(3, 120) + " " + prose(4, 40)), (6, "one two"), (7, " \t\n "), (8, LONG), (9, LONG[:90_000] + " end"),
    (10, prose(5, 60) + " shared " + prose(2, 100)), (11, "é中😀 " * 30 + prose(5, 60)), (12, "a " * 500),
    (13, "a " * 400 + "b"), (14, "x" * 3000), (15, "ends\x00 with\x0b odd\x1f spaces\u00a0here"), (16, prose(6, 90)),
    (17, prose(6, 44) + " changed " + prose(6, 90)[len(prose(6, 45)):]), (-3, prose(6, 90)), (None, None),
]


def documents(spark, rows=None):
    """Documents with an extra column whose name clashes with names the operators use."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(d, t, "x", "src", i) for i, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, row string, Name string, row_key long").repartition(3)


def none(spark):
    return documents(spark, [])
