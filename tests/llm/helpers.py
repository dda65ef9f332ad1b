"""Small tables with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + (rng.choice([",", "."]) if rng.random() < 0.1 else "") for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Null, empty, blank, short, very long, repeated and near-repeated texts; a null id; repeated rows."""
    rng = random.Random(seed)
    base, long = prose(rng, 120), prose(rng, 9000)
    swapped = base.split()
    swapped[60] = "changed"
    shared = prose(rng, 90)
    texts = [None, "", "   \n\t ", "one", "Two words", base, base, base.replace(" ", "  \n"), " ".join(swapped), long, long + " tail", "déjà vu ñandú über €“x” 12.5", "a" * 3000]
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 40) for _ in range(3)] + [prose(rng, 60) for _ in range(5)]
    rows = [(i + 1, t, None if i % 5 == 0 else ("en" if i % 2 else "fr"), f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, "no id " + prose(rng, 50), "en", None, None))
    return rows


def docs(spark, rows: list[tuple] | None = None, extra: bool = False):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "kept", "digest", "score", "n", "_id", "size", "ids", "leaf", "y", "count"):
            df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)
