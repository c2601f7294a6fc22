"""Small document tables with the cases every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names operators use inside.
CLASHING = {
    "q_list": 1, "q_words": 2, "words": 3, "w": 4, "h": 5, "hashes": 6, "fp": 7, "root": 8, "id": 9, "text_hash": 10,
    "item_id": 11, "salt": 12, "payload": 13, "held_out": 14, "lists": 15, "bucket": 16, "n": 17, "spans": 18,
}


def sentence(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def documents(spark, rows, clashing=False):
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
    if clashing:
        from pyspark.sql import functions as F
        df = df.withColumns({name: F.lit(value) for name, value in CLASHING.items()})
    return df.repartition(3)


def odd_rows(seed=1):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    base = [sentence(rng, 80) for _ in range(6)]
    rows = [(n, base[n % 6] if n % 3 else sentence(rng, 70), "en" if n % 2 else "de", f"s{n % 2}") for n in range(30)]
    rows += [
        (100, None, "en", "s0"), (101, "", "en", "s0"), (102, " \t\n ", None, None), (None, base[0], "en", "s1"),
        (None, None, None, None), (103, "x" * 200_000, "en", "s0"), (104, sentence(rng, 20_000), "en", "s0"),
        (105, "one", "en", ""), (106, "été 日本語 \U0001F600\n\n\\ \"quoted\"", "", "s0"), (106, base[1], "en", "s0"),
    ]
    return rows + rows[3:6] + rows[30:32]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])
