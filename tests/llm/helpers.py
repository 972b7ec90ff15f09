"""Small document tables with the awkward rows that every operator has to take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHES = ["id", "fp", "digest", "salt", "content", "kept", "item", "size", "bin", "score"]


def awkward_texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "déjà", "Éclair", "x", "the", "of", "zeta eta", "日本"]
    texts: list[str | None] = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)]
    long = " ".join(f"w{i % 977}q{i}" for i in range(12_000))
    return [*texts, texts[0], texts[0].swapcase(), None, "", " \t\n", "one", "One", long, long, long + " end", "a\x1cb\xa0c", "\x00"]


def documents(spark, texts, start: int = 0):
    return spark.createDataFrame([(start + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


def rows(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is None, r[k]) for k in keys))
