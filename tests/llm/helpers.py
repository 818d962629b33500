import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="s"):
    """Rows of documents from texts, or (id, text) pairs."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], DOCS)


def clashing(df):
    """df with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("size", "key", "part", "halo", "block", "rep", "label", "words", "n", "p", "gkey", "start", "copies", "target", "bucket")})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
