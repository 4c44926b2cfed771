"""Small tables with hard cases, written where the queries expect them."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


def hard_documents():
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "zzz"
    far = base.split()
    for i in range(0, 120, 6):
        far[i] = "qqq"
    texts = [base, base, " ".join(near), " ".join(far), None, "", "  \t\n ", "one", "one two", "One  two", "one two three", words(rng, 6000), "a" * 20_000, base.upper(), "ünï cödé 你好 " * 30, "x\x00y \x1c z", "same line\n" * 40]
    texts += [words(rng, rng.randint(1, 300)) for _ in range(40)]
    texts += [" ".join(w if rng.random() > 0.01 else "yyy" for w in base.split()) for _ in range(25)]
    return [(i, t, None if i % 7 == 0 else "en", "src0", None) for i, t in enumerate(texts)]


def write_tables(spark, path, documents=None, labels=(), **more):
    documents = hard_documents() if documents is None else documents
    spark.createDataFrame(documents, DOC_SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    for name, (rows, schema) in more.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
