"""Small corpora."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, digest long, size int, component_id string"


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.9 else rng.choice(["The", "of", "a,", "Zu."]) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.06 else " ") for w in words).strip()


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "k", 1, 2, "c") for d, t, s in rows], DOCS).repartition(5)
