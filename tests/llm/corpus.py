"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, size string, key string, shard string"


def texts(n=60, seed=7):
    rng = random.Random(seed)
    words = ["the", "of", "und", "la", "ärger", "x1", "ünder", "maison", "#tag", "a|b", "zu", "que", "été", " nb"]
    out = [None, "", " ", "\n\n", "one", "ONE", "a b", "a b c d", "the " * 300, "same line\nsame line\nother\nsame line"]
    for _ in range(n):
        out.append(" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))))
    base = out[-1]
    out += [base, base, base + " tail", base.replace(" ", "\n", 3), " ".join(rng.choice(words) for _ in range(5000))]
    return out


def rows(seed=7):
    out = [(i * 3, t, "en" if i % 2 else "fr", f"src{i % 4}" if i % 7 else None, None, i, "fp", "s", "k", "h") for i, t in enumerate(texts(seed=seed))]
    return out + [out[12], out[12], (None, "no id at all", None, None, 1, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def documents(spark, seed=7):
    return spark.createDataFrame(rows(seed), SCHEMA)
