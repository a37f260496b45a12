"""Small tables with the awkward cases of every operator: nulls, empty and long texts, ties, repeated rows, extra columns
with clashing names."""

import random

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, id long, score double, g int"


def words_of(text):
    return (text or "").encode().translate(LOW).split()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 160))
        out.append((i, text))
    base = out[5][1].split() * 2
    for k in range(6):  # near copies of one text, and exact copies of another
        changed = list(base)
        changed[k * 3] = f"x{k}"
        out.append((n + k, " ".join(changed)))
        out.append((n + 10 + k, out[7][1]))
    out += [(n + 30, None), (n + 31, ""), (n + 32, " \t\n"), (n + 33, "word " * 30_000), (None, "no id here"), (None, None)]
    out += [out[3], out[3], (n + 34, "Ünïcode été ß 日本語 \U0001f600"), (n + 35, "one two three")]
    return out


def table(spark, pairs, source=lambda i: f"s{i % 4}" if i is not None and i % 7 else None):
    return spark.createDataFrame([(i, t, None, source(i), None, "l", 1, 0.5, 2) for i, t in pairs], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
