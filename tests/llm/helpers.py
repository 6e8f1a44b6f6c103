"""Small tables with the awkward cases, shared by the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, size string, key string"


def rows(n=120, seed=3, vocab=40, long=True):
    """Documents with shared passages, exact and near copies, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)] + ["É", "naïve", "x.", " y", "a\x1cb", "Don't"]
    out, passages = [], [[r.choice(words) for _ in range(r.randint(20, 60))] for _ in range(6)]
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            at = r.randint(0, len(w))
            p = r.choice(passages)
            w[at:at] = p[r.randint(0, 10) :]
        text = "".join(x + r.choice([" ", "  ", "\n", "\t", " \r\n"]) for x in w)
        if out and r.random() < 0.2:
            text = r.choice(out)[1]
        out.append([i, text])
    out += [[n, None], [n + 1, ""], [n + 2, " \n\t "], [n + 3, "one"], [None, "w1 w2 w3"], [5, "w1 w2 w3"], [None, None], [n + 4, "あ" * 30 + " 123 !!!"]]
    if long:
        out.append([n + 5, " ".join(r.choice(words) for _ in range(4000))])
        out.append([n + 6, "z" * 50_000])
    out += [list(out[3]), list(out[3])]
    r.shuffle(out)
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "b", "c", None]), len(t or ""), 1, "s", "k") for i, t in out]


def table(spark, data=None, **kw):
    return spark.createDataFrame(rows(**kw) if data is None else data, SCHEMA)


def as_set(df, *cols):
    return sorted(map(str, (tuple(x[c] for c in cols) for x in df.select(*cols).collect())))
