"""Rows for the tests of training-data operators."""

import random

def made_up(rnd, n):
    parts = ["ra", "ton", "els", "ing", "mo", "the", "qui", "ver", "ó", "ß"]
    return [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def texts(seed=3):
    """Awkward documents: nulls, blanks, copies, edits, shared lines, one long text, repeated rows."""
    rnd = random.Random(seed)
    base = [" ".join(made_up(rnd, rnd.choice([4, 12, 60, 90]))) for _ in range(8)]
    line = "a line that many of these documents share word for word, all of it."
    out = []
    for i in range(60):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = made_up(rnd, 1)[0]
        text = " ".join(words)
        if rnd.random() < 0.4:
            text += "\n" + line + "\n\n" + rnd.choice(base)
        out.append((i, text))
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "One"), (None, base[0]), (None, None), (105, " ".join(made_up(rnd, 4000))), (106, "x\x1cy <|endoftext|> Ünï İ ΣΑΣ 中文 ́e don't 12"), (107, "  z")]
    return out + out[:3]


def as_rows(df, *columns):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
