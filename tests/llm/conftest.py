import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use inside.
CLASH = ["id", "key", "norm", "fp", "block", "cid", "n", "h", "size", "out", "grp", "label", "score", "_b", "_n", "_i", "_r"]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, langs=None, sources=None, ids=None, parts=3, clash=True):
        n = len(texts)
        rows = [(ids[i] if ids else i, texts[i], langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None if texts[i] is None else len(texts[i])) for i in range(n)]
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            df = df.withColumns({c: F.lit("x") for c in CLASH})
        return df.repartition(parts) if n else df

    return build


@pytest.fixture(scope="session")
def prose():
    """Random texts with copies, near copies and shared passages; nulls and empty ones among them."""

    def build(n, seed=1, words=40, vocabulary=400):
        rng = random.Random(seed)
        word = lambda: f"w{rng.randrange(vocabulary)}"
        passage = [word() for _ in range(20)]
        out = []
        for i in range(n):
            kind = rng.random()
            ws = [word() for _ in range(rng.randrange(1, words))]
            if out and kind < 0.15:
                out.append(rng.choice(out))
                continue
            if out and kind < 0.35 and (base := rng.choice(out)) and base.split():
                ws = base.split()
                ws[rng.randrange(len(ws))] = word()
            elif kind < 0.5:
                at = rng.randrange(len(ws))
                ws = ws[:at] + passage + ws[at:]
            out.append(rng.choice([" ", "\n", "  "]).join(ws) if kind < 0.95 else rng.choice([None, "", "  \n", "Aé", "a b c"]))
        return out

    return build
