import random

import pytest

WORDS = "the of and tion ing her thou ent ion was for whan erlat ouen thin".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, short, empty, null, long and non-ASCII texts."""
    base, passage = prose(1, 120), prose(2, 60)
    rows = [base, base, base.upper(), edited(base, 3, 2), edited(base, 4, 9), prose(5, 80) + "\n" + passage, passage + " " + prose(6, 40)]
    rows += [None, "", " \n\t ", "one", "one two", "ONE Two", "one two three", "a" * 500, "ab" * 300, "日本語のテキスト é ñ ß 𝔸  x", "\x00" * 250 + "x"]
    rows += [prose(7, 6000), prose(8, 11), edited(prose(8, 11), 9, 1), prose(8, 11) + " end", prose(10, 25), edited(prose(10, 25), 11, 1)]
    rows += [edited(base, 20 + i, 3) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def clashing(spark, texts):
    """The texts as documents, with columns named like those the operators use themselves."""
    extra = ("row", "key", "score", "n_removed", "spans", "ids", "label", "bucket", "component_id", "contaminated", "similar_key", "kept_text")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in extra)
    rows = [(i, t, "en", None, len(t) if t is not None else None, *("x" for _ in extra)) for i, t in enumerate(texts)]
    rows += [(None, "text of no id", None, None, None, *(None for _ in extra)), rows[5], rows[7]]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(clashing):
    return clashing.limit(0)
