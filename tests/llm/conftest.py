import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n, lines=1):
    return "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) for _ in range(lines))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def documents(spark):
    """Exact and near copies, shared passages, repeated lines and rows, nulls, empty and long texts."""
    rng = random.Random(5)
    base = prose(rng, 120, 4)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randrange(5, 60), rng.randrange(1, 8))) for i in range(40)]
    rows += [(100 + i, base) for i in range(5)]
    for i in range(12):
        w = base.split(" ")
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "one"), (405, "two words"), (406, "a " * 3000), (407, "a " * 2500), (408, prose(rng, 12_000)), (409, "ünï çødé " * 30), (410, "ünï çødé " * 31)]
    rows += [(None, base), (None, "alone in the world"), (7, rows[7][1]), (8, "another text under a known number " * 4)]
    rng.shuffle(rows)
    return spark.createDataFrame([(d, t, "en", ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None, len(t) if t is not None else None) for i, (d, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(documents):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "key", "label", "n", "a", "b", "h", "k", "p", "w", "row", "kept", "score", "text_hash", "start", "len", "item_ids", "covered", "epoch", "pos", "block", "c0", "c1", "gone_id", "_h", "_bad_id"]
    return documents.withColumns({n: F.lit(f"x-{n}") for n in names})
