import pytest

#: Columns of ``documents`` and columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, md5 string, keep_id long, group_size long, kept string, doc string, key string, hash string, node long, label string, part long, n_tokens long, path string, score double"
N_MORE = SCHEMA.count(",") - 4


def words(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 997}" for i in range(n))


def odd_documents() -> list[tuple]:
    """Null and empty texts, null and repeated ids, repeated rows, ties, short and very long texts, signs beyond ASCII."""
    long = words(1, 60)
    near = " ".join([*long.split()[:-1], "x"])
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d"), (6, "A b C d"), (7, long), (8, long), (9, near), (10, words(2, 80)),
        (11, words(3, 30_000)), (None, long), (None, None), (7, long), (7, words(4, 50)), (12, "ñandú été 漢字 ☃ " * 40), (13, "The The " * 300),
        (14, words(5, 120) + words(6, 100)), (15, words(7, 90) + " " + words(6, 100)), (-5, "x y z w v u"), (2**62, "it's <|endoftext|> we'll  go\n\n "), (16, "zero\x00byte"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), *["c"] * 3, None, None, "k", "d", "q", "h", None, "l", None, None, "p", None) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain_docs(spark):
    """Documents with unique ids, for brute force."""
    rows = [(k, r[1]) for k, r in enumerate(odd_documents())]
    base = words(9, 150).split()
    for k in range(100, 130):  # copies that differ in more and more words
        own = list(base)
        for j in range(k - 100):
            own[(j * 37 + k) % len(own)] = f"n{k}x{j}"
        rows.append((k, " ".join(own)))
    passage = words(11, 100)
    rows += [(k, words(k, 5) + " " + passage + " " + words(k + 1, 5 + k % 3)) for k in range(200, 215)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
