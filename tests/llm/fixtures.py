"""Small tables with the cases that every operator must stand."""
import random

SCHEMA = "doc_id long, text string, size long, key string, n int, spans string, line int, doc long"


def prose(seed: int, words: int, line: int = 12) -> str:
    rnd = random.Random(seed)
    out = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, words, line))


def documents(spark, texts):
    """Rows (id, text) with columns whose names operators use themselves."""
    rows = [(i, t, 7, "k", 1, "s", 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    """Null, empty and blank texts, a very long one, repeats of rows, ties, odd characters."""
    base = prose(1, 120)
    return [
        (0, base), (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base.replace("a", "A", 1)), (6, base + " " + base),
        (7, "aaaa " * 3000), (8, prose(2, 4000)), (9, "ΑΣ é x́ İ\x1c\x85 \U0001f600 don't <|endoftext|> 12"), (9, "ΑΣ é x́ İ\x1c\x85 \U0001f600 don't <|endoftext|> 12"),
        (10, "a" * 3000), (None, base), (11, prose(3, 30)), (12, "one"), (13, "one"),
    ]
