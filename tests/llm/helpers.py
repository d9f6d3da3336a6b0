"""Small tables for the training-data operators: ordinary rows, and every awkward case at once."""

import random

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stems=("an", "the", "er", "on", "tion", "re", "st", "ha")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    shared = prose(rng, 25)
    for k in range(n):
        body = prose(rng, rng.randint(5, 80))
        if k % 5 == 1:
            body = body + "\n" + shared + " " + prose(rng, 6)
        if k % 7 == 3 and rows:
            body = rows[-1][1]
        rows.append((k, body, "en" if k % 3 else "fr", f"s{k % 2}", len(body)))
    return rows


def awkward():
    """Nulls in each column, empty and long texts, ties, repeated rows, signs of every width."""
    rng = random.Random(9)
    long = prose(rng, 30_000)
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 6),
        (4, long, "en", "a", len(long)),
        (5, "twice the same row of words", "en", "b", 27),
        (5, "twice the same row of words", "en", "b", 27),
        (5, "another text of one id, long enough to hold more than fifty bytes of text", "en", "b", None),
        (None, "no id but words enough to be a text of more than fifty bytes, surely", "fr", "b", 1),
        (None, "no id but words enough to be a text of more than fifty bytes, surely", "fr", "b", 1),
        (6, "é日本 œuvre — naïve 🙂   wide　space\x0bvertical", "fr", "c", 9),
        (7, "x", "fr", "c", 1),
    ]


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
