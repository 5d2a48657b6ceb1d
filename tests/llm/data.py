"""Small documents with every awkward case: null ids and texts, empties, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, w string, root long, fingerprint string, __text string"


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "Une", "les", "und", "naïve", "don't", "3.14", "漢字", "🙂", "été,", "x_y", "a@b.co", "(ok)"] + ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 300)))
        rows.append((k, text.replace(" of ", "\n"), rng.choice(["en", "fr"]), f"src{k % 3}.example.org", len(text), k, "w", 1, "f", "t"))
    copied = rows[5][1]
    odd = [None, "", " \n\t ", copied, copied + " tail", "word " * 20_000, "a" * 5000, "1" * 3000, "\x00\x1c  ▁▁ <s><|endoftext|>", copied]
    rows += [(n + k, x, None if k % 2 else "en", None if k % 3 else "src0.example.org", None, None, None, None, None, None) for k, x in enumerate(odd)]
    return [*rows, rows[3], (None, copied, "en", "s", 1, 1, "w", 1, "f", "t"), (None, None, None, None, None, None, None, None, None, None)]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
