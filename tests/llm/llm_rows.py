"""Rows for the tests of ``colscope.llm``."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, label int"
LONG = 200_000


def words_of(rng: random.Random, n: int) -> list[str]:
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "sti", "tho", "ver", "wen"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Plain texts, exact and near copies, nulls, empty, very long and odd texts, a repeated row."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(24):
        rows.append((i, " ".join(words_of(rng, rng.randint(20, 200))) + "."))
    for i in range(24, 30):                 # near copies of document 0: one word changed
        w = rows[0][1].split()
        w[(i * 7) % len(w)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(30, rows[1][1]), (31, rows[1][1].upper()), (32, None), (33, ""), (34, ""), (35, "###"), (36, "###"),
             (37, "two words"), (38, "Two  Words!"), (39, "été 漢字 \U0001f600 naïve <|endoftext|> x"),
             (40, " ".join(words_of(rng, LONG // 6))), (41, "a" * LONG), (None, "no id here at all"), (None, None)]
    rows.append(rows[2])                    # a repeated row
    return rows
