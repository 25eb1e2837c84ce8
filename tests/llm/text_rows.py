"""Rows and helpers shared by the tests of the text operators."""

import random

SYLLABLES = "an the re of ing sta lo mi ku é ö ta".split()
EDGE_SCHEMA = ("doc_id long, text string, lang string, id long, n int, kept string, size long, "
               "words string, root long, z binary, p long, h long")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) +
                    (".\n" if r.random() < 0.08 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    """NULLs in any column, empty and very long texts, ties, repeated rows,
    copies, near copies, shared passages, other scripts and white space."""
    base = [prose(i, 120) for i in range(6)]
    near = base[0].split(" ")
    near[50] = "changed"
    shared = prose(99, 60)
    texts = [
        (1, base[0]), (2, base[1]), (3, base[0]), (4, " ".join(near)), (5, base[0].upper()),
        (6, None), (7, ""), (8, " \t\n "), (9, "one two"), (10, "one  two\n"),
        (11, base[2] + " " + shared), (12, shared + " " + base[3]), (13, prose(50, 60_000)),
        (14, "same words here again " * 400), (15, "x" * 300_000), (16, "a b c d e"),
        (17, "the quick " + shared + " end"), (18, "tab\tand\x0bfeed\x0c\rnbsp  wide　 ▁ mark ▁▁"),
        (19, "emoji 😀 " * 40), (20, "l1\nl2\nl1\n\n \nl1"), (None, base[0]), (None, None),
        (21, "  lead and trail  "), (22, "zero\x00byte"), (23, "<s> </s> <unk> <|endoftext|> [INST]"),
    ]
    rows = [(d, t, "en", 7, 1, "k", 5, "w", 3, b"z", 1, 2) for d, t in texts]
    rows += [rows[0], rows[1], (None, base[1], None, None, None, None, None, None, None, None, None, None)]
    return rows


def by_row(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
