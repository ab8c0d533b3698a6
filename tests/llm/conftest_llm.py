"""Documents that the tests share."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: Nulls, empty and very long texts, repeated rows and ids, copies, ties.
ODD = [
    (1, prose(1, 80), "s1"), (1, prose(1, 80), "s1"), (2, prose(1, 80) + " end", "s1"), (3, "", "s1"), (4, None, None), (None, prose(2, 30), "s2"), (None, None, None),
    (5, "  \n\t ", ""), (6, "x" * 200_000, "s2"), (7, prose(3, 30_000), "s2"), (8, "one two", "s3"), (9, "One  TWO", "s3"), (10, "one two", "s3"), (3, prose(4, 60), "s1"), (11, "é İ ß\x00 \u2028 日本 <|endoftext|> it's", "s3"), (12, prose(2, 30), "s2"),
]
