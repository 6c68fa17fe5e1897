"""Invented prose for tests."""


def prose(rng, n):
    """n words, some of them common."""
    common = "the of and to a in is it that for".split()
    out = []
    for _ in range(n):
        out.append(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))))
        if rng.random() < 0.08:
            out[-1] += "."
    return " ".join(out)
