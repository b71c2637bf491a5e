"""A small table with every awkward case: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, part int, node long, n_words string, items string, hub string, block string, kept string, lang_pred string"


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 15] + (str(x % 97) if x & 4 else ""))
    return " ".join(out)


def texts() -> list[str | None]:
    base, long = prose(1, 120), prose(2, 20_000)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [base, base, near, None, "", "   \n\t ", "one", "two words", "...!!!", "été \U0001f600 中文 ñandú", long, long + " tail", base + "\n" + prose(3, 40), prose(4, 200), prose(4, 200), "a" * 3000, "ab " * 2000, "\x00\x01 x", prose(5, 50) + " " + base[:300]]


def rows() -> list[tuple]:
    out = []
    for i, t in enumerate(texts()):
        out.append((i + 1, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", None if t is None else len(t), 0.5, "k", 1, 2, "w", "i", "h", "b", "z", "p"))
    out.append(out[0])  # a repeated row
    out.append((3, "another text under a known id", *out[0][2:]))
    out.append((None, texts()[0], *out[0][2:]))
    out.append((None, None, *[None] * 13))
    return out


def documents(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), COLUMNS)
