"""Rows that the tests share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, or return.
CLASHING = (
    "kept", "key", "norm", "bucket", "shard", "slot", "size", "rep", "band", "component", "row", "position",
    "block", "score", "spans", "lettered", "start", "length", "rest", "label", "__source", "__id", "__row", "n",
)


def sentence(seed: int, words: int) -> str:
    """Words of a small made-up vocabulary, different for each seed."""
    out, state = [], seed * 7919 + 17
    for _ in range(words):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("".join("bcdfglmnprst"[(state >> s) % 12] + "aeiou"[(state >> (s + 3)) % 5] for s in (4, 9, 14)))
    return " ".join(out)


LONG = sentence(99, 60_000)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "the house and the garden of the king", "en", "a", 36),
        (2, "the house and the garden of the king", "en", "a", 36),
        (2, "the house and the garden of the king", "en", "a", 36),
        (3, None, "en", "a", None),
        (4, "", "en", None, 0),
        (5, " \t\n ", None, "b", 4),
        (6, "été à la maison du roi et de la reine", "fr", "b", None),
        (7, "12 34 + 56", None, "b", 10),
        (8, LONG, "en", "c", len(LONG)),
        (None, "a text without an id of its own", "en", None, 31),
        (None, None, None, None, None),
        (9, "<|endoftext|> stands in this text", None, "c", 33),
        (10, "\U0001f600 中文 русский", "fr", "c", 9),
    ]
