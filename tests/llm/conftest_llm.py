"""Plain-Python helpers of these tests."""

SPACES = "\t\n\x0b\x0c\r"


def words_of(text, lower=True):
    """Words between the six ASCII spaces, A-Z lower-cased if asked."""
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
