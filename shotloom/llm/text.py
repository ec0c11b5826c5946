"""Small text helpers shared by the corpus operators."""

from __future__ import annotations

#: The separators of words: space and the ASCII controls 9 to 13. bytes.split() uses the same set.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def words_lower(text: str | None) -> list[bytes]:
    """Words of ``text`` as UTF-8, A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
