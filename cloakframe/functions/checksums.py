"""Check digits."""

from __future__ import annotations

ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)


def is_aba(text: str) -> bool:
    """Whether a text is nine digits that meet the checksum of bank routing numbers."""
    return len(text) == 9 and text.isdecimal() and sum(w * int(c) for w, c in zip(ABA_WEIGHTS, text)) % 10 == 0


def is_luhn(text: str) -> bool:
    """Whether a text is digits that meet the checksum of card numbers."""
    if not text.isdecimal():
        return False
    digits = [int(c) for c in reversed(text)]
    return (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
