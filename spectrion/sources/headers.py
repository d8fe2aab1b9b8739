"""Headers of laboratory tables taken apart into words, and what the words say of name and unit."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Raised and lowered digits and signs that stand for letters.
_PLAIN = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉δΔμ", "01234567890123456789ddµ")
_WORD = re.compile(r"[a-zа-яёµ]+[0-9]*|[0-9]+")

#: Words for amounts by unit, tried in this order; a pair of words is one that is written apart.
AMOUNTS = {
    "mg/l caco3": ["caco3"],
    "ueq/l": ["µeq", "ueq", "мкэкв", ("мкг", "экв")],
    "meq/l": ["meq", "mval", "мэкв", ("мг", "экв")],
    "mmol/l": ["mmol", "ммоль"],
    "ug/l": ["µg", "ug", "мкг", "ppb"],
    "mg/l": ["mgl", "ppm", ("mg", "l"), ("mg", "dm3"), ("мг", "л"), ("мг", "дм3")],
}
#: Words that may stand in a unit behind a name.
_UNIT_WORDS = {w for forms in AMOUNTS.values() for form in forms for w in ((form,) if isinstance(form, str) else form)} | {"as", "ugl", "µgl", "mmoll", "meql"}


@dataclass(frozen=True)
class Header:
    """``words`` of the header itself and ``noted``, those between brackets, in lower case."""

    words: tuple[str, ...]
    noted: tuple[str, ...]

    @classmethod
    def read(cls, header: str) -> Header:
        low = header.lower().translate(_PLAIN)
        outside, depth, inside = [], 0, []
        for c in low:
            if c in "([{":
                depth += 1
            (inside if depth else outside).append(c)
            if c in ")]}" and depth:
                depth -= 1
        return cls(tuple(_WORD.findall("".join(outside))), tuple(_WORD.findall("".join(inside))))

    @property
    def name(self) -> str:
        """The words run together without the unit behind them; the first word is always part of the name."""
        n = len(self.words)
        while n > 1 and self.words[n - 1] in _UNIT_WORDS:
            n -= 1
        return "".join(self.words[:n])

    @property
    def unit(self) -> str | None:
        every = self.words[1:] + self.noted
        pairs = set(zip(every, every[1:]))
        return next((unit for unit, forms in AMOUNTS.items() if any(f in pairs if isinstance(f, tuple) else f in every for f in forms)), None)

    def without(self, words: list[str]) -> str:
        """The words run together but for some."""
        return "".join(w for w in self.words if w not in words)
