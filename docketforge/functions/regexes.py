"""Patterns written for RE2 made to mean the same in Java's regular expressions."""

from __future__ import annotations

import re

#: RE2's \b looks at ASCII word characters only.
NOT_AFTER, NOT_BEFORE = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def re2(pattern: str) -> str:
    """pattern with \\b and \\s as RE2 has them."""
    # beside a digit a boundary needs one look only
    pattern = re.sub(r"\\b(?=\\d|\[A-Z\]\\d)", lambda m: NOT_AFTER, pattern)
    pattern = re.sub(r"(?<=\})\\b(?=\||$)", lambda m: NOT_BEFORE, pattern) if re.search(r"\\d\{[\d,]+\}\\b", pattern) and "@" not in pattern else pattern
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(BOUNDARY)
            i += 2
        elif two == r"\s":
            out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = (in_class or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)
