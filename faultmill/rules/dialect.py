"""Render one pattern table for the JVM (Spark) and for RE2 (the SQL oracle)."""

import re

# Whitespace as the rules understand it: the Unicode class plus the four ASCII separators.
_JVM_SPACE = r"[\s\x1c-\x1f]"
_CLASS = re.compile(r"\[\^?(?:\\.|[^\]\\])+\]|\\.|.", re.S)


def _widen_space(pattern: str) -> str:
    """Add the ASCII separators to every ``\\s``, inside and outside of brackets."""
    out = []
    for piece in _CLASS.findall(pattern):
        if piece == r"\s":
            out.append(_JVM_SPACE)
        elif piece.startswith("[") and r"\s" in piece:
            out.append(piece.replace(r"\s", r"\s\x1c-\x1f"))
        else:
            out.append(piece)
    return "".join(out)


def jvm(pattern: str, ignore_case: bool = False, dot_all: bool = False,
        multiline: bool = False) -> str:
    """Java pattern: only ``\\n`` ends a line, classes and word borders are Unicode."""
    flags = "dU" + ("iu" if ignore_case else "") + ("s" if dot_all else "") + (
        "m" if multiline else "")
    return f"(?{flags})" + _widen_space(pattern)


def jvm_replacement(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement)


def re2_flags(ignore_case: bool = False, dot_all: bool = False) -> str:
    flags = ("i" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags})" if flags else ""


def re2(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    return re2_flags(ignore_case, dot_all) + pattern
