"""Literals that every match of a pattern holds, read off its syntax tree.

A scan for literals is far cheaper than a pattern.  ``required`` gives a set of which any matching
text contains at least one, so a text without them needs no look; the pattern decides the others.
"""

import re
from functools import lru_cache
from re import _constants as node
from re import _parser

#: Strings that a part of a pattern may stand for before only its needs are kept.
SPELLINGS = 64
#: Characters of a class that are spelled out.
CLASS = 8
#: Shorter literals occur almost everywhere and tell nothing of a text.
LEAST = 2

# Letters beyond ASCII that a case-blind pattern takes for i and s.
ODD_LETTERS = str.maketrans("İıſ", "iis")


def fold(text: str) -> str:
    """The form in which texts and literals of case-blind patterns are compared."""
    return (text if text.isascii() else text.translate(ODD_LETTERS)).lower()


class _Part:
    """What is known of a part: ``exact``, all strings it stands for, and ``need``, of which each of
    its matches holds one; None where unknown."""

    def __init__(self, exact: frozenset[str] | None, need: frozenset[str] | None = None):
        self.exact = exact
        self.need = need if exact is None else exact if exact and "" not in exact else None


_UNKNOWN = _Part(None)
_NOTHING = _Part(frozenset([""]))


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two needs the one that is likely rarer; many spellings cost as many scans."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda need: (min(map(len, need)) >= LEAST, min(map(len, need)) - len(need) / 4))


def _joined(parts: list[_Part]) -> _Part:
    run, need, whole = _NOTHING, None, True
    for part in parts:
        if part.exact is not None and len(run.exact) * len(part.exact) <= SPELLINGS:
            run = _Part(frozenset(a + b for a in run.exact for b in part.exact))
            continue
        whole, need = False, _better(_better(need, run.need), part.need)
        run = part if part.exact is not None else _NOTHING
    return run if whole else _Part(None, _better(need, run.need))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= SPELLINGS:
        return _Part(frozenset().union(*[p.exact for p in parts]))
    if any(p.need is None for p in parts):
        return _UNKNOWN
    return _Part(None, frozenset().union(*[p.need for p in parts]))


def _letter(code: int, blind: bool) -> _Part:
    letter = chr(code)
    if not blind or letter.isascii():
        return _Part(frozenset([letter.lower() if blind else letter]))
    return _Part(frozenset([letter])) if letter == letter.lower() == letter.upper() else _UNKNOWN


def _class(items: list, blind: bool) -> _Part:
    codes: list[int] = []
    for kind, value in items:
        if kind is node.LITERAL:
            codes.append(value)
        elif kind is node.RANGE and value[1] - value[0] < CLASS:
            codes.extend(range(value[0], value[1] + 1))
        else:
            return _UNKNOWN
    return _either([_letter(code, blind) for code in codes]) if 0 < len(codes) <= CLASS else _UNKNOWN


def _part(kind, value, blind: bool) -> _Part:
    if kind is node.LITERAL:
        return _letter(value, blind)
    if kind is node.IN:
        return _class(value, blind)
    if kind is node.BRANCH:
        return _either([_tree(p, blind) for p in value[1]])
    if kind is node.SUBPATTERN:
        return _tree(value[3], blind or bool(value[1] & re.I))
    if kind is node.ATOMIC_GROUP:
        return _tree(value, blind)
    if kind in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT):
        least, most, inner = value
        part = _tree(inner, blind)
        if least == 0:
            return _either([_NOTHING, part]) if most == 1 else _UNKNOWN
        some = _joined([part] * min(least, 4))
        return some if least == most <= 4 else _Part(None, some.need)
    if kind in (node.AT, node.ASSERT, node.ASSERT_NOT):
        return _NOTHING
    if kind is node.GROUPREF_EXISTS:
        return _either([_tree(value[1], blind), _tree(value[2], blind) if value[2] else _NOTHING])
    return _UNKNOWN


def _tree(tree, blind: bool) -> _Part:
    return _joined([_part(kind, value, blind) for kind, value in tree])


@lru_cache(4096)
def required(pattern: str, ignore_case: bool = True, least: int = LEAST) -> frozenset[str] | None:
    """Literals of which every match of ``pattern`` holds one; None where none of ``least`` characters
    or more are known.

    With ``ignore_case`` they are folded and stand in the folded text.  A pattern that does not
    compile gives an empty set: nothing matches it.
    """
    try:
        tree = _parser.parse(pattern, re.I if ignore_case else 0)
        blind = ignore_case or bool(tree.state.flags & re.I)
        part = _tree(tree, blind)
    except (re.error, OverflowError, RecursionError):
        return frozenset()
    if part.need is None or not ignore_case and (blind or _turns_blind(tree)):
        return None
    if min(map(len, part.need)) < least:
        return None
    # a literal inside another one is found with it
    return frozenset(a for a in part.need if not any(b != a and b in a for b in part.need))


def _subtrees(value) -> list:
    """The syntax trees right below a part of a tree."""
    if isinstance(value, _parser.SubPattern):
        return [value]
    return [tree for v in value for tree in _subtrees(v)] if isinstance(value, (list, tuple)) else []


def _turns_blind(tree) -> bool:
    """Whether an inner group ignores the case where the pattern does not."""
    return any(kind is node.SUBPATTERN and value[1] & re.I or any(map(_turns_blind, _subtrees(value)))
               for kind, value in tree)
