"""The rule tables that a plan runs with, as one parameter."""

from collections.abc import Mapping
from dataclasses import dataclass, field

from . import fixed_values as fv
from .wording import RULE_TEXTS, RuleText


@dataclass(frozen=True)
class RuleSet:
    """Tables in the layouts of ``fixed_values``; each triage rule needs its ``texts`` entry.  Rule ids
    are above 0, which stands for no rule."""

    redaction: tuple[tuple, ...] = fv.REDACTION_RULES
    volatile: tuple[tuple, ...] = fv.VOLATILE_RULES
    triage: tuple[tuple, ...] = fv.TRIAGE_RULES
    texts: Mapping[int, RuleText] = field(default_factory=lambda: RULE_TEXTS)


BUILT_IN = RuleSet()
