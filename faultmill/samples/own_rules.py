"""Rule tables of a user, for the query that runs the plan with them."""

from ..rules import fixed_values as fv
from ..rules.ruleset import RuleSet
from ..rules.wording import Fix, RuleText

RULES = RuleSet(
    redaction=(
        *fv.REDACTION_RULES[:5],
        ("host", r"\bhost-\d+\b", "[HOST]", False, False),
        ("service", r"(svc|spill)_(\d)\d*", r"\1_\2[ID]", True, False),
        ("code", r"\bcode (?:\d+)", "FAIL 7 rows", False, False),
    ),
    volatile=(
        ("marker", r"\[(?:host|id)\]", "<M>", True),
        ("name", r"\b(?:mart|lib|extract|raw\.t|c)_?\d+\b", "<NAME>", False),
        *fv.VOLATILE_RULES[3:],
    ),
    triage=(
        (7, "data_quality", 0.6, False, r"FAIL \d+ rows"),
        (3, "permissions", 0.9, False, r"(login|permission).{1,12}(failed|denied|for (user|schema))"),
        (12, "code_error", 0.5, True, r"Error: \W?\w+\W?|k\d+'"),
        (40, "connectivity", 0.75, True, r"10\.0\.0\.\d:\d+|lost exec\w+"),
    ),
    texts={
        7: RuleText("A row check failed.", "Rows broke a check.", (Fix("Look at the rows", "manual", ("query them",)),)),
        3: RuleText("Somebody may not do this.", "A right is missing.", (Fix("Ask for the right", "manual", ("write a ticket",)),)),
        12: RuleText("The code is wrong.", "An error was raised.",
                     (Fix("Mend the code", "manual", ("read it",)), Fix("Run again", "retry", ("wait",)))),
        40: RuleText("A host is gone.", "Nobody answered.", (Fix("Run again", "retry", ("wait",)),)),
    },
)
