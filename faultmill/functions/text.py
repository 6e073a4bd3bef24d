"""Log text as Column expressions: redaction, error lines, signature, triage, truncation.

Everything stays inside generated JVM code; nothing here needs a Python worker.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import dialect, needed
from ..rules import fixed_values as fv
from .once import let, once

_STRIP = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_ERROR_LINE = dialect.jvm(
    r"^.*?\b(?:" + "|".join(fv.ERROR_WORDS) + r")\b.*$", ignore_case=True, multiline=True)
_ERROR_WORD = dialect.jvm(r"\b(?:" + "|".join(fv.ERROR_WORDS) + r")\b", ignore_case=True)
_BLANK_RUN = dialect.jvm(r"\s+")


def strip(text: Column) -> Column:
    """Strip all white space (``trim`` knows the space only)."""
    return F.regexp_replace(text, F.lit("(?U)" + _STRIP), F.lit(""))


def collapse_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, F.lit(_BLANK_RUN), F.lit(" ")))


def folded(text: Column) -> Column:
    """Lower case, with the letters that a case-blind pattern takes for i and s replaced."""
    wide = F.octet_length(text) != F.length(text)
    return F.when(wide, F.lower(F.translate(text, "\u0130\u0131\u017f", "iis"))).otherwise(
        F.lower(text))


# --- redaction -----------------------------------------------------------------------------------

def _any_of(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def may_match(pattern: str, ignore_case: bool, text: Column, fold: Column) -> Column | None:
    """A byte scan that spares texts without the literals each match needs; None where none are known.

    ``fold`` is the folded text.  A pattern that only the JVM understands has no known literals.
    """
    needs = needed.required(pattern, ignore_case, 1)
    if not needs:
        return None
    plain = not ignore_case or all(n.lower() == n.upper() for n in needs)
    return _any_of(text if plain else fold, tuple(sorted(needs)))


def _guarded(guard: Column | None, found: Column) -> Column:
    return found if guard is None else guard & found


def _entropy_bits(token: Column) -> Column:
    size = F.length(token).cast("double")

    def add(bits: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(token, char, F.lit("")))) / size
        return bits - share * F.log2(share)

    chars = F.filter(F.array_distinct(F.split(token, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), add)


def is_secret_token(token: Column) -> Column:
    """Opaque enough to hide: high entropy and neither a hash nor a UUID."""
    safe = F.rlike(token, F.lit("(?i)" + fv.ENTROPY_SAFE))
    return ~safe & (F.round(_entropy_bits(token), 9) >= F.lit(fv.ENTROPY_BITS))


def apply_redaction_rule(df: DataFrame, rule: tuple, source: str, target: str,
                         hits: str, fold: str | None = None) -> DataFrame:
    """One rule of the table: adds ``target`` (text) and ``hits`` (number of matches).

    ``fold`` names a column with the folded text, where the caller keeps one.
    """
    _, pattern, replacement, ignore_case, dot_all = rule
    regex = F.lit(dialect.jvm(pattern, ignore_case, dot_all))
    text = F.col(source)

    def counted(low: Column) -> Column:
        found = F.regexp_count(text, regex)
        guard = may_match(pattern, ignore_case, text, low)
        return found if guard is None else F.when(guard, found).otherwise(F.lit(0))

    count = counted(F.col(fold)) if fold is not None else let(folded(text), counted)
    return df.withColumn(hits, count).withColumn(
        target, F.when(F.col(hits) > 0, F.regexp_replace(
            text, regex, F.lit(dialect.jvm_replacement(replacement)))).otherwise(text))


def apply_entropy_rule(df: DataFrame, source: str, target: str, hits: str) -> DataFrame:
    """Mask opaque tokens: split around all candidates, mask some, join again."""
    regex = dialect.jvm(fv.ENTROPY_CANDIDATE)
    text = F.col(source)
    tokens = f"__{target}_tokens"
    secret = f"__{target}_secret"
    masks = F.zip_with(
        F.col(tokens), F.col(secret),
        lambda t, s: F.when(s, F.lit(fv.ENTROPY_REPLACEMENT)).otherwise(t))
    gaps = F.split(text, regex, -1)
    joined = F.array_join(
        F.zip_with(gaps, masks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return (
        df.withColumn(tokens, F.when(F.rlike(text, F.lit(regex)),
                                     F.regexp_extract_all(text, F.lit(regex), F.lit(0))))
        .withColumn(secret, F.transform(F.col(tokens), is_secret_token))
        .withColumns({
            target: F.when(F.exists(F.col(secret), lambda s: s), joined).otherwise(text),
            hits: F.coalesce(F.size(F.filter(F.col(secret), lambda s: s)), F.lit(0)),
        })
        .drop(tokens, secret)
    )


def with_redaction(df: DataFrame, source: str, target: str, count: str,
                   rules: tuple[tuple, ...] = fv.REDACTION_RULES) -> DataFrame:
    """All ``rules`` in order, each over the output of the one before, then the token rule, and
    the number of matches.

    A chain of projections, so that no intermediate text is evaluated twice.
    """
    fold = f"__{target}_folded"
    current, total, made = source, F.lit(0), [fold]
    df = df.withColumn(fold, folded(F.col(source)))
    # the built-in rules only cut text and put markers in, none of which makes a literal that a later
    # one needs, so the folded raw text decides; of other tables nobody knows
    raw = tuple(rules) == fv.REDACTION_RULES
    for position, rule in enumerate(rules):
        text, hits = f"__{target}_t{position}", f"__{target}_n{position}"
        df = apply_redaction_rule(df, rule, current, text, hits, fold if raw or position == 0 else None)
        total, current = total + F.col(hits), text
        made += [text, hits]
    text, hits = f"__{target}_t_last", f"__{target}_n_last"
    df = apply_entropy_rule(df, current, text, hits)
    total = total + F.col(hits)
    made += [text, hits]
    return once(df, {
        target: F.col(text),
        count: F.when(F.col(text).isNull(), F.lit(0)).otherwise(total).cast("long"),
    }).drop(*made)


# --- error lines and signature -------------------------------------------------------------------

def _is_error_line(line: Column) -> Column:
    # the byte scan decides most lines; the pattern adds the word borders
    return let(folded(line), lambda low: _any_of(low, fv.ERROR_WORDS)) & F.rlike(
        line, F.lit(_ERROR_WORD))


def error_lines(log: Column, limit: int = fv.ERROR_LINES_LISTED) -> Column:
    """Stripped lines holding an error word, first of each 200-character key, in log order."""
    def key(line: Column) -> Column:
        return F.substring(line, 1, fv.ERROR_LINE_KEY_CHARS)

    def pick(lines: Column) -> Column:
        keys = F.slice(F.array_distinct(F.transform(lines, key)), 1, limit)
        # lines no longer than the key are their own key; only with longer ones are they looked up
        whole = F.transform(keys, lambda k: F.element_at(
            F.filter(lines, lambda line: key(line) == k), 1))
        longer = F.exists(lines, lambda line: F.length(line) > fv.ERROR_LINE_KEY_CHARS)
        return F.when(longer, whole).otherwise(keys)

    found = F.transform(F.filter(F.split(log, "\n", -1), _is_error_line), strip)
    return let(found, pick)


def normalize_text(text: Column, rules: tuple[tuple, ...] = fv.VOLATILE_RULES) -> Column:
    """Replace volatile tokens, collapse white space, lower the case."""
    for _, pattern, replacement, ignore_case in rules:
        text = F.regexp_replace(
            text, F.lit(dialect.jvm(pattern, ignore_case)), F.lit(replacement))
    return F.lower(collapse_blanks(text))


def error_template(log: Column, rules: tuple[tuple, ...] = fv.VOLATILE_RULES) -> Column:
    """The normalised text a signature is made from."""
    return normalize_text(F.array_join(error_lines(log, fv.ERROR_LINES_HASHED), "\n"), rules)


def fingerprint(template: Column, pipeline: Column, node_type: Column) -> Column:
    basis = F.concat(
        F.coalesce(pipeline, F.lit("")), F.lit("|"), F.coalesce(node_type, F.lit("")),
        F.lit("|"), F.coalesce(template, F.lit("")))
    return F.substring(F.sha2(basis, 256), 1, 32)


def short_id(*parts: Column) -> Column:
    """Deterministic 32-character id of a natural key."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


# --- triage --------------------------------------------------------------------------------------

def triage_rule(log: Column, fold: Column | None = None,
                rules: tuple[tuple, ...] = fv.TRIAGE_RULES) -> Column:
    """Id of the first of ``rules`` matching anywhere in the log, null when none does.

    ``fold`` is ``folded(log)`` where the caller keeps it as a column.
    """
    if fold is None:
        return let(folded(log), lambda low: triage_rule(log, low, rules))
    chosen = None
    for rule in rules:
        rule_id, pattern = rule[0], rule[4]
        hit = _guarded(may_match(pattern, True, log, fold), F.rlike(log, F.lit(dialect.jvm(pattern, ignore_case=True))))
        chosen = F.when(hit, rule_id) if chosen is None else chosen.when(hit, rule_id)
    return chosen


def triage_quote(log: Column, rule_id: Column,
                 rules: tuple[tuple, ...] = fv.TRIAGE_RULES) -> Column:
    """The first line the rule matches, stripped, at most 500 characters."""
    quote = None
    for number, _, _, _, pattern in rules:
        line = F.regexp_extract(
            log, dialect.jvm(f"^.*?(?:{pattern}).*$", ignore_case=True, multiline=True), 0)
        cond = rule_id == F.lit(number)
        quote = F.when(cond, line) if quote is None else quote.when(cond, line)
    return F.substring(strip(quote), 1, fv.QUOTE_CHARS)


def curated_hits(log: Column, fold: Column | None = None) -> Column:
    """Ids of the curated knowledge rows whose pattern occurs in the log, ascending."""
    if fold is None:
        return let(folded(log), lambda low: curated_hits(log, low))
    hits = [
        F.when(_guarded(may_match(pattern, True, log, fold), F.rlike(
            log, F.lit(dialect.jvm(pattern, ignore_case=True, dot_all=True)))), F.lit(number))
        for number, _, pattern, _ in fv.CURATED_KB
    ]
    return F.array_compact(F.array(*hits))


# --- truncation ----------------------------------------------------------------------------------

def truncate_log(log: Column, budget: int = fv.LOG_BUDGET) -> Column:
    """Head, window around the first error line, and tail of a log above the budget."""
    quarter, window = budget // 4, budget // 2
    regex = _ERROR_LINE
    # code points before the first error line
    start = F.length(F.element_at(F.split(log, regex, 2), 1))
    middle = F.when(
        F.rlike(log, F.lit(regex)),
        F.substring(log, F.greatest(F.lit(0), start - window // 4) + 1, F.lit(window)),
    ).otherwise("")
    short = F.concat(
        F.substring(log, 1, quarter), F.lit(fv.TRUNCATION_MARKER), middle,
        F.lit(fv.TRUNCATION_MARKER), F.right(log, F.lit(quarter)))
    return F.when(F.length(log) <= budget, log).otherwise(short)
