"""Reading JSON payloads field by field, telling a missing key from an explicit null.

A payload is read twice in one pass over the row: with text fields, which give the values, and as
a variant, which gives their JSON types.  A field without variant is missing, a variant null is an
explicit null, and the variant's type tells ``5`` from ``"5"``.  (Casting variants to text row by
row is far slower than reading text fields.)
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once

NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def kind(value: Column) -> Column:
    """JSON type of a variant: STRING, BIGINT, VOID, OBJECT, ARRAY, ...; null when missing."""
    schema = F.schema_of_variant(value)
    return F.substring_index(F.substring_index(schema, "<", 1), "(", 1)


def variants(names: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"{n} variant" for n in names) + ">"


@dataclass(frozen=True)
class Field:
    """One field of a payload: its text, its JSON type (null when missing) and its variant."""

    text: Column
    kind: Column
    value: Column

    def missing(self) -> Column:
        return self.kind.isNull()

    def null(self) -> Column:
        return self.of("VOID")

    def of(self, *kinds: str) -> Column:
        return F.coalesce(self.kind.isin(*kinds), F.lit(False))

    def string(self) -> Column:
        """The text of a JSON string, null for anything else."""
        return F.when(self.of("STRING"), self.text)

    def not_string(self) -> Column:
        """Present, but not a string."""
        return ~self.missing() & ~self.of("STRING")

    def present_but_not(self, wanted: str) -> Column:
        return ~self.missing() & ~self.of(wanted)

    def truthy(self) -> Column:
        """Present and neither null, false, zero, empty text, empty list nor empty object."""
        number = self.text.try_cast("double")
        return F.coalesce(
            F.when(self.of("STRING"), self.text != "")
            .when(self.of("BOOLEAN"), self.text == "true")
            .when(self.of(*NUMBERS), number != 0)
            .when(self.of("ARRAY", "OBJECT"), ~self.text.isin("[]", "{}")), F.lit(False))

    def shown(self) -> Column:
        """Text as the feeds' own language prints the value: the string itself, True, None, 5."""
        return (
            F.when(self.null(), "None")
            .when(self.of("BOOLEAN"), F.initcap(self.text))
            .otherwise(self.text)
        )

    def integer(self) -> Column:
        """Numbers cut toward zero, booleans as 0 and 1, texts of digits; else null."""
        digits = F.replace(F.trim(self.text), F.lit("_"), F.lit(""))
        return (
            F.when(self.of(*NUMBERS), self.text.try_cast("double").try_cast("int"))
            .when(self.of("BOOLEAN"), F.when(self.text == "true", 1).otherwise(0))
            .when(self.of("STRING") & F.rlike(digits, F.lit(r"^[+-]?\d+$")),
                  digits.try_cast("int"))
        )


@dataclass(frozen=True)
class Doc:
    """A JSON object as structs of texts, of JSON types, and of variants."""

    texts: Column
    kinds: Column
    values: Column

    def __getitem__(self, name: str) -> Field:
        return Field(self.texts[name], self.kinds[name], self.values[name])


def kinds(values: Column, names: tuple[str, ...]) -> Column:
    """The types of all fields, computed once: later checks compare short texts."""
    return F.struct(*[kind(values[n]).alias(n) for n in names])


def paired(item: Column) -> Doc:
    """An element made by ``pair_items``."""
    return Doc(item["texts"], item["kinds"], item["values"])


def pair_items(texts: Column, value: Column, names: tuple[str, ...]) -> Column:
    """A JSON list of objects, element by element; null when it is anything else."""
    items = F.try_variant_get(value, "$", f"array<{variants(names)}>")
    return F.when(items.isNotNull(), F.zip_with(texts, items, lambda t, v: F.struct(
        t.alias("texts"), kinds(v, names).alias("kinds"), v.alias("values"))))


def parsed(feed: DataFrame, texts: str, names: tuple[str, ...]) -> DataFrame:
    """Replace ``payload`` by the parts of a ``Doc``; ``__values`` is null unless it is an object."""
    read = once(feed, {
        "__json": F.try_parse_json("payload"),
        "__texts": F.from_json("payload", texts)})
    cut = once(read, {"__values": F.try_variant_get("__json", "$", variants(names))})
    return once(cut, {"__kinds": kinds(F.col("__values"), names)}).drop("payload", "__json")


def document() -> Doc:
    return Doc(F.col("__texts"), F.col("__kinds"), F.col("__values"))


def as_events(rows: DataFrame, made: Column) -> DataFrame:
    """The columns of a struct next to the feed's own, evaluated once."""
    found = once(rows, {"__event": made})
    return found.select("event_id", "received_at", "workspace_id", "__event.*")


@dataclass
class Checks:
    """Collects (condition, reason) pairs; the first that holds refuses the whole event."""

    found: list[tuple[Column, str]] = field(default_factory=list)

    def refuse_when(self, condition: Column, reason: str) -> None:
        self.found.append((F.coalesce(condition, F.lit(False)), reason))

    def reason(self) -> Column:
        chosen = F.lit(None).cast("string")
        for condition, text in reversed(self.found):
            chosen = F.when(condition, text).otherwise(chosen)
        return chosen
