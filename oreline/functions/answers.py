"""Fields of a model's JSON answer, parsed once into a VARIANT: a field of another kind than wanted is read as far as it can be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def with_object(raw: Column, use, otherwise: Column) -> Column:
    """use(variant) where a text is a JSON object, else the other value; the text is parsed once."""
    return let(F.try_parse_json(raw), lambda v: F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), use(v)).otherwise(otherwise))


def text_of(v: Column, name: str) -> Column:
    """A field as text, numbers and truth values as JSON writes them; null for none and for null."""
    return F.try_variant_get(v, f"$.{name}", "string")


def number_of(v: Column, name: str) -> Column:
    """A field as a number, also one written as a string; null if it is none, and for truth values."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))
    return F.when(kind != "BOOLEAN", F.try_variant_get(v, f"$.{name}", "double"))


def texts_of(v: Column, name: str) -> Column:
    """The elements of a list, each as text; nested lists and objects as JSON.  Nulls are left out; null where the field is no list."""
    elements = F.try_variant_get(v, f"$.{name}", "array<variant>")
    return F.filter(F.transform(elements, lambda x: F.try_variant_get(x, "$", "string")), lambda s: s.isNotNull())
