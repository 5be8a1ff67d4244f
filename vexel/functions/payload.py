"""Conditions on JSON payloads, two-valued and strict about types.

A comparison is true only if the field holds a value of the literal's own kind (number, string or boolean); `ne` is the
negation of `eq`, so it holds where the field is missing or of another kind. A row without a payload fails every
condition. Conditions combine with & and | like any Column. Fields are flat keys; a dot is part of the name.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))$"


class Payload:
    def __init__(self, column: str | Column = "payload"):
        self.column = column

    @property
    def text(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    @property
    def json(self) -> Column:
        return F.try_parse_json(self.text)

    def _holds(self, field: str, test) -> Column:
        """Whether the test holds for the field's value, which is parsed once; false where there is none."""
        quote = '"' if "'" in field else "'"
        if quote in field:
            raise ValueError(f"a field name can't hold both kinds of quotes: {field}")
        value = F.try_variant_get(self.json, f"$[{quote}{field}{quote}]", "variant")
        # a one-element array binds the parsed value for all that the test asks of it
        return F.coalesce(F.exists(F.array(value), test), F.lit(False))

    @staticmethod
    def _is(value: Column, literal, compare) -> Column:
        """compare(value, literal) for values of the literal's kind."""
        kind = F.schema_of_variant(value)
        if isinstance(literal, bool):
            return (kind == "BOOLEAN") & compare(F.try_variant_get(value, "$", "boolean"), F.lit(literal))
        if isinstance(literal, (int, float)):
            return kind.rlike(NUMBERS) & compare(F.try_variant_get(value, "$", "double"), F.lit(float(literal)))
        return (kind == "STRING") & compare(F.try_variant_get(value, "$", "string"), F.lit(literal))

    def _compare(self, field: str, literal, compare) -> Column:
        return self._holds(field, lambda v: self._is(v, literal, compare))

    def eq(self, field: str, literal) -> Column:
        return self._compare(field, literal, lambda v, w: v == w)

    def ne(self, field: str, literal) -> Column:
        return self.text.isNotNull() & ~self.eq(field, literal)

    def lt(self, field: str, literal) -> Column:
        return self._compare(field, literal, lambda v, w: v < w)

    def le(self, field: str, literal) -> Column:
        return self._compare(field, literal, lambda v, w: v <= w)

    def gt(self, field: str, literal) -> Column:
        return self._compare(field, literal, lambda v, w: v > w)

    def ge(self, field: str, literal) -> Column:
        return self._compare(field, literal, lambda v, w: v >= w)

    def isin(self, field: str, literals) -> Column:
        """Literals may be of several kinds; none is an error."""
        if not literals:
            raise ValueError("isin needs at least one literal")
        return self._holds(field, lambda v: reduce(lambda a, b: a | b, [self._is(v, x, lambda a, b: a == b) for x in literals]))
