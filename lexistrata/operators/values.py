"""Loosely typed values behind one face: VARIANT expressions and expressions of a declared type.

A value is a piece of SQL with its declared type, if it has one. With a declared type, members are plain struct fields, so
that the optimizer prunes nested columns down to the scan; a VARIANT is asked at run time. A null member of a struct counts
as missing, a null member of a VARIANT object as there. Expressions are text, as a projection of many columns is built from
thousands of nodes: parsed in one go they cost milliseconds, made one by one through the gateway they cost seconds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text forms of VARIANT values other than texts that count as nothing.
_NOTHING = "('0', '0.0', 'false', '[]', '{}')"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_names = itertools.count()


def fresh() -> str:
    """A name for a lambda variable that no enclosing one has."""
    return f"_x{next(_names)}"


def literal(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def either(*texts: str) -> str:
    """The first text that is neither null nor empty, else the empty string."""
    return "coalesce(" + ", ".join(f"nullif({text}, '')" for text in texts) + ", '')"


def compact_sql(values: str, limit: int) -> str:
    """The first distinct non-blank texts of an array, trimmed, in one cell parted by bars."""
    v = fresh()
    trimmed = f"transform({values}, {v} -> regexp_replace({v}, r'(?U)^\\s+|\\s+$', ''))"
    return f"array_join(slice(array_distinct(filter({trimmed}, {v} -> coalesce({v}, '') <> '')), 1, {limit}), ' | ')"


class Value:
    """One value: ``kind`` is its declared type, VARIANT or, for a value that is never there, the type of null."""

    def __init__(self, sql: str, kind: T.DataType) -> None:
        self.sql, self.kind = sql, kind

    @property
    def dynamic(self) -> bool:
        """Whether the type is known at run time only."""
        return isinstance(self.kind, T.VariantType)

    @property
    def never(self) -> bool:
        """Whether the declared type has no such member at all."""
        return isinstance(self.kind, T.NullType)

    def member(self, name: str) -> Value:
        """A member of an object, missing where the value is no object."""
        if self.dynamic:
            return Value(f"try_variant_get({self.sql}, {literal(f'''$['{name}']''')}, 'variant')", self.kind)
        if isinstance(self.kind, T.StructType) and name in self.kind.names:
            return Value(f"{self.sql}.`{name}`", self.kind[name].dataType)
        return MISSING

    def as_variant(self) -> str:
        """The value as a VARIANT."""
        if self.dynamic:
            return self.sql
        return f"try_variant_get(try_parse_json(to_json(named_struct('v', {self.sql}))), '$.v', 'variant')"

    def is_object(self) -> str:
        """Whether the value is an object; false for a missing one."""
        if self.dynamic:
            return f"coalesce(startswith(schema_of_variant({self.sql}), 'OBJECT'), false)"
        return f"({self.sql} IS NOT NULL)" if isinstance(self.kind, (T.StructType, T.MapType)) else "false"

    def there(self) -> str:
        """Whether the value is there, be it a VARIANT null."""
        return f"({self.sql} IS NOT NULL)"

    def truthy(self) -> str:
        """Whether the value counts as something: an empty text, list or object, zero and false do not."""
        s = self.sql
        if self.dynamic:
            text = f"try_variant_get({s}, '$', 'string')"
            return f"CASE WHEN coalesce({text}, '') = '' THEN false WHEN {text} IN {_NOTHING} THEN startswith(to_json({s}), '\"') ELSE true END"
        if isinstance(self.kind, T.StringType):
            found = f"{s} <> ''"
        elif isinstance(self.kind, (T.ArrayType, T.MapType)):
            found = f"size({s}) > 0"
        elif isinstance(self.kind, T.StructType):
            found = " OR ".join(f"{s}.`{name}` IS NOT NULL" for name in self.kind.names) or "false"
        elif isinstance(self.kind, _NUMBERS):
            found = f"{s} <> 0"
        elif isinstance(self.kind, T.BooleanType):
            found = s
        else:
            found = f"{s} IS NOT NULL"
        return "false" if self.never else f"coalesce({found}, false)"

    def text(self) -> str:
        """Texts as they are, nothing as the empty string, anything else as JSON."""
        return f"coalesce({self.text_if_there()}, '')" if not self.never else "''"

    def text_if_there(self) -> str:
        """``text``, null where the value is missing."""
        if self.never:
            return "CAST(NULL AS STRING)"
        if isinstance(self.kind, T.StringType):
            return self.sql
        text = f"try_variant_get({self.as_variant()}, '$', 'string')"
        return f"CASE WHEN {self.sql} IS NOT NULL THEN coalesce({text}, '') END"

    def text_if_truthy(self) -> str:
        """``text``, null where the value counts as nothing."""
        if self.never or isinstance(self.kind, T.StringType):
            return "CAST(NULL AS STRING)" if self.never else f"nullif({self.sql}, '')"
        return f"CASE WHEN {self.truthy()} THEN {self.text()} END"

    def items(self) -> Value:
        """The items of a list, none for anything else."""
        if isinstance(self.kind, T.ArrayType):
            return Value(f"coalesce({self.sql}, CAST(array() AS {_declared(self.kind)}))", self.kind)
        none = "CAST(array() AS ARRAY<VARIANT>)"
        found = f"coalesce(try_variant_get({self.sql}, '$', 'array<variant>'), {none})" if self.dynamic else none
        return Value(found, T.ArrayType(T.VariantType()))

    def one_or_more(self) -> Value:
        """The items of a list, or the one object in its place."""
        if self.dynamic:
            listed = f"try_variant_get({self.sql}, '$', 'array<variant>')"
            one = f"CASE WHEN {self.is_object()} THEN array({self.sql}) END"
            return Value(f"coalesce({listed}, {one}, CAST(array() AS ARRAY<VARIANT>))", T.ArrayType(T.VariantType()))
        if isinstance(self.kind, T.StructType):
            kind = T.ArrayType(self.kind)
            return Value(f"CASE WHEN {self.sql} IS NOT NULL THEN array({self.sql}) ELSE CAST(array() AS {_declared(kind)}) END", kind)
        return self.items()

    def each(self, use: Callable[[Value], str]) -> str:
        """``use`` of every item of a list."""
        v = fresh()
        return f"transform({self.sql}, {v} -> {use(Value(v, self.kind.elementType))})"

    def only(self, test: Callable[[Value], str]) -> Value:
        """The items of a list that pass a test."""
        v = fresh()
        return Value(f"filter({self.sql}, {v} -> {test(Value(v, self.kind.elementType))})", self.kind)


#: A value that is never there.
MISSING = Value("NULL", T.NullType())


def _declared(kind: T.DataType) -> str:
    """A type as SQL, with names quoted."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_declared(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"MAP<{_declared(kind.keyType)}, {_declared(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"`{f.name}`: {_declared(f.dataType)}" for f in kind.fields) + ">"
    return kind.simpleString()


def of(df: DataFrame, name: str) -> Value:
    """A column of a table as a value."""
    return Value(f"`{name}`", df.schema[name].dataType)


def first_list(*choices: tuple[str | None, Value]) -> Value:
    """The first list whose test holds, the last one without a test; lists of unlike items become lists of VARIANT.

    Choices whose test is the literal ``false`` are no choices.
    """
    live = [(test, value) for test, value in choices if test != "false"]
    some = [(test, value) for test, value in live if value.sql != MISSING.items().sql] or live[-1:]
    if len({value.kind.simpleString() for _, value in some}) > 1:
        some = [(test, Value(value.each(Value.as_variant), T.ArrayType(T.VariantType()))) for test, value in some]
    kind = some[0][1].kind
    none = f"CAST(array() AS {_declared(kind)})"
    parts = "".join(f" WHEN {test} THEN {value.sql}" for test, value in some if test is not None)
    last = next((value.sql for test, value in some if test is None), none)
    return Value(f"CASE{parts} ELSE {last} END" if parts else last, kind)
