"""Values as the JSON text in which rows store them."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of JSON strings; other control characters are written by number.
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPES = _SHORT | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in _SHORT}


def _string(value: Column) -> Column:
    escaped = functools.reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ESCAPES.items(), value)
    return F.concat(F.lit('"'), F.when(value.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(value), F.lit('"'))


def json_text(value: Column, kind: T.DataType) -> Column:
    """JSON of strings, whole numbers, booleans, arrays, maps with string keys and structs.

    A comma and a colon are followed by a blank, and letters beyond ASCII stand as they
    are.  Null is ``null``; members keep their order, also those that are null.
    """
    if isinstance(kind, T.StringType):
        out = _string(value)
    elif isinstance(kind, T.IntegralType | T.BooleanType):
        out = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        members = F.transform(F.map_entries(value), lambda x: F.concat(_string(x["key"]), F.lit(": "), json_text(x["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        members = [F.concat(_string(F.lit(f.name)), F.lit(": "), json_text(value[f.name], f.dataType)) for f in kind]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    else:
        raise TypeError(f"no JSON text for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)
