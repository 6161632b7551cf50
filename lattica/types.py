"""Element types: their order, common supertypes, type strings, and inference from text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names and Spark types. Unsigned ones take the next wider signed type.
NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "int": T.LongType(),
    "long": T.DecimalType(38, 0), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "ulong": T.DecimalType(38, 0),
    "real32": T.FloatType(), "real64": T.DoubleType(), "number": T.DecimalType(38, 10), "string": T.StringType(), "bytes": T.StringType(), "char": T.StringType(),
    "sequence": T.StringType(), "DNA": T.StringType(), "protein": T.StringType(), "pickle": T.BinaryType(), "any": T.StringType(), "unknown": T.StringType(),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "slice": T.StructType([T.StructField(x, T.LongType()) for x in ("start", "stop", "step")]),
}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_RANK = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (*INTEGERS, T.BooleanType)) or isinstance(t, T.DecimalType) and t.scale == 0


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The most specific type that holds both; of types that share none, text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        return T.StructType([T.StructField(x.name, common_type(x.dataType, y.dataType)) for x, y in zip(a, b)])
    if is_number(a) and is_number(b):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            other = b if isinstance(a, T.DecimalType) else a
            return T.DoubleType() if isinstance(other, (T.FloatType, T.DoubleType)) else T.DecimalType(38, max(getattr(a, "scale", 0), getattr(b, "scale", 0)))
        return max(a, b, key=lambda t: _RANK.index(type(t)))
    return T.StringType()


_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\d+|[~*])|(.))")


class _Parser:
    """type := array | tuple | dict | set | name, each with optional ? or !; array := '[' dim [':' shape] ']' '<' type."""

    def __init__(self, text: str):
        self.tokens = [m.group(1) or m.group(2) or m.group(3) for m in _TOKEN.finditer(text.strip())]
        self.dims: list[str] = []

    def take(self, want: str | None = None) -> str:
        if not self.tokens or want and self.tokens[0] != want:
            raise ValueError(f"expected {want or 'a type'} at {''.join(self.tokens) or 'the end'}")
        return self.tokens.pop(0)

    def seen(self, token: str) -> bool:
        return bool(self.tokens) and self.tokens[0] == token

    def fields(self, close: str) -> T.StructType:
        out = []
        while not self.seen(close):
            name = f"f{len(out)}"
            if len(self.tokens) > 1 and self.tokens[1] == "=":
                name = self.take()
                self.take("=")
            out.append(T.StructField(name, self.type()))
            if not self.seen(close):
                self.take(",")
        self.take(close)
        return T.StructType(out)

    def dim(self, close: str) -> None:
        self.dims.append(self.take())
        if self.seen(":"):
            self.take()
            self.take()
        self.take(close)

    def type(self) -> T.DataType:
        token = self.take()
        if token == "[":
            self.dim("]")
            self.take("<")
            found: T.DataType = T.ArrayType(self.type())
        elif token == "(":
            found = self.fields(")")
        elif token == "{" and (len(self.tokens) < 2 or self.tokens[1] in "}:"):
            self.dim("}")
            self.take("<")
            found = T.ArrayType(self.type())
        elif token == "{":
            found = self.fields("}")
        elif token in NAMES:
            found = NAMES[token]
        else:
            raise ValueError(f"unknown type {token}")
        while self.tokens and self.tokens[0] in ("?", "!", "'"):
            self.take()
        return found


def create_type(text: str) -> T.DataType:
    """A type string as a Spark type."""
    parser = _Parser(text)
    found = parser.type()
    if parser.tokens:
        raise ValueError(f"left over: {''.join(parser.tokens)}")
    return found


def type_string(t: T.DataType) -> str:
    """A Spark type as a type string."""
    if isinstance(t, T.ArrayType):
        return f"[~]<{type_string(t.elementType)}"
    if isinstance(t, T.StructType):
        return f"({', '.join(f'{f.name}={type_string(f.dataType)}' for f in t)})"
    return next((n for n, x in NAMES.items() if x == t), t.simpleString())


def match_type(t: T.DataType, pattern: str) -> bool:
    """Whether a type fits a pattern: a name, several with |, or number, integer, any, array, tuple."""
    groups = {"number": is_number, "integer": is_integer, "any": lambda x: True, "array": lambda x: isinstance(x, T.ArrayType), "tuple": lambda x: isinstance(x, T.StructType)}
    return any(groups[p](t) if p in groups else NAMES.get(p) == t for p in re.split(r"\s*\|\s*", pattern.strip()))


#: Texts that stand for a missing number.
MISSING = ["", "NA", "N/A", "NaN", "nan", "--", "?", "null"]


def numeric(column: Column, kind: str) -> Column:
    """Text as a number; what stands for missing is null."""
    return F.when(~F.trim(column).isin(*MISSING), F.trim(column).try_cast(kind))


def detect(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns that hold only integers, or only numbers, besides missing marks, cast to them. One pass over all rows."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not texts:
        return df
    fails = lambda c, kind: F.count(F.when(F.col(c).isNotNull() & ~F.trim(F.col(c)).isin(*MISSING) & F.trim(F.col(c)).try_cast(kind).isNull(), 1))
    row = df.agg(*(fails(c, k).alias(f"{c}:{k}") for c in texts for k in ("bigint", "double")), *(F.count(c).alias(f"{c}:n") for c in texts)).first()
    cast = {}
    for c in texts:
        if row[f"{c}:n"]:
            if not row[f"{c}:bigint"]:
                cast[c] = numeric(F.col(c), "bigint")
            elif not row[f"{c}:double"]:
                cast[c] = numeric(F.col(c), "double")
    return df.withColumns(cast) if cast else df
