"""NumPy's rules where Spark's differ: NaN, division, overflow, equality across types."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import FeatureOperationError

NAN, INF = float("nan"), float("inf")


def _like(kind: T.DataType, value: Any) -> bool:
    """Whether a value can equal one of this type."""
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return isinstance(value, (bool, int, float))
    return True


def matches(df: DataFrame, key: str, wanted: Any) -> Column:
    """Whether a column equals a value or one of several; NaN equals nothing, and neither does a value of another type."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.ArrayType):
        raise FeatureOperationError(f"feature {key!r} has more than one value a node")
    several = isinstance(wanted, (list, tuple, set, frozenset)) or type(wanted).__module__ == "numpy" and getattr(wanted, "ndim", 0) > 0
    values = [v.item() if type(v).__module__ == "numpy" else v for v in (list(wanted) if several else [wanted])]
    if several and any(isinstance(v, str) for v in values) and not all(isinstance(v, str) for v in values):
        values = [str(v) for v in values]  # a mixed list becomes one of strings
    values = [v for v in values if _like(kind, v) and not (isinstance(v, float) and math.isnan(v))]
    if not values:
        return F.lit(False)
    column = F.col(key).cast("int") if isinstance(kind, T.BooleanType) else F.col(key)
    if isinstance(kind, T.BooleanType):
        values = [v if isinstance(v, float) else int(v) for v in values]
    if isinstance(kind, T.IntegralType) and any(isinstance(v, float) for v in values):
        column = column.cast("double")
        values = [float(v) for v in values]
    return column == F.lit(values[0]) if len(values) == 1 else column.isin(values)


def _d(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    a, b = _d(a), _d(b)
    zero = F.when((a == 0) | F.isnan(a), NAN).otherwise(F.when((a > 0) == (F.atan2(F.lit(0.0), b) == 0), INF).otherwise(-INF))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def floor_divide(a: Column, b: Column) -> Column:
    """Over whole numbers: floors, and 0 for a zero divisor."""
    q = F.floor(_d(a) / F.nullif(_d(b), F.lit(0.0)))
    return F.coalesce(q, F.lit(0)).cast("long")


def remainder(a: Column, b: Column) -> Column:
    """Over whole numbers: the sign of the divisor, and 0 for a zero divisor."""
    safe = F.nullif(b, F.lit(0))
    r = a % safe
    return F.coalesce(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r), F.lit(0)).cast("long")


def wrap(column: Column, bits: int) -> Column:
    """A whole number (as decimal(38,0)) wrapped to a signed width."""
    span, half = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (bits, bits - 1))
    wide = F.pmod(column.cast("decimal(38,0)") + half, span) - half
    return wide.cast({8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits])


def _cmp(op: str):
    def compare(a: Column, b: Column) -> Column:
        a, b = _d(a), _d(b)
        nan = F.isnan(a) | F.isnan(b)
        result = {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "!=": a != b}[op]
        return F.when(nan, F.lit(op == "!=")).otherwise(result)

    return compare


def _log(function) -> Any:
    """Logarithms: minus infinity at 0 and NaN below, where Spark has null."""
    return lambda a: F.when(_d(a) == 0, -INF).when(_d(a) < 0, NAN).otherwise(function(_d(a)))


def _log1p(a: Column) -> Column:
    return F.when(_d(a) == -1, -INF).when(_d(a) < -1, NAN).otherwise(F.log1p(_d(a)))


def _nan_wins(pick) -> Any:
    return lambda a, b: F.when(F.isnan(_d(a)) | F.isnan(_d(b)), NAN).otherwise(pick(_d(a), _d(b)))


def _nan_loses(pick) -> Any:
    return lambda a, b: F.when(F.isnan(_d(a)), _d(b)).when(F.isnan(_d(b)), _d(a)).otherwise(pick(_d(a), _d(b)))


def _truth(c: Column) -> Column:
    return F.when(F.isnan(_d(c)), True).otherwise(_d(c) != 0)


def _floor(a: Column) -> Column:
    """Spark's floor is a whole number; doubles from 2**53 on, infinities and NaN are their own floor."""
    return F.when(F.abs(_d(a)) < 2.0**53, _d(F.floor(_d(a)))).otherwise(_d(a))


def _ceil(a: Column) -> Column:
    return F.when(F.abs(_d(a)) < 2.0**53, _d(F.ceil(_d(a)))).otherwise(_d(a))


def fmod(a: Column, b: Column) -> Column:
    """Over floats: the sign of the dividend, NaN for a zero divisor or an infinite dividend."""
    a, b = _d(a), _d(b)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), NAN).when(F.abs(b) == INF, a).otherwise(a % F.nullif(b, F.lit(0.0)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turns(m: Column, b: Column) -> Column:
    return (m != 0) & ~F.isnan(m) & ((m < 0) != (b < 0))


def float_remainder(a: Column, b: Column) -> Column:
    """Over floats: the sign of the divisor, NaN for a zero divisor; an infinite divisor of the other sign is the result."""
    b = _d(b)
    return _let(fmod(a, b), lambda m: F.when(_turns(m, b), F.when(F.abs(b) == INF, b).otherwise(m + b)).when(m == 0, copysign(m, b)).otherwise(m))


def float_floor_divide(a: Column, b: Column) -> Column:
    """Over floats: the floor of the quotient, by way of the remainder; as division for a zero divisor."""
    a, b = _d(a), _d(b)

    def rounded(q: Column) -> Column:
        return F.when(q == 0, F.when((a < 0) != (b < 0), F.lit(-0.0)).otherwise(F.lit(0.0))).otherwise(_let(_floor(q), lambda n: F.when(q - n > 0.5, n + 1).otherwise(n)))

    safe = F.nullif(b, F.lit(0.0))
    whole = _let(fmod(a, b), lambda m: F.when(F.isnan(m), NAN).otherwise(_let((a - m) / safe - F.when(_turns(m, b), 1.0).otherwise(0.0), rounded)))
    return F.when(b == 0, divide(a, b)).otherwise(whole)


def whole_power(a: Column, b: Column) -> Column:
    """Over whole numbers, exact; a negative exponent raises, and so does overflow."""
    raised = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(b, F.lit(64)), F.lit(1)).cast("int")), F.lit(1).cast("long"), lambda s, _: s * a.cast("long"))
    small = F.when(b == 0, F.lit(1).cast("long")).when(a.isin(0, 1), a.cast("long")).when(a == -1, F.when(b % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long"))
    refuse = F.raise_error(F.lit("Integers to negative integer powers are not allowed.")).cast("long")
    return F.when(b < 0, refuse).otherwise(F.coalesce(small, raised))


def trunc(a: Column) -> Column:
    return F.when(_d(a) < 0, _ceil(a)).otherwise(_floor(a))


def modf(a: Column) -> tuple[Column, Column]:
    return _d(a) - trunc(a), trunc(a)


def _signbit(a: Column) -> Column:
    return (_d(a) < 0) | ((_d(a) == 0) & (F.atan2(_d(a), F.lit(-1.0)) < 0))


def copysign(a: Column, b: Column) -> Column:
    return F.when(_signbit(b), -F.abs(_d(a))).otherwise(F.abs(_d(a)))


def gcd(a: Column, b: Column) -> Column:
    """Euclid, 93 steps being enough for 64 bits; stays on the JVM."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0))).alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") * b.cast("long")) / F.nullif(gcd(a, b), F.lit(0))).cast("long")


def _exponent(a: Column) -> Column:
    """The e with 2**(e - 1) <= |a| < 2**e."""
    guess = F.floor(F.log2(F.abs(_d(a)))).cast("int")
    power = F.pow(F.lit(2.0), _d(guess))
    guess = F.when(power > F.abs(_d(a)), guess - 1).when(power * 2 <= F.abs(_d(a)), guess + 1).otherwise(guess)
    return F.when((_d(a) == 0) | F.isnan(_d(a)) | (F.abs(_d(a)) == INF), F.lit(0)).otherwise(guess + 1).cast("int")


def frexp(a: Column) -> tuple[Column, Column]:
    e = _exponent(a)
    return F.when(e == 0, F.when(F.abs(_d(a)) >= 0.5, _d(a)).otherwise(_d(a))).otherwise(_d(a) / F.pow(F.lit(2.0), _d(e))), e


def spacing(a: Column) -> Column:
    return F.when(_d(a) == 0, F.lit(5e-324)).otherwise(copysign(F.pow(F.lit(2.0), _d(_exponent(a) - 53)), a))


def nextafter(a: Column, b: Column) -> Column:
    """The neighbouring double towards b, for normal numbers."""
    up = _d(b) > _d(a)
    grow = up == (_d(a) >= 0)
    step = F.pow(F.lit(2.0), _d(_exponent(a) - 53))
    edge = F.abs(_d(a)) == F.pow(F.lit(2.0), _d(_exponent(a) - 1))
    step = F.when(~grow & edge, step / 2).otherwise(step)
    return F.when(_d(a) == _d(b), _d(b)).when(_d(a) == 0, F.when(up, 5e-324).otherwise(-5e-324)).otherwise(_d(a) + F.when(up, step).otherwise(-step))


def logaddexp(a: Column, b: Column) -> Column:
    return F.when(_d(a) == _d(b), _d(a) + math.log(2.0)).otherwise(F.greatest(_d(a), _d(b)) + F.log1p(F.exp(-F.abs(_d(a) - _d(b)))))


def logaddexp2(a: Column, b: Column) -> Column:
    return F.when(_d(a) == _d(b), _d(a) + 1.0).otherwise(F.greatest(_d(a), _d(b)) + F.log1p(F.pow(F.lit(2.0), -F.abs(_d(a) - _d(b)))) / math.log(2.0))


def _isfinite(a: Column) -> Column:
    return ~(F.isnan(_d(a)) | (F.abs(_d(a)) == INF))


def norm(vector: Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + _d(x) * _d(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def matvec(matrix: list[list[float]], vector: Column) -> Column:
    """A literal matrix times each row's vector, unrolled into expressions."""
    return F.array(*(sum((F.lit(float(m)) * _d(F.element_at(vector, k + 1)) for k, m in enumerate(row)), F.lit(0.0)) for row in matrix))


def vecmat(vector: Column, matrix: list[list[float]]) -> Column:
    return matvec([list(c) for c in zip(*matrix, strict=True)], vector)


def broadcast(vector: Column, other: Any, function) -> Column:
    """A function of each component and a scalar, a literal row, or a column of one value a node."""
    if isinstance(other, (list, tuple)):
        return F.zip_with(vector, F.array(*(F.lit(float(x)) for x in other)), function)
    return F.transform(vector, lambda x: function(x, other if isinstance(other, Column) else F.lit(other)))


_same = lambda a: a
#: Every ufunc by name, as a function of Columns; aliases share an entry.
UFUNCS: dict[str, Any] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "negative": lambda a: -a, "positive": _same,
    "divide": divide, "true_divide": divide, "reciprocal": lambda a: divide(F.lit(1.0), a),
    "floor_divide": floor_divide, "remainder": remainder, "mod": remainder, "divmod": lambda a, b: (floor_divide(a, b), remainder(a, b)), "fmod": lambda a, b: a % F.nullif(b, F.lit(0)),
    "power": lambda a, b: F.pow(a, b), "pow": lambda a, b: F.pow(a, b), "float_power": lambda a, b: F.pow(_d(a), _d(b)), "square": lambda a: a * a, "sqrt": lambda a: F.sqrt(_d(a)), "cbrt": lambda a: F.cbrt(_d(a)),
    "absolute": F.abs, "abs": F.abs, "fabs": lambda a: F.abs(_d(a)), "sign": lambda a: F.when(F.isnan(_d(a)), NAN).otherwise(F.signum(_d(a))), "copysign": copysign, "signbit": _signbit,
    "heaviside": lambda a, b: F.when(F.isnan(_d(a)), NAN).when(_d(a) == 0, _d(b)).when(_d(a) > 0, 1.0).otherwise(0.0),
    "exp": lambda a: F.exp(_d(a)), "exp2": lambda a: F.pow(F.lit(2.0), _d(a)), "expm1": lambda a: F.expm1(_d(a)), "log": _log(F.ln), "log2": _log(F.log2), "log10": _log(F.log10), "log1p": _log1p, "logaddexp": logaddexp, "logaddexp2": logaddexp2,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin, "asin": F.asin, "arccos": F.acos, "acos": F.acos, "arctan": F.atan, "atan": F.atan, "arctan2": F.atan2, "atan2": F.atan2,
    "arcsinh": F.asinh, "asinh": F.asinh, "arccosh": F.acosh, "acosh": F.acosh, "arctanh": F.atanh, "atanh": F.atanh, "hypot": F.hypot, "degrees": F.degrees, "rad2deg": F.degrees, "radians": F.radians, "deg2rad": F.radians,
    "floor": _floor, "ceil": _ceil, "trunc": trunc, "rint": lambda a: F.rint(_d(a)), "modf": modf, "frexp": frexp, "ldexp": lambda a, b: _d(a) * F.pow(F.lit(2.0), _d(b)), "nextafter": nextafter, "spacing": spacing,
    "maximum": _nan_wins(F.greatest), "minimum": _nan_wins(F.least), "fmax": _nan_loses(F.greatest), "fmin": _nan_loses(F.least),
    "equal": _cmp("=="), "not_equal": _cmp("!="), "less": _cmp("<"), "less_equal": _cmp("<="), "greater": _cmp(">"), "greater_equal": _cmp(">="),
    "logical_and": lambda a, b: _truth(a) & _truth(b), "logical_or": lambda a, b: _truth(a) | _truth(b), "logical_xor": lambda a, b: _truth(a) != _truth(b), "logical_not": lambda a: ~_truth(a),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b), "invert": F.bitwise_not, "bitwise_not": F.bitwise_not, "bitwise_invert": F.bitwise_not,
    "left_shift": lambda a, n: F.call_function("shiftleft", a, n), "bitwise_left_shift": lambda a, n: F.call_function("shiftleft", a, n), "right_shift": lambda a, n: F.call_function("shiftright", a, n), "bitwise_right_shift": lambda a, n: F.call_function("shiftright", a, n), "bitwise_count": lambda a: F.bit_count(F.abs(a)),
    "isnan": lambda a: F.isnan(_d(a)), "isinf": lambda a: F.abs(_d(a)) == INF, "isfinite": _isfinite, "isnat": lambda a: a.isNull(),
    "gcd": gcd, "lcm": lcm, "conj": _same, "conjugate": _same, "matmul": dot, "vecdot": dot, "matvec": matvec, "vecmat": vecmat,
    "str_len": F.length, "isalpha": lambda a: a.rlike(r"^\p{L}+$"), "isdigit": lambda a: a.rlike(r"^\p{Nd}+$"), "isalnum": lambda a: a.rlike(r"^[\p{L}\p{N}]+$"), "isspace": lambda a: a.rlike(r"^\s+$"),
    "isupper": lambda a: a.rlike(r"\p{Lu}") & ~a.rlike(r"\p{Ll}"), "islower": lambda a: a.rlike(r"\p{Ll}") & ~a.rlike(r"\p{Lu}"), "isdecimal": lambda a: a.rlike(r"^\p{Nd}+$"), "isnumeric": lambda a: a.rlike(r"^\p{N}+$"), "istitle": lambda a: a.rlike(r"^\P{L}*(\p{Lu}\p{Ll}*\P{L}*)+$"),
}
#: Ufuncs whose result is a plain array, not a feature.
PLAIN = frozenset("equal not_equal less less_equal greater greater_equal logical_and logical_or logical_xor logical_not".split())


#: Ufuncs for which whole numbers, or floats, need a rule of their own.
WHOLE: dict[str, Any] = {
    "power": whole_power, "pow": whole_power, "maximum": F.greatest, "minimum": F.least, "fmax": F.greatest, "fmin": F.least, "floor": _same, "ceil": _same, "trunc": _same, "square": lambda a: a * a,
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b,
    "fmod": lambda a, b: F.coalesce(a % F.nullif(b, F.lit(0)), F.lit(0)), "floor_divide": lambda a, b: whole_floor_divide(a, b), "divmod": lambda a, b: (whole_floor_divide(a, b), remainder(a, b)),
}
FLOATS: dict[str, Any] = {
    "floor_divide": float_floor_divide, "remainder": float_remainder, "mod": float_remainder, "fmod": fmod, "divmod": lambda a, b: (float_floor_divide(a, b), float_remainder(a, b)),
}


def whole_floor_divide(a: Column, b: Column) -> Column:
    """Over whole numbers, exact: the quotient without its remainder, 0 for a zero divisor."""
    return F.coalesce(F.call_function("div", a - remainder(a, b), F.nullif(b, F.lit(0))), F.lit(0)).cast("long")


def ufunc(name: str, kinds: list[T.DataType]) -> Any:
    """The ufunc for operands of these types."""
    if name not in UFUNCS:
        raise FeatureOperationError(f"no ufunc {name!r}")
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return WHOLE.get(name, UFUNCS[name])
    if any(isinstance(k, T.FractionalType) for k in kinds):
        return FLOATS.get(name, UFUNCS[name])
    return UFUNCS[name]
