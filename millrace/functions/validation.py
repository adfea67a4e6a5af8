"""JSON Schema keywords compiled to Catalyst predicates over a VARIANT.

Nothing here looks at data on the driver: a schema becomes a list of
``(violated, message)`` columns, each ``violated`` being a non-null boolean that
Spark evaluates inside whole-stage codegen. Keywords that cannot be expressed raise
``SchemaError`` when the plan is built, never silently at run time.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A declared schema cannot be parsed or compiled."""


ANNOTATIONS = frozenset(
    "$schema $id $comment $defs $anchor definitions title description default examples "
    "format deprecated readOnly writeOnly contentEncoding contentMediaType".split()
)


@dataclass(frozen=True)
class Node:
    """A JSON value in a plan: its VARIANT (NULL when absent), its type name, and the one
    conversion of it that is already at hand, if any."""

    value: Column
    type: Column
    at_hand: tuple[str, Column] | None = None

    @classmethod
    def of(cls, value: Column) -> "Node":
        return cls(value, F.schema_of_variant(value))

    def first(self) -> "Node":
        return Node.of(F.try_variant_get(self.value, "$[0]", "variant"))

    def child(self, name: str) -> "Node":
        return Node.of(field_of(self.value, name))

    def get(self, ddl: str) -> Column:
        if self.at_hand is not None and self.at_hand[0] == ddl:
            return self.at_hand[1]
        return F.try_variant_get(self.value, "$", ddl)

    @property
    def present(self) -> Column:
        return self.value.isNotNull()

    def is_a(self, kind: str) -> Column:
        if kind == "integer":
            whole = self.type.startswith("DECIMAL") & self.type.endswith(",0)")
            return (self.type == "BIGINT") | whole
        if kind == "number":
            return self.type.isin("BIGINT", "DOUBLE", "FLOAT") | self.type.startswith("DECIMAL")
        if kind == "object":
            return self.type.startswith("OBJECT")
        if kind == "array":
            return self.type.startswith("ARRAY")
        names = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
        if kind not in names:
            raise SchemaError(f"unknown type {kind!r}")
        return self.type == names[kind]


def field_of(value: Column, name: str) -> Column:
    """The named member of an object VARIANT, as a VARIANT; NULL when absent."""
    quote = "'" if "'" not in name else '"'
    if quote in name or "\\" in name:
        raise SchemaError(f"field name {name!r} cannot be addressed")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def _equals(node: Node, const: object) -> Column:
    if const is None:
        return _sure(node.is_a("null"))
    if isinstance(const, bool):
        return _sure(node.is_a("boolean") & (node.get("boolean") == const))
    if isinstance(const, int):
        return _sure(node.is_a("number") & _equals_whole(node, const))
    if isinstance(const, float):
        return _sure(node.is_a("number") & (node.get("double") == const))
    if isinstance(const, str):
        return _sure(node.is_a("string") & (node.get("string") == const))
    raise SchemaError(f"enum/const value {const!r} is not a scalar")


def _is_double(node: Node) -> Column:
    return node.type.isin("DOUBLE", "FLOAT")


def _equals_whole(node: Node, const: int) -> Column:
    """The number is ``const``, in whatever notation it came."""
    # Exact notations compare as text, without the zeros after the point.
    text = F.regexp_replace(node.get("string"), r"\.0*$", "")
    near = float(const) if abs(const) < 10**300 else None
    same_double = node.get("double") == near if near is not None and int(near) == const else F.lit(False)
    return F.when(_is_double(node), same_double).otherwise(text == str(const))


#: Digits after the leading one that a decimal number in a text can have here.
MOST_DIGITS = 18


def _scientific(number: object) -> tuple[int, int]:
    """(mantissa, exponent of ten) of a constant, exactly as written."""
    sign, digits, exponent = Decimal(str(number)).normalize().as_tuple()
    if sign or not any(digits) or len(digits) > MOST_DIGITS:
        raise SchemaError(f"{number} is no positive number of at most {MOST_DIGITS} digits")
    return int("".join(map(str, digits))), exponent


def _not_multiple(node: Node, of: object) -> Column:
    """True when the number is no whole multiple of ``of``, by its decimal digits.

    A number is M * 10**e, the constant P * 10**q. With k = e - q, M * 10**k has to be a
    multiple of P: for k >= 0 by remainders, whose powers of ten are a constant table; else M
    has to be one of P * 10**-k.
    """
    divisor, exponent = _scientific(of)
    parts = [F.regexp_extract(node.get("string"), r"^-?(\d+)(?:\.(\d+))?(?:E(-?\d+))?$", i) for i in (1, 2, 3)]
    mantissa = F.concat(parts[0], parts[1]).cast("decimal(38,0)")
    power = F.when(parts[2] == "", 0).otherwise(parts[2].try_cast("int"))
    k = power - F.length(parts[1]) - exponent
    tens = F.array(*[F.lit(pow(10, i, divisor)).cast("bigint") for i in range(330 + max(0, -exponent))])
    small = (mantissa % divisor).cast("decimal(18,0)") * F.get(tens, F.greatest(k, F.lit(0))).cast("decimal(18,0)")
    above = small % divisor != 0
    wide = F.array(*[F.lit(Decimal(divisor * 10**i)).cast("decimal(38,0)") for i in range(39 - len(str(divisor)))])
    # Beyond the table the divisor has more digits than the mantissa can have.
    below = F.coalesce(mantissa % F.get(wide, -k) != 0, mantissa != 0)
    return F.when(k >= 0, above).otherwise(below)


def _one_of_values(node: Node, values: list) -> Column:
    if not values:
        raise SchemaError("enum is empty")
    if all(isinstance(v, str) for v in values):
        return _sure(node.is_a("string") & node.get("string").isin(values))
    return _any([_equals(node, v) for v in values])


class Compiler:
    """Compiles one schema document; local ``$ref`` pointers are expanded in place."""

    def __init__(self, root: object):
        self.root = root

    def invalid(self, schema: object, node: Node, path: str, refs: tuple[str, ...] = ()) -> Column:
        return _any([bad for bad, _ in self.checks(schema, node, path, refs)])

    def checks(
        self, schema: object, node: Node, path: str = "$", refs: tuple[str, ...] = ()
    ) -> list[tuple[Column, str]]:
        if schema is True:
            return []
        if schema is False:
            return [(node.present, f"{path}: not allowed")]
        if not isinstance(schema, dict):
            raise SchemaError(f"{path}: schema must be an object or a boolean")
        out: list[tuple[Column, str]] = []
        for keyword, arg in schema.items():
            if keyword in ANNOTATIONS or keyword in ("then", "else"):
                continue
            compile_keyword = getattr(self, "_kw_" + keyword.lstrip("$"), None)
            if compile_keyword is None:
                raise SchemaError(f"{path}: unsupported keyword {keyword!r}")
            for bad, message in compile_keyword(arg, node, path, refs, schema):
                out.append((_sure(bad), message if message.startswith("$") else f"{path}: {message}"))
        return out

    # -- any type ---------------------------------------------------------------

    def _kw_type(self, arg, node, path, refs, schema):
        kinds = [arg] if isinstance(arg, str) else list(arg)
        ok = _any([node.is_a(k) for k in kinds])
        yield node.present & ~ok, "expected type " + " or ".join(kinds)

    def _kw_enum(self, arg, node, path, refs, schema):
        yield node.present & ~_one_of_values(node, list(arg)), "value not in enum"

    def _kw_const(self, arg, node, path, refs, schema):
        yield node.present & ~_equals(node, arg), "value differs from const"

    def _kw_ref(self, arg, node, path, refs, schema):
        if arg in refs:
            raise SchemaError(f"{path}: recursive reference {arg}")
        if not arg.startswith("#"):
            raise SchemaError(f"{path}: only local references are supported, not {arg}")
        target = self.root
        for step in [s for s in arg[1:].split("/") if s]:
            step = step.replace("~1", "/").replace("~0", "~")
            if not isinstance(target, dict) or step not in target:
                raise SchemaError(f"{path}: unresolved reference {arg}")
            target = target[step]
        return self.checks(target, node, path, (*refs, arg))

    def _kw_allOf(self, arg, node, path, refs, schema):
        return [c for part in arg for c in self.checks(part, node, path, refs)]

    def _kw_anyOf(self, arg, node, path, refs, schema):
        bad = reduce(lambda a, b: a & b, [self.invalid(p, node, path, refs) for p in arg])
        yield node.present & bad, "no anyOf branch matches"

    def _kw_oneOf(self, arg, node, path, refs, schema):
        hits = sum((F.when(self.invalid(p, node, path, refs), 0).otherwise(1) for p in arg), F.lit(0))
        yield node.present & (hits != 1), "not exactly one oneOf branch matches"

    def _kw_not(self, arg, node, path, refs, schema):
        yield node.present & ~self.invalid(arg, node, path, refs), "matches a forbidden schema"

    def _kw_if(self, arg, node, path, refs, schema):
        failed = self.invalid(arg, node, path, refs)
        for name, gate in (("then", ~failed), ("else", failed)):
            for bad, message in self.checks(schema.get(name, True), node, path, refs):
                yield gate & bad, message

    # -- numbers ----------------------------------------------------------------

    def _bound(self, node, violated, message):
        yield node.is_a("number") & violated(node.get("double")), message

    def _kw_minimum(self, arg, node, path, refs, schema):
        return self._bound(node, lambda x: x < float(arg), f"below minimum {arg}")

    def _kw_maximum(self, arg, node, path, refs, schema):
        return self._bound(node, lambda x: x > float(arg), f"above maximum {arg}")

    def _kw_exclusiveMinimum(self, arg, node, path, refs, schema):
        return self._bound(node, lambda x: x <= float(arg), f"not above {arg}")

    def _kw_exclusiveMaximum(self, arg, node, path, refs, schema):
        return self._bound(node, lambda x: x >= float(arg), f"not below {arg}")

    def _kw_multipleOf(self, arg, node, path, refs, schema):
        yield node.is_a("number") & _not_multiple(node, arg), f"not a multiple of {arg}"

    # -- strings ----------------------------------------------------------------

    def _kw_minLength(self, arg, node, path, refs, schema):
        yield node.is_a("string") & (F.length(node.get("string")) < int(arg)), f"shorter than {arg}"

    def _kw_maxLength(self, arg, node, path, refs, schema):
        yield node.is_a("string") & (F.length(node.get("string")) > int(arg)), f"longer than {arg}"

    def _kw_pattern(self, arg, node, path, refs, schema):
        yield node.is_a("string") & ~node.get("string").rlike(arg), f"does not match {arg}"

    # -- arrays -----------------------------------------------------------------

    def _elements(self, node):
        return node.get("array<variant>")

    def _kw_items(self, arg, node, path, refs, schema):
        if isinstance(arg, list):
            raise SchemaError(f"{path}: positional items are not supported")
        bad = F.exists(self._elements(node), lambda e: self.invalid(arg, Node.of(e), path + "[]", refs))
        yield node.is_a("array") & bad, "invalid array element"

    def _kw_contains(self, arg, node, path, refs, schema):
        least, most = int(schema.get("minContains", 1)), schema.get("maxContains")
        matching = F.filter(self._elements(node), lambda e: ~self.invalid(arg, Node.of(e), path + "[]", refs))
        if (least, most) == (1, None):
            yield node.is_a("array") & ~_sure(F.size(matching) > 0), "no matching array element"
            return
        yield node.is_a("array") & (F.size(matching) < least), f"fewer than {least} matching array elements"
        if most is not None:
            yield node.is_a("array") & (F.size(matching) > int(most)), f"more than {most} matching array elements"

    def _kw_minContains(self, arg, node, path, refs, schema):
        return []  # of ``contains``, and without it of nothing

    _kw_maxContains = _kw_minContains

    def _kw_minItems(self, arg, node, path, refs, schema):
        yield node.is_a("array") & (F.size(self._elements(node)) < int(arg)), f"fewer than {arg} items"

    def _kw_maxItems(self, arg, node, path, refs, schema):
        yield node.is_a("array") & (F.size(self._elements(node)) > int(arg)), f"more than {arg} items"

    def _kw_uniqueItems(self, arg, node, path, refs, schema):
        if arg:
            texts = F.transform(self._elements(node), lambda e: F.to_json(e))
            yield node.is_a("array") & (F.size(F.array_distinct(texts)) < F.size(texts)), "items repeat"

    # -- objects ----------------------------------------------------------------

    def _names(self, node):
        return F.map_keys(node.get("map<string,variant>"))

    def _kw_properties(self, arg, node, path, refs, schema):
        return [
            c for name, part in arg.items() for c in self.checks(part, node.child(name), f"{path}.{name}", refs)
        ]

    def _kw_required(self, arg, node, path, refs, schema):
        for name in arg:
            missing = field_of(node.value, name).isNull()
            yield node.is_a("object") & missing, f"$.{name}: required" if path == "$" else f"{name} is required"

    def _kw_dependentRequired(self, arg, node, path, refs, schema):
        for name, needed in arg.items():
            for other in needed:
                bad = field_of(node.value, name).isNotNull() & field_of(node.value, other).isNull()
                yield node.is_a("object") & bad, f"{other} is required with {name}"

    def _kw_dependentSchemas(self, arg, node, path, refs, schema):
        for name, part in arg.items():
            given = node.is_a("object") & field_of(node.value, name).isNotNull()
            for bad, message in self.checks(part, node, path, refs):
                yield given & bad, message

    def _kw_patternProperties(self, arg, node, path, refs, schema):
        for pattern, part in arg.items():
            yield node.is_a("object") & self._like(pattern, part, node, path, refs), f"invalid property like {pattern}"

    def _like(self, pattern, part, node, path, refs):
        members = F.map_filter(node.get("map<string,variant>"), lambda k, _: k.rlike(pattern))
        return F.exists(F.map_values(members), lambda e: self.invalid(part, Node.of(e), path + ".*", refs))

    def _kw_propertyNames(self, arg, node, path, refs, schema):
        # A name is checked as a text value.
        bad = F.exists(self._names(node), lambda k: self.invalid(arg, Node.of(F.to_variant_object(F.array(k))).first(), path, refs))
        yield node.is_a("object") & bad, "invalid property name"

    def _kw_additionalProperties(self, arg, node, path, refs, schema):
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        extra = F.array_except(self._names(node), known)
        patterns = list(schema.get("patternProperties", {}))
        if patterns:
            extra = F.filter(extra, lambda k: ~_any([k.rlike(p) for p in patterns]))
        if arg is False:
            yield node.is_a("object") & (F.size(extra) > 0), "undeclared property"
        elif isinstance(arg, dict) and arg:
            members = F.map_filter(node.get("map<string,variant>"), lambda k, _: F.array_contains(extra, k))
            bad = F.exists(F.map_values(members), lambda e: self.invalid(arg, Node.of(e), path + ".*", refs))
            yield node.is_a("object") & bad, "invalid undeclared property"

    def _kw_minProperties(self, arg, node, path, refs, schema):
        yield node.is_a("object") & (F.size(self._names(node)) < int(arg)), f"fewer than {arg} properties"

    def _kw_maxProperties(self, arg, node, path, refs, schema):
        yield node.is_a("object") & (F.size(self._names(node)) > int(arg)), f"more than {arg} properties"


def first_message(checks: list[tuple[Column, str]]) -> Column:
    """Message of the first violated check, NULL when all hold (checked lazily)."""
    if not checks:
        return F.lit(None).cast("string")
    out = F
    for bad, message in checks:
        out = out.when(bad, message)
    return out
