"""Formulas as Columns: expressions, conditional blocks and mapping tables.

A formula is parsed, checked against a whitelist and compiled to a Column, so
Catalyst sees plain expressions. Two notations share one tree: the Python one
(``signed(value, bits=20) * 0.0103 / 60``) and the C-like one
(``a.x > 3 && b.y ? 1 : 0``). Semantics follow Python: ``//`` and ``%`` round
down, division by zero has no value (NULL, recorded as failed). What the
whitelist lacks raises ValueError when the formula is compiled; nothing is
ever evaluated as Python code.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of mapping tables.
PAIR = re.compile(r"(-?\d+(?:\.\d+)?)\s*(?:=|->|→)\s*([^,;\n]+)")
RANGE = re.compile(r"(-?\d+(?:\.\d+)?)\s*(?:-|~|～|—|–)\s*(-?\d+(?:\.\d+)?)\s*(?:=|->|→)\s*([^,;\n]+)")
BLOCK = re.compile(r"(?:\n|^)(?:if\s+|for\s+|while\s+|result\s*=)", re.I)


def signed(v: Column, bits: int) -> Column:
    """Two's complement of the lowest bits."""
    raw = v.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(raw.bitwiseAND(F.lit(1 << (bits - 1))) != 0, raw - F.lit(1 << bits)).otherwise(raw)


def unsigned(v: Column, bits: int) -> Column:
    return v.cast("long").bitwiseAND(F.lit((1 << bits) - 1))


def clip(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low.cast("double"), F.least(high.cast("double"), v.cast("double")))


def scale(v: Column, factor: Column, offset: Column | None = None) -> Column:
    return v.cast("double") * factor + (F.lit(0.0) if offset is None else offset)


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def modulo(a: Column, b: Column) -> Column:
    return a - b * floor_div(a, b)


def _constant(c: object) -> int:
    if isinstance(c, int):
        return c
    raise ValueError("bits must be a number")


class Compiler:
    """From a syntax tree to a Column; names are looked up in ``variables``."""

    def __init__(self, variables: dict[str, Column], constants: dict[str, int] | None = None):
        self.variables, self.constants = variables, constants or {}
        self.functions: dict[str, Callable[..., Column]] = {
            "abs": F.abs, "round": lambda x, n=None: F.bround(x, 0 if n is None else n), "int": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long"), "float": lambda x: x.cast("double"),
            "double": lambda x: x.cast("double"), "long": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long"), "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x), "pow": F.pow,
            "floor": F.floor, "ceil": F.ceil, "clip": clip, "clamp": clip, "scale": scale,
        }

    def run(self, node: ast.AST) -> Column:
        handler = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if handler is None:
            raise ValueError(f"not allowed in a formula: {type(node).__name__}")
        return handler(node)

    def on_expression(self, node):
        return self.run(node.body)

    def on_constant(self, node):
        return F.lit(node.value)

    def on_name(self, node):
        if node.id in self.variables:
            return self.variables[node.id]
        if node.id in self.constants:
            return F.lit(self.constants[node.id])
        raise ValueError(f"unknown name: {node.id}")

    def on_unaryop(self, node):
        x = self.run(node.operand)
        return {"USub": lambda: -x, "UAdd": lambda: x, "Not": lambda: ~x}[type(node.op).__name__]()

    def on_binop(self, node):
        a, b = self.run(node.left), self.run(node.right)
        kinds = {"Add": lambda: a + b, "Sub": lambda: a - b, "Mult": lambda: a * b, "Div": lambda: F.try_divide(a.cast("double"), b.cast("double")), "FloorDiv": lambda: floor_div(a, b), "Mod": lambda: modulo(a, b), "Pow": lambda: F.pow(a, b)}
        if (kind := type(node.op).__name__) not in kinds:
            raise ValueError(f"not allowed in a formula: {kind}")
        return kinds[kind]()

    def on_boolop(self, node):
        parts = [self.run(x) for x in node.values]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if isinstance(node.op, ast.And) else out | x
        return out

    def on_compare(self, node):
        out, left = None, self.run(node.left)
        for op, item in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, ast.In | ast.NotIn):
                here = left.isin(*[self.run(x) for x in item.elts])
                here, left = (~here if isinstance(op, ast.NotIn) else here), left
            else:
                right = self.run(item)
                here = {"Eq": left == right, "NotEq": left != right, "Gt": left > right, "GtE": left >= right, "Lt": left < right, "LtE": left <= right}[type(op).__name__]
                left = right
            out = here if out is None else out & here
        return out

    def on_call(self, node):
        if not isinstance(node.func, ast.Name):
            raise ValueError("only listed functions may be called")
        name = node.func.id
        if name in ("signed", "unsigned"):
            bits = node.keywords[0].value if node.keywords else node.args[1]
            bits = self.constants.get(bits.id) if isinstance(bits, ast.Name) else getattr(bits, "value", None)
            return (signed if name == "signed" else unsigned)(self.run(node.args[0]), _constant(bits))
        if name not in self.functions:
            raise ValueError(f"not a listed function: {name}")
        if name == "round" and len(node.args) > 1:
            return F.bround(self.run(node.args[0]), _constant(getattr(node.args[1], "value", None)))
        return self.functions[name](*[self.run(x) for x in node.args], *[self.run(k.value) for k in node.keywords])

    def block(self, body: list[ast.stmt]) -> None:
        """Assignments and conditionals; both branches run, and a name takes the value of the branch that holds."""
        for node in body:
            if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
                self.variables[node.targets[0].id] = self.run(node.value)
            elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
                self.variables[node.target.id] = self.run(ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value))
            elif isinstance(node, ast.If):
                test, before = self.run(node.test), dict(self.variables)
                self.block(node.body)
                yes, self.variables = self.variables, dict(before)
                self.block(node.orelse)
                no = self.variables
                self.variables = {n: F.when(test, yes.get(n, F.lit(None))).otherwise(no.get(n, F.lit(None))) for n in yes.keys() | no.keys()}
            elif isinstance(node, ast.For) and isinstance(node.target, ast.Name) and isinstance(node.iter, ast.Call) and getattr(node.iter.func, "id", "") == "range":
                for i in range(*[_constant(getattr(a, "value", None)) for a in node.iter.args]):  # unrolled
                    self.variables[node.target.id] = F.lit(i)
                    self.block(node.body)
            elif not isinstance(node, ast.Pass):
                raise ValueError(f"not allowed in a formula: {type(node).__name__}")


def kind_of(formula: str) -> str:
    """mapping_table, python_block or python_expr."""
    if BLOCK.search(formula):
        return "python_block"
    return "mapping_table" if PAIR.search(formula) and not re.search(r"[=<>!]=", formula) else "python_expr"


def expression(formula: str, variables: dict[str, Column], bits: int = 0) -> Column:
    return Compiler(variables, {"bits": bits}).run(ast.parse(formula.strip(), mode="eval"))


def block(formula: str, variables: dict[str, Column], bits: int = 0) -> Column:
    compiler = Compiler({"result": F.lit(None), **variables}, {"bits": bits})
    compiler.block(ast.parse(re.sub(r"(?m)^(\s*)return ", r"\1result = ", formula)).body)
    return compiler.variables["result"]


def mapping(formula: str, value: Column, overlap: bool = False) -> Column:
    """The label of a value: by equal text, else by the first closed range that holds it, else NULL.

    ``overlap``: the right end of a range is a key too, with its sign (5-9=A also maps -9).
    """
    ranges = [(float(a), float(b), c.strip()) for a, b, c in RANGE.findall(formula)]
    exact = {k.strip(): v.strip() for k, v in PAIR.findall(formula if overlap else RANGE.sub("", formula))}
    out, number = F.lit(None).cast("string"), value.cast("double")
    for low, high, label in reversed(ranges):
        out = F.when(number.between(low, high), F.lit(label)).otherwise(out)
    for key, label in reversed(exact.items()):
        out = F.when(F.trim(value.cast("string")) == key, F.lit(label)).otherwise(out)
    return out


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    raise ValueError("unbalanced parentheses")


def _choices(text: str) -> str:
    """?: as calls of ``choose``, inside out and argument by argument."""
    flat, held, i = "", [], 0
    while i < len(text):
        if text[i] == "(":
            j = _closing(text, i)
            held.append(_choices(text[i + 1 : j]))
            flat, i = flat + f"\0{len(held) - 1}\0", j + 1
        else:
            flat, i = flat + text[i], i + 1

    def choose(part: str) -> str:
        test, mark, rest = part.partition("?")
        if not mark:
            return part
        nested = 0
        for k, c in enumerate(rest):
            if c == ":" and nested == 0:
                return f"choose({test}, {choose(rest[:k])}, {choose(rest[k + 1 :])})"
            nested += (c == "?") - (c == ":")
        raise ValueError("? without :")

    out = ",".join(choose(x) for x in flat.split(","))
    return re.sub(r"\0(\d+)\0", lambda m: f"({held[int(m[1])]})", out)


def _from_c(text: str) -> str:
    """A C-like expression in the Python notation; alias.field becomes alias__field."""
    text = re.sub(r"!(?!=)", " not ", text.replace("&&", " and ").replace("||", " or "))
    return _choices(re.sub(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)", r"\1__\2", text))


def c_expression(formula: str, variables: dict[str, Column]) -> Column:
    """variables by ``alias.field``."""
    compiler = Compiler({k.replace(".", "__"): v for k, v in variables.items()})
    compiler.functions["choose"] = lambda test, a, b: F.when(test, a).otherwise(b)
    return compiler.run(ast.parse(_from_c(formula).strip(), mode="eval"))


def compiled(formula: str, variables: dict[str, Column], value: Column | None = None, bits: int = 0, kind: str | None = None) -> Column:
    """The formula of any kind; ``value`` and ``raw`` name the rule's own field."""
    kind = kind or kind_of(formula)
    if value is not None:
        variables = {"value": value, "raw": value, **variables}
    if kind == "mapping_table":
        return mapping(formula, value)
    return (block if kind == "python_block" else expression)(formula, variables, bits)


def conditional(rules: list[tuple[str | None, str]], default: str | None, variables: dict[str, Column]) -> Column:
    """The first rule whose condition holds, else the default, else NULL."""
    out = F.lit(None) if default is None else c_expression(default, variables)
    for when, formula in reversed(rules):
        value = c_expression(formula, variables)
        out = value if when is None else F.when(c_expression(when, variables), value).otherwise(out)
    return out
