"""JSON expressions of map styles, normalised and compiled to Columns.

The compiler knows the operators that filters and classes use; get and has read a map column of properties, zoom a
Column or number. A filter never gives null: a missing property makes a comparison false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def normalize(expr):
    """Legacy filters as expressions: ["==", "class", v] and its kin, in, !in, !has, none; nested ones too."""
    if not isinstance(expr, list) or not expr:
        return expr
    op, args = expr[0], expr[1:]
    if op in ("all", "any", "none"):
        inner = [normalize(a) for a in args]
        return ["!", ["any", *inner]] if op == "none" else [op, *inner]
    if op in COMPARE and len(args) == 2 and isinstance(args[0], str):
        return [op, _subject(args[0]), args[1]]
    if op in ("in", "!in") and args and isinstance(args[0], str):
        found = ["match", _subject(args[0]), list(args[1:]), True, False]
        return ["!", found] if op == "!in" else found
    if op == "!has":
        return ["!", ["has", args[0]]]
    return [op, *(normalize(a) for a in args)]


def _subject(name: str):
    return {"$type": ["geometry-type"], "$id": ["id"]}.get(name, ["get", name])


def rewrite(expr, get: dict, has: dict | None = None):
    """The tree with ["get", k] replaced by get[k], and ["has", k] by has[k] (or by has of a plain renaming)."""
    if not isinstance(expr, list):
        return expr
    if len(expr) == 2 and expr[0] == "get" and expr[1] in get:
        to = get[expr[1]]
        return ["get", to] if isinstance(to, str) else to
    if len(expr) == 2 and expr[0] == "has":
        if has and expr[1] in has:
            return has[expr[1]]
        if isinstance(get.get(expr[1]), str):
            return ["has", get[expr[1]]]
    return [rewrite(e, get, has) for e in expr]


def recode(expr, key: str, values: dict):
    """Literals that are compared with get(key) replaced by values: domains that changed their coding."""
    if not isinstance(expr, list):
        return expr
    if len(expr) == 3 and expr[0] in ("==", "!=") and expr[1] == ["get", key]:
        return [expr[0], expr[1], values.get(expr[2], expr[2])]
    if expr and expr[0] == "match" and expr[1] == ["get", key]:
        change = lambda v: [values.get(x, x) for x in v] if isinstance(v, list) else values.get(v, v)
        body = expr[2:]
        return ["match", expr[1], *(change(b) if k % 2 == 0 and k < len(body) - 1 else recode(b, key, values) for k, b in enumerate(body))]
    return [recode(e, key, values) for e in expr]


def literals(expr, kind: type = str) -> list:
    """Literals of a kind in the tree, in order, names of operators left out."""
    if isinstance(expr, list):
        return [x for e in expr[1:] for x in literals(e, kind)]
    return [expr] if isinstance(expr, kind) and not (kind is not bool and isinstance(expr, bool)) else []


def compile_expr(expr, props: Column, zoom: Column | float = 0.0, geometry: Column | None = None, id_: Column | None = None) -> Column:
    """The Column of an expression over a map<string,string> of properties; numbers compare as numbers."""
    z = zoom if isinstance(zoom, Column) else F.lit(float(zoom))

    def number(e) -> Column:
        c = build(e)
        return c.try_cast("double") if isinstance(e, list) else F.lit(float(e))

    def is_number(e) -> bool:
        return isinstance(e, (int, float)) and not isinstance(e, bool) or isinstance(e, list) and e[:1] and e[0] in ("zoom", "interpolate", "step", "max", "min", "+", "-", "*", "/", "length")

    def pair(a, b) -> tuple[Column, Column]:
        return (number(a), number(b)) if is_number(a) or is_number(b) else (build(a), build(b))

    def build(e) -> Column:
        if not isinstance(e, list):
            return F.lit(e)
        op, a = e[0], e[1:]
        if op == "literal":
            return F.array(*(F.lit(x) for x in a[0])) if isinstance(a[0], list) else F.lit(a[0])
        if op == "get":
            return F.try_element_at(props, F.lit(a[0]))
        if op == "has":
            return F.map_contains_key(props, a[0])
        if op == "zoom":
            return z
        if op == "geometry-type":
            return geometry if geometry is not None else F.lit(None).cast("string")
        if op == "id":
            return id_ if id_ is not None else F.lit(None).cast("string")
        if op == "coalesce":
            return F.coalesce(*(build(x) if not is_number(x) else F.lit(str(x)) for x in a)) if any(isinstance(x, list) for x in a) else F.coalesce(*map(build, a))
        if op in ("all", "any"):
            out = F.lit(op == "all")
            for x in a:
                c = F.coalesce(build(x), F.lit(False))
                out = out & c if op == "all" else out | c
            return out
        if op == "!":
            return ~F.coalesce(build(a[0]), F.lit(False))
        if op in COMPARE:
            return F.coalesce(COMPARE[op](*pair(a[0], a[1])), F.lit(False))
        if op == "case":
            out = None
            for test, value in zip(a[:-1:2], a[1::2], strict=False):
                c = F.coalesce(build(test), F.lit(False))
                out = F.when(c, build(value)) if out is None else out.when(c, build(value))
            return out.otherwise(build(a[-1]))
        if op == "match":
            out = None
            for labels, value in zip(a[1:-1:2], a[2::2], strict=False):
                names = labels if isinstance(labels, list) else [labels]
                subject = number(a[0]) if all(is_number(n) for n in names) and names else build(a[0])
                c = F.coalesce(subject.isin([float(n) if is_number(n) else n for n in names]), F.lit(False))
                out = F.when(c, build(value)) if out is None else out.when(c, build(value))
            return out.otherwise(build(a[-1]))
        if op == "step":
            out, x = None, number(a[0])
            for value, stop in zip(a[1::2], a[2::2], strict=False):
                out = F.when(x < float(stop), build(value)) if out is None else out.when(x < float(stop), build(value))
            return out.otherwise(build(a[-1])) if out is not None else build(a[1])
        if op == "interpolate":
            x, stops = number(a[1]), list(zip(a[2::2], a[3::2], strict=True))
            out = F.when(x <= float(stops[0][0]), number(stops[0][1]))
            for (p, v), (q, w) in zip(stops, stops[1:], strict=False):
                out = out.when(x <= float(q), number(v) + (number(w) - number(v)) * (x - float(p)) / float(q - p))
            return out.otherwise(number(stops[-1][1]))
        if op in ("max", "min"):
            return (F.greatest if op == "max" else F.least)(*map(number, a))
        if op in ("+", "-", "*", "/"):
            out = number(a[0])
            for x in a[1:]:
                y = number(x)
                out = out + y if op == "+" else out - y if op == "-" else out * y if op == "*" else out / y
            return out
        if op == "length":
            return F.length(build(a[0]))
        if op == "to-string":
            return F.coalesce(build(a[0]).cast("string"), F.lit(""))
        if op == "concat":
            return F.concat(*(F.coalesce(build(x).cast("string"), F.lit("")) for x in a))
        raise ValueError(f"operator {op!r}")

    return build(expr)


def compile_filter(expr, props: Column, **more) -> Column:
    """A filter that is never null."""
    return F.coalesce(compile_expr(normalize(expr), props, **more), F.lit(False))
