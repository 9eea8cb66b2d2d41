"""Parse queries with Spark's own SQL parser and read facts off the logical plan.

One query becomes a tree of scopes: a SELECT, each branch of a set operation, each CTE, each derived table and each
subquery in an expression.  Facts are plain tuples, one list per fact table (see facts.py); no table is ever read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import prepass

PRIORITY = {"unknown": -1, "value": 0, "direct": 1, "expression": 2, "fallback": 3, "case_when": 4, "aggregate": 5, "pivot": 6, "window": 7}
AGGREGATES = {"sum", "avg", "count", "max", "min"}
FALLBACKS = {"nvl", "ifnull", "isnull"}
JOIN_LABEL = {"LeftOuter": "LEFT JOIN", "RightOuter": "RIGHT JOIN", "FullOuter": "FULL JOIN", "Inner": "INNER JOIN", "Cross": "CROSS JOIN", "LeftSemi": "SEMI JOIN", "LeftAnti": "ANTI JOIN"}
SYMBOL = {
    "EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<=", "EqualNullSafe": "<=>", "And": "AND", "Or": "OR",
    "Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/", "Remainder": "%",
}


@dataclass
class Node:
    """A plan or expression node; attribute values that are trees are Nodes as well."""

    kind: str
    raw: dict
    children: list[Node] = field(default_factory=list)

    def trees(self, name: str) -> list[Node]:
        """The trees held in an attribute, in order."""
        return list(_trees(self.raw.get(name)))

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def _is_tree(x) -> bool:
    return isinstance(x, list) and bool(x) and isinstance(x[0], dict) and "class" in x[0] and "num-children" in x[0]


def _trees(x):
    if _is_tree(x):
        yield build(x)
    elif isinstance(x, list):
        for y in x:
            yield from _trees(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from _trees(y)


def build(flat: list[dict]) -> Node:
    """A tree from its nodes in pre-order."""
    it = iter(flat)

    def one() -> Node:
        raw = next(it)
        node = Node(raw["class"].rsplit(".", 1)[-1], raw)
        node.children = [one() for _ in range(raw["num-children"])]
        return node

    return one()


def parts(text: str) -> list[str]:
    return [p.strip() for p in text.strip("[]").split(", ")] if text.strip("[]") else []


# --- expressions -------------------------------------------------------------------------------------------------


def function_name(e: Node) -> str:
    return parts(e.raw.get("nameParts", ""))[-1].lower() if e.kind == "UnresolvedFunction" else ""


def columns(e: Node) -> list[tuple[str, str]]:
    """(alias, field) of each column reference, first mention first; current_timestamp and the like are none."""
    out: list[tuple[str, str]] = []
    for n in e.walk():
        if n.kind == "UnresolvedAttribute":
            names = [x.lower() for x in parts(n.raw["nameParts"])]
            ref = (names[-2] if len(names) > 1 else "", names[-1])
            if ref[1] not in ("current_timestamp", "current_date") and ref not in out:
                out.append(ref)
    return out


def subqueries(e: Node) -> list[Node]:
    return [t for n in e.walk() for t in n.trees("plan")]


def sql_of(e: Node) -> str:
    """Readable SQL text of an expression."""
    c = [sql_of(x) for x in e.children]
    kind, raw = e.kind, e.raw
    if kind == "UnresolvedAttribute":
        return ".".join(parts(raw["nameParts"]))
    if kind == "Literal":
        v = raw.get("value")
        return "NULL" if v is None or raw.get("dataType") == "void" else f"'{v}'" if raw.get("dataType") == "string" else str(v)
    if kind == "Alias":
        return f"{c[0]} AS {raw['name']}"
    if kind == "UnresolvedAlias":
        return c[0]
    if kind in SYMBOL:
        return f"{c[0]} {SYMBOL[kind]} {c[1]}" if kind not in ("Or",) else f"({c[0]} OR {c[1]})"
    if kind == "UnresolvedFunction":
        star = ["*" if x == "1" and function_name(e) == "count" else x for x in c]
        return f"{function_name(e).upper()}({'DISTINCT ' if raw.get('isDistinct') else ''}{', '.join(star)})"
    if kind == "CaseWhen":
        pairs, rest = len(c) // 2, c[-1] if len(c) % 2 else None
        return "CASE " + " ".join(f"WHEN {c[2 * i]} THEN {c[2 * i + 1]}" for i in range(pairs)) + (f" ELSE {rest}" if rest else "") + " END"
    if kind == "Cast":
        return f"CAST({c[0]} AS {type_text(raw.get('dataType'))})"
    if kind == "Not":
        return f"NOT ({c[0]})"
    if kind in ("IsNull", "IsNotNull"):
        return f"{c[0]} IS {'NOT ' if kind == 'IsNotNull' else ''}NULL"
    if kind == "In":
        return f"{c[0]} IN ({', '.join(c[1:])})"
    if kind == "Coalesce":
        return f"COALESCE({', '.join(c)})"
    if kind in ("UnresolvedStar", "UnresolvedStarBase"):
        return "*"
    if kind in ("Exists", "InSubquery", "ListQuery", "ScalarSubquery"):
        return {"Exists": "EXISTS (...)", "ScalarSubquery": "(...)"}.get(kind, f"{', '.join(c)} IN (...)")
    return f"{kind}({', '.join(c)})"


def type_text(kind) -> str:
    """A data type of the plan as DDL text."""
    return str(kind if isinstance(kind, str) else kind.get("type", kind)) if kind is not None else "unknown"


def unalias(e: Node) -> Node:
    return unalias(e.children[0]) if e.kind in ("Alias", "UnresolvedAlias", "MultiAlias") and e.children else e


def classify(e: Node) -> str:
    """value, window, pivot, aggregate, case_when, fallback, direct or expression, in this order of precedence."""
    e = unalias(e)
    if e.kind == "Literal" or (e.kind == "UnresolvedAttribute" and e.raw["nameParts"].strip("[]").lower() in ("current_timestamp", "current_date")) or e.kind.startswith(("CurrentTimestamp", "CurrentDate")) or function_name(e) in ("current_timestamp", "current_date"):
        return "value"
    nodes = list(e.walk())
    if any(n.kind in ("WindowExpression", "UnresolvedWindowExpression") for n in nodes):
        return "window"
    aggregate, case = any(function_name(n) in AGGREGATES for n in nodes), any(n.kind == "CaseWhen" for n in nodes)
    if aggregate:
        return "pivot" if case else "aggregate"
    if case:
        return "case_when"
    if function_name(e) == "coalesce" or e.kind == "Coalesce" or any(function_name(n) in FALLBACKS for n in nodes):
        return "fallback"
    return "direct" if e.kind == "UnresolvedAttribute" else "expression"


def constant_type(e: Node) -> str | None:
    """Type of a literal: 'N' varchar(1), 0 integer, 1.5 numeric(2,1)."""
    e = unalias(e)
    if e.kind != "Literal" or e.raw.get("value") is None:
        return None
    value, kind = str(e.raw["value"]), str(e.raw.get("dataType"))
    if kind == "string":
        return f"varchar({len(value)})"
    if kind.startswith("decimal") or kind in ("double", "float"):
        whole, _, frac = value.lstrip("-").partition(".")
        return f"numeric({len(whole) + len(frac)},{len(frac)})"
    return "integer" if kind in ("integer", "long", "bigint", "short", "tinyint") else kind


def case_results(e: Node) -> list[Node]:
    """The THEN and ELSE expressions of a CASE."""
    e = unalias(e)
    return [c for i, c in enumerate(e.children) if i % 2 == 1 or i == len(e.children) - 1] if e.kind == "CaseWhen" else []


def root_of(e: Node) -> tuple[str, str | None]:
    """What makes the value: function name, cast (and to which type), case, or empty."""
    e = unalias(e)
    if e.kind == "Cast":
        return "cast", type_text(e.raw.get("dataType")).lower()
    return ("case", None) if e.kind == "CaseWhen" else (function_name(e), None)


def equalities(e: Node) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """(column, column) of each equality between two columns that AND joins."""
    if e.kind == "And":
        return [x for c in e.children for x in equalities(c)]
    if e.kind in ("EqualTo", "EqualNullSafe") and all(c.kind == "UnresolvedAttribute" for c in e.children):
        return [tuple(columns(c)[0] for c in e.children)]
    return []


def inferred_name(e: Node, position: int, comment: str | None) -> str:
    """AS alias, column name, /* name */ comment, known audit value, else _col_i."""
    if e.kind == "Alias":
        return e.raw["name"].lower()
    inner = unalias(e)
    kind = classify(e)
    if inner.kind == "UnresolvedAttribute" and kind == "direct":
        return parts(inner.raw["nameParts"])[-1].lower()
    if comment:
        return comment.lower()
    if inner.kind == "Literal" and str(inner.raw.get("value")) == "N":
        return "del_flag"
    if kind == "value" and inner.kind != "Literal":
        return "dw_last_update_date"
    return f"_col_{position}"


# --- scopes ------------------------------------------------------------------------------------------------------


@dataclass
class Facts:
    scopes: list[tuple] = field(default_factory=list)  # scope, parent, kind, ord, alias, depth, branch
    refs: list[tuple] = field(default_factory=list)  # scope, ord, kind, name, alias, join_type, condition, role, child, using, bare
    columns: list[tuple] = field(default_factory=list)  # scope, position, name, expression, transform, constant, root, cast_type
    sources: list[tuple] = field(default_factory=list)  # scope, position, ord, alias, field
    usage: list[tuple] = field(default_factory=list)  # scope, kind, join_type, text, alias, field
    pairs: list[tuple] = field(default_factory=list)  # scope, ord of the joined relation, alias, field, alias, field
    results: list[tuple] = field(default_factory=list)  # scope, position, ord, alias, field, constant: THEN and ELSE values
    stars: dict = field(default_factory=dict)  # (scope, position) -> (alias, left out columns)
    status: tuple = (True, None, False, 0, 0, 0)  # ok, error, star, joins, subqueries, case branches


_SET = {"Union": "union", "Intersect": "intersect", "Except": "except"}
_THROUGH = {"GlobalLimit", "LocalLimit", "Sort", "Distinct", "Offset", "WithWindowDefinition", "Deduplicate", "UnresolvedSubqueryColumnAliases", "ResolvedHint", "UnresolvedHint", "Sample"}
_QUERIES = {"Project", "Aggregate", "UnresolvedHaving", "UnresolvedWith", *_SET}
_STARS = ("UnresolvedStar", "UnresolvedStarBase", "UnresolvedStarExceptOrReplace")


class _Walker:
    def __init__(self, comments: list[str | None], unconditioned: set[str] = frozenset()):
        self.unconditioned = unconditioned
        self.facts = Facts()
        self.comments = comments
        self.n_scopes = 0
        self.star = False
        self.using = ""
        self.joins = self.subs = self.cases = 0

    def scope(self, parent: int | None, kind: str, ord_: int, alias: str, depth: int, branch: int = 0) -> int:
        self.n_scopes += 1
        self.facts.scopes.append((self.n_scopes, parent, kind, ord_, alias, depth, branch))
        return self.n_scopes

    def query(self, plan: Node, parent: int | None, kind: str, ord_: int, alias: str, depth: int, ctes: dict[str, int], role: str = "main") -> int:
        """A query with its set branches: branches are scopes of their own under one scope."""
        if plan.kind == "UnresolvedWith":
            own = dict(ctes)
            me = self.scope(parent, kind, ord_, alias, depth)
            for i, (name, body) in enumerate(_cte_bodies(plan)):
                own[name] = self.query(body, me, "cte", i, name, depth + 1, own)
            self.fill(plan.children[0], me, depth, own, role)
            return me
        me = self.scope(parent, kind, ord_, alias, depth)
        self.fill(plan, me, depth, ctes, role)
        return me

    def fill(self, plan: Node, me: int, depth: int, ctes: dict[str, int], role: str) -> None:
        while plan.kind in _THROUGH:
            plan = plan.children[0]
        if plan.kind == "UnresolvedWith":
            own = dict(ctes)
            for i, (name, body) in enumerate(_cte_bodies(plan)):
                own[name] = self.query(body, me, "cte", i, name, depth + 1, own)
            self.fill(plan.children[0], me, depth, own, role)
            return
        if plan.kind in _SET:
            for i, branch in enumerate(_branches(plan)):
                child = self.scope(me, "branch", i, _SET[plan.kind], depth, i)
                self.fill(branch, child, depth, ctes, role)
            return
        self.select(plan, me, depth, ctes, role)

    def select(self, plan: Node, me: int, depth: int, ctes: dict[str, int], role: str) -> None:
        f = self.facts
        if plan.kind == "UnresolvedHaving":
            e = plan.trees("havingCondition")[0]
            self.use(me, "having", "", e, depth, ctes)
            plan = plan.children[0]
        items: list[Node] = []
        if plan.kind in ("Project", "Aggregate"):
            items = plan.trees("projectList" if plan.kind == "Project" else "aggregateExpressions")
            for g in plan.trees("groupingExpressions") if plan.kind == "Aggregate" else []:
                self.use(me, "group", "", g, depth, ctes)
            plan = plan.children[0]
        for i, e in enumerate(items):
            comment = self.comments[i] if me == 1 and i < len(self.comments) else None
            inner = unalias(e)
            if inner.kind in _STARS:
                self.star = True
                target = parts(inner.raw.get("target") or "")
                self.facts.stars[me, i] = (target[-1].lower() if target else "", tuple(x.lower() for e in inner.raw.get("excepts") or [] for x in parts(e)))
            self.cases += sum(len(n.children) // 2 for n in e.walk() if n.kind == "CaseWhen")
            f.columns.append((me, i, inferred_name(e, i, comment), sql_of(unalias(e)), classify(e), constant_type(e), *root_of(e)))
            for k, r in enumerate(case_results(e)):
                f.results += [(me, i, k, *c, None) for c in columns(r)[:1] if r.kind == "UnresolvedAttribute"] or [(me, i, k, None, None, constant_type(r))] * (r.kind == "Literal")
            f.sources += [(me, i, k, a, c) for k, (a, c) in enumerate(columns(e))]
            self.nested(e, me, depth, ctes)
        if plan.kind == "Filter":
            e = plan.trees("condition")[0]
            self.use(me, "where", "", e, depth, ctes)
            plan = plan.children[0]
        if plan.kind != "OneRowRelation":
            self.relation(plan, me, depth, ctes, [0], "FROM", None, role)

    def use(self, me: int, kind: str, join: str, e: Node, depth: int, ctes: dict[str, int]) -> None:
        refs = columns(e) if kind != "group" or unalias(e).kind in ("UnresolvedAttribute", "Rollup", "Cube", "GroupingSets") else []
        self.facts.usage += [(me, kind, join, sql_of(e), a, c) for a, c in refs] or [(me, kind, join, sql_of(e), None, None)]
        self.nested(e, me, depth, ctes)

    def nested(self, e: Node, me: int, depth: int, ctes: dict[str, int]) -> None:
        for i, q in enumerate(subqueries(e)):
            self.subs += 1
            self.query(q, me, "subquery", i, "", depth + 1, ctes, "secondary")

    def relation(self, plan: Node, me: int, depth: int, ctes: dict[str, int], ord_: list[int], join: str, condition: Node | None, role: str) -> None:
        if plan.kind == "Join":
            kind = plan.raw["joinType"]
            text = kind.get("object", kind.get("product-class", "")).rsplit(".", 1)[-1].rstrip("$") if isinstance(kind, dict) else str(kind)
            if isinstance(kind, dict) and "tpe" in kind:
                text = kind["tpe"].get("object", "").rsplit(".", 1)[-1].rstrip("$")
            on, using = plan.trees("condition"), []
            if isinstance(kind, dict):
                using = [x.lower() for x in parts(str(kind.get("usingColumns") or ""))] or (["*"] if str(kind.get("product-class", "")).endswith("NaturalJoin") else [])
            self.joins += 1
            self.relation(plan.children[0], me, depth, ctes, ord_, join, condition, role)
            label, here = JOIN_LABEL.get(text, "INNER JOIN"), ord_[0]
            self.using = ", ".join(using)
            self.relation(plan.children[1], me, depth, ctes, ord_, label, on[0] if on else None, "secondary")
            left, right = ([r[4] for r in self.facts.refs if r[0] == me and r[1] < here] or [""])[-1], next((r[4] for r in self.facts.refs if r[0] == me and r[1] == here), "")
            for e in on:
                self.use(me, "join", label, e, depth, ctes)
                self.facts.pairs += [(me, here, *a, *b) for a, b in equalities(e)]
            for c in using if using != ["*"] else []:
                self.facts.usage += [(me, "join", label, f"USING ({self.listed(using)})", a, c) for a in (left, right)]
                self.facts.pairs.append((me, here, left, c, right, c))
            return
        if plan.kind == "Generate":  # LATERAL VIEW: its columns come from those of the generator's arguments
            for c in plan.children:
                self.relation(c, me, depth, ctes, ord_, join, condition, role)
            self.generated(plan, me, ord_)
            return
        if plan.kind == "LateralJoin":
            for c in plan.children:
                self.relation(c, me, depth, ctes, ord_, join, condition, role)
            for e in plan.trees("right"):
                self.nested(e, me, depth, ctes)
            return
        alias = ""
        while plan.kind in ("SubqueryAlias", *_THROUGH):
            if plan.kind == "SubqueryAlias" and not alias:
                alias = plan.raw["identifier"]["name"].lower()
            plan = plan.children[0]
        text = sql_of(condition) if condition is not None else None
        n = ord_[0]
        ord_[0] += 1
        using, self.using = self.using, ""
        if plan.kind == "UnresolvedRelation":
            names = [p.lower() for p in parts(plan.raw["multipartIdentifier"])]
            full, is_cte = ".".join(names), len(names) == 1 and names[0] in ctes
            self.facts.refs.append((me, n, "cte" if is_cte else "table", full, alias or names[-1], join, text, role, ctes[names[0]] if is_cte else None, using, self.bare(alias or names[-1], text, using)))
        elif plan.kind in _QUERIES or (plan.kind == "Filter" and plan.children[0].kind in _QUERIES):
            self.subs += 1
            child = self.query(plan, me, "derived", n, alias, depth + 1, ctes, role)
            self.facts.refs.append((me, n, "derived", "", alias, join, text, role, child, using, self.bare(alias, text, using)))
        elif plan.children:  # PIVOT and other nodes around relations: what they read is kept
            for c in plan.children:
                self.relation(c, me, depth, ctes, ord_, join, condition, role)
        else:  # inline rows, table functions
            self.facts.refs.append((me, n, "values", "", alias, join, text, role, None, using, False))

    def generated(self, plan: Node, me: int, ord_: list[int]) -> None:
        """A scope whose columns are the generator's output, read from the scope around it."""
        e, alias = plan.trees("generator")[0], str(plan.raw.get("qualifier") or "").lower()
        child = self.scope(me, "generated", ord_[0], alias, 0)
        for i, out in enumerate(plan.trees("generatorOutput")):
            name = parts(out.raw["nameParts"])[-1].lower()
            self.facts.columns.append((child, i, name, sql_of(e), "expression", None, "", None))
            self.facts.sources += [(child, i, k, a, c) for k, (a, c) in enumerate(columns(e))]
        self.facts.refs.append((me, ord_[0], "derived", "", alias, "LATERAL VIEW", None, "secondary", child, "", False))
        ord_[0] += 1

    def bare(self, alias: str, condition: str | None, using: str) -> bool:
        """Whether the text joins this relation by JOIN without a condition (a comma join has none by nature)."""
        return condition is None and not using and alias in self.unconditioned

    @staticmethod
    def listed(names: list[str]) -> str:
        return ", ".join(names)


def _cte_bodies(plan: Node) -> list[tuple[str, Node]]:
    out = []
    for x in plan.raw.get("cteRelations", []):
        body = next((build(v) for k, v in x.items() if k.startswith("_") and _is_tree(v)), None)
        while body is not None and body.kind in ("SubqueryAlias", "UnresolvedSubqueryColumnAliases"):
            body = body.children[0]
        out.append((str(x["_1"]).lower(), body))
    return out


def _branches(plan: Node) -> list[Node]:
    """Branches of nested set operations of one kind, in order."""
    out = []
    for c in plan.children:
        inner = c
        while inner.kind in ("Distinct",):
            inner = inner.children[0]
        out += _branches(inner) if inner.kind in _SET else [c]
    return out


def unconditioned(query: str) -> set[str]:
    """Aliases of relations that an explicit JOIN (not CROSS or NATURAL) brings without ON or USING."""
    toks = [t for t in prepass.tokens(query) if t.kind not in ("comment", "space") and t.text.strip()]
    word = lambda i: toks[i].text.upper() if 0 <= i < len(toks) else ""
    out = set()
    for i in range(len(toks)):
        before = {word(i - 1), word(i - 2), word(i - 3)}
        if word(i) != "JOIN" or toks[i].kind != "word" or word(i - 1) == "CROSS" or "NATURAL" in before:
            continue
        at, name = i + 1, ""
        if word(at) == "(":
            depth = 0
            while at < len(toks):
                depth += (word(at) == "(") - (word(at) == ")")
                at += 1
                if not depth:
                    break
        else:
            name = toks[at].text if at < len(toks) else ""
            at += 1
            while word(at) == ".":
                name, at = (toks[at + 1].text if at + 1 < len(toks) else ""), at + 2
        if word(at) == "AS":
            at += 1
        if at < len(toks) and toks[at].kind == "word" and word(at) not in _AFTER_RELATION:
            name, at = toks[at].text, at + 1
        if word(at) not in ("ON", "USING"):
            out.add(name.strip('`"').lower())
    return out


_AFTER_RELATION = {"ON", "USING", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "LATERAL", "PARTITION", "DISTRIBUTE"}


def parser_session(spark: SparkSession):
    """A JVM session whose parser keeps the lengths of character types; threads that use it make it their active one."""
    own = spark._jsparkSession.newSession()
    own.conf().set("spark.sql.preserveCharVarcharTypeInfo", "true")
    return own


def parse(spark: SparkSession, sql: str, session=None) -> Facts:
    """Facts of one vendor query; whatever goes wrong becomes the status, never an exception.  ``session``: as from parser_session."""
    try:
        query = prepass.query_of(sql or "")
        if query is None:
            raise ValueError("not a single SELECT or WITH statement")
        plan = build(json.loads((session or spark._jsparkSession).sessionState().sqlParser().parsePlan(prepass.clean(query)).toJSON()))
        walker = _Walker(prepass.comment_aliases(query), unconditioned(query))
        walker.query(plan, None, "select", 0, "", 0, {})
        walker.facts.status = (True, None, walker.star, walker.joins, walker.subs, walker.cases)
        return walker.facts
    except Exception as e:  # noqa: BLE001 - any parser or walker failure degrades this rule only
        return Facts(status=(False, re.sub(r"\s+", " ", str(e))[:300] or type(e).__name__, False, 0, 0, 0))
