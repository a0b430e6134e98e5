"""Policy over queries: statements are gated by their parse tree, columns by the lineage of the analyzed plan, rows at the leaves.

Everything unknown is refused: columns without a grade, plan nodes without a rule, conditions that can't be evaluated.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import JoinGraph
from .lineage import facts
from .statement import clause, text, tokens

GRADES = ("public", "internal", "masked", "forbidden")
#: Functions that reach outside a query or tell about the session.
DENIED = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "current_catalog", "current_database", "version", "spark_partition_id"}


@dataclass
class RowPolicy:
    name: str
    table: str
    predicate: str  # with {name} for values of the context
    when: str = ""  # names joined by 'and'; holds if the context has them all
    propagate: bool = False


@dataclass
class Policy:
    grades: dict[str, str]  # "table.column" -> grade
    masks: dict[str, str] = field(default_factory=dict)  # "table.column" -> rule
    rows: list[RowPolicy] = field(default_factory=list)
    k_tables: frozenset = frozenset()
    k: int = 0
    limit: int | None = 200  # rows of a statement without a limit of its own; None: all
    cap: int | None = 500  # rows of any other
    width: int = 8

    def grade(self, table: str, column: str) -> str:
        return self.grades.get(f"{table}.{column}", "forbidden")

    def narrowed(self, limit: int | None = None, cap: int | None = None) -> "Policy":
        """A configuration may tighten limits, never loosen them."""
        return Policy(self.grades, self.masks, self.rows, self.k_tables, self.k, *(mine if not new else new if mine is None else min(mine, new) for mine, new in ((self.limit, limit), (self.cap, cap))), self.width)


@dataclass
class Verdict:
    violations: list[tuple[str, str, str]] = field(default_factory=list)  # code, severity, subject
    result: DataFrame | None = None
    rewrites: list[str] = field(default_factory=list)

    @property
    def allowed(self) -> bool:
        return not any(s in ("block", "error") for _, s, _ in self.violations)


def mask(rule: str, c: Column) -> Column:
    c = c.cast("string")
    at = F.instr(c, "@")
    rules = {
        "name": F.concat(F.substring(c, 1, 1), F.lit("**")),
        "phone": F.concat(F.lit("***-****-"), F.right(c, F.lit(4))),
        "email": F.when(at > 0, F.concat(F.substring(c, 1, 1), F.lit("***"), c.substr(at, F.length(c)))).otherwise(F.lit("***")),
        "hash": F.substring(F.sha2(c, 256), 1, 16),
        "null": F.lit(None).cast("string"),
    }
    return rules.get(rule, F.lit("***"))


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons that stand outside quotes and comments."""
    out, at, quote, i = [], 0, "", 0
    while i < len(sql):
        two = sql[i : i + 2]
        if quote:
            if sql[i] == quote:
                quote = ""
            elif sql[i] == "\\":
                i += 1
        elif two == "--":
            i = (sql.find("\n", i) + 1 or len(sql)) - 1
        elif two == "/*":
            i = (sql.find("*/", i) + 2 if "*/" in sql[i:] else len(sql)) - 1
        elif sql[i] in "'\"`":
            quote = sql[i]
        elif sql[i] == ";":
            out.append(sql[at:i])
            at = i + 1
        i += 1
    return [s.strip() for s in [*out, sql[at:]] if s.strip()]


_WHEN = re.compile(r"\s*(?:(?P<op>==|!=)|(?P<word>and|or|not)\b|(?:ctx\.)?(?P<name>[A-Za-z_]\w*)|'(?P<one>[^']*)'|\"(?P<two>[^\"]*)\"|(?P<num>-?\d+(?:\.\d+)?))", re.I)


def holds(when: str, context: dict) -> bool:
    """Whether a row policy applies: names of the context, == and != with literals, and, or, not, from left to right.

    Without a condition a policy always applies; a condition that isn't understood is refused.
    """
    found, at = [], 0
    while at < len(when.rstrip()):
        m = _WHEN.match(when, at)
        if not m:
            raise ValueError(f"condition not understood: {when}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not found:
        return True
    out, join, negate, i = None, "and", False, 0
    while i < len(found):
        kind, value = found[i]
        if kind == "word":
            if value.lower() == "not":
                negate = not negate
            elif out is None or i + 1 == len(found):
                raise ValueError(f"condition not understood: {when}")
            else:
                join = value.lower()
            i += 1
            continue
        if kind != "name":
            raise ValueError(f"condition not understood: {when}")
        got = context.get(value)
        if i + 1 < len(found) and found[i + 1][0] == "op":
            if i + 2 >= len(found) or found[i + 2][0] not in ("one", "two", "num"):
                raise ValueError(f"condition not understood: {when}")
            one = (str(got) == found[i + 2][1]) == (found[i + 1][1] == "==")
            i += 3
        else:
            one, i = got not in (None, "", False, 0), i + 1
        one, negate = one != negate, False
        out = one if out is None else (out and one) if join == "and" else (out or one)
    return bool(out)


def with_least_groups(sql: str, k: int) -> str:
    """The statement with HAVING count(*) >= k on its outermost grouping; whatever HAVING it has is kept."""
    parts = tokens(sql)
    at = clause(parts, "group")
    if at < 0:
        return sql
    having = clause(parts, "having", at)
    stop = next((p for p in (clause(parts, w, at) for w in ("window", "qualify", "union", "intersect", "except", "order", "limit")) if p >= 0), len(parts))
    if having >= 0:
        return f"{text(parts[:having])}HAVING ({text(parts[having + 1 : stop]).strip()}) AND count(*) >= {k} {text(parts[stop:])}".strip()
    return f"{text(parts[:stop]).rstrip()} HAVING count(*) >= {k} {text(parts[stop:])}".strip()


def load_policy(path: str) -> Policy:
    """A policy document (JSON, or YAML where that is installed): columns, masks, row_policies, k_anonymity, limits.

    Columns that it doesn't name are forbidden; grades and limits that it misspells are refused.
    """
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        doc = yaml.safe_load(raw)
    else:
        doc = json.loads(raw)
    grades = {k.lower(): v for k, v in (doc.get("columns") or {}).items()}
    if bad := {v for v in grades.values() if v not in GRADES}:
        raise ValueError(f"unknown grades: {sorted(bad)}")
    k, limits = doc.get("k_anonymity") or {}, doc.get("limits") or {}
    if bad := set(limits) - {"limit", "cap", "width"}:
        raise ValueError(f"unknown limits: {sorted(bad)}")
    if bad := {x for x, v in limits.items() if not isinstance(v, int)}:
        raise ValueError(f"limits that are no numbers: {sorted(bad)}")
    return Policy(grades, {x.lower(): v for x, v in (doc.get("masks") or {}).items()}, [RowPolicy(**r) for r in doc.get("row_policies") or []], frozenset(k.get("tables") or ()), int(k.get("k") or 0), **limits)


class Guard:
    def __init__(self, spark: SparkSession, folder: str, policy: Policy, context: dict | None = None, tables: tuple[str, ...] = ()):
        self.spark, self.policy, self.context, self.graph = spark.newSession(), policy, context or {}, JoinGraph()
        self.folder, self.notes = folder, []
        for t in tables:
            self._leaf(t).createOrReplaceTempView(t)

    # --- rows

    def _holds(self, when: str) -> bool:
        return holds(when, self.context)

    def _predicate(self, p: RowPolicy) -> Column:
        quoted = {k: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for k, v in self.context.items()}
        return F.expr(p.predicate.format(**quoted))

    def _leaf(self, table: str) -> DataFrame:
        """A table as this session may see it: row policies filter it, or semi-join it to the filtered table they are about."""
        df = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        for p in self.policy.rows:
            if not self._holds(p.when):
                continue
            if p.table == table:
                df = df.where(self._predicate(p))
                self.notes.append(f"row:{p.name}:{table}")
            elif p.propagate and (path := self.graph.path(table, p.table)) and not self.graph.fans_out(table, p.table):
                target = self.spark.read.parquet(f"{self.folder}/{p.table}.parquet").where(self._predicate(p))
                for child, parent in reversed(list(zip(path, path[1:], strict=False))):
                    e = next(e for e in self.graph.edges if (e.child, e.parent) == (child, parent))
                    side = df if child == table else self.spark.read.parquet(f"{self.folder}/{child}.parquet")
                    target = side.join(target.select(F.col(e.key).alias("_k")), F.col(e.column) == F.col("_k"), "left_semi")
                df = target
                self.notes.append(f"row:{p.name}:{table}")
        return df

    # --- statements

    def shape(self, sql: str) -> list[tuple[str, str, str]]:
        parts = split_statements(sql)
        if len(parts) != 1:
            return [("MULTI_STATEMENT", "block", str(len(parts)))]
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(parts[0])
        except Exception as e:
            return [("SQL_PARSE", "error", str(e).split("\n")[0][:80])]
        out = []

        def walk(p):
            name = p.getClass().getName()
            short = p.getClass().getSimpleName()
            if ".command." in name or short.endswith("Command") or re.match(r"(Create|Drop|Insert|Delete|Update|Merge|Alter|Truncate|Replace|Set|Add|Show|Describe|Cache|Uncache|Refresh|Analyze|Load|Overwrite|Append|Rename|Recover|Repair|Use|Explain)", short):
                out.append(("WRITE_FORBIDDEN", "block", short))
            for i in range(p.children().size()):
                walk(p.children().apply(i))

        walk(plan)
        names = set(re.findall(r"'?([a-z_0-9]+)\(", re.sub(r"'[^']*'", "''", parts[0].lower())))
        return out + [("FUNCTION_FORBIDDEN", "block", n) for n in sorted(names & DENIED)]

    # --- columns

    def inspect(self, df: DataFrame) -> Verdict:
        """Verdict on an analyzed query over this guard's tables, with the masked and limited result if it is allowed."""
        v, f, seen = Verdict(rewrites=list(self.notes)), facts(df), set()

        def say(code, severity, subject):
            if (code, subject) not in seen:
                seen.add((code, subject))
                v.violations.append((code, severity, subject))

        for node in sorted(f.unknown):
            say("PLAN_UNKNOWN", "block", node)
        for name in sorted(f.functions & DENIED):
            say("FUNCTION_FORBIDDEN", "block", name)
        if len(f.tables) > self.policy.width:
            say("TOO_MANY_JOINS", "block", str(len(f.tables)))
        if f.cartesian:
            say("CARTESIAN_JOIN", "error", str(f.cartesian))
        for columns, where in f.uses:
            for t, c in sorted(columns):
                g, subject = self.policy.grade(t, c), f"{t}.{c}"
                if g == "forbidden":
                    say("PII_FORBIDDEN", "block", subject)
                elif g == "masked" and where in ("predicate", "group"):
                    say("PII_PREDICATE", "block", subject)
                elif g == "masked" and where == "expression":
                    say("PII_EXPRESSION", "block", subject)
        outputs = []
        for name, s in f.output:
            worst = max((self.policy.grade(t, c) for t, c in s.columns), key=GRADES.index, default="public")
            subject = ", ".join(sorted(f"{t}.{c}" for t, c in s.columns if self.policy.grade(t, c) == worst))
            if worst == "forbidden":
                say("PII_FORBIDDEN", "block", subject)
            elif worst == "internal" and not s.grouped:
                say("INTERNAL_ROWLEVEL", "block", subject)
            if worst == "masked" and s.bare:
                rules = {self.policy.masks.get(f"{t}.{c}", "***") for t, c in s.columns if self.policy.grade(t, c) == "masked"}
                outputs.append(mask(rules.pop() if len(rules) == 1 else "***", F.col(f"`{name}`")).alias(name))
                v.rewrites.append(f"mask:{name}")
            else:
                outputs.append(F.col(f"`{name}`"))
        for below, least in f.groupings:
            if self.policy.k and below & self.policy.k_tables and least < self.policy.k:
                say("K_ANONYMITY", "block", ", ".join(sorted(below & self.policy.k_tables)))
        if v.allowed:
            got = df.select(*outputs)
            plan = df._jdf.queryExecution().analyzed()
            single = plan.getClass().getSimpleName() == "Aggregate" and plan.groupingExpressions().isEmpty()
            most = plan.limitExpr().toString() if plan.getClass().getSimpleName() == "GlobalLimit" else ""
            bound = self.policy.cap if most else self.policy.limit
            if not single and bound is not None and not (most.isdigit() and int(most) <= bound):
                got = got.limit(bound)
                v.rewrites.append("limit")
            v.result = got
        return v

    def check(self, sql: str) -> Verdict:
        if bad := self.shape(sql):
            return Verdict(bad)
        try:
            df = self.spark.sql(split_statements(sql)[0])
        except Exception as e:
            code = {"TABLE_OR_VIEW_NOT_FOUND": "UNKNOWN_TABLE", "UNRESOLVED_COLUMN": "UNKNOWN_COLUMN", "AMBIGUOUS_REFERENCE": "AMBIGUOUS_COLUMN", "MISSING_AGGREGATION": "GROUPBY_MISMATCH", "MISSING_GROUP_BY": "GROUPBY_MISMATCH"}
            return Verdict([(next((c for k, c in code.items() if k in str(e)), "SQL_ANALYSIS"), "error", str(e).split("\n")[0][:200])])
        v = self.inspect(df)
        if {c for c, s, _ in v.violations if s in ("block", "error")} == {"K_ANONYMITY"}:
            # Small groups are cut off instead, if the statement then provably has none.
            new = with_least_groups(split_statements(sql)[0], self.policy.k)
            try:
                again = self.inspect(self.spark.sql(new))
            except Exception:
                return v
            if again.allowed:
                again.rewrites.append(f"having:{self.policy.k}")
                return again
        return v


def k_anonymous(grouped_counted: DataFrame, k: int, count: str = "cnt") -> DataFrame:
    """Only groups of at least k rows."""
    return grouped_counted.where(F.col(count) >= k)


def capped(df: DataFrame, cap: int | None) -> tuple[list, bool]:
    """At most cap rows (None: all), and whether there were more; never more than one row over the cap is fetched."""
    if cap is None:
        return df.collect(), False
    rows = df.limit(cap + 1).collect()
    return rows[:cap], len(rows) > cap
