"""Column mappings from source code.

SQL is parsed by Spark itself: the unresolved logical plan of a statement is walked for its target, its sources and the expressions of its output
columns. Statements are cut out in executors and each distinct one is parsed once, on the driver, where Spark's parser is; results go to the
shared folder in bounded batches. Python cells are read with the standard ``ast`` module by a small helper that follows DataFrame variables to the table
they are saved as; it runs in executors over a table of artifacts. The private accessor of the SQL parser is used in ``plan_of`` alone.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from types import MappingProxyType
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.durable import new_folder, saved
from weftline.sources.resolve import OPEN, read_tables, resolved

MAPPING = "artifact_id string, output_column string, output_table_fqn string, source_fqn string, source_column string, source_ref string, expr string, expr_lang string"
READ = "artifact_id string, table_fqn string"
CELL = "artifact_id string, cell int, language string, source string"
EXPR_LIMIT = 2000
#: Rows of parsed statements that the driver holds before it writes them.
PARSED_ROWS = 5000

# Fixed values of notebook source files.
CELL_BREAK = re.compile(r"^# COMMAND -+\s*$", re.M)
MAGIC = "# MAGIC"
NO_LINEAGE = ("md", "markdown", "scala", "r")


def cells_of(raw: str | None, language: str | None) -> list[tuple[str, str]]:
    """(language, source) of each cell of a notebook (exported as JSON or as a source file) or of the one cell of a plain file; cells without lineage are left out."""
    raw, language = raw or "", language or "python"
    try:
        found = json.loads(raw)["cells"]
        cells = [(str(c.get("language") or c.get("cell_type") or ""), "".join(c.get("source") or "")) for c in found if isinstance(c, dict)]
        return [(lang, _without_magics(text)) for lang, text in cells] or [(language, "")]
    except (ValueError, TypeError, KeyError):
        pass
    if not CELL_BREAK.search(raw):
        return [(language, _without_magics(raw))]
    out = []
    for part in CELL_BREAK.split(raw):
        if not part.strip():
            continue
        declared = re.search(r"^\s*# MAGIC %(\w+)", part, re.M)
        lang = declared.group(1).lower() if declared else language
        if lang in NO_LINEAGE:
            continue
        lines = []
        for line in part.splitlines():
            bare = line.lstrip()
            if declared and bare.startswith(f"{MAGIC} %") or bare.startswith("# DBTITLE"):
                continue
            if declared and bare.startswith(MAGIC):
                lines.append(bare[len(MAGIC) :].removeprefix(" "))
            elif not (lang == "sql" and bare.startswith("#")):  # the file's own comments are Python's
                lines.append(line)
        out.append((lang, _without_magics("\n".join(lines))))
    return out


def _without_magics(text: str) -> str:
    return "\n".join(line for line in text.splitlines() if not re.match(r"\s*%\w+", line))


def cells(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, cell, language, source) of artifacts (extraction_id, language, raw_source)."""
    import pandas as pd

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(a, k, lang, text) for a, language, raw in zip(p["extraction_id"], p["language"], p["raw_source"], strict=True) for k, (lang, text) in enumerate(cells_of(raw, language))]
            yield pd.DataFrame(rows, columns=["artifact_id", "cell", "language", "source"])

    return artifacts.select("extraction_id", "language", "raw_source").mapInPandas(split, CELL)


# --- SQL, by Spark's own parser -----------------------------------------------------------------

_HEAD = re.compile(r"^\s*CREATE\s+(?:OR\s+(?:REPLACE|REFRESH)\s+)?(?:(TEMPORARY)\s+)?(?:(STREAMING)\s+)?(?:(LIVE)\s+)?(MATERIALIZED\s+VIEW|TABLE|VIEW)\b", re.I)
_EXPECT = re.compile(r"\(?\s*CONSTRAINT\s+\w+\s+EXPECT\s*\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s+ON\s+VIOLATION\s+(?:DROP\s+ROW|FAIL\s+UPDATE))?\s*[,)]?", re.I)
_LIVE = re.compile(r"\bLIVE\s*\.\s*(?=[\w`])", re.I)


def statements(text: str) -> list[str]:
    """Statements between semicolons that stand outside quotes and comments."""
    out, start = [], 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", text, re.S):
        if m.group() == ";":
            out.append(text[start : m.start()])
            start = m.end()
    return [s for s in (*out, text[start:]) if re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()]


def used(text: str) -> tuple[str | None, str | None]:
    """Catalog and schema of the first USE statements."""
    c = re.search(r"\bUSE\s+CATALOG\s+`?(\w+)`?", text, re.I)
    s = re.search(r"\bUSE\s+(?:SCHEMA|DATABASE)\s+`?(\w+)`?", text, re.I)
    return (c.group(1) if c else None), (s.group(1) if s else None)


def plan_of(spark: SparkSession, sql: str):  # noqa: ANN201
    """The unresolved logical plan of one statement (a JVM object), after declarative heads that Spark does not know are written as ones that it does."""
    head = _HEAD.match(sql)
    if head and (head.group(2) or head.group(3) or "MATERIALIZED" in head.group(4).upper()):
        kind = "STREAMING TABLE" if head.group(2) else "TEMPORARY VIEW" if head.group(1) or head.group(4).upper() == "VIEW" else "MATERIALIZED VIEW"
        sql = f"CREATE {kind}" + _EXPECT.sub(" ", sql[head.end() :])
    sql = _LIVE.sub("", sql)
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _name(node) -> str:  # noqa: ANN001
    return node.getClass().getSimpleName()


def _list(seq) -> list:  # noqa: ANN001
    return [seq.apply(i) for i in range(seq.size())]


def _parts(seq) -> list[str]:  # noqa: ANN001
    return [str(x) for x in _list(seq)]


def qualified(parts: list[str], catalog: str | None, schema: str | None) -> str:
    missing = [x for x in ((catalog, schema)[: 3 - len(parts)] if len(parts) == 1 else (catalog,)[: 3 - len(parts)]) if x]
    return ".".join([*missing, *parts])


class Ref(NamedTuple):
    """Where a column comes from: one of some relations (full name, name as written if it may be a view), under a name there; ``*`` are all columns but the hidden ones.

    Several options, or a column of a relation whose columns only the catalog knows, are settled later, by ``resolve.resolved``."""

    options: tuple[tuple[str, str | None], ...]
    column: str
    written: str
    fallback: str | None = None
    hidden: tuple[str, ...] = ()


#: name (None: it has none), text of the expression, sources
Output = tuple[str | None, str, list[Ref]]


class _Scope:
    """The relations that names stand for. ``shared`` are columns of USING with their sources, ``hidden`` what a star leaves out of a relation for them."""

    def __init__(self) -> None:
        self.relations: dict[str, tuple | list] = {}
        self.shared: dict[str, list[Ref]] = {}
        self.hidden: dict[str, tuple[str, ...]] = {}

    def add(self, other: _Scope) -> _Scope:
        self.relations |= other.relations
        self.shared |= other.shared
        self.hidden |= other.hidden
        return self

    def star(self, target: str | None = None, hidden: tuple[str, ...] = ()) -> list[Output]:
        """The columns of ``*`` or ``target.*``."""
        out: list[Output] = []
        for alias, relation in self.relations.items():
            if target is not None and alias != target:
                continue
            gone = hidden if target is not None else (*hidden, *self.hidden.get(alias, ()))
            if isinstance(relation, tuple):
                out.append(("*", "*", [Ref((relation,), "*", "*", None, gone)]))
                continue
            for name, text, refs in relation:
                if name == "*":
                    out.append((name, text, [r._replace(hidden=(*r.hidden, *gone)) for r in refs]))
                elif name is not None and name.lower() not in gone:
                    out.append((name, text, refs))
        return out

    def find(self, parts: list[str]) -> list[Ref]:
        """The sources of a name. A bare one belongs to the only subquery that has it; failing that, any table or starred subquery may."""
        column, written = parts[-1], ".".join(parts)
        low = column.lower()
        if len(parts) > 1:
            some = [self.relations[parts[-2].lower()]] if parts[-2].lower() in self.relations else []
        elif low in self.shared:
            return self.shared[low]
        else:
            some = list(self.relations.values())
        having = [r for r in some if isinstance(r, list) and any(o[0] and o[0].lower() == low for o in r)]
        if len(having) == 1:
            return [ref for o in having[0] if o[0] and o[0].lower() == low for ref in o[2]]
        maybe = [] if having else [x for r in some for x in ([r] if isinstance(r, tuple) else [x for o in r if o[0] == "*" for ref in o[2] if low not in ref.hidden for x in ref.options])]
        return [Ref(tuple(dict.fromkeys(maybe)), column, written)]


class _Query:
    """Outputs and sources of one query plan. A relation is a base table or view, or the outputs of a subquery."""

    def __init__(self, catalog: str | None, schema: str | None):
        self.default = (catalog, schema)
        self.tables: list[tuple[str, str | None]] = []

    def relation(self, parts: list[str]) -> tuple[str, str | None]:
        raw = parts[0] if len(parts) == 1 else ".".join(parts) if parts[0].lower() == "global_temp" else None
        return qualified(parts, *self.default), raw

    def columns(self, plan, ctes: dict) -> tuple[list[Output], _Scope]:  # noqa: ANN001
        """(outputs, relations by alias)."""
        kind, scope = _name(plan), _Scope()
        if kind == "UnresolvedWith":
            known = dict(ctes)
            for entry in _list(plan.cteRelations()):
                known[str(entry._1()).lower()] = self.outputs(entry._2(), known)
            return self.columns(plan.child(), known)
        if kind in ("UnresolvedRelation", "RelationTimeTravel"):
            parts = _parts((plan if kind == "UnresolvedRelation" else plan.relation()).multipartIdentifier())
            if len(parts) == 1 and parts[0].lower() in ctes:
                scope.relations[parts[0].lower()] = ctes[parts[0].lower()]
                return [], scope
            table = self.relation(parts)
            if table not in self.tables:
                self.tables.append(table)
            scope.relations[parts[-1].lower()] = table
            return [], scope
        if kind == "SubqueryAlias":
            outputs, inner = self.columns(plan.child(), ctes)
            scope.relations[str(plan.alias()).lower()] = outputs or (next(iter(inner.relations.values())) if len(inner.relations) == 1 else inner.star())
            return outputs, scope
        children = [self.columns(c, ctes) for c in _list(plan.children())]
        if kind == "Union":
            return _by_position([c[0] or c[1].star() for c in children]), scope
        for _, s in children:
            scope.add(s)
        if kind in ("Project", "Aggregate"):
            items = _list(plan.projectList() if kind == "Project" else plan.aggregateExpressions())
            return [o for e in items for o in self.output(e, scope, ctes)], scope
        if kind == "Generate":
            refs: list[Ref] = []
            self.references(plan.generator(), scope, refs, ctes)
            names = [str(x.name()) for x in _list(plan.generatorOutput())]
            if names:
                alias = str(plan.qualifier().get()) if plan.qualifier().isDefined() else names[0]
                scope.relations[alias.lower()] = [(n, plan.generator().sql(), refs) for n in names]
            return (children[0][0] if children else []), scope
        for e in _list(plan.expressions()):  # filters and join conditions: their subqueries are read
            self.references(e, scope, [], ctes)
        if kind == "Join":
            return [], self.joined(plan.joinType(), *(s for _, s in children))
        return (children[0][0] if children else []), scope

    @staticmethod
    def joined(how, left: _Scope, right: _Scope) -> _Scope:  # noqa: ANN001
        """The scope after a join; a column of USING is that of the side whose rows all stay, of both in a full join."""
        kind = how.tpe().sql() if _name(how) == "UsingJoin" else how.sql()
        if kind in ("LEFT SEMI", "LEFT ANTI"):
            return left
        both = _Scope().add(left).add(right)
        if _name(how) == "UsingJoin":
            for c in (x.lower() for x in _parts(how.usingColumns())):
                sides = {"FULL OUTER": (left, right), "RIGHT OUTER": (right,)}.get(kind, (left,))
                both.shared[c] = [r for side in sides for r in side.find([c])]
                for alias in (left if kind == "RIGHT OUTER" else right).relations:
                    both.hidden[alias] = (*both.hidden.get(alias, ()), c)
        return both

    def outputs(self, plan, ctes: dict) -> list[Output]:  # noqa: ANN001
        found, scope = self.columns(plan, ctes)
        return found or scope.star()

    def writes(self, plan, ctes: dict) -> list[tuple]:  # noqa: ANN001
        """(target's name parts or None, whether it is a temporary view, outputs) of each query that a statement holds; several for inserts that share a FROM."""
        kind = _name(plan)
        if kind == "UnresolvedWith":
            known = dict(ctes)
            for entry in _list(plan.cteRelations()):
                known[str(entry._1()).lower()] = self.outputs(entry._2(), known)
            return self.writes(plan.child(), known)
        if kind == "Union" and all(_name(c) == "InsertIntoStatement" for c in _list(plan.children())):
            return [w for c in _list(plan.children()) for w in self.writes(c, ctes)]
        if kind in ("UpdateTable", "DeleteFromTable"):
            return self.updated(plan)
        name, query = _target(plan)
        outputs = self.outputs(query, ctes)
        if kind == "InsertIntoStatement":
            wanted = _parts(plan.userSpecifiedCols())
            if len(wanted) == len(outputs) and all(o[0] != "*" for o in outputs):
                outputs = [(w, text, refs) for w, (_, text, refs) in zip(wanted, outputs, strict=True)]
        elif name:  # a table made from a query names such columns by their text
            outputs = [(text if n is None else n, text, refs) for n, text, refs in outputs]
        return [(name, kind == "CreateViewCommand", outputs)]

    def assigned(self, assignments: list, scope: _Scope) -> list[Output]:
        found = []
        for pair in assignments:
            refs: list[Ref] = []
            self.references(pair.value(), scope, refs, {})
            found.append((_parts(pair.key().nameParts())[-1], pair.value().sql(), refs))
        return found

    def updated(self, plan) -> list[tuple]:  # noqa: ANN001
        """The same of an UPDATE: its target is written, and read only where a subquery names it. A DELETE reads what its condition's subqueries do."""
        scope = _Query(*self.default).columns(plan.table(), {})[1]
        for e in _list(plan.expressions()):
            self.references(e, scope, [], {})
        target = next((t for t in scope.relations.values() if isinstance(t, tuple)), None)
        found = self.assigned(_list(plan.assignments()), scope) if _name(plan) == "UpdateTable" else []
        return [(target, False, found)]

    def merged(self, plan) -> list[tuple]:  # noqa: ANN001
        """The same of a MERGE: a column of the target for each assignment of its actions, all columns for ``*``."""
        target = _Query(*self.default).columns(plan.targetTable(), {})[1]
        source = self.columns(plan.sourceTable(), {})[1]
        scope = _Scope().add(target).add(source)
        self.references(plan.mergeCondition(), scope, [], {})
        found: list[Output] = []
        for actions in (plan.matchedActions(), plan.notMatchedActions(), plan.notMatchedBySourceActions()):
            for action in _list(actions):
                if _name(action) in ("UpdateAction", "InsertAction"):
                    found += self.assigned(_list(action.assignments()), scope)
                elif _name(action) in ("UpdateStarAction", "InsertStarAction"):
                    found += source.star()
        table = next((t for t in target.relations.values() if isinstance(t, tuple)), None)
        return [(table, False, found)]

    def output(self, expression, scope: _Scope, ctes: dict) -> list[Output]:  # noqa: ANN001
        kind = _name(expression)
        if "Star" in kind:
            target = _parts(expression.target().get())[-1].lower() if expression.target().isDefined() else None
            gone = tuple(_parts(x)[-1].lower() for x in _list(expression.excepts())) if "Except" in kind else ()
            return scope.star(target, gone)
        found: list[Ref] = []
        self.references(expression, scope, found, ctes)
        if kind == "Alias":
            return [(str(expression.name()), expression.child().sql(), found)]
        if kind == "UnresolvedAttribute":
            return [(_parts(expression.nameParts())[-1], ".".join(_parts(expression.nameParts())), found)]
        return [(None, (expression.child() if kind == "UnresolvedAlias" else expression).sql(), found)]

    def references(self, expression, scope: _Scope, found: list, ctes: dict) -> None:  # noqa: ANN001
        """Adds what an expression is made from; a scalar subquery gives the sources of its column, tables of any subquery are read."""
        kind = _name(expression)
        if kind == "UnresolvedAttribute":
            found += [ref for ref in scope.find(_parts(expression.nameParts())) if ref not in found]
        elif kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            inner = [ref for o in self.outputs(expression.plan(), ctes) for ref in o[2]]
            if kind == "ScalarSubquery":
                found += [ref for ref in inner if ref.options and ref not in found]
        for c in _list(expression.children()):
            self.references(c, scope, found, ctes)


def _by_position(branches: list[list[Output]]) -> list[Output]:
    """Columns of a set operation's branches belong together by position, or by name where a star hides positions; other stars stay beside them."""
    outputs = list(branches[0])
    plain = all(len(b) == len(outputs) and all(o[0] != "*" for o in b) for b in branches)
    for other in branches[1:]:
        named = {o[0].lower(): o for o in other if o[0]}
        for k, (name, text, refs) in enumerate(branches[0]):
            more = other[k] if plain else named.get((name or "").lower()) if name != "*" else None
            outputs[k] = (name, text, outputs[k][2] + [r for r in (more[2] if more else ()) if r not in outputs[k][2]])
        if not plain:
            outputs += [o for o in other if o[0] == "*" and o not in outputs]
    return outputs


def _target(plan):  # noqa: ANN001, ANN202
    """(name parts, query) of a statement that writes, else (None, plan)."""
    kind = _name(plan)
    if kind == "InsertIntoStatement":
        return _parts(plan.table().multipartIdentifier()), plan.query()
    if kind in ("CreateTableAsSelect", "ReplaceTableAsSelect", "CreateMaterializedViewAsSelect", "CreateStreamingTableAsSelect"):
        return _parts(plan.name().nameParts()), plan.query()
    if kind == "CreateView":
        return _parts(plan.child().nameParts()), plan.query()
    if kind == "CreateViewCommand":
        return [str(plan.name().table())], plan.plan()
    return None, plan


def open_rows(target: str | None, is_view: bool, outputs: list[Output], lang: str, merging: bool = False) -> list[tuple]:
    """Rows of OPEN, without the artifact, for the columns that are written to a target: one for each source of each column. A column of a view that is made from
    nothing has one row without options. A column without a name has its position, unless a star before it hides that."""
    rows, starred = [], False
    for position, (name, text, refs) in enumerate(outputs):
        starred = starred or name == "*"
        at = None if starred else position + 1
        for r in refs or ([Ref((), None, None)] if is_view and name else []):
            kind = ("merge" if merging else "star") if r.column == "*" and name == "*" else "named"
            rows.append((kind, name, at, target, is_view, [list(o) for o in r.options], r.fallback, r.column, r.written, text[:EXPR_LIMIT], lang, list(r.hidden)))
    return rows


def statement_lineage(spark: SparkSession, sql: str, catalog: str | None, schema: str | None, view: str | None = None) -> tuple[list[tuple], list[tuple[str, str | None]]]:
    """(rows of OPEN without their artifact, tables read with their names as written) of one statement; an error of Spark's parser is passed on.

    A query that writes nothing defines ``view``, if that is given."""
    q = _Query(catalog, schema)
    plan = plan_of(spark, sql)
    merging = _name(plan) == "MergeIntoTable"
    rows = []
    for name, is_view, outputs in q.merged(plan) if merging else q.writes(plan, {}):
        if isinstance(name, tuple):
            rows += open_rows(name[0], False, outputs, "sql", merging)
        elif name:
            rows += open_rows(name[-1] if is_view else qualified(name, catalog, schema), is_view, outputs, "sql")
        elif view:
            rows += open_rows(view, True, outputs, "sql")
    return rows, q.tables


def _fault(e: Exception) -> str:
    return (getattr(e, "desc", None) or str(e).strip() or type(e).__name__).splitlines()[0][:200]


def plain(artifact: str, rows: list[tuple]) -> list[tuple]:
    """Mappings of rows of OPEN that need no catalog and no other cell: those with one option, or else the fallback."""
    out = []
    for kind, name, _, target, is_view, options, fallback, column, written, expr, lang, _ in rows:
        source = options[0][0] if len(options) == 1 else fallback
        if kind == "named" and name and not is_view and column and not (source == target and column == name):
            out.append((artifact, name, target, source, column, written, expr, lang))
    return out


def sql_mappings(spark: SparkSession, artifact: str, sql: str, catalog: str | None = None, schema: str | None = None) -> tuple[list[tuple], list[tuple], list[str]]:
    """(mappings, reads, warnings) of the statements of one artifact, each by itself. Statements that Spark cannot parse are named in the warnings."""
    use = used(sql)
    mappings: list[tuple] = []
    reads: list[tuple] = []
    warnings: list[str] = []
    for text in statements(sql):
        if re.match(r"\s*USE\b", text, re.I):
            continue
        try:
            found, tables = statement_lineage(spark, text, use[0] or catalog, use[1] or schema)
        except Exception as e:  # noqa: BLE001  the parser's own error, from the JVM
            warnings.append(_fault(e))
            continue
        mappings += plain(artifact, found)
        reads += [(artifact, t) for t, _ in tables]
    return mappings, list(dict.fromkeys(reads)), warnings


def sql_statements(sql_cells: DataFrame, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    """(artifact_id, statement, catalog, schema, view) of SQL cells (artifact_id, source and, for texts that a frame stands for, view), with the defaults that USE sets; cut out in executors."""
    import pandas as pd

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for artifact, text, view in zip(p["artifact_id"], p["source"], p["view"], strict=True):
                c, s = used(text or "")
                rows += [(artifact, x, c or catalog, s or schema, view) for x in statements(text or "") if not re.match(r"\s*USE\b", x, re.I)]
            yield pd.DataFrame(rows, columns=["artifact_id", "statement", "catalog", "schema", "view"])

    view = F.col("view") if "view" in sql_cells.columns else F.lit(None).cast("string").alias("view")
    return sql_cells.select("artifact_id", "source", view).mapInPandas(split, "artifact_id string, statement string, catalog string, schema string, view string")


def sql_lineage(spark: SparkSession, sql_cells: DataFrame, catalog: str | None = None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of OPEN, reads with their names as written) of SQL cells (artifact_id, source, view).

    Only distinct statements pass the driver, where Spark's parser is, one by one; what they give is written in batches of ``PARSED_ROWS`` and
    joined back to all artifacts that hold them."""
    key = F.sha2(F.to_json(F.struct("statement", "catalog", "schema", "view")), 256)
    said = saved(sql_statements(sql_cells, catalog, schema).withColumn("key", key), "statements")
    folder, rows = new_folder(spark, "parsed"), []
    own = OPEN.partition(", ")[2]
    kind = f"key string, is_read boolean, {own}"

    def flush() -> None:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(folder)
        rows.clear()

    for r in said.dropDuplicates(["key"]).select("key", "statement", "catalog", "schema", "view").toLocalIterator():
        try:
            found, tables = statement_lineage(spark, r["statement"], r["catalog"], r["schema"], r["view"])
        except Exception:  # noqa: BLE001, S112  not a statement of Spark's: it has no lineage
            continue
        rows += [(r["key"], False, *m) for m in found] + [(r["key"], True, None, None, None, None, None, [[t, raw]], *[None] * 6) for t, raw in tables]
        if len(rows) >= PARSED_ROWS:
            flush()
    flush()
    parsed = said.select("artifact_id", "key").distinct().join(spark.read.schema(kind).parquet(folder), "key").drop("key")
    reads = parsed.filter("is_read").select("artifact_id", F.col("options")[0]["fqn"].alias("table_fqn"), F.col("options")[0]["raw"].alias("raw"))
    return parsed.filter("not is_read").drop("is_read"), reads


# --- Python ---------------------------------------------------------------------------------------

_READS = ("table", "read", "readStream")


def _text(node: ast.AST | None, known: Mapping[str, str]) -> str | None:
    """A string constant, a name bound to one, or an f-string of such."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.Name):
        return known.get(node.id)
    if isinstance(node, ast.JoinedStr):
        parts = [p.value if isinstance(p, ast.Constant) else _text(p.value, known) for p in node.values]
        return "".join(parts) if all(p is not None for p in parts) else None
    return None


def _calls(node: ast.AST) -> list[ast.Call]:
    """The calls of a method chain, the first one first."""
    out: list[ast.Call] = []
    while True:
        if isinstance(node, ast.Call):
            out.append(node)
            node = node.func
        elif isinstance(node, ast.Attribute):
            node = node.value
        else:
            return out[::-1]


_NO_COLUMNS = ("columns", "schema", "write", "writeStream", "writeTo", "rdd", "na", "stat", "dtypes", "isStreaming")


def _column_names(node: ast.AST, frames: Mapping[str, object] = MappingProxyType({})) -> list[str]:
    """Columns that an expression names: F.col("x"), col("x"), identifier strings given to functions of F other than ``lit``, and df.x or df["x"] of a known frame."""
    out, called = [], {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)}
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            f = n.func
            plain = isinstance(f, ast.Name) and f.id == "col"
            of_f = isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("F", "f", "functions") and f.attr != "lit"
            if plain or of_f:
                out += [a.value for a in n.args if isinstance(a, ast.Constant) and isinstance(a.value, str) and re.fullmatch(r"[A-Za-z_][\w.]*", a.value)]
        elif isinstance(n, (ast.Attribute, ast.Subscript)) and isinstance(n.value, ast.Name) and n.value.id in frames and id(n) not in called:
            name = n.attr if isinstance(n, ast.Attribute) else getattr(n.slice, "value", None)
            if isinstance(name, str) and name not in _NO_COLUMNS:
                out.append(f"{n.value.id}.{name}")
    return list(dict.fromkeys(out))


_LOOSE_READ = re.compile(r"""\b(?:spark|dlt)\s*\.\s*(?:read(?:Stream)?\s*\.\s*)?table\(\s*["']([\w.]+)["']""")


def _constants(trees: list[ast.Module]) -> dict[str, str]:
    """Names that stand for one and the same string wherever they are assigned."""
    values: dict[str, set] = {}
    for n in (n for tree in trees for n in ast.walk(tree)):
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            values.setdefault(n.targets[0].id, set()).add(n.value.value if isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) else None)
    return {k: next(iter(v)) for k, v in values.items() if len(v) == 1 and None not in v}


def _option(name: str) -> tuple[str, str | None]:
    """A table, or what may be a view: a name of one part, one of global_temp, or the frame of a SQL text."""
    return name, name if "." not in name or name.lower().startswith(("global_temp.", "sql:", "frame:")) else None


class _Frame:
    """What a DataFrame expression is made of: tables, derived columns with their sources, aliases, the keys of an open grouping, and the tables whose
    columns it has whole, with those that are hidden."""

    def __init__(self, tables: list[str] = ()):
        self.tables, self.keys = list(tables), []
        self.outputs: dict[str, list[tuple[Ref, str]]] = {}
        self.aliases: dict[str, str] = {}
        self.stars: dict[str, tuple[str, ...]] = {t: () for t in tables}

    def copy(self) -> _Frame:
        f = _Frame(self.tables)
        f.outputs, f.aliases, f.stars = dict(self.outputs), dict(self.aliases), dict(self.stars)
        return f

    def hide(self, *names: str) -> None:
        self.stars = {t: (*h, *(n.lower() for n in names)) for t, h in self.stars.items()}

    def read(self, table: str) -> None:
        self.tables.append(table)
        self.stars[table] = ()

    def sources(self, names: list[str], expr: str, frames: Mapping[str, _Frame] = MappingProxyType({})) -> list[tuple[Ref, str]]:
        out: list[tuple[Ref, str]] = []
        for n in names:
            prefix, _, column = n.rpartition(".")
            if prefix in self.aliases:
                out.append((Ref((_option(self.aliases[prefix]),), column, n), expr))
            elif prefix in frames:
                out += frames[prefix].sources([column], expr)
            elif not prefix and column in self.outputs:  # made before: its sources stand for it
                out += [(r, expr) for r, _ in self.outputs[column]]
            else:
                out.append((Ref(tuple(map(_option, self.tables)), column, n, self.tables[0] if self.tables else None), expr))
        return out


_SINKS = ("saveAsTable", "insertInto", "toTable")
_VIEWS = {"createOrReplaceTempView": "", "createTempView": "", "registerTempTable": "", "createOrReplaceGlobalTempView": "global_temp.", "createGlobalTempView": "global_temp."}
#: Calls of functions inside one another that are followed.
CALL_DEPTH = 8


class _Reader:
    """Walks the statements of one artifact's cells in order, into branches and function bodies too.

    Functions have scopes of their own: names inside shadow those outside and end with the body. A call of a function of the artifact is read with its arguments
    in place of the parameters. A SQL text that a frame is made from is a view, named by its text, that the SQL reader defines."""

    def __init__(self, artifact: str, trees: list[ast.Module]):
        self.artifact, self.depth = artifact, 0
        self.known: ChainMap = ChainMap(_constants(trees))
        self.frames: ChainMap = ChainMap({})
        every = [n for tree in trees for n in ast.walk(tree)]
        self.functions = {n.name: n for n in every if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        self.called = {n.id for n in every if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} & set(self.functions)
        self.entered: set[str] = set()
        self.rows: list[tuple] = []
        self.reads: list[str] = []
        self.texts: dict[str, str] = {}

    def text(self, node: ast.AST | None) -> str | None:
        return _text(node, self.known)

    def names(self, node: ast.AST) -> list[str]:
        return _column_names(node, self.frames)

    def sources(self, f: _Frame, names: list[str], node: ast.AST) -> list[tuple[Ref, str]]:
        return f.sources(names, ast.unparse(node), self.frames)

    def items(self, frame: _Frame, nodes: list[ast.AST], named: list[ast.keyword] = ()) -> tuple[dict[str, list[tuple]], bool]:
        """Columns that the arguments of select or agg give, and whether a star keeps those there are."""
        made: dict[str, list[tuple]] = {k.arg: self.sources(frame, self.names(k.value), k.value) for k in named if k.arg}
        star = False
        for a in nodes:
            if isinstance(a, (ast.List, ast.Tuple)):
                more, s = self.items(frame, a.elts)
                made, star = made | more, star or s
                continue
            chain = _calls(a)
            last = chain[-1] if chain else None
            if last is not None and isinstance(last.func, ast.Attribute) and last.func.attr == "alias" and last.args:
                name = self.text(last.args[0])
                if name:
                    made[name] = self.sources(frame, self.names(last.func.value), last.func.value)
                continue
            if isinstance(a, ast.Constant) and a.value == "*":
                star = True
                continue
            names = self.names(a) or ([t] if (t := self.text(a)) else [])
            if len(names) == 1:
                made[names[0].rpartition(".")[2]] = self.sources(frame, names, a)
        return made, star

    def frame(self, node: ast.AST) -> _Frame:
        root = node
        while isinstance(root, (ast.Call, ast.Attribute)):
            root = root.func if isinstance(root, ast.Call) else root.value
        chain = _calls(node)
        if chain and isinstance(chain[0].func, ast.Name) and chain[0].func.id in self.functions:
            f = self.result(chain[0].func.id, chain[0].args, chain[0].keywords)
            chain = chain[1:]
        else:
            known = self.frames.get(root.id) if isinstance(root, ast.Name) else None
            f = known.copy() if known else _Frame()
        for call in chain:
            self.step(f, call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", ""), call)
        return f

    def result(self, name: str, args: list[ast.AST | _Frame], named: list[ast.keyword] = ()) -> _Frame:
        """What a call of a function returns: the body is read with the arguments in place of the parameters."""
        if self.depth >= CALL_DEPTH:
            return _Frame()
        function = self.functions[name]
        self.entered.add(name)
        given = dict(zip([a.arg for a in function.args.args], args, strict=False)) | {k.arg: k.value for k in named if k.arg}
        texts = {k: t for k, v in given.items() if not isinstance(v, _Frame) and (t := self.text(v)) is not None}
        frames = {k: v if isinstance(v, _Frame) else self.frame(v) for k, v in given.items() if k not in texts}
        self.depth += 1
        try:
            return self.body(function, texts, frames)
        finally:
            self.depth -= 1

    def body(self, function: ast.FunctionDef, texts: dict[str, str], frames: dict[str, _Frame]) -> _Frame:
        """Reads a body in a scope of its own; the frame of its last return at the top level."""
        before = self.known, self.frames
        self.known, self.frames = self.known.new_child(texts), self.frames.new_child(frames)
        try:
            self.visit([x for x in function.body if not isinstance(x, ast.Return)])
            last = next((x.value for x in reversed(function.body) if isinstance(x, ast.Return) and x.value is not None), None)
            return self.frame(last) if last is not None else _Frame()
        finally:
            self.known, self.frames = before

    def step(self, f: _Frame, method: str, call: ast.Call) -> None:
        """What one call of a method chain does to the frame."""
        first = self.text(call.args[0]) if call.args else None
        if method in _READS and first:
            f.read(first)
        elif method == "sql" and first:
            f.read(self.said(first))
        elif method == "selectExpr" and call.args and all(t is not None for t in map(self.text, call.args)):
            inner = f"frame:{len(self.texts)}:{len(self.rows)}"
            self.define(inner, f)
            texts = ", ".join(self.text(a) for a in call.args)
            f.__init__()
            f.read(self.said(f"SELECT {texts} FROM `{inner}`"))
        elif method == "transform" and call.args and isinstance(call.args[0], ast.Name) and call.args[0].id in self.functions:
            f.__dict__ |= self.result(call.args[0].id, [f.copy(), *call.args[1:]], call.keywords).__dict__
        elif method == "alias" and first and len(f.tables) == 1:
            f.aliases[first] = f.tables[0]
        elif method in ("join", "union", "unionByName", "crossJoin") and call.args:
            other = self.frame(call.args[0])
            f.tables += [x for x in other.tables if x not in f.tables]
            if method.startswith("union"):
                for name, refs in other.outputs.items():
                    f.outputs[name] = f.outputs.get(name, []) + [r for r in refs if r not in f.outputs.get(name, [])]
            else:
                keys = [t for a in call.args[1:2] for x in (a.elts if isinstance(a, (ast.List, ast.Tuple)) else [a]) if (t := self.text(x))]
                other.hide(*keys)
                f.outputs = {**other.outputs, **f.outputs}
            f.stars = other.stars | f.stars
            f.aliases |= other.aliases
        elif method == "withColumn" and len(call.args) == 2 and first:
            f.outputs[first] = self.sources(f, self.names(call.args[1]), call.args[1])
            f.hide(first)
        elif method == "withColumns" and call.args and isinstance(call.args[0], ast.Dict):
            made = {self.text(k): self.sources(f, self.names(v), v) for k, v in zip(call.args[0].keys, call.args[0].values, strict=True)}
            f.outputs |= {k: v for k, v in made.items() if k}
            f.hide(*filter(None, made))
        elif method == "withColumnRenamed" and len(call.args) == 2:
            new = self.text(call.args[1])
            if first and new:
                f.outputs[new] = f.outputs.pop(first, None) or f.sources([first], first)
                f.hide(first, new)
        elif method == "drop":
            for name in filter(None, map(self.text, call.args)):
                f.outputs.pop(name, None)
                f.hide(name)
        elif method == "select":
            made, star = self.items(f, call.args)
            f.outputs, f.stars = (f.outputs | made if star else made), (f.stars if star else {})
        elif method in ("groupBy", "groupby"):
            f.keys = call.args
        elif method == "agg":
            made = self.items(f, f.keys)[0]
            if call.args and isinstance(call.args[0], ast.Dict):
                pairs = zip(map(self.text, call.args[0].keys), map(self.text, call.args[0].values), strict=True)
                made |= {f"{how}({name})": f.sources([name], f"{how}({name})") for name, how in pairs if name and how}
            else:
                made |= self.items(f, call.args, call.keywords)[0]
            f.outputs, f.keys, f.stars = made, [], {}

    def said(self, text: str) -> str:
        """The view that a SQL text stands for."""
        name = sql_view(text)
        self.texts[name] = text
        return name

    def define(self, target: str | None, f: _Frame, is_view: bool = True) -> None:
        """Rows for the columns of a frame under a view's or a table's name; the tables that it is made from are read."""
        self.reads += [t for t in f.tables if t not in self.reads]
        if target:
            for name, refs in f.outputs.items():
                for r, expr in refs or ([(Ref((), None, None), "")] if is_view else []):
                    self.rows += open_rows(target, is_view, [(name, expr, [r])], "pyspark")
            for table, hidden in f.stars.items():
                self.rows += open_rows(target, is_view, [("*", "*", [Ref((_option(table),), "*", "*", None, hidden)])], "pyspark")

    def sinks(self, node: ast.AST) -> None:
        """Tables and views that a chain of calls writes, and SQL texts that it runs."""
        for call in _calls(node):
            method = call.func.attr if isinstance(call.func, ast.Attribute) else ""
            if method in _VIEWS and call.args and (name := self.text(call.args[0])):
                self.define(_VIEWS[method] + name, self.frame(call.func.value))
            elif method in (*_SINKS, "writeTo") and call.args:
                self.define(self.text(call.args[0]), self.frame(call.func.value), False)

    def function(self, s: ast.FunctionDef) -> None:
        """A decorated table function is written under its name. The body of a function that is never called is read where it stands."""
        for d in s.decorator_list:
            made = d.func if isinstance(d, ast.Call) else d
            if (made.attr if isinstance(made, ast.Attribute) else getattr(made, "id", "")) in ("table", "view", "materialized_view", "create_table", "create_view", "create_streaming_table", "temporary_view"):
                named = next((self.text(k.value) for k in getattr(d, "keywords", []) if k.arg == "name"), None) or (self.text(d.args[0]) if getattr(d, "args", None) else None)
                self.define(named or s.name, self.body(s, {}, {}), False)
                return
        if s.name not in self.called:
            self.body(s, {}, {})

    def visit(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)) and s.value is not None:
                name = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else getattr(s, "target", None)
                self.sinks(s.value)
                if isinstance(name, ast.Name):
                    text = self.text(s.value)
                    if text is not None:
                        self.known[name.id] = text
                    else:
                        self.frames[name.id] = self.frame(s.value)
            elif isinstance(s, ast.Expr):
                self.sinks(s.value)
                if isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name):
                    self.frame(s.value)
            for part in ("body", "orelse", "finalbody"):
                if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    self.visit(getattr(s, part, None) or [])
            for handler in getattr(s, "handlers", None) or []:
                self.visit(handler.body)

    def scan(self, text: str) -> None:
        """Reads a source that is no Python by its tokens: calls whose own arguments are Python, in the order in which they stand; the last sink is the target."""
        for name, value in re.findall(r"""^\s*(\w+)\s*=\s*["']([^"'\n]*)["']\s*$""", text, re.M):
            self.known[name] = value
        f, found, target = _Frame(), {}, None
        for method, start in ((m[1], m.end()) for m in re.finditer(r"\.\s*(table|withColumn|select|agg|saveAsTable|insertInto|toTable)\(", text)):
            call = _arguments(text, start)
            if call is None:
                continue
            first = self.text(call.args[0]) if call.args else None
            if method == "table" and first:
                f.read(first)
            elif method in _SINKS and first:
                target = first
            elif method == "withColumn" and first and len(call.args) == 2:
                found[first] = (call.args[1:], None)
            elif method in ("select", "agg"):
                found |= {a: (call.args, a) for a in self.items(f, call.args, call.keywords)[0]}
        for name, (nodes, alias) in found.items():
            refs = self.items(f, nodes)[0].get(alias) if alias else self.sources(f, self.names(nodes[0]), nodes[0])
            f.outputs[name] = refs or []
        f.stars = {}
        self.define(target, f, False)


def _arguments(text: str, start: int) -> ast.Call | None:
    """The call whose arguments begin at ``start``, up to its closing bracket; None if they are no Python."""
    depth = 1
    for m in re.finditer(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|#[^\n]*|[()\[\]{}]", text[start:]):
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            try:
                return ast.parse(f"f({text[start : start + m.start()]})", mode="eval").body
            except SyntaxError:
                return None
    return None


def sql_view(text: str) -> str:
    """The name of the view that a SQL text in Python stands for."""
    return "sql:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def read_python(artifact: str, sources: list[str]) -> _Reader:
    """A reader that has read the cells of one artifact in order. Cells that are no Python are left out; if nothing of the artifact gave a row, they are scanned."""
    trees, broken = [], []
    for source in sources:
        try:
            trees.append(ast.parse(source))
        except (SyntaxError, ValueError):
            broken.append(source)
    reader = _Reader(artifact, trees)
    for tree in trees:
        reader.visit(tree.body)
    for name in sorted(reader.called - reader.entered):  # handed on by name only
        if not reader.functions[name].decorator_list:
            reader.body(reader.functions[name], {}, {})
    if broken and not reader.rows:
        reader.scan("\n".join(broken))
    for source in broken:
        reader.reads += [t for t in _LOOSE_READ.findall(source) if t not in reader.reads]
    for text in (t for source in sources for t in sql_in_python(source, reader.known)):
        reader.said(text)
    return reader


def python_mappings(artifact: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """(mappings, reads) of one Python source: what select, agg, withColumn and withColumnRenamed make on the way from tables to ``saveAsTable`` (or ``insertInto``, ``toTable``, ``writeTo``, or a decorated table function).

    A select or an aggregation replaces the columns before it. A source that is no Python is scanned for calls."""
    reader = read_python(artifact, [source])
    return plain(artifact, reader.rows), [(artifact, t) for t in reader.reads if not t.startswith(("sql:", "frame:"))]


_LOOSE_SQL = re.compile(r"""\.sql\(\s*([fF]?)(\"{3}|'{3}|"|')(.*?)\2""", re.S)


def sql_in_python(source: str, known: Mapping[str, str] = MappingProxyType({})) -> list[str]:
    """SQL texts given to ``spark.sql`` as constants; of a source that is no Python those that stand there in quotes, f-strings with the constants that are known."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        fill = lambda t: re.sub(r"\{(\w+)\}", lambda m: known.get(m[1], m[0]), t)
        return [fill(text) if f else text for f, _, text in _LOOSE_SQL.findall(source)]
    known = ChainMap(dict(_constants([tree])), dict(known))
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "sql" and n.args]
    return [t for t in (_text(n.args[0], known) for n in calls) if t]


def python_lineage(python_cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of OPEN, reads, SQL texts with the views that they stand for) of artifacts' Python cells (artifact_id, cell, source), in executors. Cells of an artifact are read in order as one program."""
    import pandas as pd

    whole = python_cells.groupBy("artifact_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "source"))), lambda c: c["source"]).alias("sources"))
    own = [c.split()[0] for c in OPEN.split(", ")]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for a, sources in zip(p["artifact_id"], p["sources"], strict=True):
                reader = read_python(a, [x or "" for x in sources])
                rows += [("m", a, k, c, at, t, v, [{"fqn": o[0], "raw": o[1]} for o in options], *rest) for k, c, at, t, v, options, *rest in reader.rows]
                rows += [("r", a, *[None] * 5, [{"fqn": t, "raw": _option(t)[1]}], *[None] * 6) for t in reader.reads]
                rows += [("s", a, None, None, None, view, *[None] * 5, text, None, None) for view, text in reader.texts.items()]
            out = pd.DataFrame(rows, columns=["row", *own])
            out["position"] = out["position"].astype("Int32")
            out["is_view"] = out["is_view"].astype("boolean")
            yield out

    found = saved(whole.mapInPandas(parse, f"row string, {OPEN}"), "python")
    reads = found.filter("row = 'r'").select("artifact_id", F.col("options")[0]["fqn"].alias("table_fqn"), F.col("options")[0]["raw"].alias("raw"))
    return found.filter("row = 'm'").drop("row"), reads, found.filter("row = 's'").select("artifact_id", F.col("expr").alias("source"), F.col("target").alias("view"))


def lineage_of(spark: SparkSession, artifacts: DataFrame, catalog: str | None = None, schema: str | None = None, columns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mappings, reads) of artifacts of either language, with the SQL that Python cells run; views and frames lead from one cell to another.

    ``columns`` (table_fqn, column_name, ordinal_position) is the catalog's columns table, by which stars, bare names and columns without a name are settled."""
    every = saved(cells(artifacts), "cells")
    m1, r1, texts = python_lineage(every.filter("lower(language) in ('python', 'py', 'pyspark', 'code')"))
    said = every.filter("lower(language) = 'sql'").select("artifact_id", "source", F.lit(None).cast("string").alias("view")).unionByName(texts)
    m2, r2 = sql_lineage(spark, said, catalog, schema)
    rows = saved(m1.unionByName(m2.select(m1.columns)), "rows")
    return resolved(rows, columns), read_tables(r1.unionByName(r2), rows)


def producers(spark: SparkSession, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(full_name, n, statement_text, skip_reason): of each wanted table the newest of its ``queries`` (full_name, n, statement_text) that Spark parses as writing to it;
    ``no_producing_query`` where none does. Names agree in any case of letters."""
    key = F.sha2(F.to_json(F.struct(F.col("statement_text").alias("statement"), F.lit(None).cast("string").alias("catalog"), F.lit(None).cast("string").alias("schema"))), 256)
    kept = saved(queries.select("full_name", "n", "statement_text", key.alias("artifact_id")), "history")
    written = sql_targets(spark, kept.select("artifact_id", F.col("statement_text").alias("source")).distinct())
    hit = kept.join(written, "artifact_id").filter(F.lower("target") == F.lower("full_name"))
    first = hit.groupBy("full_name").agg(F.min(F.struct("n", "statement_text")).alias("q")).select("full_name", "q.n", "q.statement_text")
    return wanted.select("full_name").distinct().join(first, "full_name", "left").withColumn("skip_reason", F.when(F.col("n").isNull(), "no_producing_query"))


def _targets(plan) -> list[tuple[list[str], bool]]:  # noqa: ANN001
    """(name parts, whether it is a view's own name) of what a statement writes, without a look at its queries."""
    kind = _name(plan)
    if kind == "UnresolvedWith":
        return _targets(plan.child())
    if kind == "Union":
        return [t for c in _list(plan.children()) for t in _targets(c)]
    if kind in ("MergeIntoTable", "UpdateTable"):
        table = plan.targetTable() if kind == "MergeIntoTable" else plan.table()
        while _name(table) == "SubqueryAlias":
            table = table.child()
        return [(_parts(table.multipartIdentifier()), False)]
    name, _ = _target(plan)
    return [(name, kind == "CreateViewCommand")] if name else []


#: Words with digits, which no keyword of Spark's has, outside numbers; quoted texts are passed over.
_NUMBERED = re.compile(r"""'[^']*'|"[^"]*"|`[^`]*`|(?<!\w)(?<!\d\.)([A-Za-z_]+\d\w*)""", re.A)
_UNSHAPED = re.compile(r"""\\|--|/\*|[$@:]|wl\d+q|[^\x00-\x7F]""", re.I)


def shape(statement: str) -> tuple[str, list[str]]:
    """The statement with its distinct words that hold digits numbered, ``wl0q`` and so on, and these words.

    A numbered word is an identifier as the word itself is, so both statements have one plan but for these names. Where the text might matter to the parser
    (escapes, comments, variables, quotes left open) the statement is its own shape."""
    if _UNSHAPED.search(statement) or re.search(r"""['"`]""", _NUMBERED.sub(" ", statement)):
        return statement, []
    words: dict[str, int] = {}
    return _NUMBERED.sub(lambda m: m[0] if m[1] is None else f"wl{words.setdefault(m[1], len(words))}q", statement), list(words)


def sql_targets(spark: SparkSession, sql_cells: DataFrame) -> DataFrame:
    """(artifact_id, target) of the tables that statements (artifact_id, source) write.

    Only distinct shapes of statements pass the driver, where Spark's parser is; what they write is joined back and the words put in again in executors."""
    import pandas as pd

    def shaped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            both = [shape(s) for s in p["statement"]]
            yield p.assign(shape=[s for s, _ in both], words=[w for _, w in both])

    said = saved(sql_statements(sql_cells).drop("view").distinct().mapInPandas(shaped, "artifact_id string, statement string, catalog string, schema string, shape string, words array<string>").drop("statement"), "statements")
    folder, rows, kind = new_folder(spark, "targets"), [], "shape string, parts array<string>, whole boolean"

    def flush() -> None:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(folder)
        rows.clear()

    for r in said.select("shape").distinct().toLocalIterator():
        try:
            rows += [(r["shape"], list(names), whole) for names, whole in _targets(plan_of(spark, r["shape"]))]
        except Exception:  # noqa: BLE001, S112  not a statement of Spark's
            continue
        if len(rows) >= PARSED_ROWS:
            flush()
    flush()

    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for artifact, catalog, schema, words, names, whole in zip(p["artifact_id"], p["catalog"], p["schema"], p["words"], p["parts"], p["whole"], strict=True):
                put = [re.sub(r"wl(\d+)q", lambda m, w=words: w[int(m[1])], n) if len(words) else n for n in names]
                out.append((artifact, ".".join(put) if whole else qualified(put, catalog, schema)))
            yield pd.DataFrame(out, columns=["artifact_id", "target"])

    found = said.join(spark.read.schema(kind).parquet(folder), "shape").select("artifact_id", "catalog", "schema", "words", "parts", "whole")
    return found.mapInPandas(named, "artifact_id string, target string").filter("target != ''")
