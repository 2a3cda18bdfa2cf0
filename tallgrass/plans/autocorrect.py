"""Repairs and hints for statements that Spark has refused; text inside quotes is never touched."""

from __future__ import annotations

import difflib
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Words of the statement grammar that a typo may stand for.
KEYWORDS = ("SELECT", "FROM", "WHERE", "GROUP", "BY", "ORDER", "HAVING", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "ON", "AS", "AND", "OR", "NOT", "IN", "BETWEEN", "LIKE", "UNION", "DISTINCT", "COUNT", "SUM", "AVG", "MIN", "MAX")

TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\w+|\s+|.", re.S)


def _tokens(sql: str) -> list[str]:
    return TOKEN.findall(sql)


def balanced(sql: str) -> str:
    """Close an open quote, then open parentheses."""
    if sql.count("'") % 2:
        sql += "'"
    depth = 0
    for t in _tokens(sql):
        depth += (t == "(") - (t == ")" and depth > 0)
    return sql + ")" * depth


def corrected(sql: str, names: set[str], cutoff: float = 0.75) -> str:
    """Words that are neither keywords, functions nor known names, replaced by the keyword or name they are closest to."""
    known = {n.lower() for n in names} | {k.lower() for k in KEYWORDS}
    out, after_from = [], False
    for t in _tokens(sql):
        low = t.lower()
        if re.fullmatch(r"[A-Za-z_]\w*", t) and low not in known and not (out and out[-1] == "."):
            choices = [n for n in names] if after_from else [*KEYWORDS, *names]
            close = difflib.get_close_matches(low, [c.lower() for c in choices], 1, cutoff)
            if close:
                t = next(c for c in choices if c.lower() == close[0])
        if not t.isspace():
            after_from = low in ("from", "join") or t.lower() in ("from", "join")
        out.append(t)
    return balanced("".join(out))


def schema_names(spark: SparkSession) -> tuple[set[str], set[str]]:
    """Names of tables and of all their columns."""
    tables = {t.name for t in spark.catalog.listTables()}
    return tables, {c for t in tables for c in spark.table(t).columns}


def suggestions(spark: SparkSession, error: Exception, cutoff: float = 0.5) -> list[str]:
    """Hints for a refused statement, by the error's condition."""
    condition = error.getCondition() or "" if hasattr(error, "getCondition") else ""
    named = re.search(r"`([^`]+)`(?!\.)", str(error))
    word = (named[1] if named else "").split(".")[-1].lower()
    tables, columns = schema_names(spark)
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        pool, what = tables, "table"
    elif condition.startswith("UNRESOLVED_COLUMN"):
        pool, what = columns, "column"
    elif condition.startswith("UNRESOLVED_ROUTINE"):
        pool, what = {f.name for f in spark.catalog.listFunctions()}, "function"
    else:
        return [f"check the statement: {condition or type(error).__name__}"]
    lower = {p.lower(): p for p in sorted(pool)}
    return [f"did you mean the {what} {lower[m]}?" for m in difflib.get_close_matches(word, list(lower), 3, cutoff)] or [f"no {what} is like {word!r}"]


def run(spark: SparkSession, sql: str) -> tuple[DataFrame, str]:
    """The statement's result and the text that ran: as given if Spark takes it, repaired once if not."""
    try:
        return spark.sql(sql), sql
    except (ParseException, AnalysisException) as first:
        tables, columns = schema_names(spark)
        aliases = set(re.findall(r"\bAS\s+(\w+)", sql, re.I))
        better = corrected(sql, tables | columns | aliases)
        if better == sql:
            raise
        try:
            return spark.sql(better), better
        except (ParseException, AnalysisException):
            raise first from None
