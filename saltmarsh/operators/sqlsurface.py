"""A read-only SQL surface: one SELECT over allowed views, checked before it runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words that no read needs.
FORBIDDEN = "INSERT UPDATE DELETE REPLACE INTO CREATE ALTER DROP TRUNCATE ATTACH DETACH PRAGMA VACUUM REINDEX TRIGGER GRANT REVOKE LOAD_EXTENSION WRITEFILE READFILE FTS3_TOKENIZER".split()
#: Functions that run code of the caller's choice.
RUNNING = "REFLECT JAVA_METHOD TRY_REFLECT".split()
_WORD = re.compile(rf"\b(?:(?:{'|'.join(FORBIDDEN)})\b|(?:{'|'.join(RUNNING)})(?=\s*\())", re.IGNORECASE)
_PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\[[^\]]*\]|--[^\n]*|/\*.*?\*/|(?P<open>['\"`\[]|/\*)|(?P<code>.)", re.DOTALL)


class Refused(ValueError):
    """A query that is no single read."""


def code_of(query: str) -> str:
    """The query with strings, quoted names and comments blanked; one that isn't closed is refused."""
    out = []
    for m in _PIECE.finditer(query):
        if m["open"]:
            raise Refused("a string, name or comment isn't closed")
        out.append(m["code"] or " ")
    return "".join(out)


def check(query: str) -> str:
    """The query without its final semicolon, if it is one SELECT (with WITH or not) without forbidden words."""
    code = code_of(query)
    body = code.rstrip()
    if not body.strip():
        raise Refused("an empty query")
    if body.endswith(";"):
        body = body[:-1]
    if ";" in body:
        raise Refused("more than one statement")
    if not re.match(r"\s*(SELECT|WITH)\b", body, re.IGNORECASE):
        raise Refused("only SELECT")
    if m := _WORD.search(body):
        raise Refused(f"{m[0].upper()} isn't allowed")
    at = len(body)
    return query[:at]


def allowed(query: str) -> bool:
    try:
        check(query)
    except Refused:
        return False
    return True


def select(spark: SparkSession, query: str, views: dict[str, DataFrame]) -> DataFrame:
    """The result of a checked query over the given views only.

    The query is analysed in a session of its own in which no other view exists, so names mean what their scopes say,
    and the caller's views stay as they are. The analysed plan is walked, subqueries included: it may end in the given
    views, in inline rows and in its own common table expressions, and in nothing else.
    """
    text = check(query)
    j = spark._jsparkSession
    if "Command" in j.sessionState().sqlParser().parsePlan(text).getClass().getSimpleName():
        raise Refused("only SELECT")
    own = j.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf().isModifiable(k):
            own.conf().set(k, v)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, df in views.items():
        rows(own, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    try:
        plan = own.sql(text).queryExecution().analyzed()
    except Exception as e:  # what can't be resolved here isn't there
        raise Refused(str(getattr(e, "desc", None) or e).splitlines()[0]) from None
    _walk(plan, {v.lower() for v in views})
    return DataFrame(rows(j, plan), spark)


#: Ends of a plan that read nothing.
_READ_NOTHING = {"OneRowRelation", "LocalRelation", "CTERelationRef"}


def _walk(node, views: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind == "View":
        name = node.desc().identifier()
        if name.database().isDefined() or name.table().lower() not in views:
            raise Refused(f"{name.table()} isn't a view of this surface")
        return
    below = [node.children(), node.subqueries()]
    if kind == "WithCTE":
        below.append(node.cteDefs())
    elif not node.children().size() and kind not in _READ_NOTHING:
        raise Refused(f"{node.nodeName()} isn't a view of this surface")
    for group in below:
        for i in range(group.size()):
            _walk(group.apply(i), views)
