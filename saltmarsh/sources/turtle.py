"""A subset of Turtle and N-Quads: prefixes, `a`, `;`, `,`, IRIs, CURIEs, literals with type or language. Vocabulary files are small documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions.text import escaped

QUAD = "g string, s string, p string, o string, o_type string, datatype string, lang string"
RDF_TYPE = "rdf:type"
_T = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<prefix>@prefix\s+(?P<pn>[\w-]*):\s*<(?P<pi>[^>]*)>\s*\.|PREFIX\s+(?P<pn2>[\w-]*):\s*<(?P<pi2>[^>]*)>)|<(?P<iri>[^>\s]*)>
    |(?P<lit>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*")(?:@(?P<lang>[A-Za-z-]+)|\^\^(?:<(?P<dti>[^>]*)>|(?P<dtc>[\w-]*:[\w.-]+)))?
    |(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=[\s;,.\])]|$)|(?P<bool>true|false)\b|(?P<a>a)(?=\s)|(?P<curie>[\w-]*:[\w-]+(?:\.[\w-]+)*|[\w-]*:)|(?P<op>[;,.])""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def parse(text: str) -> list[tuple[str, str, str, str, str | None, str | None]]:
    """(s, p, o, o_type, datatype, lang) of each triple; CURIEs stay as written, base-less IRIs too."""
    out, subject, predicate, at = [], None, None, 0
    while at < len(text):
        m = _T.match(text, at)
        if not m:
            raise ValueError(f"not in the subset, at {text[at:at + 40]!r}")
        at = m.end()
        if m["ws"] or m["prefix"]:
            continue
        if m["op"]:
            if m["op"] == ".":
                subject = predicate = None
            elif m["op"] == ";":
                predicate = None
            continue
        if m["lit"] is not None:
            body = m["lit"][3:-3] if m["lit"].startswith('"""') else m["lit"][1:-1]
            value = (re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), body), "literal", m["dti"] or m["dtc"], m["lang"])
        elif m["num"] is not None:
            value = (m["num"], "literal", "xsd:double" if "e" in m["num"].lower() else "xsd:decimal" if "." in m["num"] else "xsd:integer", None)
        elif m["bool"]:
            value = (m["bool"], "literal", "xsd:boolean", None)
        else:
            value = (RDF_TYPE if m["a"] else m["iri"] if m["iri"] is not None else m["curie"], "uri", None, None)
        if subject is None:
            subject = value[0]
        elif predicate is None:
            predicate = value[0]
        else:
            out.append((subject, predicate, *value))
    return out


def turtle_quads(spark: SparkSession, text: str, graph: str) -> DataFrame:
    rows = [(graph, *t) for t in parse(text)]
    return spark.createDataFrame(rows, QUAD)


def n_quads(quads: DataFrame) -> DataFrame:
    """One line a quad."""
    term = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    lit = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise(""))
    obj: Column = F.when(F.col("o_type") == "uri", term(F.col("o"))).otherwise(lit)
    return quads.select(F.concat_ws(" ", term(F.col("s")), term(F.col("p")), obj, term(F.col("g")), F.lit(".")).alias("value"))


_ESCAPED = (("t", "\t"), ("r", "\r"), ("n", "\n"), ('"', '"'))


def read_n_quads(lines: DataFrame) -> DataFrame:
    """Quads of lines (value) as n_quads writes them; blank lines and comments are skipped, any other line that is no quad stops the run."""
    v = F.trim("value")
    pattern = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?) <([^>]*)> \.$'
    part = lambda i: F.regexp_extract(v, pattern, i)
    is_literal = v.rlike(r'^<[^>]*> <[^>]*> "')
    text = F.replace(part(4), F.lit("\\\\"), F.lit("\u0000"))  # a backslash of its own isn't the beginning of another mark
    for mark, c in _ESCAPED:
        text = F.replace(text, F.lit(f"\\{mark}"), F.lit(c))
    text = F.replace(text, F.lit("\u0000"), F.lit("\\"))
    rows = lines.where((v != "") & ~v.startswith("#"))
    checked = F.when(v.rlike(pattern), part(7)).otherwise(F.raise_error(F.concat(F.lit("no quad: "), F.left(v, F.lit(80)))).cast("string"))
    some = lambda c: F.when(c != "", c)
    return rows.select(checked.alias("g"), part(1).alias("s"), part(2).alias("p"), F.when(is_literal, text).otherwise(part(3)).alias("o"), F.when(is_literal, "literal").otherwise("uri").alias("o_type"), some(part(6)).alias("datatype"), some(part(5)).alias("lang"))


def import_quads(existing: DataFrame, lines: DataFrame, graphs: tuple[str, ...]) -> DataFrame:
    """existing with the graphs replaced by those that the lines hold; a line of any other graph stops the run."""
    new = read_n_quads(lines)
    g = F.when(F.col("g").isin(*graphs), F.col("g")).otherwise(F.raise_error(F.concat(F.lit("a graph that isn't to be imported: "), F.col("g"))).cast("string"))
    return cleared(existing, graphs).unionByName(new.withColumn("g", g).distinct())


def cleared(quads: DataFrame, graphs: tuple[str, ...]) -> DataFrame:
    """quads without the graphs."""
    return quads.where(~F.col("g").isin(*graphs))
