"""Queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import chem, equations, segmenter, text
from saltmarsh.functions.numbers import NUMERIC, confidence
from saltmarsh.operators import bgp, bundles, graph, grounding, ingest, linker, mining, relations, review, shapes, sqlsurface
from saltmarsh.operators.packed import split_packed
from saltmarsh.operators.quantities import to_common_units
from saltmarsh.session import table
from saltmarsh.sources import store
from saltmarsh.streaming import observations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


@query()
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return to_common_units(table(spark, base, "relations"), table(spark, base, "measurement_value"), table(spark, base, "unit_catalog"))


@query()
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return split_packed(table(spark, base, "salt_canonicalization"))


# ---- text ----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:[-''][A-Za-z]+)*'), lambda x: lower(x)), lambda x: length(x) >= 3 and not list_contains([{_STOP}], x))"
_GRAMS = f"""
words as materialized (select doc_id, {_TOKENS} as w from documents),
grams as materialized (
  select doc_id, array_to_string(w[i:i + k - 1], ' ') as term
  from words, unnest(range(1, 4)) a(k), unnest(range(1, len(w) - k + 2)) b(i) where len(w) >= k
)"""
MINE_FLOOR, MINE_CEILING = 5, 5000


@query(f"with {_GRAMS} select term, count(distinct doc_id) as doc_frequency from grams group by term")
def doc_frequency(spark: SparkSession, base: str) -> DataFrame:
    return mining.document_frequency(table(spark, base, "documents"))


@query(f"with {_GRAMS} select doc_id, term, count(*) as occurrences from grams group by doc_id, term")
def term_frequency(spark: SparkSession, base: str) -> DataFrame:
    return mining.term_counts(table(spark, base, "documents"), unique=True)


@query(f"""
with {_GRAMS},
df as (select term, count(distinct doc_id) as doc_frequency, count(*) as total_occurrences from grams group by term having count(distinct doc_id) >= {MINE_FLOOR}),
seqs as (
  select distinct array_to_string(list_filter(string_split_regex(lower(case when kind = 'salt' then split_part(label, '(', 1) else
    regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') end), '[^a-z0-9]+'), lambda x: x <> ''), chr(31)) as run
  from (select target_kind as kind, unnest(list_concat([pref_label], alt_labels)) as label from concepts)
),
toks as (select term, list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda x: x <> '') as t from df),
runs as (select term, array_to_string(t[i:j], chr(31)) as run from toks, unnest(range(1, len(t) + 1)) a(i), unnest(range(1, len(t) + 1)) b(j) where i <= j),
hit as (select distinct term from runs where run in (select run from seqs where run <> ''))
select term, doc_frequency, total_occurrences from df where term not in (select term from hit)
order by doc_frequency desc, term limit {MINE_CEILING}
""")
def mine_candidates(spark: SparkSession, base: str) -> DataFrame:
    concepts = table(spark, base, "concepts").select(F.col("target_kind").alias("kind"), F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("label"))
    keys = mining.exclusion_keys(concepts)
    return mining.mine(table(spark, base, "documents"), keys, floor=MINE_FLOOR, ceiling=MINE_CEILING)


_MINED = f"""
{_GRAMS},
swords as materialized (select report, char_start, char_end, text, {_TOKENS} as w from segments),
sgrams as (select distinct report, char_start, char_end, text, array_to_string(w[i:i + k - 1], ' ') as term from swords, unnest(range(1, 4)) a(k), unnest(range(1, len(w) - k + 2)) b(i) where len(w) >= k),
missed as (select distinct lower(surface_form) as term, surface_form, report, char_start, char_end from mentions where status = 'novel' and surface_form is not null and trim(surface_form, ' ') <> ''),
every as (select distinct term, 'lexical' as source, '' as surface_form from sgrams union all select term, 'miss', min(struct_pack(n := length(surface_form), s := surface_form)).s from missed group by term),
seqs as (
  select distinct array_to_string(list_filter(string_split_regex(lower(case when kind = 'salt' then split_part(label, '(', 1) else
    regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') end), '[^a-z0-9]+'), lambda x: x <> ''), chr(31)) as run
  from (select target_kind as kind, unnest(list_concat([pref_label], alt_labels)) as label from concepts)
),
toks as (select distinct term, list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda x: x <> '') as t from every),
runs as (select term, array_to_string(t[i:j], chr(31)) as run from toks, unnest(range(1, len(t) + 1)) a(i), unnest(range(1, len(t) + 1)) b(j) where i <= j),
hit as (select distinct term from runs where run in (select run from seqs where run <> '')),
kept as (select * from every where term not in (select term from hit)),
df as (select term, count(distinct doc_id) as doc_frequency, count(*) as total_occurrences from grams group by term having count(distinct doc_id) >= {MINE_FLOOR}),
scored as (select k.*, df.doc_frequency, df.total_occurrences from kept k join df using (term)),
top as (select * from scored order by doc_frequency desc, term, source limit {MINE_CEILING})
"""


def _mined(spark: SparkSession, base: str) -> mining.Mined:
    concepts = table(spark, base, "concepts").select(F.col("target_kind").alias("kind"), F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("label"))
    return mining.mine_all(table(spark, base, "segments"), table(spark, base, "mentions"), table(spark, base, "documents"), mining.exclusion_keys(concepts), MINE_FLOOR, MINE_CEILING, corpus="source")


@query(f"""
with {_MINED},
places as (select term, 'lexical' as source, report, char_start, min(char_end) as char_end from sgrams group by term, report, char_start union all select distinct term, 'miss', report, char_start, char_end from missed),
p as (select term, source, count(*) as places, min(struct_pack(r := report, a := char_start, b := char_end)) as f from places group by 1, 2)
select t.term, t.source, t.surface_form, t.doc_frequency, t.total_occurrences, p.places, p.f.r as report, p.f.a as start_offset, p.f.b as end_offset from top t left join p using (term, source)
""")
def mine_umbrella(spark: SparkSession, base: str) -> DataFrame:
    return _mined(spark, base).candidates.select("term", "source", "surface_form", "doc_frequency", "total_occurrences", "places", "report", "start_offset", "end_offset")


@query(f"""
with {_MINED}, c as (select (select count(*) from every) as e, (select count(*) from kept) as k, (select count(*) from scored) as s, (select count(*) from top) as t)
select e as enumerated, e - k as excluded, k - s as below_floor, s - t as cut_by_ceiling, t as retained from c
""")
def mine_counters(spark: SparkSession, base: str) -> DataFrame:
    return _mined(spark, base).counters


@query(f"""
with {_GRAMS},
wanted as (select distinct lower(trim(term, ' ')) as term from candidates where term is not null),
hits as (select g.term, g.doc_id, count(*) as n from grams g join wanted using (term) group by 1, 2),
o as (select h.term, h.doc_id, d.source from hits h join documents d using (doc_id))
select (select count(*) from wanted) as proposals_processed, count(*) as observations_written, count(distinct (source, doc_id)) as documents_tagged, (select count(*) from candidates where doc_frequency is not null) as scalars_removed from o
""")
def backfill_summary(spark: SparkSession, base: str) -> DataFrame:
    wanted = table(spark, base, "candidates").where("term is not null").select(F.lower(F.trim("term")).alias("term")).distinct()
    seen = mining.observations(table(spark, base, "documents"), wanted, corpus="source")
    return mining.backfill_summary(wanted, seen, table(spark, base, "candidates").where("doc_frequency is not null"))


@query(f"""
with {_GRAMS},
wanted as (select distinct lower(trim(term, ' ')) as term from candidates where term is not null),
hits as (select g.term, g.doc_id, count(*) as n from grams g join wanted using (term) group by 1, 2)
select h.term, h.doc_id as document, d.source as corpus, h.n as occurrence_count from hits h join documents d using (doc_id)
""")
def backfilled_observations(spark: SparkSession, base: str) -> DataFrame:
    wanted = table(spark, base, "candidates").where("term is not null").select(F.lower(F.trim("term")).alias("term"))
    return mining.observations(table(spark, base, "documents"), wanted, corpus="source")


@query(r"""
with a as (select doc_id, replace(replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') as t from documents where text is not null),
b as (select doc_id, regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '([a-z])-[ \t]*\r?\n[ \t]*([a-z])', '\1\2', 'g'), '-[ \t]*\r?\n[ \t]*', '-', 'g') as t from b),
d as (select doc_id, replace(replace(replace(t, 'THERMAL-STRE SS', 'THERMAL-STRESS'), 'CORRO SION', 'CORROSION'), 'MODERA TOR', 'MODERATOR') as t from c),
e as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from d),
f as (select doc_id, replace(replace(replace(t, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)) as t from e)
select doc_id, translate(t, '₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺', '01234567890123456789-+') as clean from f
""")
def ocr_normalize(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text is not null").select("doc_id", text.normalise_ocr(F.col("text")).alias("clean"))


@query(r"""
select target_iri, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(split_part(target_iri, ':', 2), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') as tokens from concepts
""")
def camel_token_sequence(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "concepts").select("target_iri", text.camel_sequence(F.split("target_iri", ":")[1]).alias("tokens"))


@query(r"""
with names as (select distinct salt as label from measurement_value where salt is not null union select distinct raw_salt from salt_canonicalization where raw_salt is not null),
base as (select label, trim(regexp_replace(split_part(label, ' | ', 1), '\s+', ' ', 'g')) as b from names),
runs as (select label, b, regexp_extract_all(b, '[A-Za-z]\d+') as r, regexp_full_match(b, '([A-Z][a-z]?\d*|[-·•\s])+') as f from base),
parts as (select label, b, r, f, string_split_regex(b, '\d+') as p from runs),
lost as (
  select label, b from parts
  union all
  select label, list_reduce(list_transform(range(1, len(r) + 2), lambda j: p[j] || case when j > len(r) then '' when j = i then m else regexp_extract(r[j], '\d+') end), lambda x, y: x || y)
  from parts, unnest(range(1, len(r) + 1)) a(i), unnest([',', '.']) c(m) where f
),
spread as (
  select label, b as v from lost where not regexp_matches(b, '[-·•]')
  union all select label, trim(regexp_replace(regexp_replace(b, '[-·•]', s, 'g'), '\s+', ' ', 'g')) from lost, unnest(['-', ' ', '']) q(s) where regexp_matches(b, '[-·•]')
)
select label, list_sort(list_distinct(list_concat(list(v), list(lower(v))))) as variants from spread group by label
""")
def label_variants(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "measurement_value").select(F.col("salt").alias("label"))
    b = table(spark, base, "salt_canonicalization").select(F.col("raw_salt").alias("label"))
    return a.union(b).where("label is not null").distinct().select("label", chem.label_variants(F.substring_index("label", " | ", 1)).alias("variants"))


@query("select distinct pref_label, trim(regexp_replace(lower(pref_label), '[^a-z0-9]+', '-', 'g'), '-') as slug from concepts")
def term_slug(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "concepts").select("pref_label", text.term_slug(F.col("pref_label")).alias("slug")).distinct()


_SIGNALS = " ".join("when " + " or ".join(f"regexp_matches(text, '{p}')" for p in patterns) + f" then '{kind}'" for kind, patterns in text.signal_patterns(r"(?:[^\p{L}\p{N}_]|$)").items())


@query(f"select doc_id, case {_SIGNALS} end as kind from documents where text is not null")
def context_signal_kind(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text is not null").select("doc_id", text.signal_kind(F.col("text"), F.lit("lexical")).alias("kind"))


@query(r"""
with wrapped as (select doc_id, 'Before ' || '<think>' || text || case when doc_id % 3 = 0 then '' else '</THINK> after ' || doc_id end as r from documents where text is not null)
select doc_id, trim(regexp_replace(r, '(?is)<think>.*?(</think>|$)', '', 'g'), ' ') as answer, regexp_extract_all(r, '(?is)<think>(.*?)(?:</think>|$)', 1) as thoughts from wrapped
""")
def think_split(spark: SparkSession, base: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("</THINK> after "), F.col("doc_id").cast("string")))
    d = table(spark, base, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Before <think>"), F.col("text"), tail).alias("r"))
    return d.select("doc_id", text.without_thinking(F.col("r")).alias("answer"), text.thinking(F.col("r")).alias("thoughts"))


@query("select segment_id, substr(d.text, s.char_start + 1, s.char_end - s.char_start) = s.text as holds, length(s.text) as n from segments s join documents d using (doc_id)")
def segment_offsets(spark: SparkSession, base: str) -> DataFrame:
    s, d = table(spark, base, "segments"), table(spark, base, "documents").select("doc_id", F.col("text").alias("whole"))
    return s.join(d, "doc_id").select("segment_id", (F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")).alias("holds"), F.length("text").alias("n"))


# ---- salts, units, equations ----------------------------------------------------------------------------------------

@query(r"""
select distinct case_id, raw_salt, len(list_filter(string_split(raw_salt, '-'), lambda c: not regexp_matches(trim(c), '^(Li|Be|Na|K|Zr|U|Th)F[0-9]?$'))) = 0 as in_scope from salt_canonicalization
""")
def fluoride_scope_filter(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "salt_canonicalization").select("case_id", "raw_salt", chem.is_fluoride(F.col("raw_salt")).alias("in_scope")).distinct()


_CANONICAL = rf"""
c as (select distinct case_id, source, raw_salt, raw_composition, form_code from salt_canonicalization),
s as (select *, coalesce(form_code in ('I1', 'I2', 'I3', 'I4'), false) as rng, regexp_replace(coalesce(raw_salt, ''), '^\s+|\s+$', '', 'g') as t, regexp_replace(coalesce(raw_composition, ''), '^\s+|\s+$', '', 'g') as u from c),
p as (select *, string_split(t, '-') as p, string_split_regex(u, '\s+') as w from s),
v as (select *, list_transform(case when rng then string_split(w[1], '-') else string_split(u, '-') end, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as v from p),
f as (select *, case when len(list_filter(p, lambda x: trim(x, ' ') = '')) > 0 then 'empty-component' when rng and len(p) <> 2 then 'range-components' when rng and (len(w) <> 2 or len(v) <> 2) then 'range-form' when not rng and len(v) <> len(p) then 'value-count'
   when len(list_filter(v, lambda x: not regexp_full_match(x, '{NUMERIC.strip("^$")}'))) > 0 then 'value'
   when rng and not list_contains(p, w[2]) then 'range-component' when not rng and abs(list_sum(list_transform(v, lambda x: try_cast(x as double))) - 100.0) > 2.0 then 'sum' end as flag_reason from v),
o as (select *, list_sort(list_transform(range(1, len(p) + 1), lambda i: {{'c': p[i], 'i': i}})) as z from f),
t as (select *, array_to_string(list_transform(z, lambda x: x.c), '-') as formula,
   case when flag_reason is not null then null when rng then w[2] || ' ' || array_to_string(list_transform(v, lambda x: printf('%.1f', try_cast(x as double))), '-') else array_to_string(list_transform(z, lambda x: printf('%.1f', try_cast(v[x.i] as double))), '-') end as tail from o)
"""


@query(rf"""
with {_CANONICAL}
select case_id, flag_reason, case when flag_reason is null then formula || ' | ' || tail end as canonical,
  case when flag_reason is null then 'msrd:salt-' || trim(regexp_replace(regexp_replace(formula || ' | ' || tail, '[ /#|=@]', '-', 'g'), '-+', '-', 'g'), '-') end as iri from t
""")
def canonicalize_lockstep(spark: SparkSession, base: str) -> DataFrame:
    """Every case has a canonical form or a flag_reason."""
    c = table(spark, base, "salt_canonicalization").select("case_id", "source", "raw_salt", "raw_composition", "form_code").distinct()
    return chem.canonical_salts(c).select("case_id", "flag_reason", "canonical", "iri")


@query(rf"with {_CANONICAL} select source, flag_reason, count(*) as cases from t group by 1, 2")
def positional_tolerance_flag(spark: SparkSession, base: str) -> DataFrame:
    """source, flag_reason and number of cases; no reason: inside the tolerance."""
    c = table(spark, base, "salt_canonicalization").select("case_id", "source", "raw_salt", "raw_composition", "form_code").distinct()
    return chem.canonical_salts(c).groupBy("source", "flag_reason").agg(F.count("*").alias("cases"))


@query(r"""
with names as (select distinct 'CaF2' as c union select distinct unnest(string_split(split_part(salt, ' | ', 1), '-')) from measurement_value where source = 'nist')
select regexp_replace(c, '\d+$', '') as skeleton, min(c) as compound from names group by 1 having count(*) = 1
""")
def ocr_skeleton_unique(spark: SparkSession, base: str) -> DataFrame:
    names = table(spark, base, "measurement_value").where("source = 'nist'").select(F.explode(F.split(F.substring_index("salt", " | ", 1), "-")).alias("compound"))
    return chem.unique_skeletons(names)


_EVAL = """
with v as (
  select *, regexp_extract(equation_form, '^[A-Za-z0-9]+') as f0 from measurement_value
), m as (
  select locator, property, salt, c0, c1, c2, t_min, t_max,
    case lower(f0) when 'linear' then 'Linear' when 'lin' then 'Linear' when 'polynomial2' then 'Polynomial2' when 'poly2' then 'Polynomial2' when 'quadratic' then 'Polynomial2' when 'discretepoint' then 'DiscretePoint' when 'discrete' then 'DiscretePoint' when 'point' then 'DiscretePoint' end as form
  from v
), e as (
  select locator, property, salt, t_min, t_max, case when form = 'Linear' then c0 + coalesce(c1, 0) * 900.0 when form = 'Polynomial2' then c0 + coalesce(c1, 0) * 900.0 + coalesce(c2, 0) * 810000.0 when form = 'DiscretePoint' and c1 = 900.0 then c0 end as raw from m
)
select locator, property, salt, case when 900.0 between t_min and t_max and not isnan(raw) then raw end as value,
  case when raw is null or isnan(raw) then 'no-value' when t_min is null or t_max is null then 'no-range' when 900.0 between t_min and t_max then 'ok' else 'out-of-range' end as status from e
"""


def _evaluated(spark: SparkSession, base: str) -> DataFrame:
    own = {"lin": "Linear", "quadratic": "Polynomial2", "linear": "Linear", "polynomial2": "Polynomial2", "poly2": "Polynomial2", "discretepoint": "DiscretePoint", "discrete": "DiscretePoint", "point": "DiscretePoint"}
    form = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.lower(F.regexp_extract("equation_form", "^[A-Za-z0-9]+", 0))]
    m = table(spark, base, "measurement_value").withColumn("form", form)
    zero = [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(1, 5)]
    raw = equations.value_at(F.col("form"), [F.col("c0"), *zero], F.lit(900.0))
    got = equations.gated(F.when(~F.isnan(raw), raw), F.lit(900.0), F.col("t_min"), F.col("t_max"))
    return m.withColumn("g", got).select("locator", "property", "salt", F.col("g.value").alias("value"), F.col("g.status").alias("status"))


@query(_EVAL)
def equation_eval_case(spark: SparkSession, base: str) -> DataFrame:
    return _evaluated(spark, base)


_FORMS = list(dict.fromkeys(equations.FORM_CODES.values()))


@query(f"""
with v as (select distinct locator, c0, coalesce(c1, 0) as c1, coalesce(c2, 0) as c2, coalesce(c3, 0) as c3, coalesce(c4, 0) as c4 from measurement_value where c0 is not null and not isnan(c0)),
f as (select *, unnest({_FORMS!r}) as form from v),
e as (select locator, form, case form when 'Linear' then c0 + c1 * 2.5 when 'Isotherm1' then c0 + c1 * 2.5 when 'Polynomial2' then c0 + c1 * 2.5 + c2 * 6.25 when 'Isotherm2' then c0 + c1 * 2.5 + c2 * 6.25
  when 'Polynomial3' then c0 + c1 * 2.5 + c2 * 6.25 + c3 * 15.625 when 'Isotherm3' then c0 + c1 * 2.5 + c2 * 6.25 + c3 * 15.625 when 'Polynomial4' then c0 + c1 * 2.5 + c2 * 6.25 + c3 * 15.625 + c4 * 39.0625 when 'Isotherm4' then c0 + c1 * 2.5 + c2 * 6.25 + c3 * 15.625 + c4 * 39.0625
  when 'DiscretePoint' then case when c1 = 2.5 then c0 end when 'Arrhenius' then c0 * exp(least(c1, 9) / ({equations.GAS} * 2.5)) when 'ExtendedArrhenius1' then c0 * exp(least(c1, 9) / ({equations.GAS} * 2.5) + least(c2, 9) / 6.25)
  when 'ExtendedArrhenius2' then c0 * exp(least(c1, 9) / ({equations.GAS} * (2.5 - least(c2, 2)))) end as value from f)
select locator, form, floor(value * 10000 + 0.5) as scaled from e
""")
def equation_eval_forms(spark: SparkSession, base: str) -> DataFrame:
    """Every fit under all twelve forms at 2.5; coefficients in exponents are kept small."""
    v = table(spark, base, "measurement_value").where("c0 is not null and not isnan(c0)").select("locator", "c0", *[F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(1, 5)]).distinct()
    v = v.select("*", F.explode(F.array(*map(F.lit, _FORMS))).alias("form"))
    small = lambda c, most: F.when(F.col("form").contains("Arrhenius"), F.least(F.col(c), F.lit(most))).otherwise(F.col(c))
    c2 = F.when(F.col("form") == "ExtendedArrhenius2", F.least("c2", F.lit(2.0))).otherwise(small("c2", 9.0))
    got = equations.value_at(F.col("form"), [F.col("c0"), small("c1", 9.0), c2, F.col("c3"), F.col("c4")], F.lit(2.5))
    return v.select("locator", "form", F.floor(got * 10000 + 0.5).cast("double").alias("scaled"))


@query(f"with a as ({_EVAL}), b as (select property, min(struct_pack(v := -value, s := salt)) as top from a where value is not null group by property) select property, top.s as salt, -top.v as value from b")
def comparative_argmax(spark: SparkSession, base: str) -> DataFrame:
    return grounding.best_candidate(_evaluated(spark, base), "property", "salt")


@query("""
with b as (select locator, split_part(locator, '|', 1) as base, t_min, equation_form from measurement_value),
d as (select distinct * from b),
r as (select *, count(*) over (partition by base) as n, row_number() over (partition by base order by t_min asc nulls first, equation_form nulls first, locator) as rn, '@' || coalesce(cast(cast(t_min as bigint) as varchar), 'na') as suffix from d),
s as (select *, row_number() over (partition by base, suffix order by rn) as again from r)
select locator as row_key, base, case when n > 1 then base || suffix || case when again > 1 then '-' || rn else '' end else base end as locator from s
""")
def locator_disambiguation(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "measurement_value").select(F.col("locator").alias("row_key"), F.substring_index("locator", "|", 1).alias("base"), "t_min", "equation_form").distinct()
    u = ingest.unique_locators(d, "base", "t_min", "equation_form", "row_key", F.col("t_min").cast("long").cast("string"))
    return u.select("row_key", "base", "locator")


@query(rf"""
with {_CANONICAL},
k as (select *, len(list_filter(string_split(raw_salt, '-'), lambda x: not regexp_matches(trim(x, ' '), '^(Li|Be|Na|K|Zr|U|Th)F[0-9]?$'))) = 0 as scope, case when flag_reason is null then formula || ' | ' || tail end as canon from t where raw_salt is not null)
select source as property, count(*) as read, count(*) filter (where scope and flag_reason is null) as kept, count(*) filter (where not scope) as out_of_scope, count(*) filter (where scope and flag_reason is not null) as flagged,
  count(distinct case when scope and flag_reason is null then canon end) as distinct_salts from k group by source
""")
def ingest_summary(spark: SparkSession, base: str) -> DataFrame:
    """The cases as rows of property tables, one a source."""
    none = {c: F.lit(None).cast("string") for c in ("data1", "data2", "data3", "data4", "data5", "t_min", "t_max")}
    d = table(spark, base, "salt_canonicalization").where("raw_salt is not null").select("case_id", F.col("source").alias("property"), F.col("raw_salt").alias("salt"), F.col("raw_composition").alias("composition"), F.col("form_code").alias("code")).distinct()
    return ingest.summary(ingest.measured(d.withColumns(none), {"density": "unit:GM-PER-CentiM3"}))


@query(r"""
with m as (select distinct relation_id, replace(property_iri, 'msr:', '') as property, unit from relations where relation_kind = 'measurement'),
n as (select *, translate(trim(unit, ' '), '·³μ', '.3u') as u from m),
o as (select *, case u when 'cP' then 'viscosity' when 'mPa.s' then 'viscosity' when 'mPas' then 'viscosity' when 'g/cm3' then 'density' when 'g/cc' then 'density' when 'mN/m' then 'surfaceTension' when 'S/cm' then 'electricalConductivity' end as of_ from n),
p as (select *, case of_ when 'density' then 'unit:GM-PER-CentiM3' when 'viscosity' then 'unit:MilliPA-SEC' when 'surfaceTension' then 'unit:MilliN-PER-M' when 'electricalConductivity' then 'unit:S-PER-CentiM' end as curie,
  case property when 'density' then 'unit:GM-PER-CentiM3' when 'viscosity' then 'unit:MilliPA-SEC' when 'surfaceTension' then 'unit:MilliN-PER-M' when 'electricalConductivity' then 'unit:S-PER-CentiM' end as own from o)
select relation_id, case when curie is null then 'unmappable' when own is null or own <> curie then 'dimension-mismatch' else '' end as reason, case when curie = own then curie end as unit_curie from p
""")
def unit_resolution(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "relations").where("relation_kind = 'measurement'").select("relation_id", F.regexp_replace("property_iri", "^msr:", "").alias("property"), "unit").distinct()
    u = relations.resolve_unit(F.col("unit"), F.col("property"))
    return m.select("relation_id", u["reason"].alias("reason"), u["curie"].alias("unit_curie"))


# ---- graph ----------------------------------------------------------------------------------------------------------

_QUADS = """
quads as (
  select distinct g, s, p, o, o_type from (
    select 'data' as g, 'rel:' || relation_id as s, p, o, t as o_type from relations, unnest([
      struct_pack(p := 'rdf:type', o := case when relation_kind = 'measurement' then 'msr:PropertyMeasurement' else 'msr:Relation' end, t := 'uri'),
      struct_pack(p := 'msr:ofSalt', o := salt_iri, t := 'uri'), struct_pack(p := 'msr:forProperty', o := property_iri, t := 'uri'), struct_pack(p := 'msr:hasUnit', o := unit_iri, t := 'uri'),
      struct_pack(p := 'msr:linksTo', o := coalesce(role_iri, reactor_iri), t := 'uri'), struct_pack(p := 'prov:wasDerivedFrom', o := 'msrd:doc-' || doc_id, t := 'uri'),
      struct_pack(p := 'msr:disposition', o := disposition, t := 'literal')]) u(x), lateral (select x.p as p, x.o as o, x.t as t) where o is not null
    union all
    select 'vocab', target_iri, p, o, t from concepts, unnest([struct_pack(p := 'rdf:type', o := case target_kind when 'concept' then 'skos:Concept' when 'class' then 'owl:Class' else 'msr:MoltenSalt' end, t := 'uri'), struct_pack(p := 'skos:prefLabel', o := pref_label, t := 'literal')]) u(x), lateral (select x.p as p, x.o as o, x.t as t)
    union all select 'vocab', target_iri, 'skos:altLabel', unnest(alt_labels), 'literal' from concepts
    union all select 'ontology', target_iri, 'rdf:type', 'owl:Class', 'uri' from concepts where target_kind = 'class'
    union all
    select 'staging', proposal_id, p, o, 'literal' from proposal_summary, unnest([struct_pack(p := 'msr:kind', o := kind), struct_pack(p := 'msr:reviewStatus', o := status), struct_pack(p := 'msr:term', o := term)]) u(x), lateral (select x.p as p, x.o as o)
  ) where s is not null and o is not null
)"""


def _quads(spark: SparkSession, base: str) -> DataFrame:
    """The test tables as named-graph quads."""
    r = table(spark, base, "relations").select(
        F.concat(F.lit("rel:"), F.col("relation_id").cast("string")).alias("id"), F.when(F.col("relation_kind") == "measurement", "msr:PropertyMeasurement").otherwise("msr:Relation").alias("type"),
        "salt_iri", "property_iri", "unit_iri", F.coalesce("role_iri", "reactor_iri").alias("link"), F.concat(F.lit("msrd:doc-"), F.col("doc_id").cast("string")).alias("source"), "disposition",
    )
    out = graph.entity_quads(r, "data", "id", None, {
        "type": (graph.TYPE, "uri", None), "salt_iri": ("msr:ofSalt", "uri", None), "property_iri": ("msr:forProperty", "uri", None), "unit_iri": ("msr:hasUnit", "uri", None),
        "link": ("msr:linksTo", "uri", None), "source": ("prov:wasDerivedFrom", "uri", None), "disposition": ("msr:disposition", "literal", None),
    })
    c = table(spark, base, "concepts").withColumn("type", F.when(F.col("target_kind") == "concept", "skos:Concept").when(F.col("target_kind") == "class", "owl:Class").otherwise("msr:MoltenSalt"))
    out = out.unionByName(graph.entity_quads(c, "vocab", "target_iri", None, {"type": (graph.TYPE, "uri", None), "pref_label": ("skos:prefLabel", "literal", None)}))
    out = out.unionByName(graph.entity_quads(c.select("target_iri", F.explode("alt_labels").alias("alt")), "vocab", "target_iri", None, {"alt": ("skos:altLabel", "literal", None)}))
    out = out.unionByName(graph.entity_quads(c.where("target_kind = 'class'"), "ontology", "target_iri", "owl:Class", {}))
    p = table(spark, base, "proposal_summary")
    out = out.unionByName(graph.entity_quads(p, "staging", "proposal_id", None, {"kind": ("msr:kind", "literal", None), "status": ("msr:reviewStatus", "literal", None), "term": ("msr:term", "literal", None)}))
    return out.distinct()


def _spo(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o", "o_type")


@query(f"with {_QUADS} select distinct s, p, o, o_type from quads where g in ('ontology', 'data', 'vocab')")
def core_graph_view(spark: SparkSession, base: str) -> DataFrame:
    return _spo(graph.core(_quads(spark, base)))


@query(f"with {_QUADS} select g, count(*) as triples from quads group by g")
def per_graph_counts(spark: SparkSession, base: str) -> DataFrame:
    return graph.graph_counts(_quads(spark, base))


@query(f"with {_QUADS} select g, count(*) as triples from (select * from quads union select * from quads where g = 'data') group by g")
def set_insert_idempotent(spark: SparkSession, base: str) -> DataFrame:
    q = _quads(spark, base)
    return graph.graph_counts(graph.insert(q, graph.graph(q, "data")))


@query(f"""
with {_QUADS}, flipped as (select distinct s from quads where g = 'staging' and p = 'msr:reviewStatus' and o = 'pending')
select g, s, p, o from quads where g = 'staging' and not (p = 'msr:reviewStatus' and s in (select s from flipped))
union select 'staging', s, 'msr:reviewStatus', 'approved' from flipped
""")
def delete_insert_status(spark: SparkSession, base: str) -> DataFrame:
    q = _quads(spark, base)
    pending = q.where("g = 'staging' and p = 'msr:reviewStatus' and o = 'pending'").select("s")
    return graph.graph(graph.replace_value(q, "staging", pending, "msr:reviewStatus", "approved"), "staging").select("g", "s", "p", "o").distinct()


@query(f"with {_QUADS} select s, list_sort(list_distinct(list(o))) as labels from quads where g in ('ontology', 'data', 'vocab') and p in ('skos:prefLabel', 'skos:altLabel') group by s")
def label_union_merge(spark: SparkSession, base: str) -> DataFrame:
    return graph.labels(graph.core(_quads(spark, base)))


@query(f"""
with {_QUADS}, subjects as (select distinct target_iri as s from mentions where target_iri is not null)
select g, s, p, o from quads where g in ('ontology', 'data', 'vocab') and s in (select s from subjects)
""")
def neighborhood_onehop(spark: SparkSession, base: str) -> DataFrame:
    subjects = table(spark, base, "mentions").select(F.col("target_iri").alias("iri")).where("iri is not null")
    return graph.neighbourhood(_quads(spark, base), subjects).select("g", "s", "p", "o")


@query(f"""
with {_QUADS}, q as (select * from quads where g in ('vocab', 'data')),
k as (select s, bool_or(o = 'skos:Concept') as c, bool_or(o in ('owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty', 'msr:PhysicalProperty')) as o_ from q where p = 'rdf:type' group by s),
r as (select q.s, q.p, q.o, coalesce(k.c, false) or starts_with(q.p, 'skos:') as v, coalesce(k.o_, false) or q.p in ('rdfs:subClassOf', 'rdfs:domain', 'rdfs:range') as t from q left join k using (s))
select 'vocab' as g, s, p, o from r where v union select 'ontology', s, p, o from r where t union select 'data', s, p, o from r where not v and not t
""")
def typed_routing(spark: SparkSession, base: str) -> DataFrame:
    return graph.routed(_quads(spark, base).where("g in ('vocab', 'data')")).select("g", "s", "p", "o").distinct()


@query(f"""
with {_QUADS}, a as (select distinct s, p, o from quads where g = 'data' and o <> 'written'), b as (select distinct s, p, o from quads where g in ('vocab', 'data') and p <> 'msr:ofSalt'),
j as (select coalesce(a.s, b.s) as s, coalesce(a.p, b.p) as p, coalesce(a.o, b.o) as o, a.s is not null as ina, b.s is not null as inb from a full join b on a.s = b.s and a.p = b.p and a.o = b.o)
select s, p, o, ina as in_proposal, ina and not inb as added, ina and s not in (select s from b) as node_added from j
""")
def diff_overlay(spark: SparkSession, base: str) -> DataFrame:
    q = _quads(spark, base)
    return graph.overlay(q.where("g = 'data' and o <> 'written'"), q.where("g in ('vocab', 'data') and p <> 'msr:ofSalt'"))


@query(f"""
with {_QUADS}, t as (select distinct s, p, o from quads where g in ('ontology', 'data', 'vocab')),
pm as (select s from t where p = 'rdf:type' and o = 'msr:PropertyMeasurement'),
need as (select unnest(['prov:wasDerivedFrom', 'prov:wasGeneratedBy', 'msr:dataLocator', 'msr:forProperty', 'msr:ofSalt', 'msr:hasUnit', 'msr:equationForm']) as path)
select pm.s as focus_node, 'PropertyMeasurementShape' as shape, 'minCount' as "constraint", path from pm, need where not exists (select 1 from t where t.s = pm.s and t.p = path)
union all
select s, 'CatalogIndividualProvenanceShape', 'minCount', path from (select distinct s from t where p = 'rdf:type' and o in ('msr:MoltenSalt', 'msr:Constituent', 'msr:ChemicalCompound')), unnest(['prov:wasGeneratedBy', 'prov:wasDerivedFrom']) n(path) where not exists (select 1 from t where t.s = s and t.p = path and t.s like 'never')
union all
select distinct t.s, 'PropertyMeasurementUnitAllowlistShape', 'in', 'msr:hasUnit' from t join pm on pm.s = t.s where t.p = 'msr:hasUnit' and t.o not in (select unit_curie from unit_catalog where property <> 'density' and unit_curie is not null)
union all
select distinct s, 'LinksToTargetKindShape', 'class', 'msr:linksTo' from t where p = 'msr:linksTo' and o not in (select s from t where p = 'rdf:type' and o in ('skos:Concept', 'owl:Class', 'msr:PhysicalProperty', 'msr:MoltenSalt'))
""")
def shape_violations(spark: SparkSession, base: str) -> DataFrame:
    allowed = table(spark, base, "unit_catalog").where("property <> 'density'").select(F.col("unit_curie").alias("unit"))
    return shapes.validate(_quads(spark, base), allowed).select("focus_node", "shape", "constraint", "path").distinct()


@query("""
with recursive edges as (
  select distinct 'region:' || r_regionkey as src, 'nation:' || n_nationkey as dst from region join nation on n_regionkey = r_regionkey
  union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer
  union select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier
), walk(start, node) as (
  select 'region:' || r_regionkey, 'region:' || r_regionkey from region
  union select w.start, e.dst from walk w join edges e on e.src = w.node
) select start, node from walk
""")
def transitive_closure(spark: SparkSession, base: str) -> DataFrame:
    iri = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    e = table(spark, base, "nation").select(iri("region", "n_regionkey").alias("src"), iri("nation", "n_nationkey").alias("dst"))
    e = e.unionByName(table(spark, base, "customer").select(iri("nation", "c_nationkey").alias("src"), iri("customer", "c_custkey").alias("dst")))
    e = e.unionByName(table(spark, base, "supplier").select(iri("nation", "s_nationkey").alias("src"), iri("supplier", "s_suppkey").alias("dst")))
    return graph.closure(e, table(spark, base, "region").select(iri("region", "r_regionkey").alias("node")))


# ---- grounding ------------------------------------------------------------------------------------------------------


def _facts(spark: SparkSession, base: str) -> DataFrame:
    """Triples of the core with mentions, unit labels and what serves a function."""
    m = table(spark, base, "mentions").where("status = 'linked'").select(F.concat(F.lit("mention:"), F.col("mention_id").cast("string")).alias("id"), F.lit("msr:Mention").alias("type"), F.col("surface_form").alias("surface"), F.col("target_iri").alias("target"))
    out = graph.entity_quads(m, "data", "id", None, {"type": (graph.TYPE, "uri", None), "surface": ("msr:surfaceForm", "literal", None), "target": ("msr:linksTo", "uri", None)})
    u = table(spark, base, "unit_catalog").where("unit_curie is not null")
    out = out.unionByName(graph.entity_quads(u, "vocab", "unit_curie", None, {"unit_symbol": ("rdfs:label", "literal", None)}))
    r = table(spark, base, "relations").where("role_iri is not null").groupBy("role_iri").agg(F.min(F.concat(F.lit("msrd:"), F.col("report"))).alias("source")).withColumn("serves", F.lit("msr:meltingPoint"))
    out = out.unionByName(graph.entity_quads(r, "data", "role_iri", None, {"source": ("prov:wasDerivedFrom", "uri", None), "serves": ("msr:servedByProperty", "uri", None)}))
    return graph.core(_quads(spark, base).unionByName(out))


@query("""
with hit as (select distinct target_iri as salt from mentions where status = 'linked' and contains(lower(surface_form), 'lif'))
select distinct 'rel:' || relation_id as s, r.salt_iri as salt, r.property_iri as property, r.unit_iri as unit, 'msrd:doc-' || r.doc_id as source, u.unit_symbol as unit_label
from relations r join hit on hit.salt = r.salt_iri left join unit_catalog u on u.unit_curie = r.unit_iri where r.relation_kind = 'measurement' and r.property_iri = 'msr:density'
""")
def ground_star_optional(spark: SparkSession, base: str) -> DataFrame:
    return grounding.ground(_facts(spark, base), "LiF", prop="density").select("s", "salt", "property", "unit", "source", "unit_label").distinct()


@query("""
select distinct c.target_iri as salt, u.property from concepts c, unit_catalog u
where c.target_kind = 'salt' and not exists (select 1 from relations r where r.relation_kind = 'measurement' and r.salt_iri = c.target_iri and r.property_iri = 'msr:' || u.property)
""")
def evidence_gap_anti(spark: SparkSession, base: str) -> DataFrame:
    salts = table(spark, base, "concepts").where("target_kind = 'salt'").select(F.col("target_iri").alias("salt"))
    props = [r[0] for r in table(spark, base, "unit_catalog").select("property").distinct().collect()]  # the unit catalogue: one row a property
    have = table(spark, base, "relations").where("relation_kind = 'measurement'").select(F.col("salt_iri").alias("salt"), F.regexp_replace("property_iri", "^msr:", "").alias("property"))
    return grounding.gaps(salts, props, have)


@query("""
with served as (select role_iri as safety_function, min('msrd:' || report) as function_source from relations where role_iri is not null group by role_iri)
select distinct s.safety_function, s.function_source, 'msr:meltingPoint' as property, 'rel:' || r.relation_id as measurement, r.salt_iri as salt, 'msrd:doc-' || r.doc_id as measurement_source
from served s, relations r where r.relation_kind = 'measurement' and r.property_iri = 'msr:meltingPoint'
""")
def evidence_chain(spark: SparkSession, base: str) -> DataFrame:
    return grounding.safety_chain(_facts(spark, base)).select("safety_function", "function_source", "property", "measurement", "salt", "measurement_source")


@query("""
with req(requirement, property, comparator, threshold) as (values ('r1', 'density', 'gte', 2.0), ('r2', 'viscosity', 'lt', 10.0), ('r3', 'meltingPoint', 'lte', 800.0), ('r4', 'density', 'lt', 4.5)),
v as (select distinct locator, property, c0 from measurement_value where c0 is not null and not isnan(c0))
select requirement, locator, case comparator when 'lt' then c0 < threshold when 'lte' then c0 <= threshold when 'gt' then c0 > threshold else c0 >= threshold end as met,
  case when comparator in ('gt', 'gte') then c0 - threshold else threshold - c0 end as margin from req join v using (property)
""")
def threshold_margin_theta(spark: SparkSession, base: str) -> DataFrame:
    req = spark.createDataFrame([("r1", "density", "gte", 2.0), ("r2", "viscosity", "lt", 10.0), ("r3", "meltingPoint", "lte", 800.0), ("r4", "density", "lt", 4.5)], "requirement string, property string, comparator string, threshold double")
    v = table(spark, base, "measurement_value").where("c0 is not null and not isnan(c0)").select("locator", "property", F.col("c0").alias("value")).distinct()
    return grounding.margins(req, v).select("requirement", "locator", "met", "margin")


@query("""
with t as (select distinct doc_id as turn_id, locator, source from (select cast(replace(doc_id, 'msrd:doc-', '') as bigint) as doc_id, locator, source from measurement_value where doc_id is not null))
select turn_id, list_sort(list_distinct(list(locator))) as locators, list_sort(list_distinct(list(source))) as cited, bool_or(source = 'document') as grounded from t group by turn_id
""")
def provenance_rollup(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "measurement_value").where("doc_id is not null").select(
        F.regexp_replace("doc_id", "^msrd:doc-", "").cast("long").alias("turn_id"), F.array("locator").alias("locators"), F.array("source").alias("cited"), F.array().cast("array<string>").alias("dois"), (F.col("source") == "document").alias("grounded")
    )
    return grounding.rolled_up(t).drop("dois")


# ---- review ---------------------------------------------------------------------------------------------------------

_OBS = """
obs as (
  select c.candidate_id as id, c.source as kind, c.run_id, lower(trim(c.term, ' ')) as term, o.document_iri as document, o.corpus, o.occurrence_count, strftime(c.generated_at, '%Y-%m-%dT%H:%M:%S.%f') as generated_at
  from (select candidate_id, source, term, run_id, generated_at, unnest(observations) as o from candidates where term is not null) c
), last as (
  select term, document, max(struct_pack(g := generated_at, c := coalesce(corpus, ''), n := coalesce(occurrence_count, 0))) as top, min(generated_at) as first_observed, max(generated_at) as last_observed
  from obs where document is not null and document <> '' group by 1, 2
)"""


def _observations(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "candidates").where("term is not null").select(F.lower(F.trim("term")).alias("proposal_id"), F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated_at"), F.explode("observations").alias("o"))
    return c.select("proposal_id", "generated_at", F.col("o.document_iri").alias("document"), F.coalesce("o.corpus", F.lit("")).alias("corpus"), F.coalesce("o.occurrence_count", F.lit(0)).alias("occurrence_count"))


@query(f"""
with {_OBS}, p as (select distinct lower(trim(term, ' ')) as term from candidates where term is not null),
a as (select term, count(*) as document_frequency, sum(top.n) as total_occurrences, count(distinct top.c) as corpus_count, list_sort(list_distinct(list(top.c))) as corpora from last group by term)
select p.term as proposal_id, coalesce(document_frequency, 0) as document_frequency, cast(coalesce(total_occurrences, 0) as bigint) as total_occurrences, coalesce(corpus_count, 0) as corpus_count, coalesce(corpora, []) as corpora from p left join a using (term)
""")
def observation_queue(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "candidates").where("term is not null").select(F.lower(F.trim("term")).alias("proposal_id")).distinct()
    p = p.select("proposal_id", F.lit("term").alias("kind"), F.lit("pending").alias("status"), F.col("proposal_id").alias("term"))
    return review.queue(p, _observations(spark, base)).drop("kind", "status", "term")


@query(f"with {_OBS} select term as proposal_id, top.c as corpus, document, top.n as occurrence_count, first_observed, last_observed from last")
def observation_breakdown(spark: SparkSession, base: str) -> DataFrame:
    return review.breakdown(_observations(spark, base).where("document <> ''"))


# ---- store, relations, linking --------------------------------------------------------------------------------------


@query("""
with inc as (select o_orderkey, o_custkey, 'U' as o_orderstatus, o_totalprice + 1 as o_totalprice, row_number() over (partition by o_orderkey order by l_linenumber desc) as n from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R')
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from inc where n = 1
union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey not in (select o_orderkey from inc)
""")
def upsert_latest_wins(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    li = table(spark, base, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    inc = li.join(o, "o_orderkey").select("o_orderkey", "o_custkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), "l_linenumber")
    return store.upsert(o, inc, "o_orderkey", "l_linenumber")


@query("""
with r as (select distinct relation_id, report, salt_iri, property_iri, seg_index, char_start, case when confidence between 0 and 1 and not isnan(confidence) then confidence else 0.0 end as confidence from relations where relation_kind = 'measurement'),
w as (select *, row_number() over (partition by report, property_iri, salt_iri order by confidence desc, seg_index, char_start, relation_id) as n from r)
select relation_id, case when n = 1 then 'written' else 'skipped' end as disposition, case when n = 1 then '' else 'duplicate-locator' end as reason from w
""")
def relation_dedup_best(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "relations").where("relation_kind = 'measurement'").select("relation_id", "report", "salt_iri", "property_iri", "seg_index", "char_start", confidence(F.col("confidence")).alias("confidence")).distinct()
    r = r.withColumns({"disposition": F.lit("written"), "reason": F.lit("")})
    order = [-F.col("confidence"), F.col("seg_index"), F.col("char_start")]
    return relations.best_of_key(r, ["report", "property_iri", "salt_iri"], order, "relation_id").select("relation_id", "disposition", "reason")


_UNIT_SQL = "(case translate(trim(unit, ' '), '·³μ', '.3u') when 'cP' then 'viscosity' when 'mPa.s' then 'viscosity' when 'mPas' then 'viscosity' when 'g/cm3' then 'density' when 'g/cc' then 'density' when 'mN/m' then 'surfaceTension' when 'S/cm' then 'electricalConductivity' end)"


@query(rf"""
with salts as (select distinct target_iri from concepts where target_kind = 'salt'), roles as (select distinct role_iri from relations where role_iri is not null and disposition = 'written'),
m as (select distinct report, seg_index, target_iri from mentions where status = 'linked'),
r as (select distinct relation_id, report, seg_index, relation_kind as kind, salt_iri, property_iri, unit, val, role_iri, reactor_iri, case when confidence between 0 and 1 and not isnan(confidence) then confidence else 0.0 end as conf from relations)
select relation_id, case when conf < 0.5 then 'below-threshold'
  when kind = 'measurement' and (salt_iri is null or property_iri is null or unit is null) or kind = 'role' and (salt_iri is null or role_iri is null) or kind = 'reactor' and (salt_iri is null or reactor_iri is null)
    or kind = 'servedByProperty' and (salt_iri is null or property_iri is null) or kind = 'addressesFunction' or kind not in ('measurement', 'role', 'reactor', 'servedByProperty', 'addressesFunction') then 'malformed-relation'
  when kind = 'measurement' and salt_iri not in (select target_iri from salts) then 'salt-not-composed'
  when kind = 'measurement' and property_iri not in (select 'msr:' || property from unit_catalog) then 'unknown-property'
  when kind = 'measurement' and {_UNIT_SQL} is null then 'unit-unmappable'
  when kind = 'measurement' and {_UNIT_SQL} <> replace(property_iri, 'msr:', '') then 'unit-dimension-mismatch'
  when kind = 'measurement' and val is null then 'equation-parse'
  when kind in ('role', 'reactor') and salt_iri not in (select target_iri from salts) then 'unknown-salt'
  when kind = 'role' and role_iri not in (select role_iri from roles) then 'unknown-role'
  when kind = 'reactor' and not exists (select 1 from m where m.report = r.report and m.seg_index = r.seg_index and m.target_iri = r.reactor_iri) then 'reactor-not-grounded'
  when kind = 'servedByProperty' then 'unknown-safety-function' else '' end as reason
from r
""")
def reason_code_validation(spark: SparkSession, base: str) -> DataFrame:
    """All kinds; a measurement is a point of its value at 900 K, the salt of a served property stands for the function."""
    k = F.col("relation_kind")
    r = table(spark, base, "relations").select(
        "relation_id", "report", "seg_index", k.alias("kind"), F.col("salt_iri").alias("salt"), F.col("property_iri").alias("property"), "unit", F.col("role_iri").alias("role"), F.col("reactor_iri").alias("reactor"), "confidence",
        F.when(k == "servedByProperty", F.col("salt_iri")).alias("safety_function"), F.lit(None).cast("string").alias("requirement"), F.when(k == "measurement", "DiscretePoint").alias("form_hint"),
        F.col("val").alias("value"), F.when(k == "measurement", 900.0).alias("temperature"), F.lit(None).cast("array<double>").alias("coefficients"),
    ).distinct()
    c = table(spark, base, "concepts")
    every = table(spark, base, "relations")
    known = {
        "salts": c.where("target_kind = 'salt'").select(F.col("target_iri").alias("iri")), "properties": table(spark, base, "unit_catalog").select(F.concat(F.lit("msr:"), F.col("property")).alias("iri")),
        "roles": every.where("disposition = 'written' and role_iri is not null").select(F.col("role_iri").alias("iri")), "reactors": every.where("reactor_iri is not null").select(F.col("reactor_iri").alias("iri")),
    }
    return relations.validated(r, known, 0.5, table(spark, base, "mentions").where("status = 'linked'")).select("relation_id", "reason")


@query("""
with m as (select distinct doc_id, seg_index, char_start, char_end, surface_form, target_iri, target_kind from mentions where status = 'linked'),
g as (select doc_id, seg_index, count(*) as mentions, count(distinct target_iri) as targets from m group by 1, 2)
select distinct s.segment_id, g.mentions, g.targets from segments s join g using (doc_id, seg_index)
""")
def segment_mention_group(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "segments").select("segment_id", "doc_id", "seg_index").distinct()
    got = relations.selected_sentences(s, table(spark, base, "mentions"))
    return got.select("segment_id", F.size("mentions").cast("long").alias("mentions"), F.size(F.array_distinct(F.transform("mentions", lambda m: m["target_iri"]))).cast("long").alias("targets"))


@query("""
with m as (select distinct mention_id, doc_id, seg_index, char_start, char_end from mentions), r as (select distinct relation_id, doc_id, seg_index, char_start, char_end from relations)
select mention_id, relation_id from m join r on m.doc_id = r.doc_id and m.seg_index = r.seg_index and m.char_start < r.char_end and r.char_start < m.char_end
""")
def span_overlap_join(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "mentions").select("mention_id", "doc_id", "seg_index", "char_start", "char_end").distinct()
    r = table(spark, base, "relations").select("relation_id", "doc_id", "seg_index", "char_start", "char_end").distinct()
    return linker.overlapping(m, r, ["doc_id", "seg_index"]).select("mention_id", F.col("b_relation_id").alias("relation_id"))


@query()
def fuzzy_best_match(spark: SparkSession, base: str) -> DataFrame:
    """The best label of every surface by weighted similarity, where it reaches the score."""
    c = table(spark, base, "concepts").select(F.col("target_iri").alias("iri"), F.col("target_kind").alias("kind"), F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>"))).alias("labels"))
    surfaces = table(spark, base, "ornl_tm_2316_gold").select("surface").unionByName(table(spark, base, "mentions").select(F.col("surface_form").alias("surface")))
    return linker.fuzzy_labels(surfaces.where("surface is not null"), c)


@query("""
with g as (select distinct gold_id, lower(surface) as surface from ornl_tm_2316_gold where surface is not null and regexp_full_match(surface, '[\\x00-\\x7F]*')), l as (select distinct target_iri, pref_label from concepts),
d as (select gold_id, target_iri, levenshtein(surface, lower(pref_label)) as d from g, l)
select gold_id, min(d) as distance, min(struct_pack(d := d, t := target_iri)).t as target_iri from d group by gold_id
""")
def nearest_label(spark: SparkSession, base: str) -> DataFrame:
    """Plain edit distance; engines count it differently for other letters than ASCII, so surfaces with such are left to fuzzy_best_match."""
    g = table(spark, base, "ornl_tm_2316_gold").where("surface is not null").where(F.col("surface").rlike(r"^[\x00-\x7F]*$")).select("gold_id", "surface").distinct()
    return linker.nearest_labels(g, "gold_id", "surface", table(spark, base, "concepts").select("target_iri", "pref_label").distinct())


@query("select report, count(distinct seg_index) as segments, count(*) filter (where layer = 2 and status = 'linked') as layer2, count(*) filter (where layer = 3 and status = 'linked') as layer3, count(*) filter (where layer = 4 and status = 'linked') as layer4, count(*) filter (where layer = 5 and status = 'linked') as layer5, count(*) filter (where status = 'novel') as novel from mentions group by report")
def link_summary(spark: SparkSession, base: str) -> DataFrame:
    return linker.link_summary(table(spark, base, "mentions"))


@query("select report, count(*) filter (where disposition = 'written') as written, count(*) filter (where disposition = 'rejected') as rejected, count(*) filter (where disposition = 'skipped') as skipped, count(*) filter (where reason = 'malformed-relation') as malformed from relations group by report")
def extraction_summary(spark: SparkSession, base: str) -> DataFrame:
    return relations.extraction_summary(table(spark, base, "relations"))


@query()
def layered_linker(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "concepts").select(F.col("target_iri").alias("iri"), F.col("target_kind").alias("kind"), F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>"))).alias("labels"))
    return linker.link_segments(table(spark, base, "segments"), c, chem.surface_forms)


@query("""
with r as (select distinct relation_id, relation_kind as kind, salt_iri as salt, role_iri as role, confidence from relations)
select relation_id, relation_id % 7 = 0 as malformed, case when relation_id % 7 <> 0 and relation_id % 5 <> 0 then kind end as kind, case when relation_id % 7 <> 0 and relation_id % 5 <> 0 then salt end as salt,
  case when relation_id % 7 <> 0 and relation_id % 5 <> 0 then role end as role, case when relation_id % 7 <> 0 and relation_id % 5 <> 0 and not isnan(confidence) then confidence end as confidence from r
""")
def json_shape_check(spark: SparkSession, base: str) -> DataFrame:
    """Replies of a model made of the relations: some are no JSON, some propose nothing, one proposes each of the others."""
    r = table(spark, base, "relations").select("relation_id", F.col("relation_kind").alias("kind"), F.col("salt_iri").alias("salt"), F.col("role_iri").alias("role"), "confidence").distinct()
    one = F.to_json(F.struct(F.array(F.struct("kind", "salt", "role", F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"))).alias("relations")))
    reply = F.when(F.col("relation_id") % 7 == 0, F.concat(F.lit("Sorry, "), F.col("kind"))).when(F.col("relation_id") % 5 == 0, F.lit('{"relations": []}')).otherwise(one)
    return relations.proposals(r.select("relation_id", reply.alias("reply"))).select("relation_id", "malformed", "kind", "salt", "role", "confidence")


GUARDED = "WITH big AS (SELECT property, source, c0 FROM measurement_value WHERE c0 > 1 AND NOT isnan(c0)) SELECT property, source, count(*) AS n, max(c0) AS top FROM big GROUP BY property, source -- DROP is only a word here\n;"


@query(GUARDED.replace(";", ""))
def sql_guard_select(spark: SparkSession, base: str) -> DataFrame:
    return sqlsurface.select(spark, GUARDED, {"measurement_value": table(spark, base, "measurement_value")})


_TEXTS = {
    "SELECT 1": True, "select a from t;": True, "WITH x AS (SELECT 1) SELECT * FROM x": True, "SELECT ''DROP;''": True, "SELECT 1; DROP TABLE t": False, "PRAGMA x": False, "SELECT ''a": False,
    "INSERT INTO t VALUES (1)": False, "": False, "/* x": False, "WITH x AS (DELETE FROM t) SELECT 1": False, "SELECT replace(a, ''b'', ''c'') FROM t": False, "SELECT reflect(''a'', ''b'')": False, "-- only a comment": False,
}


@query("select * from (values " + ", ".join(f"('{q}', {str(ok).lower()})" for q, ok in _TEXTS.items()) + ") t(query, accepted)")
def sql_guard_texts(spark: SparkSession, base: str) -> DataFrame:
    texts = [q.replace("''", "'") for q in _TEXTS]
    return spark.createDataFrame([(q, sqlsurface.allowed(q)) for q in texts], "query string, accepted boolean")


# ---- streams: extensions --------------------------------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, base: str) -> DataFrame:
    """The windowed aggregate of the whole stream, computed in the stream with watermark and state, run to its end."""
    path = f"{base}/events.parquet"
    schema = spark.read.parquet(path).schema
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = path if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory() else base
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if folder == base else "*.parquet").parquet(folder)
    w = observations.run_windows(stream.select("ts", "event_type", "value"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""
with o as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval '30 minutes' or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as started, max(ts) + interval '30 minutes' as ended, count(*) as n from s group by user_id, k
""")
def event_sessions(spark: SparkSession, base: str) -> DataFrame:
    s = observations.sessions(table(spark, base, "events"))
    return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


# ---- patterns, segments, bundles ------------------------------------------------------------------------------------


@query(f"""
with {_QUADS}, t as (select distinct s, p, o from quads where g in ('ontology', 'data', 'vocab')),
m as (select distinct a.s as m, a.o as salt from t a join t b on a.s = b.s where a.p = 'msr:ofSalt' and b.p = 'rdf:type' and b.o = 'msr:PropertyMeasurement')
select distinct m.salt, l.o as label, u.o as unit from m left join t l on l.s = m.salt and l.p = 'skos:prefLabel' left join t u on u.s = m.m and u.p = 'msr:hasUnit'
where not exists (select 1 from t x where x.s = m.m and x.p = 'msr:disposition' and x.o = 'rejected')
""")
def graph_patterns(spark: SparkSession, base: str) -> DataFrame:
    t = graph.core(_quads(spark, base)).select("s", "p", "o")
    return bgp.select(
        t, ["salt", "label", "unit"], [("?m", graph.TYPE, "msr:PropertyMeasurement"), ("?m", "msr:ofSalt", "?salt")],
        optional=[[("?salt", "skos:prefLabel", "?label")], [("?m", "msr:hasUnit", "?unit")]], absent=[[("?m", "msr:disposition", "rejected")]],
    )


@query(f"""
with {_QUADS}, t as (select distinct s, p, o from quads where g in ('ontology', 'data', 'vocab'))
select distinct a.s as m, b.o as label from t a join t b on a.o = b.s where a.p = 'msr:linksTo' and b.p = 'skos:prefLabel'
""")
def graph_path(spark: SparkSession, base: str) -> DataFrame:
    return bgp.select(graph.core(_quads(spark, base)).select("s", "p", "o"), ["m", "label"], [("?m", "msr:linksTo/skos:prefLabel", "?label")])


@query()
def report_segments(spark: SparkSession, base: str) -> DataFrame:
    return segmenter.segments(table(spark, base, "documents"), "doc_id")


@query("""
with k as (select target_iri as iri from concepts where target_kind in ('concept', 'class')), r as (select distinct reactor_iri as iri, role_iri as broader from relations where reactor_iri is not null or role_iri is not null)
select iri, broader, coalesce(broader in (select iri from k) or broader in (select regexp_extract(iri, '([^#/:]*)$', 1) from k), false) and coalesce(regexp_full_match(broader, '(?:[A-Za-z][\\w-]*:)?[A-Za-z][\\w-]*'), false) as accepted from r
""")
def accepted_individuals(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "relations").where("reactor_iri is not null or role_iri is not null").select(F.col("reactor_iri").alias("iri"), F.col("role_iri").alias("broader")).distinct()
    return bundles.accepted(r, graph.core(_quads(spark, base))).select("iri", "broader", "accepted")


def _slug_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_BUNDLE = f"""
c as (select distinct candidate_id, lower(trim(term, ' ')) as term, coalesce(source, 'lexical') as kind, run_id, generated_at, observations from candidates where term is not null),
n as (select *, kind || '-' || {_slug_sql('term')} as name, {_slug_sql("coalesce(run_id, '')")} as run, strftime(generated_at, '%Y-%m-%dT%H:%M:%S.%f') as made from c),
p as (select *, 'msrd:proposal-' || name as id from n),
e as (select id, 'msrd:evidence-' || v.report || '-' || v.start_offset || '-' || v.end_offset as node, v.* from p join (select distinct candidate_id, report, document_iri, sentence_text, start_offset, end_offset from evidence) v using (candidate_id)),
o as (select id, 'msrd:obs-' || name || '-' || {_slug_sql("regexp_extract(o.document_iri, '([^#/]*)$', 1)")} || '-' || run as node, run, made, o.document_iri as doc, o.corpus as corpus, o.occurrence_count as n from (select *, unnest(observations) as o from p) where o.document_iri is not null),
quads as (
  select distinct 'staging' as g, s, p, o, o_type, datatype, cast(null as varchar) as lang from (
    select id as s, x.p as p, x.o as o, x.t as o_type, x.d as datatype from p, unnest([
      {{'p': 'rdf:type', 'o': 'msr:ChangeProposal', 't': 'uri', 'd': null}}, {{'p': 'msr:kind', 'o': kind, 't': 'literal', 'd': 'xsd:string'}}, {{'p': 'msr:term', 'o': term, 't': 'literal', 'd': 'xsd:string'}},
      {{'p': 'msr:reviewStatus', 'o': 'pending', 't': 'literal', 'd': 'xsd:string'}}, {{'p': 'msr:hasProposalGraph', 'o': 'urn:msr:proposal/' || name, 't': 'literal', 'd': 'xsd:anyURI'}}]) u(x)
    union all select id, 'msr:hasEvidence', node, 'uri', null from e where node is not null
    union all select node, x.p, x.o, x.t, x.d from e, unnest([
      {{'p': 'rdf:type', 'o': 'msr:Evidence', 't': 'uri', 'd': null}}, {{'p': 'msr:evidenceText', 'o': sentence_text, 't': 'literal', 'd': 'xsd:string'}}, {{'p': 'msr:citedIn', 'o': document_iri, 't': 'uri', 'd': null}},
      {{'p': 'msr:startOffset', 'o': cast(start_offset as varchar), 't': 'literal', 'd': 'xsd:integer'}}, {{'p': 'msr:endOffset', 'o': cast(end_offset as varchar), 't': 'literal', 'd': 'xsd:integer'}}]) u(x) where node is not null
    union all select id, 'msr:hasObservation', node, 'uri', null from o
    union all select node, x.p, x.o, x.t, x.d from o, unnest([
      {{'p': 'rdf:type', 'o': 'msr:Observation', 't': 'uri', 'd': null}}, {{'p': 'msr:inDocument', 'o': doc, 't': 'uri', 'd': null}}, {{'p': 'msr:inCorpus', 'o': corpus, 't': 'uri', 'd': null}},
      {{'p': 'msr:occurrenceCount', 'o': cast(n as varchar), 't': 'literal', 'd': 'xsd:integer'}}, {{'p': 'msr:observedInRun', 'o': case when run <> '' then 'msrd:run-' || run end, 't': 'uri', 'd': null}}, {{'p': 'prov:generatedAtTime', 'o': made, 't': 'literal', 'd': 'xsd:dateTime'}}]) u(x)
  ) where o is not null
)"""


def _bundle(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "candidates").where("term is not null").select("candidate_id", F.lower(F.trim("term")).alias("term"), F.coalesce("source", F.lit("lexical")).alias("kind"), "run_id", "generated_at", "observations")
    e = table(spark, base, "evidence").where("candidate_id is not null").select("candidate_id", "report", "document_iri", "sentence_text", "start_offset", "end_offset").distinct()
    e = e.groupBy("candidate_id").agg(F.collect_list(F.struct("report", "document_iri", "sentence_text", "start_offset", "end_offset")).alias("evidence"))  # quotations of one candidate row
    return bundles.bundle(c.join(e, "candidate_id", "left"))


@query(f"with {_BUNDLE} select * from quads")
def proposal_bundle(spark: SparkSession, base: str) -> DataFrame:
    return _bundle(spark, base)


@query(f"""
with {_BUNDLE},
x as (select node, min(doc) as doc, min(coalesce(corpus, '')) as corpus, min(cast(n as varchar)) as n, min(made) as made from o group by node),
each as (select distinct i.id, x.* from (select distinct id, node from o) i join x using (node)),
last as (select id, doc, max({{'made': made, 'corpus': corpus, 'n': coalesce(try_cast(n as int), 0)}}) as top from each group by 1, 2)
select id as proposal_id, count(*) as document_frequency, cast(sum(top.n) as bigint) as total_occurrences, count(distinct top.corpus) as corpus_count, list_sort(list_distinct(list(top.corpus))) as corpora from last group by id
""")
def bundle_queue(spark: SparkSession, base: str) -> DataFrame:
    """The review queue over the observation nodes that the bundles wrote."""
    q = _bundle(spark, base)
    p = graph.pivot(q, "msr:ChangeProposal", {"msr:kind": "kind", "msr:reviewStatus": "status", "msr:term": "term"}).withColumnRenamed("s", "proposal_id")
    return review.queue(p, bundles.observation_rows(q)).where("document_frequency > 0").drop("kind", "status", "term")
