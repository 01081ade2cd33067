"""DuckDB SQL for the engine's queries, written against the same tables."""

from __future__ import annotations

from ..functions import attributes as a
from ..functions import unicode as u
from ..operators import fonts, repair, rules  # noqa: F401 - fonts registers its rules
from . import queries as q
from . import units as un

AR, LA = u.ARABIC_LETTER, "[A-Za-z]"
_T = u.joining_table()
_UNITS = f"units as ({un.flat_sql()})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count(pattern: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def has(pattern: str, c: str = "text") -> str:
    return f"regexp_matches({c}, '{pattern}')"


def mapping(table: dict[str, str]) -> str:
    return "map([" + ", ".join(lit(k) for k in table) + "], [" + ", ".join(lit(v) for v in table.values()) + "])"


def case(table: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + " end"


CH = "string_split(text, '')"
POS = "range(1, length(text) + 1)"
OFF = "strlen(substr(text, 1, i - 1))"
HEX = "upper(case when unicode(c) < 65536 then lpad(to_hex(unicode(c)), 4, '0') else to_hex(unicode(c)) end)"
TYPES = f"translate(regexp_replace(regexp_replace(text, '{u.UNSTATED}', chr(1), 'g'), '[^\\x{{0600}}-\\x{{06FF}}\\x{{200D}}\\x01]', 'U', 'g'), {lit(''.join(_T) + chr(0x200D))} || chr(1), '{''.join(_T.values())}CX')"
#: One row per character with its joining type.
CHARS = f"""pos as (
  select ord, unnest({CH}) as c, unnest(string_split({TYPES}, '')) as k, unnest({POS}) as i from units
), chars as (select ord, i, c, k, coalesce(sum(strlen(c)) over (partition by ord order by i rows between unbounded preceding and 1 preceding), 0)::bigint as off from pos)"""
VERDICT = "case when coalesce(nxt, '') = 'T' then 'carrier' when n >= 2 and (coalesce(bef, '') in ('D','L','C','K') or coalesce(nxt, '') in ('D','R','C','K')) then 'stretched' when n >= 2 then 'standalone' when coalesce(bef, '') in ('D','L','C','K') and coalesce(nxt, '') in ('D','R','C','K') then 'wedged' else 'displayed' end"
RUNS = f"""{CHARS}, isl as (
  select *, i - row_number() over (partition by ord order by i) as g from chars where k = 'K'
), span as (select ord, min(i) as i, min(off) as off, count(*)::int as n from isl group by ord, g
), runs as (select s.*,
  (select arg_max(p.k, p.i) from chars p where p.ord = s.ord and p.i < s.i and p.k <> 'T') as bef,
  (select p.k from chars p where p.ord = s.ord and p.i = s.i + s.n) as nxt from span s
), judged as (select ord, off, n, {VERDICT} as verdict from runs)"""
FORMS = f"""{CHARS}, seen as (
  select *, lag(k) over (partition by ord order by i) as bef, lead(k) over (partition by ord order by i) as nxt from chars where k <> 'T'
), forms as (select ord, off, c,
  coalesce(bef, '') in ('D','L','C','K') as back, k = 'D' and coalesce(nxt, '') in ('D','R','C','K') as onw
  from seen where k in ('D','R') and {has(AR, 'c')} and coalesce(bef, '') <> 'X' and coalesce(nxt, '') <> 'X'
), named as (select ord, off, c, case when back and onw then 'medial' when back then 'final' when onw then 'initial' else 'isolated' end as form from forms)"""
STRETCH = f"""{CHARS}, isl as (select *, i - row_number() over (partition by ord order by i) as g from chars where k <> 'U'
), runs as (select ord, min(off) as off, string_agg(c, '' order by i) as run from isl group by ord, g)"""
EFF = "case when {0}_state <> 'unset' then {0}_value end"
LOGICAL = f"list_aggregate(list_transform({CH}, lambda c: coalesce({mapping(u.PRESENTATION)}[c], c)), 'string_agg', '')"
DOM = f"case when {count(AR)} > {count(LA)} then 'rtl' else 'ltr' end"
STRIP = f"translate(text, {lit(''.join(u.CONTROL_NAMES))}, '')"
HITS = f"list_filter({POS}, lambda i: {has(u.CONTROL, 'substr(text, i, 1)')})"
OFFENDERS = "list_aggregate(list_sort(list_distinct(list_transform(list_filter({ch}, lambda c: {m}), lambda c: 'U+' || {hex}))), 'string_agg', '{sep}')"


def with_units(body: str, more: str = "") -> str:
    return f"with {_UNITS}{', ' + more if more else ''} {body}"


def offenders(pattern: str, sep: str = " ") -> str:
    return "coalesce(" + OFFENDERS.format(ch=CH, m=has(pattern, "c"), hex=HEX, sep=sep) + ", '')"


SQL: dict[str, str] = {
    "f01_05_script_classes": with_units(f"select ord, {count(AR)} as arabic_letters, {has(AR)} as arabic, {has(u.LTR_OR_DIGIT)} as ltr_or_digits, {has(u.ARABIC_INDIC_DIGIT)} as indic_digit, {has(u.ARABIC_MARK)} as mark from units"),
    "f06_09_presentation_forms": with_units(f"select ord, {count(u.PRESENTATION_FORM)} as forms, {count(u.WORD_LIGATURE)} as ligatures, {LOGICAL} as logical from units"),
    "f10_12_controls": with_units(
        f"select ord, coalesce(list_aggregate(list_transform(h, lambda i: {OFF}::varchar), 'string_agg', ','), '') as offsets, coalesce(list_aggregate(list_transform(h, lambda i: 'U+' || lpad(upper(to_hex(unicode(substr(text, i, 1)))), 4, '0')), 'string_agg', ','), '') as codepoints,"
        f" coalesce(list_aggregate(list_transform(h, lambda i: {mapping(u.CONTROL_NAMES)}[substr(text, i, 1)]), 'string_agg', ','), '') as names, {STRIP} as stripped from (select *, {HITS} as h from units)"
    ),
    "f13_dominant_direction": with_units(f"select ord, {DOM} as dominant from units"),
    "f14_auto_direction": with_units(r"select ord, case when regexp_extract(text, '[A-Za-z\x{00C0}-\x{024F}\x{0620}-\x{064A}\x{0671}-\x{06D3}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}\x{200F}]') ~ '[A-Za-z\x{00C0}-\x{024F}]' or not regexp_matches(text, '[\x{0620}-\x{064A}\x{FB50}-\x{FEFC}]') then 'ltr' else 'rtl' end as auto from units"),
    "f17_imposed": with_units(f"select ord, list_aggregate(list_reverse({CH}), 'string_agg', '') as rtl, text as ltr from units"),
    "f20_joining_types": with_units(f"select ord, {TYPES} as types from units"),
    "f21_22_joining_forms": with_units("select u.ord, coalesce(string_agg(off || ':' || case form when 'initial' then 'init' when 'medial' then 'medi' when 'final' then 'fina' else 'isol' end, ' ' order by off) filter (where off is not null), '') as forms from units u left join named n on n.ord = u.ord group by u.ord", FORMS),
    "f23_arabic_runs": with_units("select u.ord, coalesce(string_agg(off || ':' || run, ' ' order by off) filter (where off is not null), '') as runs from units u left join runs n on n.ord = u.ord group by u.ord", STRETCH),
    "f24_27_tatweel": with_units(
        "select u.ord, coalesce(string_agg(off || ':' || n || ':' || verdict, ' ' order by off) filter (where off is not null), '') as runs, coalesce(string_agg(list_aggregate(list_transform(range(0, n), lambda j: (off + 2 * j)::varchar), 'string_agg', ','), ',' order by off) filter (where verdict in ('stretched', 'wedged')), '') as padding from units u left join judged j on j.ord = u.ord group by u.ord",
        RUNS,
    ),
    "f28_30_character_names": with_units(f"select ch, count(*) as n, {mapping(u.NAMES)}[ch] as name, {has(u.char_class(map(chr, u.FORMAT_CHARS)), 'ch')} as format, {mapping(u.NAMES)}[ch] is not null and not {has(u.char_class(map(chr, u.FORMAT_CHARS)), 'ch')} as judged from (select unnest({CH}) as ch from units) group by ch"),
    "f31_arabic_tag": f"select doc_id, coalesce(lower(tag) = 'ar' or lower(tag) like 'ar-%', false) as arabic from (select doc_id, {un.FLAT['language_value']} as tag from documents)",
    "f32_leading_marker": with_units(f"select ord, nullif(regexp_extract(text, '{u.LEADING_MARKER}', 1), '') as marker, regexp_replace(text, '{u.LEADING_MARKER}[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]*', '') as stripped from units"),
    "f33_carries_strong": with_units(f"select ord, {has(AR)} as rtl, {has(LA)} as ltr from units"),
    "f34_offending_codepoints": with_units(f"select ord, {offenders(u.PRESENTATION_FORM)} as offenders from units"),
    "f35_span_text": with_units(f"""select ord, case when s is not null and e is not null then substr(text, s, e - s) end as part from (
        select ord, text, list_position(list_transform(range(1, length(text) + 2), lambda i: {OFF}), ord % 7) as s, list_position(list_transform(range(1, length(text) + 2), lambda i: {OFF}), ord % 7 + 6) as e from units)"""),
    "f36_37_resolved_values": with_units(f"select ord, {EFF.format('alignment')} as effective, {EFF.format('alignment')} <> 'left' as coherent, case when alignment_state = 'inherited' then 'styles alignment' end as origin, case when alignment_state = 'explicit' then alignment_value end as explicit from units"),
    "f38_escape": with_units(f"select ord, list_aggregate(list_transform({CH}, lambda c: case when regexp_matches(c, '[ -~]') then c else '\\u{{' || {HEX} || '}}' end), 'string_agg', '') as escaped from units"),
    "f39_column_of": "with p as (select p_partkey, (case p_partkey % 3 when 0 then 'A' when 1 then 'ab' else '' end) || (case when p_partkey % 5 = 0 then 'Z' else '' end) || p_partkey as reference from part) select p_partkey, reference, case p_partkey % 15 when 0 then 51 when 5 then 25 when 10 then 753 else case p_partkey % 3 when 0 then 0 when 1 then 27 end end as column_no from p",
    "f40_43_attributes": f"""with p as (select p_partkey, {q.ATTRIBUTES['word']} as word, {q.ATTRIBUTES['flag']} as flag from part), m as (select *, {case(a.ALIGNMENT['html'], 'lower(trim(word))')} as h, {case(a.ALIGNMENT['docx'], 'word')} as d, p_partkey % 2 = 0 as rtl from p),
        e as (select *, case h when 'start' then case when rtl then 'right' else 'left' end when 'end' then case when rtl then 'left' else 'right' end else h end as edge from m)
        select p_partkey, coalesce(flag in ('1', 'true', 'on'), false) as is_on, {case(a.ALIGNMENT['pptx'], 'word')} as pptx, d as docx, {case(a.ALIGNMENT['xlsx'], 'word')} as xlsx, h as html, {case(dict(left='l', right='r', center='ctr', justify='just', distributed='dist'), 'edge')} as lowered_pptx,
        {case(dict(start='start', end='end', center='center', justify='both', distributed='distribute'), 'd')} as lowered_docx, case when edge in ('left', 'right', 'center', 'justify', 'distributed') then edge end as lowered_xlsx, case flag when '1' then 'ltr' when '2' then 'rtl' end as reading_order, case when lower(trim(word)) in ('rtl', 'ltr') then lower(trim(word)) end as direction from e""",
    "f45_50_styles": """select p_partkey, case p_partkey % 4 when 0 then 'Amiri' when 1 then 'Arial' when 2 then 'Noto Naskh' end as family, case p_partkey % 5 when 1 then 'left' when 2 then 'left' end as inset, case p_partkey % 4 when 0 then 2 when 1 then 3 end as columns,
        case when p_partkey % 3 = 0 then 'div#main' else 'div.row' end as described, least(greatest(p_partkey % 12 - 1, 0), 8)::int as level, case p_partkey % 5 when 0 then 'minor' when 1 then 'major' when 3 then 'minor' end as font, case p_partkey % 5 when 0 then 'cs' when 1 then 'latin' when 3 then 'ea' end as script from part""",
    "f48_collapse_space": r"select doc_id, sha256(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) as collapsed_sha256 from documents",
    "f52_54_names_and_ids": f"""with p as (select p_partkey, {q.ATTRIBUTES['part']} as part, p_partkey % 6 as k from part) select p_partkey, lower(part) as folded,
        case p_partkey % 4 when 0 then 'ppt/slides/_rels/slide1.xml.rels' when 1 then 'word/_rels/document.xml.rels' when 2 then '_rels/a.xml.rels' else 'xl/_rels/_rels/workbook.xml.rels.rels' end as rels, case when p_partkey % 4 = 3 then 'xl/workbook.xml' end as source,
        case k when 0 then 'slide1.xml' when 2 then 'x' when 4 then 's' when 5 then 'a#b' end as id_part, case k when 0 then 'p' when 2 then 'cols' when 4 then 'c' when 5 then 'p' end as id_kind, case k when 0 then 3 when 2 then 12 when 4 then 7 when 5 then 2 end as id_number,
        part || case when p_partkey % 2 = 0 then ':paragraph-' || p_partkey else '' end || case when p_partkey % 3 = 0 then ':table 1' else '' end as location from p""",
}


# ---- rules ----

PAR = "kind = 'paragraph'"
HAS, RTL = has(AR), f"({has(AR)} and {count(AR)} > {count(LA)})"


def finding(where: str, severity: str, offender: str = "''", source: str = "null", fixable: str = "false") -> str:
    return f"select ord, '{severity}' as severity, {offender} as offenders, {source} as inherited_from, {fixable} as fixable from units where {where}"


def source(name: str) -> str:
    return f"case when {name}_state = 'inherited' then 'styles {name}' end"


NAMES = f"list_aggregate(list_sort(list_distinct(list_transform({HITS}, lambda i: {mapping(u.CONTROL_NAMES)}[substr(text, i, 1)]))), 'string_agg', '|')"
EFFECTIVE = {n: EFF.format(n) for n in un.PROPERTIES}
RULES = {
    "bidi-control": with_units(finding(f"{PAR} and {has(u.CONTROL)}", "error", NAMES, fixable="true")),
    "presentation-forms": with_units(finding(f"{PAR} and {has(u.PRESENTATION_FORM)}", "error", offenders(u.PRESENTATION_FORM, "|"), fixable="true") + " union all " + finding(f"{PAR} and {has(u.WORD_LIGATURE)}", "warning", offenders(u.WORD_LIGATURE, "|"))),
    "tatweel-padding": with_units("select ord, 'warning' as severity, string_agg('U+0640 ARABIC TATWEEL ×' || n || ' @' || off, '|' order by off) as offenders, null as inherited_from, true as fixable from judged where verdict in ('stretched', 'wedged') and ord in (select ord from units where kind = 'paragraph') group by ord", RUNS),
    "alignment-incoherent": with_units(finding(f"{PAR} and {RTL} and alignment_state = 'explicit' and alignment_value = 'left'", "warning", fixable="true")),
    "inset-physical": with_units(finding(f"{PAR} and {RTL} and {EFFECTIVE['inset']} = 'left'", "warning", source=source("inset"))),
    "alignment-unset": with_units(finding(f"{PAR} and {RTL} and alignment_state <> 'explicit' and coalesce({EFFECTIVE['alignment']}, 'left') = 'left'", "note", source=source("alignment"))),
    "container-direction": with_units(finding(f"not {PAR} and {HAS} and {EFFECTIVE['direction']} is distinct from {DOM} and (direction_state = 'explicit' or {DOM} = 'rtl')", "warning", source=source("direction"), fixable="true")),
    "order-reversed": with_units(finding(f"not {PAR} and {RTL} and reversed is not null", "warning", source="'page.html ' || reversed")),
    "language-missing": with_units(finding(f"{PAR} and {HAS} and not coalesce(lower({EFFECTIVE['language']}) = 'ar' or lower({EFFECTIVE['language']}) like 'ar-%', false)", "warning", fixable="true")),
    "complex-font-missing": with_units(finding(f"{PAR} and {HAS} and latin_font_state <> 'unset' and complex_font_state = 'unset'", "warning")),
    "literal-bullet": with_units(finding(f"{PAR} and bullet <> 'native' and {has(u.LEADING_MARKER)}", "warning", fixable="true")),
}
for _n, _id in enumerate(q.FONTLESS, start=1):
    if _id in RULES:
        SQL[f"r{_n:02d}_{_id.replace('-', '_')}"] = RULES[_id]


def _all_rules(ids) -> str:
    parts = [f"select '{i}' as rule, {list(rules.REGISTRY).index(i)} as rule_ord, s.* from ({RULES[i]}) s" for i in ids]
    return " union all ".join(parts)


_FOUND = _all_rules(q.NATIVE)
SQL["x01_audit_native"] = f"select rule, severity, count(*) as findings from ({_FOUND}) group by rule, severity"
SQL["a01_report"] = f"""with f as (select ord, count(*) filter (where severity = 'error') as e, count(*) filter (where severity = 'warning') as w, count(*) filter (where severity = 'note') as n from ({_FOUND}) group by ord), {_UNITS}
    select u.doc_id, 1::bigint as units_scanned, ({HAS})::int::bigint as arabic_units, ({HAS} and {has(u.LTR_OR_DIGIT)})::int::bigint as mixed_units, coalesce(e, 0)::bigint as errors, coalesce(w, 0)::bigint as warnings, coalesce(n, 0)::bigint as notes, coalesce(e, 0) > 0 or coalesce(w, 0) > 0 as blocking from units u left join f on f.ord = u.ord"""
SQL["a02_rollup"] = f"select format, rule, severity, count(*) as findings from (select 'table' as format, * from ({_all_rules(['bidi-control', 'presentation-forms', 'tatweel-padding'])})) group by rollup(format, rule, severity)"
SQL["a04_coverage"] = with_units(f"select ord as unit_id, c as char, min(off) as first_offset, count(*) as occurrences from chars where {mapping(u.NAMES)}[c] is not null and not {has(u.char_class(map(chr, u.FORMAT_CHARS)), 'c')} and not contains('{q.COVERED}', c) group by ord, c", CHARS)
SQL["a07_08_control_names"] = with_units(f"select {mapping(u.CONTROL_NAMES)}[c] as name, count(*) as hits from chars where {has(u.CONTROL, 'c')} group by 1", CHARS)
SQL["a09_container_text"] = "select conv_id, sha256(string_agg(text, chr(10) order by turn)) as text_sha256 from conversations group by conv_id"
SQL["a10_ordered_distinct"] = "select user_id, string_agg(event_type, ',' order by f) as types from (select user_id, event_type, min(event_id) as f from events group by 1, 2) group by user_id"
SQL["a11_role_of_part"] = "select l_orderkey % 50 as doc_id, l_partkey as part, min(l_linenumber % 9) as role_rank from lineitem group by 1, 2"
SQL["a12_cascade_argmax"] = "select element, property, value from (select l_orderkey % 997 as element, l_linenumber % 3 as property, l_partkey::varchar as value, row_number() over (partition by l_orderkey % 997, l_linenumber % 3 order by (l_quantity > 45) desc, l_suppkey % 3 desc, l_partkey % 2 desc, l_partkey % 5 desc, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey desc) as n from lineitem) where n = 1"
SQL["a13_family_winner"] = "select folded, path from (select lower(trim(p_brand)) as folded, p_partkey::varchar as path, row_number() over (partition by lower(trim(p_brand)) order by p_size % 2, p_size % 7, p_partkey) as n from part) where n = 1"
SQL["a15_derived_formats"] = "select doc_id, base, alignment, reading_order, (10 + dense_rank() over (partition by doc_id order by f) - 1)::int as new_index from (select l_orderkey % 20 as doc_id, l_partkey % 4 as base, l_returnflag as alignment, l_linestatus as reading_order, min(l_orderkey * 8 + l_linenumber) as f from lineitem group by 1, 2, 3, 4)"
SQL["a16_unread_list"] = "select (user_id % 40)::varchar as doc_id, string_agg(distinct event_type, ',' order by event_type) as unread from events group by 1"
SQL["j01_shared_strings"] = "select l_orderkey % 10 as doc_id, l_orderkey * 8 + l_linenumber as cell, p_name as text from lineitem join part on p_partkey + 50 = l_partkey and p_partkey % 10 = l_orderkey % 10"
SQL["j02_cell_formats"] = """with xf as (select id % 10 as doc_id, id // 10 as s, (id // 10) % 3 as style, case when id % 4 <> 0 then id % 5 end as font, case when id % 3 = 0 then 'right' end as h, case when id % 7 = 0 then '2' end as r, id % 6 <> 0 as af, id % 9 <> 0 as aa from range(120) t(id)),
    st as (select id % 10 as doc_id, id // 10 as style, id % 5 as font, case when id % 2 = 0 and id % 5 <> 0 then 'center' end as h, case when id % 5 <> 0 then '1' end as r from range(30) t(id)), fo as (select id % 10 as doc_id, id // 10 as font, 'Font ' || id as name from range(40) t(id)),
    c as (select l_orderkey % 10 as doc_id, l_orderkey * 8 + l_linenumber as cell, l_partkey % 12 as s from lineitem)
    select c.doc_id, cell, coalesce(case when aa then xf.h end, st.h) as horizontal, coalesce(case when aa then xf.r end, st.r) as reading_order, fo.name as font_name, case when aa and xf.h is not null then 'explicit' when st.h is not null then 'inherited' else 'unset' end as alignment_state
    from c left join xf on xf.doc_id = c.doc_id and xf.s = c.s left join st on st.doc_id = c.doc_id and st.style = xf.style left join fo on fo.doc_id = c.doc_id and fo.font = coalesce(case when af then xf.font end, st.font)"""
SQL["j03_sheet_parts"] = "select o_orderkey % 100 as doc_id, 'rId' || (o_custkey % 7) as rel_id, o_orderkey as name, 'xl/sheet' || (o_orderkey % 100 + 100 * (o_custkey % 7)) as part from orders where o_custkey % 7 < 5 and (o_orderkey % 100 + 100 * (o_custkey % 7)) % 11 <> 0"
SQL["j04_axis_group"] = "select o_custkey % 90 as ax_id, o_orderkey as axis, g.c_name as group_name from orders join (select c_custkey % 80 as ax_id, arg_min(c_name, c_custkey) as c_name from customer group by 1) g on g.ax_id = o_custkey % 90"
SQL["j05_installed_family"] = "select doc_id, b as path from documents left join (select min(p_brand) as b from part group by lower(trim(p_brand))) on lower(b) = 'brand#' || (doc_id % 60)"
SQL["j06_placeholder_match"] = "select o_orderkey as shape, id as placeholder from orders left join range(120) t(id) on id % 30 = o_orderkey % 30 and id // 30 = o_custkey % 4 and (id % 3 = 0) = (o_custkey % 2 = 0)"
_PARENT = "parent as (select c_custkey as child, case when c_custkey % 50 = 7 then c_custkey + 3 when c_custkey > 4 then c_custkey // 3 end as parent from customer), up(child, ancestor, hop, seen) as (select distinct child, child, 0, [child] from parent union all select u.child, e.parent, u.hop + 1, list_append(u.seen, e.parent) from up u join parent e on e.child = u.ancestor where u.hop < 64 and not list_contains(u.seen, e.parent) and e.parent is not null)"
SQL["j07_08_ancestors"] = f"with recursive {_PARENT} select child, ancestor, hop from up"
SQL["j09_nearest_stated"] = f"with recursive {_PARENT} select child, arg_min(d, hop) filter (where d is not null) as direction, arg_min(f, hop) filter (where f is not null) as font from (select u.*, case when c_custkey % 3 = 0 then c_mktsegment end as d, case when c_custkey % 5 = 0 then c_name end as f from up u left join customer on c_custkey = ancestor) group by child"
SQL["j10_theme_typeface"] = "select p_partkey as run, nullif(face, '') as typeface from part left join (select id % 5 as d, case when (id // 5) % 2 = 0 then 'major' else 'minor' end as font, case when id // 10 = 0 then 'cs' else 'latin' end as script, case when id % 4 = 0 then '' else 'Face' || id end as face from range(20) t(id)) th on th.d = p_size % 5 and th.font = case when p_partkey % 2 = 0 then 'major' else 'minor' end and th.script = case when p_partkey % 3 = 0 then 'cs' else 'latin' end"
SQL["j11_repair_locations"] = "select o_orderkey as repair, coalesce(c_name, o_custkey::varchar) as place from orders left join customer on c_custkey + 25 = o_custkey and c_custkey % 9 = o_orderkey % 9"
SQL["j12_unknown_parts"] = "select distinct l_orderkey % 10 as doc_id, l_partkey as part from lineitem where not exists (select 1 from part where p_partkey + 30 = l_partkey and p_partkey % 10 = l_orderkey % 10)"
_PLAN = f"(select doc_id::varchar as doc_id, {un._case('doc_id % 4', ['pptx', 'docx', 'xlsx', 'html'])} as format, {un._case('cast(floor(doc_id / 4) as bigint) % 8', q.KINDS)} as kind from documents)"
_ABLE = "(values " + ", ".join(f"('{f}', '{k}')" for f, ks in repair.SUPPORTED.items() for k in ks) + ")"
SQL["j13_supported_semi"] = f"select doc_id, kind from {_PLAN} where (format, kind) in {_ABLE}"
SQL["j13_unsupported_anti"] = f"select doc_id, kind from {_PLAN} where (format, kind) not in {_ABLE}"
SQL["j14_before_after"] = """with b as (select user_id % 100 as doc_id, event_type as rule, count(*) as n from events group by 1, 2), e as (select user_id % 100 + 40 as doc_id, event_type || case when event_id % 5 = 0 then '!' else '' end as rule, count(*) as n from events group by 1, 2)
    select coalesce(b.doc_id, e.doc_id) as doc_id, 'u' as unit_id, coalesce(b.rule, e.rule) as rule, coalesce(b.n, 0) as before, coalesce(e.n, 0) as after, case when e.n is null then 'fixed' when b.n is null then 'new' else 'kept' end as change from b full join e on e.doc_id = b.doc_id and e.rule = b.rule"""
SQL["j15_span_containment"] = "select l_suppkey as k, l_orderkey * 8 + l_linenumber as hit, l_orderkey % 500 as pos from lineitem join supplier on s_suppkey = l_suppkey where l_orderkey % 500 >= s_nationkey * 11 and l_orderkey % 500 < s_nationkey * 11 + 40"
SQL["j18_newest_entry"] = "select user_id as object, min(event_id) as section, arg_min(event_type, event_id) as event_type from events group by user_id"
_RANK = "case severity when 'error' then 2 when 'warning' then 1 else 0 end"
SQL["o1_report_order"] = f"select {_RANK}::int as severity_rank, rule, ord, case when rule = 'presentation-forms' and severity = 'warning' then 1 else 0 end as hit_ord from ({_all_rules(['bidi-control', 'presentation-forms', 'tatweel-padding', 'language-missing'])})"
SQL["o4_deletions"] = with_units(f"select u.ord, coalesce(string_agg(c, '' order by i) filter (where not {has(u.CONTROL, 'c')} and not exists (select 1 from judged j where j.ord = ch.ord and j.verdict in ('stretched', 'wedged') and ch.off >= j.off and ch.off < j.off + 2 * j.n)), '') as text from units u left join chars ch on ch.ord = u.ord group by u.ord", RUNS)
SQL["p04_grids"] = "select l_orderkey % 3000 as doc_id, 'sheet1' as part, count(distinct l_partkey % 4 = 0) as text_columns from lineitem where l_partkey % 6 <> 0 group by 1 having count(distinct l_partkey % 4 = 0) >= 2"
SQL["s02_format_dispatch"] = f"select page_id, {un._case('page_id % 6', ['pptx', 'docx', 'xlsx', 'html', 'html'])} as format from pages"
SQL["u01_union_of_rules"] = f"select ord, rule from ({_all_rules(['bidi-control', 'tatweel-padding'])})"
SQL["u03_missing_parts"] = "select c_custkey as k from customer where c_custkey not in (select o_custkey from orders)"
SQL["w1_tatweel_runs"] = with_units("select ord, off as offset, n as length, verdict from judged", RUNS)
SQL["w2_joining_forms"] = with_units("select ord, off as offset, c as ch, form from named", FORMS)
SQL["w3_arabic_runs"] = with_units("select ord, off as offset, run from runs", STRETCH)
SQL["w4_ordinals"] = "select conv_id, turn, row_number() over (partition by conv_id order by turn)::int as ordinal from conversations"
SQL["w5_cell_cursor"] = "select l_suppkey as tbl, l_linenumber as line, l_orderkey * 8 + l_linenumber as k, dense_rank() over (partition by l_suppkey order by l_linenumber)::int as row_no, row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey * 8 + l_linenumber)::int as cell_no from lineitem"
SQL["w7_carried"] = "select user_id, event_id, last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as stated from events"
_OFFS = f"(exists (select 1 from judged j where j.ord = ch.ord and j.verdict in ('stretched', 'wedged') and ch.off >= j.off and ch.off < j.off + 2 * j.n))"
SQL["x04_apply_text"] = with_units(
    f"""select ord, case when kind = 'paragraph' and bullet <> 'native' and {has(u.LEADING_MARKER, 'old')} then regexp_replace(t, '{u.LEADING_MARKER}[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]*', '') else t end as text from (
    select u.ord, u.kind, u.bullet, u.text as old, case when u.kind = 'paragraph' then coalesce(string_agg(coalesce({mapping(u.PRESENTATION)}[c], c), '' order by i) filter (where not {has(u.CONTROL, 'c')} and not {_OFFS}), '') else u.text end as t from units u left join chars ch on ch.ord = u.ord group by u.ord, u.kind, u.bullet, u.text)""",
    RUNS,
)
SQL["k04_rules_listing"] = "select * from (values " + ", ".join(f"({k}, {lit(r.id)}, {lit(r.description)})" for k, r in enumerate(rules.REGISTRY.values())) + ") t(rule_ord, rule, description)"

# ---- files made from rows ----

_SQUEEZE = r"trim(regexp_replace(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'))"
_DIRECTION = "case when direction_state = 'explicit' then 'explicit' else 'unset' end as state, case when direction_state = 'explicit' then direction_value end as direction"
SQL["s05_pptx_units"] = with_units(f"select ord, 'paragraph' as kind, text, {_DIRECTION} from units")
SQL["s07_docx_units"] = SQL["s05_pptx_units"]
SQL["s08_xlsx_units"] = with_units(f"select ord, 'paragraph' as kind, text, 'unset' as state, null as direction from units union all select ord, 'paragraph', 'b', 'unset', null from units union all select ord, 'table', text || chr(10) || 'b', {_DIRECTION} from units")
SQL["s13_html_units"] = with_units(f"select ord, 'paragraph' as kind, {_SQUEEZE} as text, {_DIRECTION} from units")
SQL["s16_unread_sheets"] = "select page_id::varchar as doc_id, case page_id % 4 when 0 then 'https://cdn.test/a.css' when 1 then '/root.css' else 'gone.css' end as name from pages where page_id % 4 <> 2"
SQL["s19_pdf_pages"] = with_units("select ord, text || '|second' as content from units")
SQL["x06_docx_rewrite"] = with_units(f"select ord, 'paragraph' as kind, {STRIP} as text, {_DIRECTION} from units")
_COVERED = f"contains('{q.COVERED}', c)"
_FONT = "complex_font_state <> 'unset'"
SQL["r16_17_font_rules"] = with_units(
    f"""select ord, 'font-coverage' as rule, case when m = n then 'error' else 'warning' end as severity, m::int as offenders from (select c.ord, count(distinct c) as n, count(distinct c) filter (where not {_COVERED}) as m from chars c join units u on u.ord = c.ord where kind = 'paragraph' and {HAS.replace('text', 'u.text')} and {_FONT}
    and {mapping(u.NAMES)}[c] is not null and not {has(u.char_class(map(chr, u.FORMAT_CHARS)), 'c')} group by c.ord) where m > 0
    union all select ord, 'font-shaping', '', 0 from units where false
    union all select ord, 'shaping-broken', 'error', d::int from (select n.ord, count(*) as k, count(distinct c) as d, count(*) filter (where contains('{q.COVERED[:3]}', c)) as made from named n join units u on u.ord = n.ord where kind = 'paragraph' and {_FONT} and form <> 'isolated' and {_COVERED} group by n.ord) where k >= 4 and made = 0""",
    FORMS,
)
SQL["a06_shaping_counts"] = with_units(f"select u.ord, count(*) filter (where form <> 'isolated')::int as required, count(*) filter (where form <> 'isolated' and {_COVERED})::int as observable, count(*) filter (where form <> 'isolated' and contains('{q.COVERED[:3]}', c))::int as produced from units u left join named n on n.ord = u.ord where {_FONT} group by u.ord", FORMS)
SQL["st1_tumbling_counts"] = "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as events from events group by 1, 2"
