"""The row types of the engine."""

from __future__ import annotations

RESOLVED = "struct<state:string,value:string,origin:struct<part:string,property:string>>"
ORIGIN = "struct<part:string,property:string>"
PROPS = f"struct<direction:{RESOLVED},alignment:{RESOLVED},inset:{RESOLVED},language:{RESOLVED},complex_font:{RESOLVED},latin_font:{RESOLVED},bullet:string,reversed:{ORIGIN}>"
SPANS = f"array<struct<offset:int,len:int,bidi:string,direction:string,origin:{ORIGIN}>>"
LOCATION = "struct<part:string,paragraph:int,container:string>"
#: One row per paragraph or container of a document.
UNITS = f"doc_id string, format string, ord bigint, unit_id string, kind string, text string, props {PROPS}, spans {SPANS}, location {LOCATION}"
UNREAD = "doc_id string, ord bigint, name string"
EVIDENCE = "struct<logical:string,visual_declared:string,visual_expected:string,offenders:array<string>,inherited_from:string>"
FIX = "struct<kind:string,value:string,offsets:array<int>>"
DIAGNOSTIC = f"struct<rule:string,rule_ord:int,hit_ord:int,severity:string,severity_rank:int,message:string,evidence:{EVIDENCE},fixable:boolean,fix:{FIX}>"
KINDS = ("paragraph", "table", "columns", "chart_text")
SEVERITIES = {"note": 0, "warning": 1, "error": 2}
