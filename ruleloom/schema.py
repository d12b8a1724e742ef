"""Controlled vocabularies and record shapes. Fixed values, in natural order."""

AUTHORITIES = ["root", "system", "developer", "user", "guideline"]
MODALITIES = ["must", "should"]
RELATIONS = ["same_sentence", "same_section", "shares_example", "cross_reference", "shares_dimension", "thematic"]
XREF_SUBTYPES = ["defers_to", "carves_exception_from", "tightens", "style_modulates", "background"]
THEMATIC_SUBTYPES = ["reinforces", "conditions", "specializes"]
FACETS = ["surface", "modality", "age", "setting", "state"]
FACET_VALUES = ["applies", "not_applicable", "unconditional_or_unspecified"]
EXCEPTION_KINDS = ["hard_edge", "judgment_delegated"]
VERDICTS = ["GOOD", "OK", "BAD"]
FINDING_FIELDS = ["context_resolution", "rule_ids", "unsat_reason", "witness"]

RULE = "id string, authority string, system_flags array<string>, sections array<string>, text string, trigger string, behavior string, modality string, examples array<string>"
NEIGHBOR = "id string, relation string, subtype string, direction string, source string, via array<string>, evidence struct<where:string,quote:string>, note string"
GROUPED_RULE = f"{RULE}, dimensions array<string>, groups array<string>, neighbor array<struct<{NEIGHBOR}>>"
FRAGMENT = "records array<struct<id:string,trigger:string,behavior:string,modality:string,examples:array<string>>>, fragments array<struct<records:array<struct<id:string,trigger:string,behavior:string,modality:string,examples:array<string>>>>>"
UNIT_FILE = """spec string, source string, authority string, derivation string, config struct<cap:bigint,floor:bigint,subdivide:boolean>,
split_vertices array<string>, nodes array<struct<id:string,rule:string,context:string,section:string>>,
edges array<struct<a:string,b:string,relation:string,subtype:string,context:string>>, bridges array<struct<a:string,b:string,relation:string,subtype:string>>,
components array<struct<cid:string,size:bigint,provenance:string,dominant_dimension:string,members:array<string>>>,
balance_stats struct<rules:bigint,copies:bigint,duplication:double,units:bigint,sizes:array<bigint>,min:bigint,median:bigint,max:bigint,structural_edges_cut:bigint,bridges:bigint>"""
FINDING = "array<struct<rule_ids:array<string>,witness:string,unsat_reason:string,context_resolution:string>>"
RAW_RESULT = "custom_id string, result struct<type:string,message:struct<stop_reason:string,content:array<struct<type:string,text:string>>,usage:map<string,bigint>>>"
