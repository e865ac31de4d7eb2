"""Schemas shared by the operators."""

ENTITY = "struct<text:string,start:int,end:int,type:string,score:double,source:string>"
ENTITIES = f"array<{ENTITY}>"
PAIR = "struct<original:string,surrogate:string>"
PAIRS = f"array<{PAIR}>"
BASELINE = "array<struct<value:string,type:string,score:double>>"
TIMINGS = "struct<pattern_scan_ms:double,entity_trace_ms:double,context_guard_ms:double,surrogate_gen_ms:double,llm_call_ms:double,total_ms:double>"
SCORES = "struct<precision:double,recall:double,f1:double>"

#: One row of a batch run; every column may be null.
ANSWER = (
    "idx bigint, question string, pattern_scan_pii array<string>, entity_trace_pii array<string>, context_guard_pii array<string>, "
    "confirmed_pii array<string>, pii_detail map<string,struct<type:string,score:double,source:string,surrogate_status:string,skip_reason:string,fuzzed_to:string>>, "
    "quasi_id_risks array<struct<combination:string,matched_fields:array<string>,risk_level:string,all_fields_matched:boolean,reference:string>>, "
    "surrogate_map map<string,string>, sanitized_input string, llm_response string, final_output string, presidio_sanitized_input string, "
    "recognized_not_replaced array<struct<value:string,type:string,reason:string,fuzzed_to:string>>, "
    "stage_timings_ms struct<pattern_scan_ms:double,entity_trace_ms:double,context_guard_ms:double,surrogate_gen_ms:double,llm_call_ms:double,total_ms:double>, "
    f"presidio_found_piis {BASELINE}, bertscore_ss {SCORES}, bertscore_presidio {SCORES}, error string"
)
