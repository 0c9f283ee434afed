"""Fixed schemas of the engine's tables; readers never infer."""

from __future__ import annotations

TASKS = "task_id string, task_num int, code string, test string, test_list array<string>"
INPUTS = "task_id string, line_no int, literal string"
RESULT_LINES = "mode string, source string, task_id string, line_no int, value string"
COMPARE_LINES = RESULT_LINES + ", is_valid boolean"
RAW_OUTPUTS = "mode string, output_name string, task_id string, raw string"
TRACE_EVENTS = "run_id string, step bigint, func string, frame_id bigint, event string, line_no int, var string, value string"
TRACE_VALUES = "mode string, status string, source string, task_id string, var string, value string"
DELTA_TRACE = "struct<func:string,line:int,changes:map<string,string>>"
BLOCK_TRACE = "struct<block_sequence:array<string>,output_var:string,values:array<string>>"
CFG_BLOCKS = "block_id string, block_type string, line_start int, line_end int, lines array<int>, successors array<string>, source_snippet string"
CFG_JSON = "struct<output_var:string,blocks:map<string,struct<block_id:string,block_type:string,line_start:int,line_end:int,lines:array<int>,successors:array<string>,source_snippet:string>>>"
SPAN_MAP = "path string, iid string, start_line int, start_column int, end_line int, end_column int, file string"
SPAN = "iid:string,variable:string,start_line:int,start_column:int,end_line:int,end_column:int"
ATTEMPT = "struct<attempt:int,ok:boolean,reason:string,diff_indices:array<int>>"
REPAIR_RESULT = f"task_id string, status string, attempts array<{ATTEMPT}>, diff_count int, diff_indices array<int>, old_hash string, new_hash string, deleted_llm_output string"
REPAIR_REPORT = f"started_at string, finished_at string, model_name string, selected_task_count int, discovered struct<failed_or_timeout:array<string>,empty_compare:array<string>,fully_same:array<string>>, results array<struct<{REPAIR_RESULT.replace(' string', ':string').replace(' array', ':array').replace(' int', ':int')}>>"

#: The marker of a line on which a mutant equals the original, and the texts of empty outputs.
INVALID_LINE = "变异前后结果相同，认为该测试用例无效"
ERROR_EMPTY = "ERROR: empty"
ERROR_NO_RESULT = "ERROR: LLM returned no result"
