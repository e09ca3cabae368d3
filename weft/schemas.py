"""Row types of the engine's entities, as Spark DDL."""

TOOL_USE = "struct<tool_id:string,tool_name:string,input_args:map<string,string>>"
TOOL_RESULT = "struct<tool_id:string,tool_name:string,output:string,status:string,error_message:string>"
BLOCK = f"struct<block_type:string,text:string,thinking:string,tool_use:{TOOL_USE},tool_result:{TOOL_RESULT}>"

MESSAGES = f"session_id string, pos int, role string, text string, blocks array<{BLOCK}>, name string, message_type string, message_id string, turn_index int, approved boolean, metadata map<string,string>, ts timestamp"
TASKS = "plan_id string, pos int, task_id string, description string, required_skill string, assigned_agent string, input_data map<string,string>, dependencies array<string>, status string, result string, error string"
POLICIES = "ord int, subject string, action string, resource string, effect string, description string"
CALLS = "call_id string, session_id string, subject string, tool_name string, args map<string,string>, risk_level string, ts timestamp, result string, error string"
TOKENS = "id string, session_id string, tool_name string, resource string, created_at timestamp, expires_at timestamp, approved boolean, denied boolean"
AUDIT = "ts timestamp, call_sequence bigint, subject string, session_id string, tool_name string, action string, resource string, risk_level string, parameters map<string,string>, status string, result_summary string, error_message string, escalated boolean, escalation_approved boolean, escalation_reason string"
PREFERENCES = "category string, pos int, content string, confidence double, created_at timestamp, updated_at timestamp, stale boolean"
TOPICS = "slug string, pos int, title string, keywords array<string>, summary string, created_at string, updated_at string, last_accessed_at string, entry_count int, embedding array<float>"
ENTRIES = "slug string, pos int, title string, task string, approach string, lessons string, user_feedback string, user_adjustment string, date string"
SKILLS = "name string, type string, description string, summary string, body string, max_iterations int, tools array<struct<name:string,description:string,parameters:array<struct<name:string,type:string,description:string,required:boolean>>>>"
SESSIONS = "session_id string, status string, last_active_at timestamp, checkpoint_created_at timestamp"
EVENTS = "session_id string, seq bigint, type string, event string, payload string, ts timestamp"
ENVELOPE = "type string, event string, payload map<string,string>, id string, version string, timestamp string"
DOCUMENT = f"session_id string, status string, turn_count int, messages array<struct<role:string,content:string,blocks:array<{BLOCK}>,name:string,message_type:string,message_id:string,metadata:map<string,string>>>, checkpoint string"
