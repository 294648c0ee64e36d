"""Row shapes of the tables that cross an operator or file boundary."""

USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,"
    "cost:double,currency:string>"
)
MESSAGE = "struct<role:string,content:string,name:string>"
REFERENCE = (
    "struct<answers:array<string>,label:string,answer:string,"
    "test_code:string,entry_point:string>"
)

MIXED_ROW = (
    "id string, source_dataset string, question string, context string, gold_answer string, "
    "gold_label string, unit_tests string, skill_tags array<string>, "
    "hallucination_subset boolean, split string, original_id string, metadata string"
)

CASE = (
    "example_id string, dataset_name string, question string, context string, "
    f"options array<string>, reference {REFERENCE}, answerable boolean"
)

PREDICTION = (
    "run_id string, dataset_name string, model string, example_id string, status string, "
    "prompt_version string, response_text string, latency_ms double, request_id string, "
    f"finish_reason string, provider string, usage {USAGE}, error_type string, "
    "error_message string, completed_at timestamp, row_ordinal bigint"
)

SCORE = (
    "suite_id string, dataset_name string, model string, example_id string, status string, "
    "prediction_status string, metrics map<string,double>, metric_name string, "
    "extracted_answer string, error_type string, error_message string"
)

# Log lines of either dialect; usage stays a map because a present-but-null key matters.
POLICY_LOG = (
    "policy string, query_id string, example_id string, dataset string, dataset_name string, "
    "model string, status string, failed boolean, usage map<string,string>, "
    "wall_latency_ms double, latency_ms double, latencyms double, metrics map<string,double>, "
    "primary_metric double, task_tag string, tasktype string, task_type string, "
    "predicted_tag string, routedrole string, routed_role string, routed_correctly boolean, "
    "gold_answers array<string>, reference struct<answers:array<string>,answer:string>, "
    "final_answer string, response_text string, responsetext string, row_ordinal bigint"
)

CALL = (
    "event_id string, started_at string, completed_at string, target string, "
    "resolved_alias string, model string, provider string, provider_mode string, "
    f"response_text string, usage {USAGE}, request_id string, finish_reason string, "
    "latency_ms double, error_type string, error_message string"
)

CHAT_RESPONSE = (
    "struct<id:string,model:string,choices:array<struct<message:struct<role:string,"
    "content:string>,finish_reason:string>>,usage:struct<prompt_tokens:bigint,"
    "completion_tokens:bigint,total_tokens:bigint>>"
)

ROLE_DEFAULTS = (
    "role string, model string, temperature double, max_tokens int, system_prompt string, "
    "user_prompt string, context string, stop_sequences array<string>, "
    "metadata map<string,string>, provider_params map<string,string>"
)

COUNCIL_CALL = (
    "example_id string, dataset_name string, phase string, role string, model string, "
    "status string, text string, latency_ms double, input_tokens bigint, output_tokens bigint, "
    "total_tokens bigint, error_type string, error_message string, row_ordinal bigint"
)
