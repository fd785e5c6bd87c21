"""Schemas of the run archives."""

PROBLEM = "id string, dataset string, problem string, gold_answer string, reference_solution string, subject string, level string"

RETRY = "struct<attempt:int,status:int,type:string,message:string>"
STEP = (
    "struct<step_num:int,model_input_messages:array<struct<role:string,content:string>>,model_input_hash:string,reasoning:string,provider_reasoning:string,"
    "raw_response:string,action_type:string,action_source:string,parse_error:string,code:string,final_answer:string,stdout:string,stderr:string,observation:string,"
    "code_success:boolean,code_blocked:boolean,tool_elapsed_sec:double,request_latency_sec:double,service_latency_sec:double,service_time_all_attempts_sec:double,"
    f"rate_limit_wait_sec:double,retry_wait_sec:double,request_attempts:int,retry_errors:array<{RETRY}>,finish_reason:string,provider_truncated:boolean,"
    "visible_content_chars:int,provider_reasoning_chars:int,input_tokens:bigint,output_tokens:bigint,hidden_reasoning_tokens:bigint,evidence_hash:string,error:string>"
)
TRAJECTORY = (
    "problem_id string, dataset string, subject string, level string, problem_text string, gold_answer string, agent_name string, provider string, model_id string, "
    f"steps array<{STEP}>, final_answer string, finished boolean, stop_reason string, started_at string, elapsed_sec double, timed_out boolean"
)
STEP_DETAIL = (
    "struct<step_num:int,prm_score:double,prm_delta:double,prm_signal:double,critic_signal:double,critic_used:boolean,"
    "critic_record:struct<used:boolean,signal:double,label:string,confidence:double,reason:string,raw:string,error:string,key_slot:string,attempts:int,latency_sec:double>,"
    "tool_gain:double,max_similarity:double,exact_repetition:boolean,semantic_repetition:boolean,algebraic_restatement:boolean,harmful_repeat:double,"
    "useful_verification:boolean,error_flag:double,hybrid_score:double,label:string>"
)
METRIC = (
    "problem_id string, dataset string, subject string, agent string, "
    "C_G_V struct<C_sym:int,C_judge:int,C_final:int,correctness_source:string,judge_used:boolean,"
    "judge_record:struct<decision:int,confidence:double,reason:string,raw:string,error:string,key_slot:string,attempts:int,latency_sec:double>,"
    "needs_judge:boolean,G_level:string,G:int,V:int,grounding_source:string,grounding_evidence_step:int,grounding_candidate:string,grounding_evidence_hash:string,tool_evidence_count:int>, "
    f"Q struct<Q_step:double,signed_quality:double,step_labels:array<string>,step_details:array<{STEP_DETAIL}>,progressive_rate:double,neutral_useful_rate:double,neutral_waste_rate:double,redundant_rate:double,regressive_rate:double>, "
    "T struct<PTU:double,T_api_input:bigint,T_api_output:bigint,T_billable:bigint,T_hidden_reasoning:bigint,T_tool_output:bigint,T_code:bigint,T_visible_reasoning_est:bigint,T_visible_process:bigint,"
    "T_useful:bigint,T_pre_waste:bigint,T_post_waste:bigint,T_answer_reporting:bigint,solution_evidence_step:int,PreWasteRate:double,PostWasteRate:double>, "
    "R struct<R_exact:double,R_semantic_raw:double,R_algebraic_restatement:double,R_useful_verification:double,R_circular:double,R_harmful:double>, "
    "L struct<L_trajectory_sec:double,L_request_total_sec:double,L_provider_service_sec:double,L_rate_limit_wait_sec:double,L_retry_wait_sec:double,request_attempts:bigint,retry_count:bigint,truncated_step_count:bigint,trajectory_timed_out:boolean>, "
    "E_optional double, finished boolean, stop_reason string, total_steps int, elapsed_sec double, final_answer string, gold_answer string, valid_trajectory boolean"
)
EVALUATION = (
    "task_id string, task_type string, agent string, problem_id string, judge_model string, step_index int, prompt_hash string, status string, "
    "parsed struct<correct:boolean,label:string,confidence:double,reason:string>, raw string, key_slot string, lane_id int, attempts int, latency_sec double, response_channel string, error string, completed_at string"
)
PRM_SHEET = "map<string,map<string,struct<by_model:map<string,array<double>>,errors:map<string,string>,ensemble:array<double>>>>"
