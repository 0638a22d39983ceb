"""Explicit schemas of the files the engine reads (missing fields read as null)."""

LOCATION = "struct<unit:string,start:int,end:int>"
FINDING = f"struct<id:string,claim:string,location:{LOCATION},severity:string,evidence:string,raw:string>"
TRAJECTORY = (
    "trajectory struct<run_id:string,artifact_id:string,config_id:string,model_id:string,seed:bigint,"
    f"rounds:array<struct<round_index:int,findings:array<{FINDING}>>>>, "
    "transcripts array<array<string>>, reviewer_calls int, extractor_calls int, prompt_version string"
)
SCORED_RUN = (
    "struct<run_id:string,artifact_id:string,config_id:string,model_id:string,artifact_type:string,n_rounds:int,set_sizes:array<int>,"
    "churn:array<double>,mean_churn:double,late_churn:double,false_fraction:array<double>,terminal_false_fraction:double,"
    "true_attrition_events:int,oscillation_degree:int,stabilized_round:int,converged:boolean,terminal_precision:double,"
    "terminal_recall:double,n_defects:int,regime:string,round_elements:array<array<string>>>"
)
SCORED = f"n_runs bigint, n_files bigint, n_skipped bigint, skipped_files array<string>, runs array<{SCORED_RUN}>"
META = (
    "id string, type string, artifact_file string, title string, recipe_version string, "
    "source struct<origin:string,license:string,url:string,source_ref:string,retrieved:string,attribution:string,notes:string>, "
    "construction struct<proposer:string,transformations:array<string>>, "
    "clean_regions array<struct<unit:string,start:int,end:int,note:string>>, "
    f"known_gray_zone array<struct<location:{LOCATION},note:string>>, defect_count int"
)
DEFECT = f"struct<id:string,category:string,severity:string,description:string,location:{LOCATION},anchor:string,paraphrases:array<string>,confirmed:boolean,rationale:string>"
DEFECTS = f"artifact_id string, defects array<{DEFECT}>"
GOLD = "pair_id string, a_text string, b_text string, label boolean, source string, a_unit string, a_start int, a_end int, b_unit string, b_start int, b_end int"
COLLECTED = f"key string, text_a string, loc_a {LOCATION}, text_b string, loc_b {LOCATION}"
CACHE = "verdicts map<string,boolean>"
