"""Row types of every stage, as DDL."""

SEED = "problem string, ground_truth string, source string"
NODE = (
    "problem_id long, node_id int, parent_id int, child_ord int, depth int, action string, "
    "visit_count long, total_value double, reward double, is_terminal boolean"
)
TRAJECTORY = (
    "problem_id long, traj_ord int, steps array<string>, is_correct boolean, reward double, "
    "visit_count long, length int, max_q_value double, final_answer string"
)
PAIR = (
    "problem string, ground_truth string, source string, contrast_type string, "
    "positive_steps array<string>, negative_steps array<string>, positive_answer string"
)
CRITIQUE = (
    "divergence_step_index int, local_step_critique map<string,string>, global_strategic_analysis string, "
    "success_pattern string, failure_mode_to_avoid string, parse_path string"
)
VERIFIED = "problem string, solution string, answer string, source string, contrast_type string"
SFT = "problem string, solution string"
EVAL_DETAIL = "problem string, ground_truth string, predicted string, correct boolean, response string"
MESSAGES = "array<struct<role:string,content:string>>"
