import pytest
from pyspark.sql import functions as F

from cairnflow.functions import answers, critique, prompts, segment, symbolic, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


EXTRACT = [
    ("so \\boxed{\\frac{1}{2}}", "\\frac{1}{2}", "\\frac{1}{2}", "\\frac{1}{2}"),
    ("\\boxed{1} then \\boxed{2}", "2", "2", "2"),
    ("Final Answer: 7\nThe answer is 8", "8", "7", "8"),
    ("The answer is 3.5.", "3.5", "3.5", "3"),
    ("The answer is 42. Then 9", "9", "42", "42"),
    ("total 1,234", "234", "1234", "234"),
    ("ratio 5/6", "6", "5/6", "6"),
    ("\\boxed{unclosed 9", "9", "9", "9"),
    ("\\boxed{}", "", "", ""),
    ("", None, None, ""),
    ("**Final Answer:** 42", "42", "** 42", "42"),
    ("\\boxed{ {a}{b{c}} } tail }", "{a}{b{c}}", "{a}{b{c}}", "{a}{b{c}}"),
    (None, None, None, None),
    ("٣ and \\boxed{𝒳}", "𝒳", "𝒳", "𝒳"),
]


@pytest.mark.parametrize("place,f", [(1, answers.extract_reward), (2, answers.extract_pipeline), (3, answers.extract_eval)])
def test_extractors(spark, place, f):
    assert column(spark, [e[0] for e in EXTRACT], f) == [e[place] for e in EXTRACT]


def test_few_shot_truncation(spark):
    values = ["a\nProblem: b 5", "\nProblem: 5", "The answer is 4\n\nProblem: 9"]
    assert column(spark, values, lambda c: answers.extract_eval(c, few_shot=True)) == ["", "5", "4"]
    assert column(spark, values[:1], answers.extract_eval) == ["5"]


def test_normalizers(spark):
    pipeline = {
        "$\\dfrac{1}{2}$": "frac{1}{2}", "1,234,567": "1234567", "1,2,3": "12,3", "(1,2)": "(12)", "(1, 2)": "(1, 2)", "\\left(\\frac{1}{2}\\right)": "(frac{1}{2})",
        "\\text{cm}": "{cm}", "\\textbf{x}": "bf{x}", "a\\quad b": "a b", "$ 5 $": "5", "\\leftarrow": "arrow", "": "", None: "",
    }
    assert column(spark, list(pipeline), answers.normalize_pipeline) == list(pipeline.values())
    evaluated = {
        "1/2": "0.500000", "50%": "50.000000", "1/0": "1/0", "1/2/3": "1/2/3", "\\dfrac{1}{2}": "\\frac{1}{2}", "ABC d": "abcd", "1,000": "1,000", "1_000": "1000.000000", "1d": "1d", " 3. ": "3.000000", ".5": "0.500000",
        "-2e3": "-2000.000000", "\\left[ 1 \\right]": "[1]", None: None,
    }
    assert column(spark, list(evaluated), answers.normalize_eval) == list(evaluated.values())


def test_verify(spark):
    cases = [("1/2", "0.5", True), ("\\frac{1}{2}", "0.5", True), ("2x", "2*x", True), ("x^2", "x**2", True), ("1e-9", "0", True), ("(1,2)", "12", True), ("", "1", False), (None, "1", False), ("x=5", "5", False), ("{cm}", "5", False), ("7", "7", True), ("2(3+4)", "14", True)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(answers.verify(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]
    checked = [("1/2", "0.5", True), ("0.1", "1/10", True), ("2x", "2*x", False), ("", "", False), ("x+1", "1+x", True), ("1e-9", "0", True), ("1e-5", "0", False)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(checked)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(answers.check(F.col("a"), F.col("b"))).collect()] == [c[2] for c in checked]


def test_symbolic_has_no_limit_of_size():
    assert symbolic.equal("x" + "+x" * 249, "250*x") and symbolic.equal("x" + "+x" * 20000, "20001x")
    assert symbolic.equal("(" * 5000 + "1" + ")" * 5000, "1") and symbolic.equal("-" * 300 + "x", "x")
    assert symbolic.equal("x^200*x^1000", "x^1200") and symbolic.equal("10^400", "10^399*10") and not symbolic.equal("x^65", "x^66")
    assert symbolic.equal("9^9^9^9", "9^9^9^9") and not symbolic.equal("9^9^9^9", "1")


def test_symbolic():
    assert not symbolic.equal("__import__('os')", "1")
    assert symbolic.equal("sqrt(8)", "2sqrt(2)") and symbolic.equal("(x+1)^2", "x^2+2x+1") and not symbolic.equal("x", "y")
    same = ["frac{frac{1}{2}}{3} 1/6", "frac{5} 5", "2frac{1}{2} 1", "frac{x+1}{2}*2 x+1", "-x^2 0-x*x", "2^-3 1/8", "2^-3^2 1/512", "1/2x x/2", "sin(x)^2+cos(x)^2 1", "x^-1 1/x", "x^y*x x^(y+1)", "2pi pi+pi", "abs(-3) 3", "sqrt(4) 2"]
    assert all(symbolic.equal(*pair.split()) for pair in same)
    assert not any(symbolic.equal(*pair.split()) for pair in ["pi 3.14159", "1/0 2/0", "a) a", "frac{1 1", "1e-7 0", "x^2 x"])
    assert symbolic.equal("sin x^2", "sin(x^2)") and symbolic.same_raw("x+1", "1+x") and not symbolic.same_raw("2x", "2*x")


def test_segmentation(spark):
    cases = [("a\n\nb\n", 256, ["a", "b"]), (" ", 256, []), ("x $a\nb$ y", 256, ["x $a\nb$ y"]), ("one two. So, three four", 3, ["one two.", "So, three four"]), ("a b c d e", 2, ["a b", "c d", "e"]), ("$ \\(x\\) $", 256, ["$ \x00MATH0\x00 $"]), ("p q r\\\\s t u", 3, ["p q r", "s t u"])]
    for value, limit, want in cases:
        assert segment.segment_steps(value, limit) == want
        assert column(spark, [value], lambda c, n=limit: segment.segment(c, n)) == [want]
    assert segment.segment_steps(None) == []


def test_segment_paths_agree(spark):
    values = ["plain\nlines here", "  spaced \n\n out ", "tab\tand nbsp\n x", "w " * 700, "So, $x$\ny", None, "a\rb\x1cc"]
    assert column(spark, values, segment.segment) == [None if v is None else segment.segment_steps(v) for v in values]


def test_steps(spark):
    values = ["pre\nStep 1: a\n**Step 2:** b\nFinal Answer: \\boxed{3}", "no markers", "", "STEP 1. x\n  step 12 : y"]
    assert column(spark, values, text.parse_steps) == [["a", "b\nFinal Answer: \\boxed{3}"], ["no markers"], [], ["x", "y"]]
    assert column(spark, [["a", "b"], []], text.format_steps, "array<string>") == [" a b", " "]
    assert column(spark, [["a", "b\nc"]], segment.format_trajectory, "array<string>") == ["Step 1: a\nStep 2: b\nStep 3: c"]
    assert column(spark, [[" a", "b", "a ", "", "b"]], text.ordered_distinct, "array<string>") == [["a", "b"]]


def test_critiques(spark):
    assert critique.parse('```json\n{"divergence_step_index": 2, "global_strategic_analysis": "g"}\n```')["divergence_step_index"] == 2
    assert critique.parse('{"divergence_step_index": "x"}') is None
    assert critique.parse('{"divergence_step_index": 1, "global_strategic_analysis": "a\nb"')["global_strategic_analysis"] == "a\nb"
    assert critique.parse('{"success_pattern": "s" "x"}')["parse_path"] == "fields"
    assert critique.parse("text") is critique.parse("[1]") is critique.parse("") is critique.parse(None) is None
    assert critique.parse('{"divergence_step_index": 0, "global_strategic_analysis": "\\frac \\alpha",}')["global_strategic_analysis"] == "\x0crac \\alpha"
    assert critique.parse('{"divergence_step_index": 0, "global_strategic_analysis": "\\frac",}', strict_latex=True)["global_strategic_analysis"] == "\\frac"
    odd = '{"success_pattern": "a \\"b\\" c", "global_strategic_analysis": "g\tx\\alpha\ny", "trajectory_a_logic": "{[1, ]}", ,}'
    assert critique.repair(odd) == '{"success_pattern": "a \\"b\\" c", "global_strategic_analysis": "g\\tx\\\\alpha\\ny", "trajectory_a_logic": "{[1]}", }'
    assert critique.repair('{"a": {"b": "x') == '{"a": {"b": "x}}' and critique.repair("[1, ]") == "[1]"
    found = critique.single_fields('"divergence_step_index": "no" "divergence_step_index": 4, "global_strategic_analysis": "abc, "success_pattern": "s", "success_pattern": "t"')
    assert found["divergence_step_index"] == 4 and found["success_pattern"] == "s" and found["global_strategic_analysis"] == "abc, "
    got = column(spark, ['{"divergence_step_index": -3, "global_strategic_analysis": "g", "local_step_critique": [1]}', "x"], critique.parse_critique)
    assert got[0]["divergence_step_index"] == 0 and got[0]["local_step_critique"] == {} and got[1] is None


def test_prompts(spark):
    df = spark.createDataFrame([("P {steps}", ["a"], [("system", "s"), ("tool", "t"), ("user", "u")])], "p string, s array<string>, m array<struct<role:string,content:string>>")
    row = df.select(prompts.simulation_prompt(F.col("p"), F.col("s"), [("q", "r")]).alias("sim"), prompts.chat_text(F.col("m")).alias("chat"), prompts.library_prompt(prompts.LIBRARY_EXPANSION, "S", F.col("p"), F.array().cast("array<string>")).alias("lib")).first()
    assert row["sim"] == "Problem: q\nSolution: r\n\nProblem: P {steps}\nSolution: a"
    assert row["chat"] == "System: s\nUser: u\nAssistant:"
    assert prompts.NO_STEPS in row["lib"] and row["lib"].startswith("S\n\n")
