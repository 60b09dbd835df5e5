import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cairnflow.plans.catalog import CritiqueStub
from cairnflow.plans.phases import evaluate, phase1, phase2
from cairnflow.plans.provider import Replay, Stub, generate, provider_factory, replay
from cairnflow.plans.search import Settings, binary_reward, search, search_trees, usable_actions
from cairnflow.sources import readers, writers
from cairnflow.streaming.resume import verified_stream


def seeds(spark, n=12):
    return spark.createDataFrame([(i, f"Find {i}", str(i % 3), None if i % 4 else "gsm") for i in range(n)], "problem_id long, problem string, ground_truth string, source string")


def test_search_invariants():
    for rollouts, depth in ((1, 16), (8, 16), (25, 2)):
        for tree in search([f"p{i}" for i in range(10)], ["1"] * 10, Stub(), binary_reward, Settings(num_rollouts=rollouts, max_depth=depth)):
            assert tree.visits[0] == rollouts and tree.value[0] <= rollouts
            assert max(tree.depth) <= depth and any(tree.terminal)
            for node, children in enumerate(tree.children):
                assert sum(tree.visits[c] for c in children) <= tree.visits[node]
                assert len({tree.action[c] for c in children}) == len(children) <= 3
                assert not (tree.terminal[node] and children)
            assert sum(tree.terminal) <= rollouts or depth == 2


def test_search_without_candidates():
    tree = search(["p"], ["1"], Replay({}), binary_reward, Settings(num_rollouts=3))[0]
    assert tree.visits == [3] and tree.terminal == [True] and tree.reward == [0.0]
    assert usable_actions([" a\nb", "a", "", "c "], 256) == ["a", "c"]


def test_phases_are_deterministic(spark):
    first = phase1(seeds(spark), Stub, Settings(num_rollouts=8), 4)
    again = phase1(seeds(spark).repartition(5), Stub, Settings(num_rollouts=8), 4)
    assert first.count() and sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))
    assert {r["source"] for r in first.collect()} <= {"gsm", "unknown"}
    assert max(Counter(r["problem"] for r in first.collect()).values()) <= 4
    solved = phase2(first, CritiqueStub).collect()
    assert solved and all(r["answer"] and r["solution"] for r in solved)
    assert evaluate(seeds(spark), Stub).where("correct").count() + evaluate(seeds(spark), Stub).where("not correct").count() == 12


def test_nodes_are_a_table(spark):
    rows = search_trees(seeds(spark, 5), Stub, Settings(num_rollouts=6)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["problem_id"]].append(r)
    assert len(by) == 5 and all(sum(n["parent_id"] is None for n in nodes) == 1 for nodes in by.values())


def test_provider_errors_and_replay(spark):
    class Broken(Stub):  # local, so that it travels by value
        def __call__(self, prompts, n=1, max_tokens=1):
            raise RuntimeError("down")

    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = generate(df, Broken).collect()
    assert [(r["response"], r["response_error"]) for r in got] == [("", "RuntimeError: down")] * 2
    recorded = df.limit(1).select(F.sha2("prompt", 256).alias("prompt_sha"), F.lit(0).alias("sample"), F.lit("hi").alias("text"))
    assert sorted(r["response"] for r in replay(df, recorded).collect()) == ["", "hi"]
    with pytest.raises(ValueError):
        provider_factory("none")


def test_one_bad_prompt_spoils_no_other(spark):
    class Picky(Stub):
        def __call__(self, prompts, n=1, max_tokens=1):
            if "b" in prompts:
                raise RuntimeError("refused")
            return [[p.upper()] for p in prompts]

    got = generate(spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string").coalesce(1), Picky).collect()
    assert [(r["response"], r["response_error"]) for r in got] == [("A", None), ("", "RuntimeError: refused"), ("C", None)]


def test_chat_roles(spark):
    class Roles(Stub):
        def chat(self, conversations, n=1, max_tokens=1):
            return [["|".join(f"{m['role']}={m['content']}" for m in c)] for c in conversations]

    df = spark.createDataFrame([("u", "s"), (None, None)], "prompt string, sys string")
    assert [r["response"] for r in generate(df, Roles, system="sys").collect()] == ["system=s|user=u", "system=|user="]


def test_http_backend():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            status = 503 if len(seen) == 1 else 400 if body["messages"][-1]["content"] == "bad" else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"] + "!"}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = provider_factory("http", url=f"http://127.0.0.1:{server.server_port}/chat", model="m", pause=0.01)()
        assert provider(["a", "b"], n=2, max_tokens=7) == [["a!", "a!"], ["b!", "b!"]]
        assert len(seen) == 5 and seen[0]["max_tokens"] == 7 and seen[0]["model"] == "m"
        assert provider.chat([[{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]]) == [["u!"]]
        with pytest.raises(Exception, match="400"):
            provider(["bad"])
    finally:
        server.shutdown()


def test_tokenized_rows(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from cairnflow.operators.tokenize import chat_template, plain_template, sft_rows

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [("p", "a short solution"), ("q " * 30, "long " * 50), ("r", None), ("", "")]
    df = spark.createDataFrame(rows, "problem string, solution string")
    for template, shown in ((plain_template, ("{}\n", "{}\n{}")), (chat_template, ("User: {}\nAssistant:", "User: {}\nAssistant: {}"))):
        got = [(r["input_ids"], r["attention_mask"], r["labels"]) for r in sft_rows(df, path, 9, 40, template).collect()]
        want = []
        for p, s in rows:
            user = f"{p}\nPlease reason step by step, and put your final answer within \\boxed{{}}."
            ask, full = (library.encode(t.format(user, s or ""), add_special_tokens=False).ids for t in shown)
            ids = full[:39] + [9]
            n = min(len(ask[:40]), len(ids))
            want.append((ids, [1] * len(ids), [-100] * n + ids[n:]))
        assert got == want


def test_plugins(spark):
    from cairnflow.plans.plugins import Plugins

    own = Plugins(extract=lambda text: F.lit("7"), verify=lambda a, b: F.coalesce(a == "7", F.lit(False)), analysis=lambda p, a, b: F.struct(F.lit("S").alias("system"), F.concat(F.lit("Trajectory B "), p).alias("user")))
    found = phase1(seeds(spark), Stub, Settings(num_rollouts=8), 4, plugins=own)
    assert {r["positive_answer"] for r in found.collect()} == {"7"}
    assert {r["answer"] for r in phase2(found, CritiqueStub, plugins=own).collect()} == {"7"}


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "pairs.jsonl").write_text('{"problem": "p"}\n{broken\n')
    with pytest.raises(Exception, match=r"(?i)malformed"):
        readers.read_pairs(spark, str(tmp_path)).collect()


def test_sources_round_trip(spark, tmp_path):
    lines = ['{"problem": "p", "solution": "s"}', "", "{bad", '{"problem": "q"}', '{"problem": null, "solution": "t", "more": 1}', "{'problem': 1, 'solution': 2}"]
    (tmp_path / "sft.jsonl").write_text("\n".join(lines))
    assert sorted(map(tuple, readers.read_sft(spark, str(tmp_path / "sft.jsonl")).collect()), key=repr) == [("p", "s"), (None, "t")]
    pairs = phase1(seeds(spark), Stub, Settings(num_rollouts=8), 4)
    for part in ("a", "b"):
        folder = tmp_path / "pairs" / part
        folder.mkdir(parents=True)
        (folder / "pairs.jsonl").write_text("".join(json.dumps(r.asDict(recursive=True)) + "\n" for r in pairs.collect()))
    (tmp_path / "pairs" / "top.jsonl").write_text("not read")
    assert readers.read_pairs(spark, str(tmp_path / "pairs")).count() == 2 * pairs.count()
    details = spark.createDataFrame([("m", False, "gsm", True), ("m", False, "gsm", False), ("m", False, "math", True)], "model string, few_shot boolean, bench string, correct boolean")
    writers.write_details(details, str(tmp_path / "details"))
    writers.write_summary(details, str(tmp_path / "summary"))
    summary = spark.read.json(str(tmp_path / "summary")).first()
    assert summary["benchmarks"]["gsm"]["accuracy"] == 50.0 and summary["benchmarks"]["math"]["total"] == 1
    paths = spark.createDataFrame([("p", ["a", "b"])], "problem string, steps array<string>")
    writers.write_dataset(paths, 3, str(tmp_path / "set"), F.col("problem"))
    assert [r["solution"] for r in spark.read.json(str(tmp_path / "set")).collect()] == ["Step 1: a\nStep 2: b"] * 3
    gsm = spark.createDataFrame([("q", "work\n#### 1,234 ")], "question string, answer string")
    assert readers.union_sources({"g": readers.gsm_problems(gsm)}).first()["ground_truth"] == "1234"


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("BASE", "there")
    (tmp_path / "c.json").write_text('{"mcts": {"num_rollouts": 3}, "url": "${BASE}"}')
    config = readers.read_config(str(tmp_path / "c.json"))
    assert config["mcts"]["num_rollouts"] == 3 and config["mcts"]["c_puct"] == 1.4 and config["url"] == "there"


def test_stream_processes_files_once(spark, tmp_path):
    pairs = phase1(seeds(spark), Stub, Settings(num_rollouts=8), 4)
    pairs.write.json(str(tmp_path / "in"))
    run = lambda: verified_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), CritiqueStub).awaitTermination()
    run()
    n = spark.read.json(str(tmp_path / "out")).count()
    assert n == phase2(pairs, CritiqueStub).count() > 0
    run()
    assert spark.read.json(str(tmp_path / "out")).count() == n


def test_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_phase2_until_target(spark, tmp_path):
    from cairnflow.plans.phases import phase2_until

    pairs = phase1(seeds(spark), Stub, Settings(num_rollouts=8), 4)
    every = phase2(pairs, CritiqueStub).count()
    got = phase2_until(pairs, CritiqueStub, 3, [F.col("problem"), F.col("contrast_type"), F.to_json("negative_steps")], 5, str(tmp_path / "out"))
    assert got == 3 < every and spark.read.json(str(tmp_path / "out")).count() == 3
    got = phase2_until(pairs, CritiqueStub, 10**6, [F.col("problem")], 7, str(tmp_path / "all"))
    assert got == every  # ties in the order: still each pair once


ODD_STEPS = [
    "* a bullet", "*** Step", "a\nStep 4: b", "a\n**step 12.** b", "ſtep 3: long s", "\x0bvertical\x0b", "\x0b", "   ", "", None, "a\n*", "﷐ ﷐0 ﷐3﷐", "Stepf\n  Step\n5: x", "plain",
]


def test_parse_steps_equals_its_sql_on_text_like_marks(spark, tmp_path):
    import duckdb

    rows = [(i, t, s, "en") for i, (t, s) in enumerate((t, s) for t in ODD_STEPS for s in ("src1", "*s", "Step 2: s", "\x0b", None))]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["steps"] for r in __spark_entry__.queries()["parse_steps"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert found == dict(con.execute(__spark_entry__.oracle_sql()["parse_steps"]).fetchall())
