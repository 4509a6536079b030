"""Sources, sinks, resuming, answers, validation, prompts, inference."""

import json

import pytest
from pyspark.sql import functions as F

from convoeval.functions import answers as A
from convoeval.operators import incremental as I
from convoeval.operators import inference as INF
from convoeval.operators import joins as J
from convoeval.operators import ledger as L
from convoeval.operators import normalise as N
from convoeval.operators import prompts as P
from convoeval.operators import reports as REP
from convoeval.operators import routing
from convoeval.operators import validation as V
from convoeval.sources import readers as R
from convoeval.sources import writers as W


def dump(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_session_dialogues(spark, tmp_path):
    item = {
        "sample_id": "s1", "session_summary": {"a": "x", "b": "y"},
        "qa": [{"question": "When?", "answer": 2022, "category": 2, "evidence": ["D1:3", "D10:1"]},
               {"question": "Who?", "adversarial_answer": "Bob", "category": 5, "evidence": []}],
        "conversation": {
            "speaker_a": "Ann", "speaker_b": "Bo", "session_10": [{"speaker": "Bo", "text": "late"}],
            "session_10_date_time": "d10", "session_2_date_time": "d2",
            "session_2": [{"speaker": "Ann", "text": "hi", "blip_caption": "a cat"}, {"speaker": "Bo", "text": "yo"}],
        },
    }
    turns, questions = R.read_session_dialogues(spark, dump(tmp_path / "d.json", [item]))
    rows = turns.orderBy("session", "turn").collect()
    assert [(r["session"], r["date"], r["text"], r["caption"]) for r in rows] == [
        (2, "d2", "hi", "a cat"), (2, "d2", "yo", None), (10, "d10", "late", None)]
    line = N.speaker_line("quoted", F.col("speaker"), F.col("text"), F.col("turn"), F.col("caption"))
    head = N.session_head(F.col("speaker_a"), F.col("speaker_b"), F.col("date"))
    chunk = N.render_sessions(turns, ["sample_id", "session"], "turn", line, head).orderBy("session").first()["text"]
    assert chunk == (
        "Below is a conversation between Ann and Bo.\n\nDATE: d2\nCONVERSATION:\n"
        'Ann said, "hi" and shared a cat\nBo said, "yo"\n\n\n'
    )
    q = questions.withColumn("last", N.evidence_session(F.col("evidence"), F.col("n_sessions")))
    q = N.rewrite_by_category(q).orderBy("ord").collect()
    assert [r["last"] for r in q] == [10, 2] and q[0]["answer"] == "2022"
    assert q[1]["answer"] in ("a", "b") and "Bob" in q[1]["query"]


def test_haystack_and_persona(spark, tmp_path):
    hay = {"question_id": "q1", "question_type": "t", "question": "What?", "answer": 5, "question_date": "d",
           "haystack_sessions": [[{"role": "user", "content": "a"}], [], [{"role": "assistant", "content": "b"}]],
           "haystack_dates": ["d1"]}
    turns, q = R.read_haystack_dialogues(spark, dump(tmp_path / "h.json", [hay]))
    assert [(r["session"], r["date"], r["text"]) for r in turns.orderBy("session").collect()] == [(0, "d1", "a"), (2, "Unknown", "b")]
    assert tuple(q.first()) == ("q1", "[d] What?", "5", 1, "t")
    persona = {"metadata": {"initial_data_id": "m1"}, "self_instruct": {"A": "yes", "B": "Do you?"},
               "previous_dialogs": [{"dialog": [{"text": "x"}, {"text": "x"}]}], "dialog": [{"id": "Speaker 2", "text": "z"}]}
    turns, q = R.read_persona_dialogues(spark, dump(tmp_path / "p.json", [persona]))
    assert [(r["session"], r["speaker"]) for r in turns.orderBy("session", "turn").collect()] == [
        (0, "Speaker 1"), (0, "Speaker 2"), (1, "Speaker 2")]
    assert (q.first()["query"], q.first()["position"]) == ("Do you?", 1)


def test_json_tree_and_qa_files(spark, tmp_path):
    dump(tmp_path / "tree/cases/kind_a/1/b.json", [{"x": 1}, {"x": 2}])
    rows = R.read_json_tree(spark, str(tmp_path / "tree"), "x int", "cases").collect()
    assert {(r["x"], r["category"], r["file_name"]) for r in rows} == {(1, "kind_a", "b"), (2, "kind_a", "b")}
    base = tmp_path / "qa"
    dump(base / "set1/question/Who Is_questions.json", [{"id": 1, "question": "a?"}, {"id": 2, "question": "b?"}])
    dump(base / "set1/answer/Who Is_answers.json", [{"id": 1, "answer": [{"event": "e"}, {"text": "f"}]}])
    dump(base / "set2/question/Where_question.json", [{"id": "z", "question": "c?"}])
    dump(base / "set2/answer/Where_answer.json", [{"id": "z", "answer": "here"}])
    questions, answers = R.read_qa_files(spark, str(base))
    got = J.match_answers(questions, answers, ["corpus", "type", "id"]).withColumn("answer", N.flatten_answer(F.col("answer")))
    assert {(r["corpus"], r["type"], r["answer"]) for r in got.collect()} == {
        ("set1", "Who Is", "1. e\n2. f"), ("set2", "Where", "here")}


def test_file_names_are_cut_without_a_search(spark, tmp_path, capsys):
    base = tmp_path / "qa"
    for place in ("set 1/question/a_question_questions.json", "question/question/b+c_question.json", "set2/question/d_questions.json/part-0_question.json"):
        dump(base / place, [{"id": place[0], "question": "a?"}])
        dump(base / place.replace("/question/", "/answer/").replace("question.json", "answer.json").replace("questions.json", "answers.json"), [{"id": place[0], "answer": "b"}])
    questions, answers = R.read_qa_files(spark, str(base))
    tree = R.read_json_tree(spark, str(base), "id string", "qa")
    assert {(r["type"], r["id"]) for r in questions.collect()} == {("a_question", "s"), ("b c", "q"), ("d", "s")}
    assert {r["corpus"] for r in questions.collect()} == {"set%201", "question", "set2"}
    assert questions.join(answers, ["corpus", "type", "id"]).count() == 3
    assert {"part-0_question", "part-0_answer"} <= {r["file_name"] for r in tree.collect()}
    capsys.readouterr()
    questions.explain()
    assert "regexp" not in capsys.readouterr().out


def test_results_tree(spark, tmp_path):
    good = {"qid": "q1", "response": "x", "metric": {"f1_score": 0.5, "llm_score": -1}}
    dump(tmp_path / "task1/evaluated_my_agent_2024.jsonl", json.dumps(good) + "\n")
    dump(tmp_path / "task1/evaluated_7.jsonl", json.dumps(good) + "\n")
    dump(tmp_path / "task1/responses_a.jsonl", '{"qid": "q1", "response": "ok"}\n{broken\n{"qid": "q2", "response": "ERROR x"}\n')
    e = R.read_evaluations(spark, str(tmp_path))
    assert {(r["task"], r["agent"]) for r in e.collect()} == {("task1", "my_agent"), ("task1", "7")}
    assert R.long_metrics(e).count() == 4
    assert [r["missing"] for r in I.audit_completeness(e, ["f1_score", "llm_score"]).collect()] == [["llm_score"]] * 2
    responses = R.read_responses(spark, str(tmp_path / "task1/responses_a.jsonl"))
    assert sorted(r["qid"] for r in responses.collect()) == ["q1", "q2"]
    assert [r["qid"] for r in I.completed(responses, ["qid"]).collect()] == ["q1"]
    assert [tuple(r) for r in R.discover_outputs(spark, str(tmp_path)).collect()] == [("task1", "a")]
    ignore = R.read_ignore_list(spark, dump(tmp_path / "ignore", "# no\n\n 7 \n"))
    assert [r["agent"] for r in J.drop_ignored(e, ignore, "agent").collect()] == ["my_agent"]


def test_canonical_round_trip(spark, tmp_path):
    sample = {"task_id": "t", "chunks": ["a", "b"], "questions": [{"qid": "q", "query": "x", "answer": "y", "position": 1}]}
    df = R.read_canonical(spark, dump(tmp_path / "small_valsets/s.json", [sample]).replace("small_valsets/", ""), small=True)
    path = str(tmp_path / "out")
    W.write_canonical(df, path)
    W.write_canonical(df.limit(0), path)
    chunks, questions = R.to_long(R.read_canonical(spark, path))
    assert chunks.count() == 2 and questions.first()["position"] == 1
    with pytest.raises(ValueError):
        R.read_samples(spark, path, "nothing", column="task_id")


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "a"), ("q2", "b")], "qid string, response string")
    path = str(tmp_path / "r")
    W.append_results(rows, path)
    W.append_results(rows, path, R.read_responses(spark, path))
    assert R.read_responses(spark, path).count() == 2


def test_visible_tail_is_the_end_of_the_joined_text(spark):
    texts = ["", "abc", "x" * 40, "defg", "", "hi"]
    chunks = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "task_id string, position long, text string")
    asked = spark.createDataFrame([(f"q{p}", "t", p) for p in range(8)], "qid string, task_id string, position long")
    for budget in (1, 3, 7, 25, 500):
        got = {r["qid"]: r["context"] for r in J.visible_tail(asked, chunks, budget, marker="<", bucket_rows=2).collect()}
        for p in range(8):
            joined = "\n\n".join(texts[: p + 1])
            assert got[f"q{p}"] == (joined if len(joined) <= budget else "<" + joined[-budget:])


def test_answers(spark):
    df = spark.createDataFrame(
        [("x \\boxed{a{b}c} y",), ("\\boxed{\\text{k}}",), ("\\boxed 5$ z",), ("\\box{q} \\boxed{open",), ("none",), ("\\boxed{}e",)],
        "t string",
    ).select(A.extract_boxed(F.col("t")).alias("a"))
    assert [r["a"] for r in df.collect()] == ["a{b}c", "k", "5", "q", "none", "\\boxed{}e"]
    v = spark.createDataFrame([("Yes",), ("yes, I know",), ("No",)], "t string").select(A.parse_verdict(F.col("t")).alias("v"))
    assert [r["v"] for r in v.collect()] == [1.0, 0.0, 0.0]


def test_unmentioned(spark):
    chunks = spark.createDataFrame([("t", "paid 12.50 and 7 at the Shop"), ("u", "x99y")], "task_id string, text string")
    tx = spark.createDataFrame(
        [("t", 0, "food", 12.5), ("t", 1, "shop", 800.0), ("t", 2, "food", 31.0), ("t", 3, "food", 7.9), ("u", 4, "a", 99.2)],
        "task_id string, ord int, scene string, amount double",
    )
    assert [r["ord"] for r in V.unmentioned(tx, chunks).collect()] == [2]


def test_ledger_ties(spark):
    tx = spark.createDataFrame(
        [("2024-01-01", "A", 10.0), ("2024-01-02", "B", 10.0), ("2024-01-02", "C", 5.0)], "date string, scene string, amount double"
    ).withColumn("date", F.to_date("date"))
    q = spark.sql("select 1 as qid, date'2024-01-01' as start, date'2024-01-03' as end")
    assert L.top_scenes(q, L.daily(tx)).first()["answer"] == "A, B"


def test_means(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 0.0), ("m", -1.0)], "metric string, value double")
    assert REP.mean_valid(df, []).first()["avg_value"] == 0.5
    assert REP.strict_mean(df, []).first()["avg_value"] == -1.0


def test_batch_infer_turns_failures_into_text(spark):
    def shout(client, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string").coalesce(1)
    got = [r["response"] for r in INF.batch_infer(df, shout, "t").collect()]
    assert got == ["A", "ERROR_API_CALL: no", "C"]


def test_a_model_call_gets_a_bounded_text(spark):
    df = spark.range(8, numPartitions=1).select("id", F.when(F.col("id") != 3, F.repeat(F.lit("x"), 1_500_000)).alias("t"), F.array("id").alias("own"))
    got = INF.batch_infer(df, lambda client, texts: [str(len(texts))] * len(texts), "t").drop("t").collect()
    assert sorted((r["id"], r["own"]) for r in got) == [(i, [i]) for i in range(8)]
    assert max(int(r["response"]) for r in got) <= 3


def test_fold_keeps_order_and_failed_chunks(spark):
    def step(memory, chunk):
        if chunk == "x":
            raise RuntimeError("no")
        return memory + chunk

    df = spark.createDataFrame([("k", 2, "x"), ("k", 0, "a"), ("k", 1, "b"), ("j", 0, "x")], "k string, i int, text string")
    got = {r["k"]: r["memory"] for r in INF.fold_summary(df, step, ["k"], "i").collect()}
    assert got["k"] == "No previous memoryab\n\n[Memory update failed due to API error] x"
    assert got["j"] == "[Memory update failed due to API error] x"


def test_adaptive_branches(spark):
    chunks = [("icl", i, f"\nLabel: {i}\nword{i}") for i in range(12)] + [("short", i, f"s{i}") for i in range(5)]
    chunks += [("long", i, f"talk w{i} " + "z" * 6000) for i in range(10)]
    c = spark.createDataFrame(chunks, "task_id string, position long, text string")
    types = routing.task_types(c)
    assert {r["task_id"]: r["task_type"] for r in types.collect()} == {"icl": "icl", "short": "short", "long": "long"}
    q = spark.createDataFrame([("a", "icl", "word3"), ("b", "short", "s"), ("c", "long", "[d] w4")], "qid string, task_id string, query string")
    got = routing.adaptive_retrieve(q, c, types, top_k=3).collect()
    assert sum(r["qid"] == "a" for r in got) == 12 and sum(r["qid"] == "b" for r in got) == 5
    assert [r["position"] for r in got if r["qid"] == "c" and r["rank"] == 1] == [4]


def test_route_split_cuts_each_text_once(spark, capsys):
    texts = ["\n" * 2500, "ab\n" * 1000, None, "x" * 2500 + "\n\ny", "s", ""]
    c = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)] + [("u", 0, "ab\n" * 1000)], "task_id string, position long, text string")
    types = spark.createDataFrame([("t", "long"), ("u", "short")], "task_id string, task_type string")
    routed = routing.route_split(c, types)
    got = {(r["task_id"], r["position"], r["piece_no"]): r["piece"] for r in routed.collect()}
    assert [k for k in sorted(got) if k[:2] == ("t", 0)] == [] and got["t", 2, 0] is None and got["t", 5, 0] == "" and got["t", 4, 0] == "s"
    assert [got["t", 1, i] for i in range(4)] == [("ab\n" * 333)[:-1]] * 3 + ["ab\n"]
    assert [got["t", 3, i] for i in range(2)] == ["x" * 2500, "y"] and got["u", 0, 0] == "ab\n" * 1000
    assert len(got) == 10
    capsys.readouterr()
    routed.explain()
    plan = capsys.readouterr().out
    assert "regexp_extract_all" not in plan and "BroadcastHashJoin" in plan


def test_adaptive_ranking_shuffles_no_postings(spark, monkeypatch):
    def built(*_, **__):
        raise AssertionError("an index of postings was built")

    monkeypatch.setattr("convoeval.operators.retrieval.in_blocks", built)
    c = spark.createDataFrame([("icl", i, f"\nLabel: {i}\nword{i} is") for i in range(12)], "task_id string, position long, text string")
    q = spark.createDataFrame([("a", "icl", "word3")], "qid string, task_id string, query string")
    got = routing.adaptive_retrieve(q, c, routing.task_types(c), top_k=3, icl_all=5).collect()
    assert sorted((r["rank"], r["position"]) for r in got) == [(1, 3), (2, 0), (3, 1), (4, 2), (5, 4)]


def test_unknown_task_is_an_error(spark):
    tasks = spark.createDataFrame([("a_5",), ("zzz",)], "task string")
    catalog = spark.createDataFrame([("a", "src", "p", True)], "task string, data_source string, prefix string, hint boolean")
    resolved = N.source_catalog(tasks, catalog)
    assert resolved.where("task = 'a_5'").first()["parameter"] == "5"
    with pytest.raises(Exception, match="unknown task: zzz"):
        N.require_known(resolved).collect()


def test_abstention_rules(spark):
    q = spark.createDataFrame([("p_x_abs_0", "c"), ("p_x_abs", "c"), ("p_1", "k")], "qid string, category string")
    known = spark.createDataFrame([("k",)], "category string")
    inner = {r["qid"]: r["template"] for r in P.choose_template(q, known).collect()}
    suffix = {r["qid"]: r["template"] for r in P.choose_template(q, known, "suffix").collect()}
    assert inner == {"p_x_abs_0": "abstention", "p_x_abs": "default", "p_1": "k"}
    assert suffix["p_x_abs"] == "abstention" and suffix["p_x_abs_0"] == "default"


def test_made_questions_are_answered_right(spark):
    import random
    import re

    rng = random.Random(2)
    data = [("t", f"2024-01-{rng.randint(1, 9):02d}", rng.choice(["food", "rent", "fun"]), rng.randint(100, 9999) / 100) for _ in range(80)]
    tx = spark.createDataFrame(data, "task_id string, date string, scene string, amount double").withColumn("date", F.to_date("date"))
    made = L.make_questions(tx, ["food", "rent", "fun", "none"], per_type=6, seed=1).collect()
    assert len({r["query"] for r in made}) == len(made) and len({r["category"] for r in made}) == 8
    for r in made:
        days = re.findall(r"\d{4}-\d\d-\d\d", r["query"])
        scenes = [s for s in ("food", "rent", "fun", "none") if s in r["query"]]
        inside = [d for d in data if len(days) < 2 or days[0] <= d[1] <= days[1]]
        if r["category"] == "single_date_scene_amount":
            inside = [d for d in data if d[1] == days[0]]
        if scenes:
            inside = [d for d in inside if d[2] in scenes]
        total = f"{sum(d[3] for d in inside):.2f}"
        if r["category"] == "max_scene":
            sums = {}
            for d in inside:
                sums[d[2]] = round(sums.get(d[2], 0) + d[3], 2)
            total = ", ".join(sorted(s for s, v in sums.items() if v == max(sums.values())))
        elif r["category"] == "max_frequency_date":
            n = {}
            for d in inside:
                n[d[1]] = n.get(d[1], 0) + 1
            total = ", ".join(sorted(k for k, v in n.items() if v == max(n.values())))
        elif r["category"] == "max_single_amount":
            total = f"{max(d[3] for d in inside):.2f}"
        assert r["answer"] == total, r


def test_profile_report_repeats_the_parts(spark):
    from convoeval.operators import profiling as PRO

    rows = [("c", i, t, p, "x" * i) for i, (t, p) in enumerate(
        [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:10:00", "b"), (None, "a"), ("2024-01-01 00:05:00", "a"), ("bad", "")])]
    df = spark.createDataFrame(rows, "corpus string, ord long, timestamp string, location string, action string")
    got = {(r["section"], r["item"]): r["value"] for r in PRO.profile_report(df, "corpus", "ord", ["action"]).collect()}
    assert got[("span", "n_records")] == "5" and got[("span", "n_places")] == "2"
    assert (got[("gaps", "n_gaps")], got[("gaps", "mean")], got[("gaps", "min")]) == ("2", "2.5", "-5.0")
    assert got[("gap_buckets", "<=1m")] == "1" and got[("gap_buckets", "5-30m")] == "1"
    assert got[("lengths", "action")] == "2.5" and got[("places", "a")] == "3" and got[("times", "hour_0")] == "3"
