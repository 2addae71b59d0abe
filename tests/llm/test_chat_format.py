import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import chat_format as C


def records(spark, payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "conv_id long, p string").select("conv_id", F.try_parse_json("p").alias("record"))


def said(spark, payloads):
    out = {}
    for r in C.canonical_turns(records(spark, payloads)).collect():
        out.setdefault(r.conv_id, []).extend([r.turn] if r.turn else [])
    return {k: [(t.role, t.text) for t in sorted(v, key=lambda t: t.order)] for k, v in out.items()}


def test_layouts(spark):
    got = said(spark, [json.dumps(x) for x in [
        {"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": None, "name": "x"}]},
        {"id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "input": "", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"system": None, "prompt": "p", "response": "r"},
        {"question": "q", "answer": "a", "context": "k"},
        {"dialog": {"turns": [{"speaker": "bot", "utterance": "hello"}]}},
        {"messages": []},
        {"messages": None},
        {"conv_id": 70, "turn": 3, "role": None, "text": None},
        {"unknown": 1},
        {"messages": ["text"]},
    ]] + ["not json", None])
    assert got == {
        0: [("user", "q"), ("tool", "")], 1: [("system", "s"), ("user", "q"), ("assistant", "a")],
        2: [("user", "do\n\nthis"), ("assistant", "done")], 3: [("user", "do"), ("assistant", "done")],
        4: [("user", "p"), ("assistant", "c")], 5: [("user", "p"), ("assistant", "r")],
        6: [("user", "k\n\nq"), ("assistant", "a")], 7: [("assistant", "hello")], 8: [], 9: [], 70: [("", "")],
    }


def test_unknown_layouts_are_told(spark):
    got = C.unmapped(records(spark, ['{"a": 1, "b": {"c": [1]}}', '{"b": {"c": [2, 3]}, "a": "x"}', '{"prompt": "p", "completion": "c"}', None])).collect()
    assert sorted((r.records, r.example, r.shape is None) for r in got) == [(1, 3, True), (2, 0, False)]


def test_shapes_are_those_of_records(spark):
    """Whatever a layout declares is what Spark finds in a record of just these fields."""
    def record(paths):
        out = {}
        for p in paths:
            at, names = out, p.split(".")
            for n in names[:-1]:
                key = n.removesuffix("[]")
                at.setdefault(key, [{}] if n.endswith("[]") else {})
                at = at[key][0] if n.endswith("[]") else at[key]
            at[names[-1]] = "x"
        return json.dumps(out)

    for x in C.LAYOUTS:
        got = records(spark, [record(x.fields), record(x.fields + x.optional)]).select(C.layout_of(F.col("record")).alias("name")).collect()
        assert [r.name for r in got] == [x.name, x.name]


def brute(rows):
    """The digests by a loop over the rows."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is None, turn or 0, C.ROLES.get(role, role) or "", text or ""))
    for conv, turns in out.items():
        turns.sort()
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        every = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


CONTROL = ["", "</s>", "[INST]", "[\\INST]", "\\\\", "[", "<", "[/INST]", "[TEXT] ", " [TEXT] ", "<s>", "[[INST]]", "é😀", "[ANS] ", "</s", "\n", "[<INST]", "$1", "\\["]


def test_reads_back(spark):
    texts = [a + b for a in CONTROL for b in CONTROL] + [None, "x" * 300_000, "[INST]" * 20_000]
    roles = ["user", "assistant", "system", None, "User", " [TEXT] ", "tool"]
    rows = [(k % 11 if k % 13 else None, k // 5 if k % 17 else None, roles[k % 7], t) for k, t in enumerate(texts)]
    rows += rows[:30] + [(99, k, "assistant", "same") for k in range(3000)]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn int, role string, text string, record int, piece string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_conversations(table).collect()}
    assert got == brute([*rows, (-7, 0, "user", C.PROBE[1]), (-7, 1, "assistant", C.PROBE[1])])


def test_mask_and_marks(spark):
    table = spark.createDataFrame([(1, 0, "user", "a[INST]"), (1, 1, "assistant", "</s>b")], "conv_id long, turn long, role string, text string")
    row = C.format_turns(C.canonical_turns(C.row_records(table))).collect()[0]
    assert row.formatted == "[INST] a[\\INST] [/INST][ANS] <\\/s>b</s>" and row.turn_starts == [0, 23]
    assert [row.formatted[x.start : x.end] for x in row.loss] == ["<\\/s>b"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("[]<>\\/INSTs x"), max_size=30), min_size=1, max_size=20))
def test_escape_is_undone(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.TEMPLATE.escape(F.col("t")).alias("e"))
    for r in frame.withColumn("u", C.TEMPLATE.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in C.TEMPLATE.controls)


def test_no_python_in_the_plan_and_empty_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    frame = C.format_conversations(empty)
    assert [r.conv_id for r in frame.collect()] == [-7]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
