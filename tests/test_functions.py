import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkset.functions import answers as an
from sparkset.functions import cast, shapes
from sparkset.functions import conversations as cv
from sparkset.functions import features as ft
from sparkset.functions import preference as pf


def values(spark, given, make, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_answers(spark):
    given = ["so #### 42", "#### 1,234", "#### 1234.56", "#### $50", "none", None, "a #### 1 b #### 7"]
    assert values(spark, given, an.numerical_answer) == [42.0, 1234.0, 1234.56, 50.0, None, None, 7.0]
    assert values(spark, ["<<a>><<b>>", "", None], an.count_steps) == [3, 1, 1]
    assert values(spark, [r"is \boxed{42}", r"\boxed{x^{2} + 1} \boxed{3}", "no", r"\boxed{ }"], an.boxed_answer) == ["42", "x^{2} + 1", None, ""]
    assert values(spark, [r"\boxed{1} #### 2 ", r"\boxed{1}", "x", None], an.final_answer) == ["2", "1", None, None]
    assert values(spark, ['def f():\n  """Adds.  \n', "x", None], an.code_description) == ['"""Adds.', "", ""]
    assert values(spark, ["A", "D", "2", "zz", None], an.choice_index) == [0, 3, 2, 0, 0]
    assert values(spark, ["x" * 99, "x" * 299, "x" * 300, None], an.code_difficulty) == ["easy", "medium", "hard", "medium"]


def test_conversations(spark):
    assert values(spark, ["human", "gpt", "system", "tool", None], cv.role) == ["user", "assistant", "system", "tool", None]
    text = ["Human: Hi\n\nAssistant: Hello!", "\n\nHuman: a\nb\n\nAssistant: c\n\nHuman: d", "no marks", None]
    got = values(spark, text, cv.from_text)
    assert [[tuple(m) for m in c] if c else c for c in got] == [[("user", "Hi"), ("assistant", "Hello!")], [("user", "a\nb"), ("assistant", "c"), ("user", "d")], None, None]
    assert values(spark, text[:2], lambda x: cv.user_prompt(cv.from_text(x))) == ["Hi", "a\nb\n\nd"]
    kind = "array<struct<from:string,value:string>>"
    talks = [[("human", "q"), ("gpt", "a"), ("human", "r")], [], [("human", None)], None]
    made = values(spark, talks, lambda x: cv.from_messages(x, "from", "value"), kind)
    assert made[0][1] == Row(role="assistant", content="a") and made[1] == [] and made[2] is None and made[3] is None
    assert values(spark, talks[:2], lambda x: cv.turn_count(cv.from_messages(x, "from", "value")), kind) == [1, 0]


def test_preferences(spark):
    assert values(spark, ["A", " b ", "TIE", "chosen", "model_b", "x", None], pf.label_score) == [1.0, 0.0, 0.5, 1.0, 0.0, None, None]
    assert values(spark, [-1, 0, 2, None], pf.label_of_sign, "int") == ["a", None, "b", "b"]
    df = spark.createDataFrame([("p", [("m1", "r1", 3), ("m2", "r2", 9), ("m3", "r3", 3)]), ("q", [("m", "r", 1)])], "p string, r array<struct<model:string,response:string,score:int>>")
    got = [r[0] for r in df.select(pf.from_ranked(F.col("p"), F.col("r"))).collect()]
    assert (got[0]["response_a"], got[0]["response_b"]) == ("r2", "r3") and got[1] is None


def test_casts(spark):
    to = lambda f, kind="string", strict=False: (lambda x: cast.cast_column_expr(x, x_kind(kind), f, strict))
    x_kind = lambda k: spark.createDataFrame([], f"x {k}").schema["x"].dataType
    assert values(spark, [" 1 ", "1.7", "+3", "-12", "300", None], to(ft.int8)) == [None, None, 3, -12, None, None]
    assert values(spark, ["NaN", "1e3", "2", ".5"], to(ft.float64)) == [None, 1000.0, 2.0, None]
    assert values(spark, ["TRUE", "true", "false", "1"], to(ft.boolean)) == [None, True, False, None]
    assert values(spark, [1.9, -1.9, 3e9, float("nan")], to(ft.int32, "double"), "double") == [1, -1, None, None]
    assert values(spark, [0, 1, 2], to(ft.boolean, "int"), "int") == [False, True, None]
    assert values(spark, ["a", None], to(ft.string, strict=True)) == ["a", ""]
    assert values(spark, ["a", "z", None], to(ft.ClassLabel(names=["a", "b"]))) == [0, None, None]
    assert [int(x) for x in values(spark, [0, 2**63 - 1], to(ft.uint64, "long"), "long")] == [0, 2**63 - 1]


def test_validation(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], ("x", "y"), (["en"], ["a"])), (300, [[1.0]], ("x", None), (["en", "de"], ["a"]))], "i int, m array<array<double>>, t struct<en:string,de:string>, v struct<languages:array<string>,translation:array<string>>")
    wrong = cast.validate(df, {"i": ft.int8, "m": ft.Array((2, 3)), "t": ft.Translation(("en", "de")), "v": ft.TranslationVariableLanguages(), "gone": ft.string})
    assert wrong == {"i": 1, "m": 1, "v": 1, "gone": 2}
    assert cast.validate(df, {"t": ft.Translation(("en", "fr"))}) == {"t": 2}


def test_features():
    assert ft.Features.infer({"a": 1, "b": 1.5, "c": True, "d": None, "e": [], "f": [1], "g": {"h": "x"}}) == {"a": ft.int64, "b": ft.float64, "c": ft.boolean, "d": ft.string, "e": ft.Sequence(ft.string), "f": ft.Sequence(ft.int64), "g": ft.Struct({"h": ft.string})}
    for f in (ft.ClassLabel(num_classes=2), ft.Array((2, 2)), ft.Sequence(ft.int8, 3), ft.Struct({"a": ft.Image.rgb()}), ft.Translation(("a", "b")), ft.Audio.speech()):
        assert ft.from_json(f.to_json()) == f
    label = ft.ClassLabel(names=["n", "p"])
    assert (label.int2str(1), label.int2str(-1), label.int2str(5), label.str2int("p"), label.str2int("q")) == ("p", "p", None, 1, None)
    assert ft.ClassLabel(num_classes=2).names == ["class_0", "class_1"]
    with pytest.raises(ValueError):
        ft.Array((2,))
    with pytest.raises(ValueError):
        ft.Value("int128")
    assert ft.Array((1, 2)).to_numpy([[1, 2]]).shape == (1, 2)


def rows_of(spark, data, schema, shape, *args):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"pos long, {schema}")
    return [r.asDict(recursive=True) for r in shape(df, *args).orderBy("pos").collect()]


def test_shapes(spark):
    r = rows_of(spark, [("q", ["a", "b"], "B", "art"), ("r", None, "x", "law")], "question string, choices array<string>, answer string, subject string", shapes.multiple_choice, "test", ["art", "law"])
    assert [x["id"] for x in r] == ["mmlu_art_test_0", "mmlu_law_test_1"] and r[0]["expected"] == 1 and r[1]["input"]["choices"] == []
    r = rows_of(spark, [("p", r"\boxed{5}", "1", "algebra")], "problem string, solution string, level string, type string", shapes.competition_math, "math_500")
    assert r[0]["id"] == "math500_0" and r[0]["expected"] == "5" and r[0]["metadata"]["type"] == "algebra"
    r = rows_of(spark, [([("human", "q"), ("gpt", "<think> a")],)], "conversations array<struct<from:string,value:string>>", shapes.reasoning)
    assert r[0]["input"]["prompt"] == "q" and r[0]["metadata"]["has_reasoning"]
    r = rows_of(spark, [("\n\nHuman: x\n\nAssistant: y", "\n\nHuman: x\n\nAssistant: z"), ("bad", "bad")], "chosen string, rejected string", shapes.preferences, "hh_rlhf")
    assert len(r) == 1 and r[0]["input"]["comparison"]["prompt"] == "x" and r[0]["expected"]["preferred"] == "a"
    r = rows_of(spark, [("model_b", [("user", [("text", "hi"), ("image", None)])], []), ("tie", [], [])], "winner string, conversation_a array<struct<role:string,content:array<struct<type:string,text:string>>>>, conversation_b array<struct<role:string,content:array<struct<type:string,text:string>>>>", shapes.preferences, "arena_140k")
    assert [x["id"] for x in r] == ["arena_0"] and r[0]["input"]["comparison"]["prompt"] == "hi" and r[0]["expected"]["preferred"] == "b"
    r = rows_of(spark, [("i", "c", "ref", "bad", None)], "instruction string, criteria string, reference_answer string, score1_description string, score2_description string", shapes.rubrics)
    assert r[0]["expected"]["rubric"] == {1: "bad"} and r[0]["metadata"]["has_rubric"]
    r = rows_of(spark, [([("user", "a"), ("assistant", "b")], "s"), ([("user", None)], "s"), (None, None)], "messages array<struct<role:string,content:string>>, source string", shapes.chats)
    assert [x["id"] for x in r] == ["chat_0", "chat_2"] and r[0]["metadata"]["turn_count"] == 1
    r = rows_of(spark, [(bytearray(b"x"), 3)], "image binary, label int", shapes.images, "caltech101")
    assert r[0]["input"]["image"]["bytes"] == b"x" and r[0]["id"] == "caltech101_0"
    r = rows_of(spark, [("p", "s")], "prompt string, code string", shapes.code_tasks)
    assert r[0]["input"] == {"problem": "p", "language": "python"} and r[0]["expected"] == "s"
