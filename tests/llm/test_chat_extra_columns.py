"""Extra columns named like a layout's paths, and conversations without turns."""

from trackgeo.llm import chat


def test_extra_columns_do_not_hide_the_layout(spark):
    df = spark.createDataFrame(
        [(1, [("user", "hi"), ("assistant", "yo")], "a note", None), (2, None, "said", "ask"), (3, None, None, None), (4, [], None, None)],
        "id int, messages array<struct<role:string,content:string>>, text string, prompt string")
    told = chat.canonical_turns(df)
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in told.collect()}
    assert got[1] == ("messages", [("user", "hi"), ("assistant", "yo")])
    assert got[2] == ("prompt", [("user", "ask"), ("assistant", "")])
    back = {r.id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chat(told, "id")).collect()}
    assert back[1] == got[1][1] and back[2] == got[2][1] and set(back) == {1, 2, 3, 4}


def test_conversations_without_turns_are_kept(spark):
    df = spark.createDataFrame([(1, []), (2, [("user", "x")]), (3, None)], f"id int, turns {chat.TURNS}")
    got = {r.id: (r.formatted, len(r.loss_spans)) for r in chat.format_chat(df, "id").collect()}
    assert got[1] == got[3] == ("", 0) and got[2][0] == "<|turn|>user\nx<|end|>\n"
    assert {r.id: len(r.turns) for r in chat.read_back(chat.format_chat(df, "id")).collect()} == {1: 0, 2: 1, 3: 0}
