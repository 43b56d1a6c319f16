import hashlib
import random

from pyspark.sql import functions as F

from tracewell.llm import chat


def test_round_trip_of_hostile_content(spark):
    rng = random.Random(3)
    bits = ["[INST]", "[/INST]", "</s>", "[", "<", "\\", "/s>", "INST]", "ok", "é", "\n", " ", "[\\INST]", "<\\\\/s>", "$1", "日"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(("user", "assistant", "system", "odd</s>role", None)),
                         rng.choice((None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(6))))))
    rows += [(1, 0, "user", "tie b"), (1, 0, "user", "tie a"), (1, 0, "user", "tie a"), (None, 0, "user", "x"), (2, None, "assistant", "first")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(df)
    assert all(r["round_trip"] for r in out.select("round_trip").collect())
    source = {}
    for conv, turn, role, text in rows:
        source.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    back = {r["conv_id"]: r for r in chat.read_chats(out).collect()}
    assert set(back) == set(source)
    for conv, turns in source.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [t[1:] for t in turns]
        assert back[conv]["loss_text"] == "".join(t[2] for t in turns if t[1] == "assistant")
    plain = out.filter("n_escaped = 0").join(df.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    assert plain.filter("n_turns != n").count() == 0
    assert chat.format_chats(df.limit(0)).count() == 0


def test_control_strings_stay_out_of_texts(spark):
    text = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df).first()
    assert (row["formatted"].count("[INST]"), row["formatted"].count("[/INST]"), row["formatted"].count("</s>")) == (2, 2, 2)
    back = chat.read_chats(chat.format_chats(df)).first()
    assert hashlib.sha256(back["loss_text"].encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_parser_refuses_what_is_not_of_the_grammar(spark):
    bad = ["x", "[INST]user[/INST]a", "[INST]user</s>", "[INST]u[/INST]a[INST]b</s>", "[INST]u[/INST]a[/INST]</s>", "u[/INST]a</s>"]
    df = spark.createDataFrame([(t,) for t in [*bad, "", "[INST]u[/INST]</s>"]], "f string")
    got = [r[0] for r in df.select(chat.parse(F.col("f"))).collect()]
    assert got[:-2] == [None] * len(bad) and got[-2] == [] and [tuple(t) for t in got[-1]] == [("u", "")]
