import hashlib

import pytest
from pyspark.sql import functions as F
from riskframe.llm import chat

ROWS = [
    (1, 1, "assistant", "hi <|turn|> \\ <\\| </s>"), (1, 0, "user", None), (1, 2, None, "x"), (1, 2, None, "x"),
    (2, 0, "system", ""), (2, 1, "assistant", None), (None, 0, "user", "[INST] é \n"), (3, 0, "assistant", "<|body|><|end|>" * 400),
    (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, None, "ro<|le\n", "z"),
]


def conversations(spark, rows=ROWS):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return d.withColumn("no", F.lit(1)).withColumn("formatted", F.lit("x")).withColumn("piece", F.lit(0))


def test_digests_match_brute_force(spark):
    got = {r.conv_id: r for r in chat.chat_digests(chat.with_probe(conversations(spark))).collect()}
    rows = ROWS + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "<\\\\|", "\\<|", "</s>", "<\\s>", "[INST]\\", "a<<|[[/INST]", "\\\\<|\\"])
def test_escape_is_reversible_and_hides_control_strings(spark, text):
    r = spark.range(1).select(chat.escape(F.lit(text)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert r.u == text and not any(c in r.e for c in chat.CONTROL)


def test_typed_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "see <|image|> ", None, None), ("image", None, "s3://a", 256), ("AUDIO", "x", "b", None),
                            (None, "plain", None, None)]),
            (1, 1, "assistant", None), (1, 2, "user", [("document", None, "c", 7)])]
    df = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{part}>"))
    r = df.first()
    assert r.formatted == ("<|turn|>user<|body|>see <\\|image|> <|image|><|audio|>plain<|end|>"
                           "<|turn|>assistant<|body|><|end|><|turn|>user<|body|><|document|><|end|>")
    assert [tuple(a) for a in r.attachments] == [("image", "s3://a", 256, 0, 1), ("audio", "b", 0, 0, 2), ("document", "c", 7, 2, 0)]
    assert r.expanded_tokens == 263
    m = r.loss_mask[0]
    assert len(r.loss_mask) == 1 and r.formatted[m.start:m.start + m.length] == ""


def test_empty_table_has_only_the_probe(spark):
    got = chat.chat_digests(chat.with_probe(conversations(spark, []))).collect()
    assert [r.conv_id for r in got] == [-1] and got[0].loss_chars == 21
