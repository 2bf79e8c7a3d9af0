import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vakanz.llm import chat, queries

TRICKY = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn:user|>", "a\\<|b", "<\\|", "\\\\", "<\\\\|x", "[\\INST]", "<<SYS>>\n", "$0 \\1", "🙂é",
          "", "<|turn:", "[INST", "<s><s>", "\n\n"]


def rows():
    out = []
    for c in range(6):
        out.append((c, 0, "system" if c % 2 else "user", f"system {c} " + "s " * c))
        for t in range(1, 30 + c):
            text = TRICKY[(c + t) % len(TRICKY)] + " w" * ((c * 7 + t * 13) % 60)
            out.append((c, t, "user" if t % 2 else "assistant", text))
    out += [(10, 0, "assistant", " long" * 5000), (10, 1, None, None), (11, None, "assistant", "null turn"), (11, 3, "as|>sist\\", "x"),
            (None, 1, "user", "a"), (None, 2, "assistant", "b"), (12, 1, "assistant", "twice"), (12, 1, "assistant", "twice")]
    return out


def expected(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        every = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks(spark):
    frame = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    return frame.withColumn("conv", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("cost", F.lit("x"))


@pytest.mark.parametrize(("budget", "history"), [(64, 32), (512, 64), (40, 0)])
def test_round_trip(talks, budget, history):
    windows = chat.format_windows(talks, budget=budget, history=history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(windows).collect()}
    assert got == expected(rows())


def test_windows_keep_to_the_budget(talks):
    out = chat.format_windows(talks, budget=128, history=32).collect()
    by = defaultdict(list)
    for r in out:
        by[r["conv_id"]].append(r)
    for c, windows in by.items():
        windows.sort(key=lambda r: r["window"])
        for i, w in enumerate(windows):
            assert w["text"].count("<|turn:") == w["n_turns"] == w["text"].count("<|end|>")
            if c in range(6):
                assert w["cost"] <= 128 + 80  # the last turn of a span may go over
                assert i > 0 or w["n_repeated"] == 0
                if c % 2:
                    assert (w["n_repeated"] > 0) == (i > 0)
                    assert w["text"].startswith("<|turn:system|>")
        assert c not in range(6) or len(windows) > 5


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t and not any(c in e for c in chat.CONTROL)


def test_empty_and_options(talks):
    assert chat.digests(chat.format_windows(talks.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(talks, budget=10, history=9)


def test_query_on_the_table(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op5(spark, sf_dir).collect()}
    assert got == expected(table + queries.EXTRA_CONVERSATION)


def test_no_python_in_the_plan(talks):
    text = chat.digests(chat.format_windows(talks))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in text and "MapInArrow" not in text
