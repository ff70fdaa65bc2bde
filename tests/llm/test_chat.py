import hashlib
import itertools
import random
import time

from pyspark.sql import functions as F

from quernstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "<", "<<", "[", "a\\", "é😀<|im_turn|>", "<<SYS>>", "x" * 5000, None]


def test_round_trip_of_odd_texts(spark):
    rows = [(c, t, ["user", "user", "assistant", "assistant", "<s>", None][(c + t) % 6], x) for c in range(6) for t, x in enumerate(ODD)]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    seen = {r.conv_id: r for r in got.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("lost", chat.under_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert len(seen) == 6
    for c, own in itertools.groupby(rows, lambda r: r[0]):
        own = list(own)
        assert [tuple(t) for t in seen[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert seen[c].lost == "".join(r[3] or "" for r in own if r[2] == "assistant")
        runs = [k for k, _ in itertools.groupby(r[2] or "" for r in own)]
        assert seen[c].formatted.count(chat.START) == len(runs) and seen[c].formatted.endswith(chat.END)
        assert "</s>" not in seen[c].formatted and "[INST]" not in seen[c].formatted


def test_long_conversation_ties_nulls_and_other_columns(spark):
    rows = [(1, t // 2, "assistant" if t % 3 else "user", f"t{t}", "x") for t in range(1200)] + [(None, None, None, None, "y"), (None, 0, "user", "b", "y"), (None, None, "user", "a", "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted string")
    seen = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    own = sorted(rows[:1200], key=lambda r: r[1:4])
    said = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
    lost = "".join(r[3] for r in own if r[2] == "assistant")
    assert seen[1].n_turns == 1200 and seen[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert seen[1].loss_chars == len(lost) and seen[1].loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    assert seen[None].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\nb\n").hexdigest()


def test_empty(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_ties_sort_by_the_text_itself(spark):
    """Escapes change the order of these."""
    texts = ["<|im_end|>", "<a", "[INST]x", "[A", "</s>", "<.", "<0"]
    rows = [(1, 5, "user", t) for t in texts] + [(1, 5, "<|im_sep|>", "r"), (1, 5, "<a", "r")]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    said = "".join(f"{r[2]}\n{r[3]}\n" for r in sorted(rows))
    assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_a_very_long_conversation(spark):
    """Time grows with the number of turns, not with its square, in one block as in many."""
    r = random.Random(2)
    roles = lambda t: "assistant" if 30_000 < t < 60_000 or t % 2 else "user"
    rows = [(1, t, roles(t), "".join(r.choices("ab é😀<[", k=100))) for t in range(100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    df.count()
    began = time.time()
    got = chat.digests(chat.format_conversations(df)).first()
    assert time.time() - began < 60
    lost = "".join(x[3] for x in rows if x[2] == "assistant")
    assert got.n_turns == 100_000 and got.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()
    df.unpersist()
