"""Chat formatting: sorted turn structs, merged blocks and concatenation in Spark expressions.

A conversation becomes one string of blocks, one for each run of adjacent turns of the same
role; the turns within a block stay apart by a separator, so that the format can be read back:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_turn|>TEXT<|im_end|>\\n

Control strings within roles and texts are escaped by one backslash after their first
character, and those that have backslashes there already gain one more; unescaping takes one
away. So any text, an escaped one among them, comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import let, running

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>\n"
#: What a text must not hold as it stands: marks of this template and of other common ones.
ANGLE, SQUARE = r"(\|[A-Za-z_]+\|>|/?s>|/?SYS>>)", r"(/?INST\])"
#: Code points to a piece of a formatted conversation that spans are cut from.
PIECE = 4096


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)" + ANGLE, r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)" + SQUARE, r"[\\$1$2")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)" + ANGLE, "<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)" + SQUARE, "[$1$2")


def laid(turns: Column) -> Column:
    """``(formatted, loss_spans)`` of escaped turns (role, text, loss) in order; each step's value is bound once."""
    # a turn opens a block where its role differs from the one before; a block is the slice up to the next
    opens = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    cut = lambda o: F.transform(o, lambda i, k: F.slice(turns, i + 1, F.coalesce(F.get(o, k + 1), F.size(turns)) - i))
    return let(let(opens, cut), of_blocks)


def of_blocks(blocks: Column) -> Column:
    shown = F.transform(blocks, lambda b: F.concat(F.lit(START), b[0]["role"], F.lit(SEP), F.array_join(F.transform(b, lambda t: t["text"]), TURN), F.lit(END)))
    # what stands before a text: a mark, or the end of a block and the head of the next
    head = lambda t, k: F.length(t["role"]) + len(START) + len(SEP) + F.when(k > 0, len(END)).otherwise(0)
    gap = lambda t, k, j: F.when(j > 0, len(TURN)).otherwise(head(t, k))
    sized = F.transform(blocks, lambda b, k: F.transform(b, lambda t, j: F.struct(gap(t, k, j).alias("gap"), F.length(t["text"]).alias("length"), t["loss"].alias("loss"))))

    def spans(sizes: Column) -> Column:
        before = running(F.transform(sizes, lambda t: t["gap"] + t["length"]))
        placed = F.zip_with(sizes, before, lambda t, at: F.struct((at + t["gap"]).cast("int").alias("start"), t["length"].alias("length"), t["loss"].alias("loss")))
        return F.transform(F.filter(placed, lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))

    return F.struct(F.array_join(shown, "").alias("formatted"), let(F.flatten(sized), spans).alias("loss_spans"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from ``(conv_id, turn, role, text)``.

    loss_spans: ``(start, length)`` in code points of ``formatted`` of each text of ``loss_role``,
    as escaped there, in order. Turns sort by turn (null first), then role, then text; repeated
    rows each stay a turn. A null text or role is an empty one; rows with a null conv_id are one
    conversation. No rows give no rows. Other columns of ``turns`` are not read. A conversation
    is one row and takes time in proportion to its length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    return got.select("conv_id", let(made, laid).alias("made")).select("conv_id", "made.formatted", "made.loss_spans")


def parsed(formatted: Column) -> Column:
    """The ``(role, text)`` turns of a formatted conversation, unescaped."""
    blocks = let(F.split(formatted, rf"\Q{START}\E", -1), lambda p: F.slice(p, F.lit(2), F.size(p) - 1))
    body = lambda parts: F.substr(parts[1], F.lit(1), F.length(parts[1]) - len(END))

    def turns(parts: Column, role: Column) -> Column:
        return F.transform(F.split(body(parts), rf"\Q{TURN}\E", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    block = lambda b: let(F.split(b, rf"\Q{SEP}\E", -1), lambda parts: let(unescaped(parts[0]), lambda role: turns(parts, role)))
    return F.flatten(F.transform(blocks, block))


def under_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped.

    A place in a string is found by walking there, so the string is cut into pieces first and a span is
    taken from those that it touches.
    """

    def cut(pieces: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / PIECE).cast("int")
            touched = F.slice(pieces, first + 1, F.floor((s["start"] + s["length"]) / PIECE).cast("int") - first + 1)
            return unescaped(F.substr(F.array_join(touched, ""), s["start"] - first * PIECE + 1, s["length"]))

        return F.array_join(F.transform(spans, one), "")

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut)


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back; see format_conversations."""
    said = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = let(parsed(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n_turns"), F.sha2(said(t), 256).alias("turns_sha256")))
    lost = let(under_loss(F.col("formatted"), F.col("loss_spans")), lambda t: F.struct(F.length(t).cast("long").alias("loss_chars"), F.sha2(t, 256).alias("loss_sha256")))
    got = conversations.select("conv_id", read.alias("read"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    return got.select("conv_id", "read.*", "lost.*", "formatted_chars")
