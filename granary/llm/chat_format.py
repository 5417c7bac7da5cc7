r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected, sorted, merged where neighbours have the same role, and joined to one string.

Template (marks are control strings):
  user       ``[INST] text [/INST]``
  assistant  `` text </s>``
  any other  ``<<SYS>>role`` newline ``text`` newline ``<</SYS>>``
``<sep>`` stands between merged turns of one block. A control string inside a text or a role name gets a backslash after its first
character, after any backslashes that already stand there; reading back takes one backslash away, so every text survives.

Defined results: a null text is empty; a null role is the empty role; rows are ordered by turn (null first), then role, then text, so
repeated rows and ties stay, in a fixed order; a null conv_id is a conversation of its own; an empty table gives no row; very long texts
and conversations cost time in proportion (offsets by a logarithm of the turns); other columns, of any name, are ignored. A conversation becomes one output row, so its turns meet in one task; that is the size of the result itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import fresh

_TAIL = r"(/?INST\]|/?s>|</?SYS>>|sep>)"
_ESCAPE = r"([\[<])(\\*)" + _TAIL
_UNESCAPE = r"([\[<])\\(\\*)" + _TAIL
_BLOCK = r"(?s)\[INST\] (.*?) \[/INST\]|<<SYS>>(.*?)\n<</SYS>>| (.*?) </s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, r"$1$2$3")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, `formatted`, and `loss_mask`, the spans (start, length in code points) of assistant texts."""
    turns = F.array_sort(
        F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    )
    grouped = df.groupBy(F.col(conv).alias("conv_id")).agg(turns.alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        here = F.col("turns")
        before = F.when(i > 0, F.get(here, i - 1)["role"])
        after = F.get(here, i + 1)["role"]
        opens, closes = ~before.eqNullSafe(t["role"]), ~after.eqNullSafe(t["role"])
        opening = F.when(t["role"] == "user", F.lit("[INST] ")).when(t["role"] == "assistant", F.lit(" ")).otherwise(F.concat(F.lit("<<SYS>>"), escape(F.replace(F.replace(t["role"], F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))), F.lit("\n")))
        closing = F.when(t["role"] == "user", F.lit(" [/INST]")).when(t["role"] == "assistant", F.lit(" </s>")).otherwise(F.lit("\n<</SYS>>"))
        head = F.when(opens, opening).otherwise(F.lit("<sep>"))
        tail = F.when(closes, closing).otherwise(F.lit(""))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), tail.alias("tail"), (t["role"] == "assistant").alias("loss"))

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])
    # Ends of the pieces by doubling: after step k an entry is the sum of the 2^(k+1) sizes up to it, so no array grows turn by turn.
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size("pieces"), F.lit(2)))).cast("int") - 1)
    ends = F.aggregate(steps, F.transform("pieces", size), lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))))

    def located(ends: Column) -> Column:
        spans = F.transform("pieces", lambda p, i: F.struct((F.get(ends, i) - F.length(p["tail"]) - F.length(p["body"])).alias("start"), F.length(p["body"]).alias("length"), p["loss"].alias("loss")))
        return F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    loss_mask = F.get(F.transform(F.array(ends), located), F.lit(0))  # bound, so that the ends are computed once
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        loss_mask.alias("loss_mask"),
    )


def read_back(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds `turns`, an array of (role, text), parsed from the formatted string alone."""
    (turns,) = fresh(df, "turns")

    def block(b: Column) -> Column:
        user, system = b.startswith("[INST] "), b.startswith("<<SYS>>")
        inner = F.when(user, F.substring(b, F.lit(8), F.length(b) - 15)).when(system, F.substring(b, F.lit(8), F.length(b) - 16)).otherwise(F.substring(b, F.lit(2), F.length(b) - 6))
        end = F.instr(inner, "\n")
        name = unescape(F.substring(inner, F.lit(1), end - 1))
        role = F.when(user, F.lit("user")).when(system, F.replace(F.replace(name, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))).otherwise(F.lit("assistant"))
        body = F.when(system, F.substring(inner, end + 1, F.length(inner))).otherwise(inner)
        return F.transform(F.split(body, "<sep>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.regexp_extract_all(F.col(formatted), F.lit(_BLOCK), F.lit(0))
    return df.withColumn(turns, F.flatten(F.transform(blocks, block)))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped text under the mask. Spans are cut from fixed-width code points, so a cut costs its own length only."""
    wide = F.encode(formatted, "UTF-32")
    mark = F.unhex(F.lit("0000FEFF"))  # a byte-order mark of its own, so that one in the text stays

    def cut(w: Column, span: Column) -> Column:
        own = F.substring(w, span["start"] * 4 + 1, span["length"] * 4)
        return unescape(F.decode(F.concat(mark, own), "UTF-32"))

    return F.array_join(F.flatten(F.transform(F.array(wide), lambda w: F.transform(loss_mask, lambda span: cut(w, span)))), "")


def digest(df: DataFrame) -> DataFrame:
    """What `formatted` and `loss_mask` say, read back from them."""
    back = read_back(df.select("conv_id", "formatted", "loss_mask"))
    back = back.withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    loss = F.col("loss")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
