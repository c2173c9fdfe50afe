"""Chat formatting: a template with marked turns whose output is parsed back by its grammar, with escapes where texts hold marks.

    conversation = turn*
    turn         = "<s>" role "[INST]" text "[/INST]" "</s>"

Roles and texts hold none of the four marks. Where one does, each mark in them, and each that was escaped before, gets a
backslash behind its first sign (`<s>` is written `<\\s>`, `<\\s>` is written `<\\\\s>`), which reading takes away again. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: The four marks; where a mark, escaped or not, takes one escape more; and the escape that reading takes away.
MARK = r"</?s>|\[/?INST\]"
PLACE = r"<(?=\\*/?s>)|\[(?=\\*/?INST\])"
ESCAPE = r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])"
#: Whose texts a model learns to write.
LEARNED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PLACE, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(OPEN), text, F.lit(CLOSE), F.lit(END))


def stretches(formatted: Column) -> Column:
    """The text's turns, still rendered, without the mark that ends them; what follows the last one comes last."""
    return F.split(formatted, END)


def _turn(stretch: Column) -> Column:
    """role and text of one stretch; null where it is no turn of the grammar."""

    def of(halves: Column) -> Column:
        whole = F.startswith(stretch, F.lit(BEGIN)) & F.endswith(stretch, F.lit(CLOSE)) & (F.size(halves) == 2) & (F.regexp_count(stretch, F.lit(MARK)) == 3)
        role, text = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
        return F.when(whole, F.struct(unescaped(F.substr(role, F.lit(len(BEGIN) + 1))).alias("role"), unescaped(F.left(text, F.length(text) - len(CLOSE))).alias("text")))

    return let(F.split(stretch, r"\[INST\]"), of)


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, by the grammar alone; one that does not hold is null, and so is what
    follows the last turn's end, if anything does."""

    def of(parts: Column) -> Column:
        n = F.size(parts)
        ended = F.slice(parts, 1, n - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))
        return F.transform(ended, lambda x, i: F.when(i < n - 1, _turn(x)))

    return let(stretches(formatted), of)


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, n_turns, formatted (the conversation's text), mask: an array of structs turn, begin, end, the stretches of
    code points to learn, counted within the turn's own stretch of the text (turns from 0), one for each turn of the learned
    roles. Each turn is rendered as it is, read back by the grammar, and rendered with escapes where that does not give the
    source; then the conversation is read back as a whole. What could not be recovered would be an error.

    Turns stand in the order of `turn`, null first, then of role and text; repeated rows are so many turns. Null role or
    text: empty. Rows without conversation are one conversation, null. No rows: none. Other columns are not read. A
    conversation is one text, so its turns meet in one task."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    plain, marked = rendered(F.col("role"), F.col("text")), rendered(escaped(F.col("role")), escaped(F.col("text")))
    tried = [let(way, lambda x: F.when(parsed(x).eqNullSafe(source), x)) for way in (plain, marked)]
    own = rows.withColumn("piece", F.coalesce(*tried, F.raise_error(F.lit("a turn cannot be read back"))))
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("turns"))
    joined = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    same = parsed(F.col("formatted")).eqNullSafe(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    spans = F.transform("turns", lambda t, i: F.when(t["role"].isin(*learned), F.struct(i.alias("turn"), (F.instr(t["piece"], OPEN) + len(OPEN) - 1).alias("begin"), (F.length(t["piece"]) - len(CLOSE) - len(END)).alias("end"))))
    sure = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))
    return joined.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sure.alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("mask"))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, without escapes, nothing between."""
    return let(stretches(formatted), lambda parts: F.array_join(F.transform(mask, lambda s: unescaped(F.substr(F.get(parts, s["turn"]), s["begin"] + 1, s["end"] - s["begin"]))), ""))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from each conversation of formatted()."""
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumns({"read": parsed(F.col("formatted")), "loss": learned_text(F.col("formatted"), F.col("mask"))})
    return read.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
