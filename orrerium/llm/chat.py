"""Chat formatting: turns of typed content parts become one marked string with a loss mask, by Spark's own functions only.

A visitor flattens each turn's parts into ordered pieces: texts as they are, images, audio and documents as
placeholders, whose references and expanded token counts are recorded beside the string. A conversation is cut
into blocks of turn numbers, so that no task needs the whole of a long one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAF = "type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int"
#: Type of a parts column. A document's own parts are `parts`; they hold no documents.
PARTS = f"array<struct<{_LEAF}, parts: array<struct<{_LEAF}>>>>".replace(": ", ":")


@dataclass(frozen=True)
class Template:
    """Marks of turns and attachments, and what an attachment expands to.

    A turn is the mark of its role (or the role between `other`), its content and `end`. Control strings start with
    `<` or `[` and hold neither of these nor a backslash after it, which is what makes the escapes reversible.
    """

    system: str = "[SYS]"
    user: str = "[INST]"
    assistant: str = "[/INST]"
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    end: str = "</s>"
    image: str = "<image>"
    audio: str = "<audio>"
    document: tuple[str, str] = ("<document>", "</document>")
    reserved: tuple[str, ...] = ("<s>",)
    patch: int = 14
    image_tokens: int = 256
    second_tokens: int = 25
    page_tokens: int = 512

    def __post_init__(self) -> None:
        for s in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\]+", s):
                raise ValueError(f"control string {s!r} must be < or [ and then none of < [ \\")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.system, self.user, self.assistant, *self.other, self.end, self.image, self.audio, *self.document, *self.reserved)

    @property
    def _rests(self) -> str:
        return "|".join(sorted({re.escape(s[1:]) for s in self.controls}))

    def escape(self, text: Column) -> Column:
        """text with one backslash more after the bracket of each control string, escaped ones included."""
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._rests})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._rests})", "$1$2$3")

    def _tokens(self, part: Column) -> Column:
        def cells(side: str) -> Column:
            return F.ceil(F.greatest(part[side], F.lit(1)) / F.lit(self.patch)).cast("long")

        image = F.coalesce(cells("width") * cells("height"), F.lit(self.image_tokens).cast("long"))
        image = F.when(part["width"].isNull() | part["height"].isNull(), F.lit(self.image_tokens).cast("long")).otherwise(image)
        audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * self.second_tokens).cast("long")
        pages = F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)).cast("long") * self.page_tokens
        return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages)

    def _leaf(self, part: Column) -> Column:
        """The pieces of a part that holds no others: one, or none for a null part or one of an unknown type without text."""
        mark = F.when(part["type"] == "image", F.lit(self.image)).when(part["type"] == "audio", F.lit(self.audio)).when(part["type"] == "document", F.lit("".join(self.document)))
        piece = F.struct(F.when(mark.isNotNull(), part["type"]).alias("kind"), F.coalesce(mark, self.escape(part["text"])).alias("body"), F.when(mark.isNotNull(), part["ref"]).alias("ref"), F.when(mark.isNotNull(), self._tokens(part)).alias("tokens"))
        return F.filter(F.array(piece), lambda p: p["body"].isNotNull())

    def visit(self, parts: Column) -> Column:
        """Ordered pieces (kind, body, ref, tokens) of a column of PARTS; kind is null for text."""

        def piece(body: str, part: Column | None = None) -> Column:
            none = F.lit(None)
            return F.struct(
                (none if part is None else part["type"]).cast("string").alias("kind"), F.lit(body).alias("body"),
                (none if part is None else part["ref"]).cast("string").alias("ref"), (none if part is None else self._tokens(part)).cast("long").alias("tokens"),
            )

        def inner(part: Column) -> Column:
            return F.flatten(F.transform(F.filter(part["parts"], lambda x: x.isNotNull()), self._leaf))

        def one(part: Column) -> Column:
            whole = F.concat(F.array(piece(self.document[0], part)), inner(part), F.array(piece(self.document[1])))
            return F.when((part["type"] == "document") & (F.size(part["parts"]) > 0), whole).otherwise(self._leaf(part))

        return F.coalesce(F.flatten(F.transform(F.filter(parts, lambda x: x.isNotNull()), one)), F.array().cast("array<struct<kind:string,body:string,ref:string,tokens:bigint>>"))


def format_blocks(rows: DataFrame, template: Template = Template(), parts: str | None = None, turns: int = 64, learn: str = "assistant") -> DataFrame:
    """Conversations as marked strings, a row for each block of `turns` turn numbers; the blocks of one, joined in order, are its whole.

    rows: conv_id, turn, role, text, and a column of PARTS if `parts` names one (its null: the text). Other columns
    are left aside. Result: conv_id, block, formatted, n_turns, spans (start and length, in code points of
    `formatted`, of what is learned from: the contents of turns of the role `learn`) and attachments (turn number,
    position of the placeholder, kind, ref, tokens it expands to).

    Null texts and roles are empty; a null role is marked as any other role. Rows of a conversation come by turn,
    then role and text, nulls first; a null turn number is a block of its own, before the others. Repeated rows are
    turns of their own; rows without a conv_id are one conversation. Pieces of a turn are joined by line feeds.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("kind"), template.escape(text).alias("body"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))
    seen = plain if parts is None else F.when(F.col(parts).isNull(), plain).otherwise(template.visit(F.col(parts).cast(PARTS)))
    mark = F.when(role == "system", F.lit(template.system)).when(role == "user", F.lit(template.user)).when(role == "assistant", F.lit(template.assistant))
    mark = F.coalesce(mark, F.concat(F.lit(template.other[0]), template.escape(role), F.lit(template.other[1])))
    turn = rows.select("conv_id", F.col("turn").alias("at"), role.alias("who"), text.alias("said"), mark.alias("mark"), seen.alias("pieces"))
    turn = turn.withColumn("content", F.array_join(F.transform("pieces", lambda p: p["body"]), "\n"))
    sizes = F.transform("pieces", lambda p: F.char_length(p["body"]).cast("long"))
    # The place of a piece: what stands before it, with a line feed each.
    held = F.filter(F.transform("pieces", lambda p, k: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), (F.aggregate(F.slice(F.col("sizes"), F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x) + k).alias("place"))), lambda p: p["kind"].isNotNull())
    turn = turn.withColumn("sizes", sizes).select(
        "conv_id", F.floor(F.col("at") / turns).cast("long").alias("block"),
        F.struct("at", "who", "said", F.concat("mark", "content", F.lit(template.end)).alias("whole"), F.char_length("mark").cast("long").alias("lead"), F.char_length("content").cast("long").alias("body"), held.alias("held")).alias("t"),
    )
    blocks = turn.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # The start of every turn, by one pass over the block's lengths.
    starts = F.aggregate(
        F.transform("t", lambda x: x["lead"] + x["body"] + len(template.end)), F.array(F.lit(0).cast("long")),
        lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )
    blocks = blocks.withColumn("starts", starts)
    placed = F.transform("t", lambda x, k: F.struct((F.col("starts")[k] + x["lead"]).alias("start"), x["body"].alias("length"), x["who"].alias("who"), x["at"].alias("turn"), x["held"].alias("held")))
    return blocks.withColumn("placed", placed).select(
        "conv_id", "block", F.array_join(F.transform("t", lambda x: x["whole"]), "").alias("formatted"), F.size("t").cast("long").alias("n_turns"),
        F.transform(F.filter("placed", lambda p: p["who"] == learn), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("spans"),
        F.flatten(F.transform("placed", lambda p: F.transform(p["held"], lambda h: F.struct(p["turn"].alias("turn"), (p["start"] + h["place"]).alias("position"), h["kind"].alias("kind"), h["ref"].alias("ref"), h["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a marked string; an attachment's placeholder stays in the text."""
    pieces = F.split(formatted, re.escape(template.end))

    def read(p: Column) -> Column:
        known = [(r, m) for r, m in (("system", template.system), ("user", template.user), ("assistant", template.assistant))]
        head = F.substring_index(p, template.other[1], 1)
        role = template.unescape(F.substring(head, len(template.other[0]) + 1, 2**31 - 1))
        text = F.substring(p, F.char_length(head) + len(template.other[1]) + 1, F.lit(2**31 - 1))
        for r, m in known:
            role = F.when(F.startswith(p, F.lit(m)), F.lit(r)).otherwise(role)
            text = F.when(F.startswith(p, F.lit(m)), F.substring(p, len(m) + 1, 2**31 - 1)).otherwise(text)
        return F.struct(role.alias("role"), template.unescape(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)


def read_loss(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def join_blocks(blocks: DataFrame, *texts: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """A row for each conversation: each of the string columns, joined in the order of blocks, n_turns, and sums of other columns."""
    out = blocks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("n_turns", *sums)], F.sort_array(F.collect_list(F.struct("block", *texts))).alias("b"))
    return out.select("conv_id", "n_turns", *sums, *[F.array_join(F.col("b")[c], "").alias(c) for c in texts])
