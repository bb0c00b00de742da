r"""Chat formatting: typed content parts flattened into one text, with a loss mask and a way back.

A turn's content is a list of parts ``(kind, text, ref, amount, height)``. A visitor has one
rule for each kind: a text part gives its text, escaped; an image, a sound or a document
gives the placeholder of its kind. Placeholders stand in the order of the parts, and the
k-th one of a conversation belongs to the k-th entry of its ``attachments(kind, ref,
tokens)``, where ``tokens`` says into how many the placeholder expands: an image of
``amount`` x ``height`` pixels into one for each patch, a sound of ``amount`` seconds
into some for each second, a document of ``amount`` pages into some for each page.

The template marks where a turn opens, where its role ends and where it closes. Marks,
placeholders and other control strings cannot be written by anybody: in roles and texts
a backslash goes behind the first character of each place where one starts, and each
backslash is doubled. ``parse`` undoes that: a backslash stands for the character after it.

``loss`` holds the ranges of code points, end exclusive, of what assistants say.

Turns go by number, nulls first; turns with one number go by role, then text. Null roles,
texts and references are empty, null amounts 0, null contents without parts, and a part of
an unknown kind gives nothing. Rows with no conversation id are one conversation.
Repeated rows are turns of their own. Other columns are not read. A conversation
without rows does not exist, so an empty table gives an empty result.

Everything is DataFrame code: parts are visited where they are read, offsets and attachment
order come from a window over the conversation, which spills. A formatted conversation is one
value of one row, as its readers need it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,amount:double,height:double>"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Template:
    """Marks of turns, placeholders, strings that nobody may write, and what placeholders expand to."""

    begin: str = "<s>"
    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "<|end|>"
    finish: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    others: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    patch: int = 28
    per_second: float = 25.0
    per_page: int = 256

    def __post_init__(self):
        # An escape goes behind the first character, so there has to be a second one.
        if any(len(c) < 2 or "\\" in c for c in self.control()):
            raise ValueError("control strings have two characters or more and no backslash")

    def control(self) -> list[str]:
        """All control strings that are not empty."""
        return [c for c in (self.begin, self.open, self.says, self.close, self.finish, *self.placeholders.values(), *self.others) if c]


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    starts = "|".join(re.escape(c) for c in template.control())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"(?s)(?={starts})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(part: Column, template: Template = CHAT) -> Column:
    """Into how many tokens a part expands: words of a text, patches, stretches of sound or of pages of the rest."""
    size = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    patches = F.ceil(size(part["amount"]) / template.patch) * F.ceil(size(part["height"]) / template.patch)
    return (
        F.when(part["kind"] == "text", F.coalesce(F.regexp_count(part["text"], F.lit(WORD)), F.lit(0)).cast("long"))
        .when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(size(part["amount"]) * template.per_second))
        .when(part["kind"] == "document", F.ceil(size(part["amount"])) * template.per_page)
        .otherwise(0).cast("long")
    )


def visit(part: Column, template: Template = CHAT) -> Column:
    """What a part gives to the text."""
    said = F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")), template))
    for kind, placeholder in template.placeholders.items():
        said = said.when(part["kind"] == kind, F.lit(placeholder))
    return said.otherwise("")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    nothing = {"ref": "string", "amount": "double", "height": "double"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]))


def format_chats(
    turns: DataFrame, content: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    template: Template = CHAT,
) -> DataFrame:
    """``(id_col, n_turns, formatted, loss, attachments, n_tokens)`` for each conversation of ``turns``.

    ``content`` is an array of ``PART``. ``n_tokens`` counts words of texts and what placeholders expand to.
    """
    rows = turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(content, F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts"),
    )
    said = F.array_join(F.transform("parts", lambda p: visit(p, template)), "")
    held = F.transform(
        F.filter("parts", lambda p: p["kind"].isin(*template.placeholders)),
        lambda p: F.struct(p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), tokens(p, template).alias("tokens")),
    )
    count = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + tokens(p, template))
    rows = rows.select("id", "turn", "role", said.alias("said"), held.alias("held"), count.alias("count"))
    rows = rows.withColumn("head", F.concat(F.lit(template.open), escape(F.col("role"), template), F.lit(template.says)))
    rows = rows.withColumn("piece", F.concat("head", "said", F.lit(template.close)))
    in_order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head") + len(template.begin)
    trained = F.col("role").isin(*template.trained)
    span = F.when(trained, F.struct(start.alias("start"), (start + F.length("said")).alias("stop")))
    rows = rows.select("id", F.row_number().over(in_order).alias("at"), "piece", "held", "count", span.alias("span"))
    # The same key as that of the window: no second exchange.
    found = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "span", "held"))).alias("all"), F.count("*").alias("n"), F.sum("count").alias("tokens"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_turns"),
        F.concat(F.lit(template.begin), F.array_join("all.piece", ""), F.lit(template.finish)).alias("formatted"),
        F.array_compact("all.span").alias("loss"), F.flatten("all.held").alias("attachments"), F.col("tokens").alias("n_tokens"),
    )


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns ``(role, text)`` of a formatted conversation; placeholders stay in the text as they are."""
    body = F.substring(formatted, len(template.begin) + 1, F.length(formatted) - len(template.begin) - len(template.finish))
    # Behind the last close there is nothing.
    turns = F.split(body, re.escape(template.close))
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(piece: Column) -> Column:
        sides = F.split(piece, re.escape(template.says), 2)
        role = F.substring(sides[0], len(template.open) + 1, F.length(sides[0]))
        return F.struct(unescape(role).alias("role"), unescape(sides[1]).alias("text"))

    return F.transform(turns, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    # Each range on its own: a backslash never reaches over the end of one.
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
