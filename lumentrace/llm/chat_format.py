"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

The template gives the text before and after every turn and the roles that are trained on. Texts and roles
are escaped so that no control string of the template can arise inside them, and unescaped on the way back.
The output holds the formatted text and its segments, each with its loss flag. All native columns; one
shuffle brings the turns of a conversation together, which its text needs as one value anyway.

Defined results: turns are ordered by turn, then role, then text, nulls first; null text or role is empty;
repeated rows are turns of their own; the rows with a null conversation form one; an invalid order of roles
is flagged in ``valid`` and formatted all the same; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; what is missing is an error.
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)


def _swap(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


#: No escaped text holds "<|", with which every control string begins; no escaped role holds a line feed.
_ESCAPE = (("&", "&amp;"), ("<|", "&lt;|"))
_ROLE = (("\n", "&#10;"),)


def escape(c: Column) -> Column:
    return _swap(c, _ESCAPE)


def escape_role(c: Column) -> Column:
    return _swap(c, _ESCAPE + _ROLE)


def unescape(c: Column) -> Column:
    return _swap(c, (("&#10;", "\n"), ("&lt;", "<"), ("&amp;", "&")))


def format_chats(turns: DataFrame, template: Template | None = None, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Per conversation: ``formatted``, ``segments`` (text, loss), ``valid``."""
    t = template or Template()
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                piece(F.concat(F.lit(t.start), escape_role(x["role"]), F.lit(t.after_role)), F.lit(False)),
                piece(escape(x["text"]), x["role"].isin(*t.loss_roles)),
                piece(F.lit(t.end), F.lit(False)),
            ),
        )
    )
    moves = F.create_map(*[F.lit(x) for (state, r), to in t.moves.items() for x in (f"{state} {r}", to)])
    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.element_at(moves, F.concat(s, F.lit(" "), x["role"])), F.lit("error")))
    df = chats.select("conv_id", segments.alias("segments"), state.isin(*t.final).alias("valid"))
    return df.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse ``formatted`` into ``turns`` (role, text), and collect the ``learned`` texts under the loss flags."""
    t = template or Template()
    parts = F.split("formatted", "".join("\\" + c if c in "|<>" else c for c in t.start), -1)
    df = chats.withColumn("_lt_parts", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))

    def turn(x: Column) -> Column:
        cut = F.instr(x, t.after_role)
        return F.struct(
            unescape(F.substring(x, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(x, cut + len(t.after_role), F.length(x) - cut - len(t.after_role) - len(t.end) + 1)).alias("text"),
        )

    return df.select(
        "*",
        F.transform("_lt_parts", turn).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("learned"),
    ).drop("_lt_parts")
