"""Prompt and chat rendering as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Chat markup of the local chat models (start/end markers).
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
# ---------------------------------------------------------------------------


def render(template: str, **fields) -> Column:
    """``str.format``-style template over columns. ``{name}`` takes the
    column (or Column) passed as ``name``; doubled braces are literal. The
    template text is a parameter; nothing is evaluated per row in Python."""
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported in templates")
            v = fields[field]
            parts.append((F.col(v) if isinstance(v, str) else v).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def block_col(role: Column, text: Column) -> Column:
    return F.concat(F.lit(IM_START), role, F.lit("\n"), text, F.lit(f"{IM_END}\n"))


def render_chats(turns: DataFrame, default_system: str, include_ending: bool = True,
                 conv: str = "conv_id") -> DataFrame:
    """one prompt string per conversation ``(conv_id, turn, role, text)``:
    the system block (first system turn, else ``default_system``), then
    user/assistant pairs by their order within each role, then — when there
    are more user turns than replies — a user block with the *last* user
    turn, then an open assistant tag.

    One shuffle: a conversation's turns are gathered in order, and everything
    else is array expressions on them."""
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))

    def of(role: str) -> Column:
        return F.transform(F.filter("_t", lambda x: x["role"] == role), lambda x: x["text"])

    g = g.select(conv, of("user").alias("_u"), of("assistant").alias("_a"), F.get(of("system"), 0).alias("_s"))
    pairs = F.zip_with(F.slice("_u", 1, F.least(F.size("_u"), F.size("_a"))), F.slice("_a", 1, F.least(F.size("_u"), F.size("_a"))),
                       lambda u, a: F.concat(block_col(F.lit("user"), u), block_col(F.lit("assistant"), a)))
    left = F.when(F.size("_u") > F.size("_a"), block_col(F.lit("user"), F.element_at("_u", -1))).otherwise(F.lit(""))
    parts = [block_col(F.lit("system"), F.coalesce("_s", F.lit(default_system))), F.array_join(pairs, ""), left]
    if include_ending:
        parts.append(F.lit(f"{IM_START}assistant\n"))
    return g.select(conv, F.concat(*parts).alias("prompt"))
