"""Chat formatting with schema fingerprints.

Records of many layouts (message lists, prompt and response, instruction and
output, one turn a row) become canonical turns (role, text). A record is a
variant value; its nested field paths, without their types, are hashed to a
fingerprint, and the fingerprint selects a declarative mapping with a hash
join. Mappings list where turns come from; no code belongs to a layout.

Turns are then written with a template::

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (in roles
also a line feed becomes ``\\n``), so a control string can only come from the
template, and reading back restores every character. The loss mask covers the
texts of assistant turns.

Null texts and roles count as empty. A record whose fingerprint no mapping has
is a layout null with no turns; nothing is dropped. A conversation without
turns formats to ''. Turns with equal numbers are ordered by role and text.
A conversation is one output string, so its turns meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """``example``: a JSON record with exactly the layout's fields. ``turns``:
    single turns as (role, path), taken where the path is not null. ``each``:
    (path of a list, role field, text field), its items in order. ``roles``:
    names of roles in the list and what they become."""

    name: str
    example: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = [
    Layout("turn_row", '{"role": "", "text": ""}', each=("$", "role", "text")),
    Layout("messages", '{"messages": [{"role": "", "content": ""}]}', each=("$.messages", "role", "content")),
    Layout("messages_text", '{"messages": [{"role": "", "text": ""}]}', each=("$.messages", "role", "text")),
    Layout("conversations", '{"conversations": [{"from": "", "value": ""}]}', each=("$.conversations", "from", "value"), roles=_NAMES),
    Layout("system_conversations", '{"system": "", "conversations": [{"from": "", "value": ""}]}', (("system", "$.system"),),
           ("$.conversations", "from", "value"), _NAMES),
    Layout("prompt_response", '{"prompt": "", "response": ""}', (("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("prompt_completion", '{"prompt": "", "completion": ""}', (("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", '{"instruction": "", "output": ""}', (("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", '{"instruction": "", "input": "", "output": ""}',
           (("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("question_answer", '{"question": "", "answer": ""}', (("user", "$.question"), ("assistant", "$.answer"))),
]


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, without types: names, nesting and
    lists only (fields in order of name)."""
    schema = F.schema_of_variant(record)
    # Types of plain values and of empty or mixed lists all count alike.
    return F.regexp_replace(schema, r": (STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID)(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def mapping_table(spark: SparkSession, layouts: list[Layout]) -> DataFrame:
    rows = spark.createDataFrame([(x.name, k, x.example) for k, x in enumerate(layouts)], "layout string, _rank int, example string")
    # Two layouts with the same paths: the first listed wins.
    return (rows.select("layout", "_rank", fingerprint(F.parse_json("example")).alias("fingerprint"))
            .groupBy("fingerprint").agg(F.min(F.struct("_rank", "layout")).alias("_l")).select("fingerprint", F.col("_l.layout").alias("layout")))


def _turns(record: Column, layout: Layout) -> Column:
    one = [F.struct(F.lit(role).alias("role"), F.try_variant_get(record, path, "string").alias("text")) for role, path in layout.turns]
    out = F.filter(F.array(*one), lambda t: t.text.isNotNull()) if one else F.array().cast(TURNS)
    if layout.each:
        path, role, text = layout.each
        kind = f"struct<`{role}`:string,`{text}`:string>"
        items = F.array(F.try_variant_get(record, "$", kind)) if path == "$" else F.try_variant_get(record, path, f"array<{kind}>")

        def turn(x):
            name = F.coalesce(x[role], F.lit(""))
            for a, b in layout.roles.items():
                name = F.when(x[role] == a, F.lit(b)).otherwise(name)
            return F.struct(name.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        out = F.concat(out, F.coalesce(F.transform(items, turn), F.array().cast(TURNS)))
    return out.cast(TURNS)


def canonical_turns(records: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with layout (the mapping's name, or null) and turns, which
    replace columns of those names."""
    spark = records.sparkSession
    rows = records.drop("layout", "turns").withColumn("_f", fingerprint(F.col(record)))
    table = mapping_table(spark, layouts).withColumnRenamed("fingerprint", "_f")
    rows = rows.join(F.broadcast(table), "_f", "left").drop("_f")  # one row a layout
    turns = F.array().cast(TURNS)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col(record), x)).otherwise(turns)
    return rows.withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Pairs of backslashes come first: what is left of a run belongs to a mark.
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def format_turns(turns: Column) -> Column:
    """The conversation as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), escape_role(t.role), F.lit("\n"), escape(t.text), F.lit(END + "\n"))), "")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from the formatted string."""
    parts = F.split(formatted, r"<\|im_end\|>\n")

    def turn(p):
        body = F.substring(p, F.lit(len(START) + 1), F.length(p))
        at = F.locate("\n", body)
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(body, at + 1, F.length(body))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def _blocks(items: Column, size: int) -> Column:
    """``items`` in consecutive blocks of ``size``; no items give no blocks."""
    last = F.floor((F.size(items) - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * size + 1, F.lit(size)))
    return F.when(F.size(items) > 0, cut).otherwise(F.filter(cut, lambda b: F.size(b) > 0))


#: Spans read, and turns placed, at a time. A character's place in a string, and
#: an item added to an array, cost the length before it; in blocks that is the
#: block's.
READ, PLACED = (4096, 64), 256


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read back from the formatted string."""
    def read(text: Column, start: Column, spans: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s.start - start + 1, s.end - s.start))), "")
        first, last = (lambda b: F.element_at(b, 1).start), (lambda b: F.element_at(b, -1).end)
        blocks = F.transform(_blocks(spans, sizes[0]), lambda b: F.struct(
            F.substring(text, first(b) - start + 1, last(b) - first(b)).alias("text"), first(b).alias("start"), b.alias("spans")))
        return F.array_join(F.transform(blocks, lambda b: read(b.text, b.start, b.spans, sizes[1:])), "")

    return read(formatted, F.lit(0), spans, READ)


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conversations`` (turns, and any other columns) with formatted and
    loss_spans (start and end of each assistant text in it, in characters)."""
    cols = [c for c in conversations.columns if c not in ("formatted", "loss_spans")]
    sizes = F.transform("turns", lambda t: F.struct(
        (F.length(F.lit(START)) + F.length(escape_role(t.role)) + 1).alias("head"), F.length(escape(t.text)).alias("text"),
        (t.role == "assistant").alias("loss")))
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc, t):
        start, end = acc.at + t.head, acc.at + t.head + t.text
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(t.loss, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    # Spans within each block of turns, and where the blocks start.
    blocks = F.transform(_blocks(F.col("_z"), PLACED), lambda b: F.aggregate(b, zero, step))
    starts = F.aggregate(F.transform("_b", lambda b: b.at), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
                         lambda acc, n: F.struct((acc.at + n).alias("at"), F.concat(acc.starts, F.array(acc.at)).alias("starts")),
                         lambda acc: acc.starts)
    placed = F.transform(F.arrays_zip("_b", "_s"), lambda z: F.transform(
        z["_b"].spans, lambda s: F.struct((s.start + z["_s"]).alias("start"), (s.end + z["_s"]).alias("end"))))
    out = conversations.select(F.struct(*cols).alias("_row"), format_turns(F.col("turns")).alias("formatted"), sizes.alias("_z"))
    out = out.withColumn("_b", blocks).withColumn("_s", starts)
    return out.select(*[F.col("_row")[c].alias(c) for c in cols], "formatted", F.flatten(placed).cast(kind).alias("loss_spans"))


def gather_turns(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the turns of its rows in order."""
    flat = rows.select(key, F.col(order).alias("_o"), F.posexplode_outer("turns").alias("_p", "_t"))
    one = F.struct(F.col("_o").alias("o"), F.col("_p").alias("p"), F.col("_t.role").alias("role"), F.col("_t.text").alias("text"))
    return (flat.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), one))).alias("_l"))
            .select(key, F.transform("_l", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns")))
