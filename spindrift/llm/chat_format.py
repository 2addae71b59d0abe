"""Chat records of many layouts to canonical turns, and turns to one marked text that can be read back.

A record's layout is told by its fingerprint, a hash of the paths of all its nested fields, whatever their values and
types. Each layout that is known declares which paths it has and which of them hold roles and texts; from that follow the
fingerprints that it covers and the expression that takes the turns out. Nothing is guessed from values, and a record
whose fingerprint nobody declared keeps it (see ``unmapped``).

Only DataFrame functions are used. Texts are shuffled once, by conversation. A conversation becomes one text, so a single
one must fit into a task, as any single text must.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- layouts


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role: the texts at ``paths`` that are there and not empty, joined by an empty line."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """One turn for each element of the array at ``path``, which has its role and text at these names."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class Row:
    """The record is a turn itself: of the conversation at ``key``, at the place ``order``."""

    key: str
    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """fields: paths that a record always has, as ``a.b`` or ``a[].b`` below an array; optional: those it may have."""

    name: str
    fields: tuple[str, ...]
    turns: tuple[Said | Each | Row, ...]
    optional: tuple[str, ...] = ()


ANSWERS = (Said("system", ("system",)), Said("user", ("prompt",)))
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), (Row("conv_id", "turn", "role", "text"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),), ("id", "messages[].name", "source")),
    Layout(
        "shared_chats",
        ("conversations[].from", "conversations[].value"),
        (Said("system", ("system",)), Each("conversations", "from", "value")),
        ("id", "system", "conversations[].weight"),
    ),
    Layout(
        "instruction",
        ("instruction", "output"),
        (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",))),
        ("id", "system", "input"),
    ),
    Layout("prompt_completion", ("prompt", "completion"), (*ANSWERS, Said("assistant", ("completion",))), ("id", "system")),
    Layout("prompt_response", ("prompt", "response"), (*ANSWERS, Said("assistant", ("response",))), ("id", "system")),
    Layout("question_answer", ("question", "answer"), (Said("user", ("context", "question")), Said("assistant", ("answer",))), ("id", "context")),
    Layout("dialog", ("dialog.turns[].speaker", "dialog.turns[].utterance"), (Each("dialog.turns", "speaker", "utterance"),), ("id", "dialog.topic")),
)
#: Other names of the three roles; all other roles stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

LEAF = r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]*\))?(?=[,>])"


def shape(record: Column) -> Column:
    """The paths of all fields of a variant as one text, in the order of names, without types of values."""
    return F.regexp_replace(F.schema_of_variant(record), LEAF, "")


def fingerprint(record: Column) -> Column:
    """Hash of the paths of all fields; null for a null record."""
    return F.when(record.isNotNull(), F.xxhash64(shape(record)))


def shape_of(paths: tuple[str, ...]) -> str:
    """The shape of a record that has just these paths; one that ends in ``[]`` is an array without elements."""
    below: dict[str, list[str]] = {}
    for path in paths:
        name, _, rest = path.partition(".")
        below.setdefault(name, []).extend([rest] if rest else [])
    parts = []
    for name in sorted(below, key=lambda x: x.removesuffix("[]").encode()):
        inner = shape_of(tuple(below[name])) if below[name] else "VOID"
        inner = f"ARRAY<{inner}>" if name.endswith("[]") else inner
        parts.append(name.removesuffix("[]") + (f": {inner}" if inner != "VOID" else ""))
    return f"OBJECT<{', '.join(parts)}>"


def shapes(layout: Layout) -> list[str]:
    """All shapes that a layout covers: with any of its optional fields; arrays of objects may be empty or null."""
    out = set()
    for n in range(len(layout.optional) + 1):
        for more in itertools.combinations(layout.optional, n):
            paths = layout.fields + more
            out.add(shape_of(paths))
            for kept in ("[]", ""):
                out.add(shape_of(tuple(dict.fromkeys(re.sub(r"\[\]\..*", kept, p) for p in paths))))
    return sorted(out)


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the first layout that covers the record's fingerprint, or null."""
    print_ = fingerprint(record)
    named = [F.when(print_.isin([F.xxhash64(F.lit(s)) for s in shapes(x)]), F.lit(x.name)) for x in layouts]
    return F.coalesce(*named)


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _role(name: Column, roles: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(name == old, F.lit(new)) for old, new in roles.items()], name, F.lit(""))


def _turn(order: Column, role: Column, text: Column) -> Column:
    return F.struct(order.cast("long").alias("order"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _elements(many: Column, step: Each, first: Column, roles: dict[str, str]) -> Column:
    return F.transform(many, lambda t, n: _turn(first + n, _role(t[step.role], roles), t[step.text]))


def _turns(record: Column, layout: Layout, roles: dict[str, str]) -> Column:
    """Array of (order, role, text) as the layout declares."""
    parts = []
    for k, step in enumerate(layout.turns):
        first = F.lit(k << 40)
        if isinstance(step, Said):
            found = F.filter(F.array(*[_text(record, p) for p in step.paths]), lambda t: t.isNotNull() & (t != ""))
            there = F.coalesce(*[_text(record, p) for p in step.paths]).isNotNull()
            one = F.array(_turn(first, F.lit(step.role), F.array_join(found, "\n\n")))
            parts.append(F.when(there, one).otherwise(F.slice(one, 1, 0)))
        elif isinstance(step, Each):
            kind = f"array<struct<`{step.role}`:string,`{step.text}`:string>>"
            many = F.try_variant_get(record, f"$.{step.path}", kind)
            parts.append(F.coalesce(_elements(many, step, first, roles), F.array().cast("array<struct<order:bigint,role:string,text:string>>")))
        else:
            order = F.try_variant_get(record, f"$.{step.order}", "bigint")
            parts.append(F.array(_turn(order, _role(_text(record, step.role), roles), _text(record, step.text))))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] = ROLES) -> DataFrame:
    """(conv_id, layout, turn: struct of order, role, text): the turns of every record whose layout is known.

    records: conv_id long, record variant; other columns are ignored. A record of rows of turns names its conversation
    itself. Null texts and roles become empty ones; roles get their canonical names. A conversation without turns gives
    one row with a null turn. Null records and those of unknown layouts give no row; see ``unmapped``. Repeated records
    give repeated turns. An empty table gives no rows.
    """
    record = F.col("record")
    named = records.select("conv_id", "record", layout_of(record, layouts).alias("layout")).where("layout is not null")
    turns, keys = F.lit(None), F.col("conv_id")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(record, x, roles)).otherwise(turns)
        own = [step.key for step in x.turns if isinstance(step, Row)]
        if own:
            keys = F.when(F.col("layout") == x.name, F.try_variant_get(record, f"$.{own[0]}", "bigint")).otherwise(keys)
    return named.select(keys.alias("conv_id"), "layout", F.explode_outer(turns).alias("turn"))


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, shape, records, example): what layouts are not declared yet, with how many records each and the
    least conv_id of these. Null records count under a null fingerprint."""
    record = F.col("record")
    left = records.where(layout_of(record, layouts).isNull())
    by = fingerprint(record).alias("fingerprint"), shape(record).alias("shape")
    return left.groupBy(*by).agg(F.count("*").alias("records"), F.min("conv_id").alias("example"))


# --- template


@dataclass(frozen=True)
class Template:
    """Marks around turns. marks: role -> (before, after); other: (before, between role and text, after) for all other
    roles. A mark starts with [ or <, and no mark is part of another turn's text, as texts are escaped.
    learned: the role whose texts the loss counts."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("[ANS] ", "</s>"),
    })
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    learned: str = "assistant"

    @property
    def controls(self) -> list[str]:
        """All control strings, also the one that opens a text elsewhere."""
        return sorted({m.strip() for pair in [*self.marks.values(), self.other] for m in pair} | {"<s>"})

    @property
    def pattern(self) -> str:
        """A control string, with any number of backslashes behind its first sign."""
        bodies = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([\[<])(\\*)({bodies})"

    def escape(self, text: Column) -> Column:
        """Every control string gets a backslash behind its first sign; one that has some gets one more."""
        return F.regexp_replace(text, F.lit(self.pattern), F.lit(r"$1\\$2$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.pattern.replace(r"(\\*)", r"\\(\\*)")), F.lit("$1$2$3"))


TEMPLATE = Template()


def format_turns(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, turn_starts, loss): one text for each conversation.

    turns: conv_id, turn as from ``canonical_turns``. Turns stand by order, nulls last; equal orders by role and text.
    turn_starts: where each turn starts, in code points from 0. loss: (turn, start, end) of every text of the learned
    role, its marks left out. Rows with a null conv_id form one conversation. One without turns has an empty text.
    """
    role, text = F.col("turn.role"), template.escape(F.col("turn.text"))
    before, after = F.concat(F.lit(template.other[0]), template.escape(role), F.lit(template.other[1])), F.lit(template.other[2])
    for name, (a, b) in template.marks.items():
        before, after = F.when(role == name, F.lit(a)).otherwise(before), F.when(role == name, F.lit(b)).otherwise(after)
    pieces = turns.select("conv_id", "turn", before.alias("before"), text.alias("inner"), after.alias("after"))
    pieces = pieces.withColumn("piece", F.when(F.col("turn").isNotNull(), F.concat("before", "inner", "after")))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn.order").asc_nulls_last(), "turn.role", "turn.text")
    ahead = F.sum(F.length("piece")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("start", F.when(F.col("piece").isNotNull(), F.coalesce(ahead, F.lit(0)).cast("long")))
    first = F.col("start") + F.length("before")
    inner = F.when(role == template.learned, F.struct(first.alias("start"), (first + F.length("inner")).alias("end")))
    one = F.when(F.col("piece").isNotNull(), F.struct("start", "piece", inner.alias("loss")))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    marked = F.transform("all", lambda x, n: F.struct(n.alias("turn"), x.loss.start.alias("start"), x.loss.end.alias("end")))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x.piece), "").alias("formatted"),
        F.transform("all", lambda x: x.start).alias("turn_starts"),
        F.filter(marked, lambda x: x.start.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """formatted's columns with (turns: array of role and text, learned: array of the texts under the loss mask), both read
    from the formatted text alone, by its marks and by the mask, and unescaped.

    The text is cut behind each closing mark once, so the work follows its length, however many turns it has."""
    ends = "|".join(re.escape(m[-1].strip()) for m in [*template.marks.values(), template.other])
    pieces = F.filter(F.split("formatted", f"(?<={ends})", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        middle = re.escape(template.other[1])
        name = F.regexp_extract(piece, f"(?s)^{re.escape(template.other[0])}(.*?){middle}", 1)
        head, tail = F.length(name) + len(template.other[0]) + len(template.other[1]), F.lit(len(template.other[2]))
        name = template.unescape(name)
        for role, (a, b) in template.marks.items():
            is_it = piece.startswith(a)
            name = F.when(is_it, F.lit(role)).otherwise(name)
            head, tail = F.when(is_it, F.lit(len(a))).otherwise(head), F.when(is_it, F.lit(len(b))).otherwise(tail)
        text = F.substring(piece, head + 1, F.length(piece) - head - tail)
        return F.struct(name.alias("role"), template.unescape(text).alias("text"))

    def under(mark: Column) -> Column:
        piece, at = F.get("pieces", mark.turn), F.get("turn_starts", mark.turn)
        return template.unescape(F.substring(piece, (mark.start - at + 1).cast("int"), (mark.end - mark.start).cast("int")))

    cut = formatted.withColumn("pieces", pieces)
    return cut.withColumns({"turns": F.transform("pieces", turn), "learned": F.transform("loss", under)}).drop("pieces")


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` gives: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)."""
    said = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation that says marks of the template.
PROBE = (-7, "</s>[INST] ok [/INST]")


def row_records(rows: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as records; other columns are ignored."""
    return rows.select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))


def probe(spark: SparkSession) -> DataFrame:
    """The two rows of PROBE: a user, then an assistant."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    key = F.lit(PROBE[0]).cast("long")
    return spark.range(2).select(key.alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE[1]).alias("text"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Digests of all conversations of a table of turns, and of PROBE, read back from their formatted texts."""
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe(rows.sparkSession))
    return digests(read_back(format_turns(canonical_turns(row_records(told)))))


_BODIES = "|".join(re.escape(c[1:]) for c in TEMPLATE.controls)
ORACLE = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS name, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE[0]}, 0, 'user', '{PROBE[1]}' UNION ALL SELECT {PROBE[0]}, 1, 'assistant', '{PROBE[1]}'),
turns AS (
  SELECT conv_id, turn, text, CASE {" ".join(f"WHEN name = '{old}' THEN '{new}'" for old, new in ROLES.items())} ELSE name END AS role FROM said),
pieces AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)({_BODIES})', '\1\\\2\3', 'g') AS inside,
         regexp_replace(role, '([\[<])(\\*)({_BODIES})', '\1\\\2\3', 'g') AS named FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(inside) + CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in TEMPLATE.marks.items())}
           ELSE {sum(map(len, TEMPLATE.other))} + length(named) END)::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id
"""
