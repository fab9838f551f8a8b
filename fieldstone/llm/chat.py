"""Chat formatting by schema fingerprints, all in DataFrame functions.

Chat data comes in many layouts: rows by turn, arrays of messages under various names, instruction and
output columns, prompt and completion pairs, or JSON text of any of these.  The nested field paths of
a layout (from the root, names and kinds, sorted) are hashed; the hash selects a declarative mapping
(``MAPPINGS``) that turns rows of that layout into canonical turns: an array of (role, text).  Paths that no layout
names, such as ids and metadata, are left out before hashing.  For JSON text every record is fingerprinted by
itself, so one column may mix layouts; ``layouts_of`` counts the records of each, also of none.

The template is, per turn, ``<|im_start|>role\\n``, the text, ``<|im_end|>\\n``.  Control strings inside
texts are escaped reversibly: one backslash is put after the ``<`` of every ``<``, backslashes, ``|``;
taking one away again gives back every text.  Roles are percent-encoded where they hold anything
else than letters, digits and ``.-_*``.  The formatted conversation is kept as segments, each under the loss
mask or not: the texts of assistant turns are, everything else is not.

Defined results: a null text is empty, a null role is the empty role; turns with equal numbers are
ordered by role and text, repeated turns stay; a null conversation id is a conversation; an empty table gives
none; very long texts are formatted whole.  Roles of rows by turn are kept as they are; in the other layouts
the names in ``ROLES`` are replaced.  An empty array of messages is a conversation without turns.  A JSON
record whose fingerprint no mapping has gets null turns; a table of that kind is refused.  Other columns are
ignored, unless one has the path of another layout, which makes the fingerprint another one.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sketch import let

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
# Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


def kind(of: T.DataType) -> str:
    if isinstance(of, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "number" if isinstance(of, T.NumericType) else of.simpleString()


def field_paths(of: T.DataType, path: str = "") -> list[str]:
    """``a.b[].c:string`` for every leaf, sorted."""
    if isinstance(of, T.StructType):
        return sorted(p for f in of.fields for p in field_paths(f.dataType, f"{path}.{f.name}".lstrip(".")))
    if isinstance(of, T.ArrayType):
        return field_paths(of.elementType, path + "[]")
    return [f"{path}:{kind(of)}"]


def fingerprint(paths: list[str]) -> str:
    """The hash of the sorted paths, 16 hex digits."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


# Layout name -> (required paths, optional paths, where the turns are).  A mapping is data only:
#   rows:   conversation, order, role and text columns of one turn a row
#   list:   array column with the names of its role and text fields; the text may be a list of parts with a ``text``
#   fixed:  (role, fields) pairs; a pair whose fields are all empty is left out unless it is the assistant's
LAYOUTS = {
    "turn rows": (["conv_id:number", "turn:number", "role:string", "text:string"], [], {"rows": ("conv_id", "turn", "role", "text")}),
    "messages": (["messages[].role:string", "messages[].content:string"], [], {"list": ("messages", "role", "content")}),
    "message parts": (["messages[].role:string", "messages[].content[].text:string"], ["messages[].content[].type:string"], {"list": ("messages", "role", "content")}),
    "message texts or parts": (["messages[].role:string", "messages[].content:variant"], [], {"list": ("messages", "role", "content")}),
    "message texts": (["messages[].role:string", "messages[].text:string"], [], {"list": ("messages", "role", "text")}),
    "no messages": (["messages[]:empty"], [], {"list": ("messages", "role", "content")}),
    "conversations": (["conversations[].from:string", "conversations[].value:string"], [], {"list": ("conversations", "from", "value")}),
    "no conversations": (["conversations[]:empty"], [], {"list": ("conversations", "from", "value")}),
    "dialog": (["dialog[].speaker:string", "dialog[].text:string"], [], {"list": ("dialog", "speaker", "text")}),
    "no dialog": (["dialog[]:empty"], [], {"list": ("dialog", "speaker", "text")}),
    "instruction": (["instruction:string", "output:string"], ["input:string", "system:string"], {"fixed": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))}),
    "prompt": (["prompt:string", "completion:string"], ["system:string"], {"fixed": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))}),
    "prompt response": (["prompt:string", "response:string"], ["system:string"], {"fixed": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))}),
    "question": (["question:string", "answer:string"], ["system:string"], {"fixed": (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))}),
    "system question": (["question:string", "response:string"], ["system_prompt:string"], {"fixed": (("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))}),
}
KNOWN = sorted({p for required, optional, _ in LAYOUTS.values() for p in (*required, *optional)})
MAPPINGS = {
    fingerprint([*required, *some]): (name, mapping)
    for name, (required, optional, mapping) in LAYOUTS.items()
    for n in range(len(optional) + 1)
    for some in combinations(optional, n)
}


def canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    given = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(known, F.lower(given)), given)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _fixed(pairs, get) -> Column:
    """Turns from single fields; an input below an instruction is set off by an empty line."""
    made = []
    for role, names in pairs:
        text = F.array_join(F.filter(F.array(*[F.coalesce(get(n), F.lit("")) for n in names]), lambda x: x != ""), "\n\n")
        made.append(_turn(F.lit(role), text))
    return F.filter(F.array(*made), lambda t: (t["role"] == "assistant") | (t["text"] != ""))


def _texts(content: Column, of: T.DataType) -> Column:
    """A message's text: itself, or the texts of its parts, nothing between."""
    return F.array_join(F.transform(content, lambda p: p["text"]), "") if isinstance(of, T.ArrayType) else content


def turns_of(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Canonical turns of a table in any known layout, chosen by the fingerprint of its schema: the
    columns ``keep`` (for rows by turn: the conversation's id) and ``turns``."""
    keep = keep or []
    body = records.drop(*keep) if keep else records
    found = MAPPINGS.get(fingerprint([p for p in field_paths(body.schema) if p in KNOWN]))
    if found is None:
        raise ValueError(f"no mapping has the fields {field_paths(body.schema)}")
    name, mapping = found
    if "rows" in mapping:
        conv, order, role, text = mapping["rows"]
        given = lambda c: F.coalesce(F.col(c), F.lit(""))
        one = F.struct(F.col(order).alias("turn"), given(role).alias("role"), given(text).alias("text"))
        grouped = records.groupBy(conv).agg(F.sort_array(F.collect_list(one)).alias("turns"))
        return grouped.select(conv, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if "list" in mapping:
        column, role, text = mapping["list"]
        of = records.schema[column].dataType.elementType
        made = F.transform(F.col(column), lambda m: _turn(canonical_role(m[role]), _texts(m[text], of[text].dataType)))
        return records.select(*keep, F.coalesce(made, F.array().cast(TURNS)).alias("turns"))
    there = set(body.columns)
    return records.select(*keep, _fixed(mapping["fixed"], lambda n: F.col(n) if n in there else F.lit("")).alias("turns"))


# What a variant's shape is made of: a name and its colon, the start of an object or array, an end, a type.
_SHAPE = r"(?:`(?:[^`]|``)*`|[^<>,:` ]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?"


def json_paths(record: Column) -> Column:
    """A variant's nested field paths, from the root, as ``field_paths`` gives those of a schema; the items of an
    empty array and of an array of nulls have the kind ``empty``."""
    parts = F.regexp_extract_all(F.schema_of_variant(record), F.lit(f"({_SHAPE})"), 1)
    state = F.struct(F.array(F.lit("")).alias("up"), F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def read(s: Column, part: Column) -> Column:
        """``up``: the paths of the open objects and arrays, ``at``: of the value that comes next."""
        up, at, out = s["up"], s["at"], s["out"]
        inside = F.element_at(up, -1)
        name = F.regexp_replace(F.regexp_replace(part, ": $", ""), "^`|`$", "")
        to = lambda up, at, out: F.struct(up.alias("up"), at.alias("at"), out.alias("out"))
        kind = F.when(part.isin("STRING", "VOID"), F.when((part == "VOID") & at.endswith("[]"), "empty").otherwise("string"))
        kind = kind.when(part.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise(F.lower(part))
        return (
            F.when(part.endswith(": "), to(up, F.when(inside == "", name).otherwise(F.concat(inside, F.lit("."), name)), out))
            .when(part == "OBJECT<", to(F.array_append(up, at), at, out))
            .when(part == "ARRAY<", to(F.array_append(up, F.concat(at, F.lit("[]"))), F.concat(at, F.lit("[]")), out))
            .when(part == ">", to(F.slice(up, 1, F.size(up) - 1), F.element_at(up, -1), out))
            .otherwise(to(up, at, F.array_append(out, F.concat(at, F.lit(":"), kind))))
        )

    return F.aggregate(parts, state, read, lambda s: s["out"])


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of a variant's field paths, those that any layout names."""
    known = F.array_sort(F.array_intersect(json_paths(record), F.array(*map(F.lit, KNOWN))))
    return F.substring(F.sha2(F.array_join(known, "\n").cast("binary"), 256), 1, 16)


def _json_texts(content: Column) -> Column:
    """A message's text in a variant: itself, or the texts of its parts, nothing between."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), joined).otherwise(F.try_variant_get(content, "$", "string"))


def json_turns(text: Column) -> Column:
    """Canonical turns of a JSON record, by the mapping that its own fingerprint selects."""

    def of(record: Column) -> Column:
        def selected(mark: Column) -> Column:
            out = F.lit(None).cast(TURNS)
            for name, (_, _, mapping) in LAYOUTS.items():
                keys = [k for k, (n, _) in MAPPINGS.items() if n == name]
                if "list" in mapping:
                    out = F.when(mark.isin(keys), _json_list(record, *mapping["list"])).otherwise(out)
                elif "fixed" in mapping:
                    out = F.when(mark.isin(keys), _fixed(mapping["fixed"], lambda n: F.try_variant_get(record, f"$.{n}", "string"))).otherwise(out)
            return out

        return let(json_fingerprint(record), selected)

    return let(F.try_parse_json(text), of)


def _json_list(record: Column, column: str, role: str, text: str) -> Column:
    items = F.try_variant_get(record, f"$.{column}", "array<variant>")
    item = lambda m: _turn(canonical_role(F.try_variant_get(m, f"$.{role}", "string")), _json_texts(F.try_variant_get(m, f"$.{text}", "variant")))
    return F.transform(items, item)


def layouts_of(records: DataFrame, text: str) -> DataFrame:
    """(fingerprint, layout, records): how many JSON records have each fingerprint; the layout is null where no
    mapping has it, the fingerprint too where the text is no JSON."""
    marked = records.select(let(F.try_parse_json(F.col(text)), lambda r: F.when(r.isNotNull(), json_fingerprint(r))).alias("fingerprint"))
    name = F.lit(None).cast("string")
    for key, (layout, mapping) in MAPPINGS.items():
        if "rows" not in mapping:
            name = F.when(F.col("fingerprint") == key, layout).otherwise(name)
    return marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records")).select("fingerprint", name.alias("layout"), "records")


def escape(text: Column) -> Column:
    """One more backslash in every ``<``, backslashes, ``|``: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Takes that backslash away."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def segments(turns: Column) -> Column:
    """The formatted conversation in order: array<struct<text, loss>>, three segments a turn."""

    def of(t: Column) -> Column:
        head = F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"]), t["role"] == "assistant"), part(F.lit(END + "\n"), F.lit(False)))

    return F.flatten(F.transform(turns, of))


def joined(parts: Column) -> Column:
    """The formatted conversation as one string."""
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The turns, read back from a formatted conversation."""

    def of(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(END) - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0), of)


def masked_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns`` with ``segments`` and ``formatted`` beside it."""
    return turns.withColumn("segments", segments(F.col("turns"))).withColumn("formatted", joined(F.col("segments")))
