"""Chat formatting by schema fingerprints (operator 13).

Records come in many layouts: one message a record, prompt and completion, instruction with
input and output, lists of messages. A layout is known by the nested field paths that a record has: those
paths that any layout names are looked for, the ones found are listed, and the MD5 of the list is the
record's fingerprint. A table of fingerprints, made from the declarative LAYOUTS, selects the mapping that turns
the record into canonical turns; other fields of a record don't matter. A record that fits no layout has a
null layout and no turns, so `canonical(...).where("layout IS NULL")` lists what was left out.

The template marks each turn and escapes control strings in texts with a backslash, backslashes included, so that the text
can be read back exactly. Output is one row a turn; a conversation's text is its rows' text, in
order. loss_start and loss_end bound, in the row's text, what a model is trained on: the assistant's text.
`read_back` parses that text as one stream and needs no rows, but for the place of the loss.

Nulls: a null text is empty, so are null roles; a null conv_id is a conversation like any other; null or malformed JSON
fits no layout. Turns are in order of turn, nulls first, then of place in their record; equal ones by role and by the MD5 of the
text. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquilt.llm.common import text_key, unused
from terraquilt.llm.folds import fold, grouped

# --- layouts --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """`turns` are (role, path of the text), the role being a constant or, after an @, the path of one. Paths are
    fields joined by dots; [] after a field means each of its elements. `needs` must be there, `may` may be."""

    name: str
    turns: tuple[tuple[str, str], ...]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        subsets = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [fingerprint_of(self.needs + more) for more in subsets]


def fingerprint_of(paths: Iterable[str]) -> str:
    return hashlib.md5(",".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("turn", (("@role", "text"),), ("role", "text")),
    Layout("content", (("@role", "content"),), ("role", "content")),
    Layout("speaker", (("@from", "value"),), ("from", "value")),
    Layout("message", (("@message.role", "message.content"),), ("message.role", "message.content")),
    Layout("messages", (("@messages[].role", "messages[].content"),), ("messages[].role", "messages[].content"), ("prompt",)),
    Layout("conversations", (("@conversations[].from", "conversations[].value"),), ("conversations[].from", "conversations[].value"), ("system",)),
    Layout("prompt", (("system", "system"), ("user", "prompt")), ("prompt",), ("system",)),
    Layout("completion", (("assistant", "completion"),), ("completion",)),
    Layout("system", (("system", "system"),), ("system",)),
    *(
        Layout(f"prompt and {answer}", (("system", "system"), ("user", "prompt"), ("assistant", answer)), ("prompt", answer), ("system",))
        for answer in ("completion", "response", "answer")
    ),
    Layout("question", (("system", "system"), ("user", "question"), ("assistant", "answer")), ("question", "answer"), ("system",)),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), ("instruction", "output"), ("input", "system")),
)
#: What layouts call the roles, and the canonical names. Others stay as they are.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _get(record: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def _elements(record: Column, path: str) -> Column:
    return _get(record, path, "array<variant>")


def _present(record: Column, path: str) -> Column:
    if "[]." not in path:
        return _get(record, path).isNotNull()
    outer, inner = path.split("[].")
    # An empty list has no elements to show their fields: it has them all.
    return F.coalesce(F.forall(_elements(record, outer), lambda m: _get(m, inner).isNotNull()), F.lit(False))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """MD5 of the sorted field paths of a variant that the layouts know."""
    paths = sorted({p for x in layouts for p in x.needs + x.may})
    found = F.filter(F.array(*(F.when(_present(record, p), F.lit(p)) for p in paths)), lambda p: p.isNotNull())
    return F.md5(F.array_join(found, ",").cast("binary"))


def _role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.try_element_at(names, role), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    parts = []
    for role, path in layout.turns:
        if "[]." in path:
            outer, text = path.split("[].")
            name = role.split("[].")[1]
            own = F.transform(_elements(record, outer), lambda m: _turn(_role(_get(m, name, "string")), _get(m, text, "string")))
        else:
            said = _role(_get(record, role[1:], "string")) if role.startswith("@") else F.lit(role)
            own = F.array(_turn(said, _get(record, path, "string")))
            if path in layout.may:
                own = F.when(_present(record, path), own).otherwise(F.filter(own, lambda t: F.lit(False)))
        parts.append(own)
    return F.concat(*parts)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records, whose column `record` is JSON text or a variant, with layout (its name) and turns
    (array of role and text) after their own columns. Narrow."""
    taken = unused(records, "variant")
    own = F.col(record) if dict(records.dtypes)[record] == "variant" else F.try_parse_json(F.col(record))
    known = {}
    for at, layout in enumerate(layouts):
        for f in layout.fingerprints():
            if known.setdefault(f, at) != at:
                raise ValueError(f"layouts {layouts[known[f]].name} and {layout.name} have the same fields")
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    v, at = F.col(taken), unused(records, "layout_no")
    rows = records.withColumn(taken, own).withColumn(at, F.try_element_at(table, fingerprint(v, layouts)))
    name = reduce(lambda c, i: c.when(F.col(at) == i, layouts[i].name), range(1, len(layouts)), F.when(F.col(at) == 0, layouts[0].name))
    turns = reduce(lambda c, i: c.when(F.col(at) == i, _turns(v, layouts[i])), range(1, len(layouts)), F.when(F.col(at) == 0, _turns(v, layouts[0])))
    return rows.withColumn("layout", name).withColumn("turns", turns).drop(taken, at)


# --- template -------------------------------------------------------------------------------------

#: Marks of a turn's beginning and end. Other roles are named, between NAMED.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
NAMED, NAMED_END = ("[ROLE]", "[/ROLE]"), "</s>"
#: Strings that a text must not hold as they are.
CONTROL = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")


def escaped(text: Column) -> Column:
    """Backslashes doubled and one put after the first character of each control string."""
    rest = "|".join(re.escape(c[1:]) for c in CONTROL)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={rest})", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, place, role, key, text, loss_start and loss_end of turns (conv_id, turn, place, role,
    text). Narrow: columns conv_id, turn, place, role, key say how rows follow each other."""
    role, said = F.col("role"), F.coalesce(F.col("text"), F.lit(""))
    text = escaped(said)
    begin, end = F.concat(F.lit(NAMED[0]), escaped(role), F.lit(NAMED[1])), F.lit(NAMED_END)
    for name, (b, e) in MARKS.items():
        begin, end = F.when(role == name, b).otherwise(begin), F.when(role == name, e).otherwise(end)
    rows = turns.withColumn("role", F.coalesce(role, F.lit(""))).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "place", "role", text_key(said).alias("key"),
        begin.alias("begin"), text.alias("body"), end.alias("end"),
    )
    size, loss = F.length("begin"), F.col("role") == "assistant"
    return rows.select(
        "conv_id", "turn", "place", "role", "key", F.concat("begin", "body", "end").alias("text"),
        F.when(loss, size).alias("loss_start"), F.when(loss, size + F.length("body")).alias("loss_end"),
    )


def _pattern() -> re.Pattern:
    sections = [rf"(?P<{n}>{re.escape(b)}(.*?){re.escape(e)})" for n, (b, e) in MARKS.items() if b]
    sections.append(rf"(?P<other>{re.escape(NAMED[0])}(.*?){re.escape(NAMED[1])}(.*?){re.escape(NAMED_END)})")
    sections.append(rf"(?P<assistant>(.*?){re.escape(MARKS['assistant'][1])})")
    return re.compile("|".join(sections), re.S)


class _Reader:
    """Reads a conversation's text as a stream, keeping what doesn't yet make a turn."""

    pattern = _pattern()

    def __init__(self, conv_id):
        self.conv_id, self.rest, self.turns, self.size, self.loss = conv_id, "", 0, 0, 0
        self.said, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, texts: list[str], starts: list, ends: list) -> Iterable[tuple]:
        for text, start, end in zip(texts, starts, ends):
            self.size += len(text)
            if start is not None:
                own = unescaped(text[start:end])
                self.loss += len(own)
                self.trained.update(own.encode())
        text, at = self.rest + "".join(texts), 0
        while found := self.pattern.match(text, at):
            groups = [g for g in found.groups()[0:] if g is not None]
            role, own = found.lastgroup, groups[-1]
            role = unescaped(groups[-2]) if role == "other" else role
            self.said.update(f"{role}\n{unescaped(own)}\n".encode())
            self.turns += 1
            at = found.end()
        self.rest = text[at:]
        return ()

    def end(self) -> Iterable[tuple]:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id} ends within a turn")
        return [(self.conv_id, self.turns, self.said.hexdigest(), self.loss, self.trained.hexdigest(), self.size)]


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars and loss_sha256 (of
    all text under the loss mask, unescaped) and formatted_chars of formatted rows."""
    kind = dict(output.dtypes)["conv_id"]
    rows = grouped(output, ["conv_id"], [F.asc_nulls_first("turn"), "place", "role", "key"])
    return fold(
        rows.select("conv_id", "text", "loss_start", "loss_end"), 1, _Reader,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def dressed(conversations: DataFrame) -> DataFrame:
    """Rows of conversations as JSON records of several layouts, one for each fourth of the conversations:
    turns as they are, speakers, nested messages, and prompts and completions."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    which = F.coalesce(F.pmod(F.xxhash64("conv_id"), F.lit(4)), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in (("user", "human"), ("assistant", "gpt")) for x in pair))
    plain = F.to_json(F.struct(role.alias("role"), text.alias("text")))
    # Only names that ROLE_NAMES gives back.
    speaker = F.to_json(F.struct(F.coalesce(F.try_element_at(names, role), role).alias("from"), text.alias("value")))
    nested = F.to_json(F.struct(F.struct(role.alias("role"), text.alias("content")).alias("message")))
    part = (
        F.when(role == "user", F.to_json(F.struct(text.alias("prompt"))))
        .when(role == "assistant", F.to_json(F.struct(text.alias("completion"))))
        .when(role == "system", F.to_json(F.struct(text.alias("system"))))
        .otherwise(plain)
    )
    record = F.when(which == 1, speaker).when(which == 2, nested).when(which == 3, part).otherwise(plain)
    return conversations.select("conv_id", "turn", record.alias("record"))


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place (in its record), role and text of canonical records."""
    # The outer form, as the planner would compute an array once more to see whether it is empty.
    found = rows.select("conv_id", "turn", F.posexplode_outer("turns").alias("place", "own"))
    return found.where("own IS NOT NULL").select("conv_id", "turn", "place", "own.role", "own.text")
