"""Chat formatting by a finite-state machine over roles and a declarative template.

Every turn becomes segments, each a piece of output with its loss flag; control strings of the
template inside roles and texts are escaped reversibly.  The machine reads the turns of a
conversation in order and accepts ``[system] (user assistant)* [user]``; where it does not, the
conversation is still formatted whole and the first offending turn is reported.

Cases: a NULL text is empty, a NULL role the empty role; unknown roles get the template's form for
other roles and are never valid; turns with equal numbers are ordered by their formatted output, NULL turns
come first; repeated rows are turns of their own; rows without a conversation id form one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.text import pieces


@dataclass(frozen=True)
class Template:
    """What surrounds the turns of each role; a role in ``learned`` has its text under the loss mask."""

    around: tuple[tuple[str, str, str], ...]  # role, before, after
    other: tuple[str, str, str]  # before the role, between role and text, after
    learned: frozenset[str]

    @property
    def controls(self) -> list[str]:
        marks = {m for _, before, after in self.around for m in (before, after)} | set(self.other)
        return sorted({c for m in marks for c in re.findall(r"</?s>|\[/?[A-Z]+\]|<</?[A-Z]+>>", m)}, key=lambda c: (-len(c), c))


#: Instruction template (fixed value): turns of every role end with </s>.
INSTRUCT = Template(
    around=(("system", "<<SYS>>", "<</SYS>></s>"), ("user", "[INST]", "[/INST]</s>"), ("assistant", "<s>", "</s>")),
    other=("<<ROLE>>", "<</ROLE>>", "</s>"),
    learned=frozenset({"assistant"}),
)


class Codec:
    """Formats and reads back single turns.  A control string is broken by a backslash after its first character."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.around = {role: (before, after) for role, before, after in template.around}
        split = [(re.escape(c[0]), re.escape(c[1:])) for c in template.controls]
        self.whole = re.compile("|".join(rf"(?<={a})(\\*)(?={b})" for a, b in split))
        self.broken = re.compile("|".join(rf"(?<={a})\\(\\*)(?={b})" for a, b in split))

    def escape(self, text: str) -> str:
        return self.whole.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self.broken.sub(lambda m: m[0][1:], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        body = (self.escape(text), role in self.template.learned)
        if role in self.around:
            before, after = self.around[role]
            return [(before, False), body, (after, False)]
        first, second, last = self.template.other
        return [(first + self.escape(role) + second, False), body, (last, False)]

    def read(self, output: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, (before, after) in self.around.items():
            if output.startswith(before):
                return role, self.unescape(output[len(before) : len(output) - len(after)])
        first, second, last = self.template.other
        at = output.index(second)
        return self.unescape(output[len(first) : at]), self.unescape(output[at + len(second) : len(output) - len(last)])


#: Allowed roles after each state; the state is the last role, "" before the first turn.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def formatted_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, segments array<struct<text, loss>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in pieces(batches):
            turns = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            rows = [[{"text": t, "loss": f} for t, f in codec.segments(role or "", text or "")] for role, text in turns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["conv_id", "turn", "segments"])

    source = conversations.select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segments array<struct<text: string, loss: boolean>>")


class _Reader:
    """Digests of one conversation, read turn by turn from its formatted output."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.turns, self.state, self.bad = codec, 0, "", None
        self.all, self.loss, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0

    def take(self, segments: list[dict]) -> None:
        output = "".join(s["text"] for s in segments)
        role, text = self.codec.read(output)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for s in segments:
            if s["loss"]:
                learned = self.codec.unescape(s["text"])
                self.loss.update(learned.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(learned)
        if self.bad is None and role not in NEXT.get(self.state, ()):
            self.bad = self.turns
        self.state = role
        self.turns += 1
        self.chars += len(output)

    def row(self, key) -> tuple:
        return key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.bad is None, self.bad


def conversation_digests(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation what its formatted turns read back to, and whether the machine accepts the order.

    Conversations are streamed in order through sorted partitions: a task holds one turn at a time, so
    a conversation of any length needs only the state of its digests.
    """
    ordered = turns.withColumn("__tie", F.concat_ws("", F.col("segments.text")))
    ordered = ordered.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "__tie").select("conv_id", "segments")
    key_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "bad_turn"]
        reader, current, started = _Reader(codec), None, False
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
            rows = []
            for key, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if started and key != current:
                    rows.append(reader.row(current))
                    reader = _Reader(codec)
                current, started = key, True
                reader.take(segments)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(reader.row(current), kinds)], names)

    return ordered.mapInArrow(
        run, f"conv_id {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn long"
    )


def sql(template: Template = INSTRUCT) -> str:
    """The digests over ``conversations`` and the probe conversation -7 in SQL, from the same declarative template."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        for c in template.controls:
            pattern = rf"({re.escape(c[0])})(\\*{re.escape(c[1:])})"
            column = rf"regexp_replace({column}, {quoted(pattern)}, '\1\\\2', 'g')"
        return column

    size = f"length({escaped('text')})"
    whens = " ".join(f"WHEN {quoted(role)} THEN {len(before) + len(after)} + {size}" for role, before, after in template.around)
    other = sum(map(len, template.other))
    learned = ", ".join(map(quoted, sorted(template.learned)))
    allowed = ", ".join(f"({quoted(state)}, {quoted(role)})" for state, roles in NEXT.items() for role in roles)
    return f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CASE role {whens} ELSE {other} + length({escaped('role')}) + {size} END AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, (lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn), role) IN ({allowed}) AS fits FROM raw)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learned})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role IN ({learned})), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(fits) AS valid, min(place) FILTER (NOT fits) AS bad_turn
FROM t GROUP BY conv_id"""
