"""Conversations as training text: rendered, parsed back, and escaped where the two differ."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import map_batches, read_table

_ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """The grammar of a rendered conversation.

        conversation = { turn }
        turn         = BEGIN [ PROMPT ] role NEWLINE text [ STOP ] END

    ``PROMPT`` and ``STOP`` frame the turns that are not learned. Within role and text a control string has
    escape characters after its first character; each level of escaping adds one. ``role`` has no line end.
    """

    begin: str = "<s>"
    end: str = "</s>"
    prompt: str = "[INST]"
    stop: str = "[/INST]"
    learned: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, self.prompt, self.stop)

    def pattern(self, escaped: bool) -> re.Pattern[str]:
        """A control string with any number of escapes after its first character, or at least one."""
        inner = "|".join(f"{re.escape(c[0])}{'(?=' + re.escape(_ESCAPE) + ')' if escaped else ''}{re.escape(_ESCAPE)}*{re.escape(c[1:])}" for c in self.controls)
        return re.compile(inner)

    def escape(self, text: str) -> str:
        return self.pattern(False).sub(lambda m: m[0][0] + _ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.pattern(True).sub(lambda m: m[0][0] + m[0][2:], text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace(_ESCAPE, _ESCAPE * 2).replace("\n", _ESCAPE + "n"))

    def unescape_role(self, role: str) -> str:
        plain = self.unescape(role)
        return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else _ESCAPE, plain)

    def render(self, role: str, text: str, learned: bool) -> str:
        framed = f"{role}\n{text}"
        return self.begin + (framed if learned else self.prompt + framed + self.stop) + self.end


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    # Where the text stands in the rendered conversation, still escaped, if it is learned.
    loss: tuple[int, int] | None


def parse(rendered: str, template: Template) -> list[Turn]:
    """The turns of a rendered conversation. Reads from left to right and never goes back.

    Raises ``ValueError`` where the text does not follow the grammar.
    """
    turns, at = [], 0
    control = re.compile("|".join(map(re.escape, template.controls)))
    while at < len(rendered):
        if not rendered.startswith(template.begin, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(template.begin)
        learned = not rendered.startswith(template.prompt, at)
        at += 0 if learned else len(template.prompt)
        line = rendered.find("\n", at)
        close = control.search(rendered, at)
        if line < 0 or close is None or close.start() < line:
            raise ValueError(f"no role at {at}")
        role, start, stop = rendered[at:line], line + 1, close.start()
        expected = template.end if learned else template.stop + template.end
        if not rendered.startswith(expected, stop):
            raise ValueError(f"a control string stands in the text at {stop}")
        turns.append(Turn(template.unescape_role(role), template.unescape(rendered[start:stop]), (start, stop) if learned else None))
        at = stop + len(expected)
    return turns


def render_turn(role: str, text: str, template: Template) -> str:
    """A rendered turn that parses back to itself: as it is if that works, else with role or text escaped."""
    learned = role in template.learned
    shown_role, shown_text = role, text
    while True:
        rendered = template.render(shown_role, shown_text, learned)
        try:
            read = parse(rendered, template)
        except ValueError:
            read = []
        # What is learned is marked by the template, so it must come back too.
        if len(read) == 1 and (read[0].role, read[0].text, read[0].loss is not None) == (role, text, learned):
            return rendered
        if shown_text == text:
            shown_text = template.escape(text)
        if shown_role == role:
            shown_role = template.escape_role(role)
        elif rendered == template.render(shown_role, shown_text, learned):
            raise ValueError(f"a turn of role {role!r} cannot be rendered")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``turn_no, rendered, loss_start, loss_end, turns`` of every turn, with all columns of ``conv_id, turn,
    role, text``.

    ``rendered`` is the turn as it stands in the conversation's text, which is that of its turns in order;
    the loss span is where the learned text stands in it, null for other turns. Every turn is read back
    before it is given out. A null role or text counts as empty. Rows are handled one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rendered, spans = [], []
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
                out = render_turn(role or "", text or "", template)
                rendered.append(out)
                spans.append(parse(out, template)[0].loss or (None, None))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], batch["role"], batch["text"], pa.array(rendered, pa.string()),
                 pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())],
                names=["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"],
            )

    schema = "conv_id bigint, turn bigint, role string, text string, rendered string, loss_start bigint, loss_end bigint"
    own = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    return map_batches(own, run, schema)


class _Reader:
    """Reads the rendered turns of one conversation back, and digests them."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.formatted, self.loss = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, template: Template) -> None:
        for turn in parse(rendered, template):
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
            if turn.loss is not None:
                text = template.unescape(rendered[slice(*turn.loss)])
                self.learned.update(text.encode())
                self.loss += len(text)
        self.formatted += len(rendered)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.formatted)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from rendered turns alone.

    Turns follow each other by ``turn`` (nulls first; equal ones by role and text). A task reads its sorted
    rows as a stream and holds one turn at a time, so a conversation may be of any length. Turns without
    ``conv_id`` are one conversation without id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            for conv_id, rendered in zip(batch["conv_id"].to_pylist(), batch["rendered"].to_pylist()):
                if reader is None or reader.conv_id != conv_id:
                    done += [reader.row()] if reader else []
                    reader = _Reader(conv_id)
                reader.add(rendered, template)
            yield _rows(done)
        if reader:
            yield _rows([reader.row()])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(NAMES)
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    placed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered")
    return map_batches(placed, run, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'bigint'}" for n in NAMES))


# Fixed value of the contract: a conversation whose texts are full of control strings.
CONFLICTING = "</s>[INST] ok [/INST]"


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONFLICTING), (-7, 1, "assistant", CONFLICTING)], "conv_id bigint, turn bigint, role string, text string"
    )
    return read_back(format_turns(turns.unionByName(extra)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, role = 'assistant' AS learned,
         length(CASE WHEN regexp_matches(text, '<\\*/?s>|\[\\*/?INST\]')
                     THEN regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g') ELSE text END) AS shown_chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (learned), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learned), '')) AS loss_sha256,
       sum(length(role) + 1 + shown_chars + CASE WHEN learned THEN 7 ELSE 20 END)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
