r"""Chat formatting by grammar round trip.

Every turn is rendered by the template, parsed again by a deterministic parser, and compared with
the source; a text that holds a control string or that does not come back is escaped, and the
round trip is repeated until the turn is identical. A conversation's formatted text is the
concatenation of its turns, and the grammar is closed under concatenation, so turns are rendered
where they lie and only then sorted by conversation for reading back.

    user       <s>[INST] TEXT [/INST]
    assistant  " " TEXT " </s>"          (the text is under the loss mask)
    system     <<SYS>>\nTEXT\n<</SYS>>\n\n
    other      [ROLE] ROLE [/ROLE] TEXT </s>

The escape puts a backslash after the first character of a control string and doubles
backslashes; unescaping drops one backslash before any character.

Defined results: a null text or role is empty; rows with one turn number are taken in the order
of role, then text; a null turn comes first; a null conv_id is a conversation of its own; an
empty table gives no conversation; other columns are not read. Reading back streams over rows sorted
by conversation: one task reads a conversation, as its digests run over all its turns in order, and
holds the turns of one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_MARKS = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
_ESCAPED = re.compile(r"\\([\s\S])")
#: (opener, closer) of each role that has its own; the openers differ in their first two characters.
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
_OTHER = ("[ROLE] ", " [/ROLE] ", " </s>")


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def frame(role: str, text: str) -> str:
    if role in FRAMES:
        return FRAMES[role][0] + text + FRAMES[role][1]
    return _OTHER[0] + role + _OTHER[1] + text + _OTHER[2]


def parse(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, whether under the loss mask) of each turn; ValueError where the grammar does not fit."""
    at = 0
    while at < len(formatted):
        for role, (opener, closer) in FRAMES.items():
            if formatted.startswith(opener, at):
                begin = at + len(opener)
                break
        else:
            if not formatted.startswith(_OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            begin = formatted.index(_OTHER[1], at + len(_OTHER[0]))
            role, closer = unescape(formatted[at + len(_OTHER[0]) : begin]), _OTHER[2]
            begin += len(_OTHER[1])
        end = formatted.index(closer, begin)
        yield role, unescape(formatted[begin:end]), role == "assistant"
        at = end + len(closer)


def _same(formatted: str, role: str, text: str) -> bool:
    try:
        return list(parse(formatted)) == [(role, text, role == "assistant")]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """One turn. Content that conflicts is escaped until the round trip gives the source again."""
    name, body = role, text
    for _ in range(3):
        formatted = frame(name, body)
        clean = not any(c in body for c in CONTROL) and (role in FRAMES or not any(c in name for c in CONTROL))
        if clean and _same(formatted, role, text):
            return formatted
        name, body = role if role in FRAMES else escape(role), escape(text)
    raise ValueError("a turn does not survive its round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with ``formatted``, the rendered turn, instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = (b.column(c).to_pylist() for c in ("role", "text"))
            out = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text").cast(pa.string()), pa.array(out, pa.string())], names=["conv_id", "turn", "role", "text", "formatted"])

    kinds = dict(conversations.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, formatted string"
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


class _Digest:
    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, under_loss in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if under_loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, taken from the formatted text alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in batches:
            done, part, convs = [], [], b.column("conv_id").to_pylist()
            for conv, text in zip(convs, b.column("formatted").to_pylist(), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        now.add("".join(part))
                        done.append(now.row())
                    now, part = _Digest(conv), []
                part.append(text)
            if now is not None:
                now.add("".join(part))
            if done:
                yield _batch(done)
        if now is not None:
            yield _batch([now.row()])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    id_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The contract's additional conversation.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations and one with id -1, whose two texts hold control strings."""
    kinds = dict(conversations.dtypes)
    extra = conversations.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
