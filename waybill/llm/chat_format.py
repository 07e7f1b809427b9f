"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens them in order: texts are
escaped and written, every other part becomes its kind's placeholder, and its reference, place and expanded token
count are recorded as an attachment. A part of a null or unknown kind is recorded as an attachment of kind other. The template marks turns with control strings::

    <s><|turn|>user\n...<|end|><|turn|>assistant\n...<|end|></s>

A control string inside a text gets a backslash after its first character (and one more for each that is there
already), which the reader takes away: nothing that a text says can end a turn, and every text comes back whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

BEGIN, CLOSE, TURN, END = "<s>", "</s>", "<|turn|>", "<|end|>"
#: Placeholders by kind; parts of a null or unknown kind are kept as ``other``.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "other": "<|other|>"}
#: Strings that this template or common ones read as control.
CONTROLS = (BEGIN, CLOSE, TURN, END, *PLACEHOLDERS.values(), "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: Tokens a part stands for when it doesn't say.
PART_TOKENS = {"image": 576, "audio": 250, "document": 1024, "other": 0}
PART = "struct<type:string,text:string,ref:string,tokens:int>"

_REST = "|".join(sorted((re.escape(c[1:]) for c in CONTROLS), key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")
_HOLDER = re.compile("(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits the parts of a conversation in order. ``place`` is the code point where the next one begins."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.place = 0
        self.attachments: list[dict] = []
        self.loss: list[dict[str, int]] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.place += len(text)

    def visit(self, turn: int, index: int, part: dict) -> None:
        self._VISITORS.get(part["type"], Flattener.visit_other)(self, turn, index, part)

    def visit_text(self, turn: int, index: int, part: dict) -> None:
        self.write(part["text"] or "")

    def _attach(self, kind: str, turn: int, index: int, part: dict) -> None:
        tokens = part["tokens"] if part["tokens"] is not None else PART_TOKENS[kind]
        self.attachments.append({"turn": turn, "part": index, "kind": kind, "ref": part["ref"], "place": self.place, "tokens": tokens})
        self.write(PLACEHOLDERS[kind])

    def visit_image(self, turn: int, index: int, part: dict) -> None:
        self._attach("image", turn, index, part)

    def visit_audio(self, turn: int, index: int, part: dict) -> None:
        self._attach("audio", turn, index, part)

    def visit_document(self, turn: int, index: int, part: dict) -> None:
        self._attach("document", turn, index, part)

    def visit_other(self, turn: int, index: int, part: dict) -> None:
        self._attach("other", turn, index, part)

    #: The kinds there are; a part can't name any other method.
    _VISITORS = {"text": visit_text, "image": visit_image, "audio": visit_audio, "document": visit_document}

    def visit_turn(self, turn: int, role: str, parts: list[dict]) -> None:
        self.write(TURN + _escape_role(role) + "\n")
        begin = self.place
        run: list[str] = []

        def flush() -> None:  # texts side by side are one text: a control string may reach over both
            if run:
                self.visit(turn, -1, {"type": "text", "text": escape("".join(run))})
                run.clear()

        for i, part in enumerate(parts):
            if part is None:
                continue
            if part["type"] == "text":
                run.append(part["text"] or "")
            else:
                flush()
                self.visit(turn, i, part)
        flush()
        if role == "assistant":
            self.loss.append({"start": begin, "end": self.place})
        self.write(END)


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in _FORMATTED}
        for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            flat = Flattener()
            flat.write(BEGIN)
            for t in turns:
                flat.visit_turn(t["turn"], t["role"] or "", t["parts"] or [])
            flat.write(CLOSE)
            for k, v in (("conv_id", conv_id), ("formatted", "".join(flat.out)), ("loss_spans", flat.loss), ("attachments", flat.attachments), ("n_turns", len(turns)), ("attached_tokens", sum(a["tokens"] for a in flat.attachments))):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, _FORMATTED)


_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))),
    ("n_turns", pa.int64()), ("attached_tokens", pa.int64()),
])


def text_part(text: Column) -> Column:
    """A content of one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, and ``parts``, an array of PART, or ``text``):
    conv_id, formatted, loss_spans (contents of assistant turns), attachments, n_turns, attached_tokens.

    A column named parts that isn't an array of PART is ignored; where both are there, a turn whose parts are null says
    its text. Turns come in order of turn, then role, then content; repeated rows are turns of their own. Null texts,
    parts and roles are empty, a null within parts is left out. A row with a null conv_id is a conversation by
    itself, so that no key gathers such rows. Other columns are ignored. A conversation is one row, as it is in
    training; an empty table gives an empty result.
    """
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    typed = isinstance(kinds.get("parts"), ArrayType) and isinstance(kinds["parts"].elementType, StructType) and kinds["parts"].elementType.fieldNames() == ["type", "text", "ref", "tokens"]
    given = F.col("parts").cast(f"array<{PART}>") if typed else None
    said = text_part(F.col("text")).cast(f"array<{PART}>") if "text" in kinds else None
    parts = F.coalesce(*(c for c in (given, said) if c is not None))
    # Sorting by the number first and the contents last; nulls sort first.
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), parts.alias("parts")).alias("t"))
    keyed = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    grouped = keyed.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", "turns")
    kinds = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<turn:long,part:int,kind:string,ref:string,place:long,tokens:long>>, n_turns long, attached_tokens long"
    return grouped.mapInArrow(_format_batches, kinds)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, as they were; attachments leave nothing."""
    if not (formatted.startswith(BEGIN) and formatted.endswith(CLOSE)):
        raise ValueError("not a formatted conversation")
    turns = []
    for piece in formatted[len(BEGIN) : -len(CLOSE)].split(TURN)[1:]:
        head, _, body = piece.partition("\n")
        if not body.endswith(END):
            raise ValueError("a turn does not end")
        turns.append((_unescape_role(head), _text_of(body[: -len(END)])))
    return turns


def _text_of(content: str) -> str:
    return "".join(unescape(x) for x in _HOLDER.split(content)[::2])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv_id, formatted, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns = read_turns(formatted)
            loss = "".join(_text_of(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """Read every conversation back from its formatted text and loss mask, and give digests of what they say."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
