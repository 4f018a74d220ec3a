"""Chat formatting: typed content parts are visited and flattened into one marked text.

A turn is ``### role: body</turn>`` and a line end.  Wherever a control string of the template
stands in a role or a text it gets a backslash in front, and so does every backslash, which makes
the escape reversible.  Image, audio and document parts become placeholders ``<|kind n|>`` (n: the
part's place in its turn); their references and the tokens they expand to are recorded beside the
text.  A loss mask of code point spans covers the bodies of assistant turns.

One row per turn comes out, in order and with its offset, so a conversation of any length is
spread over many tasks; its formatted text is the concatenation of its rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from predio.llm.frames import without
from predio.llm.ranges import running

# --- fixed values: the template -----------------------------------------------
HEAD = "### "
AFTER_ROLE = ": "
END = "</turn>"
OPEN = "<|"
CLOSE = "|>"
LEARNT_ROLE = "assistant"
KINDS = ("text", "image", "audio", "document")
# ------------------------------------------------------------------------------
_IN_TEXT = r"(\\|### |</turn>|<\|)"
_IN_ROLE = r"(\\|### |: |</turn>|<\|)"
_ESCAPED = re.compile(r"\\(.)", re.S)
_STOP = re.compile(r"\\.|</turn>\n", re.S)
_ROLE = re.compile(r"\\.|: ", re.S)
_PIECE = re.compile(r"\\(.)|<\|(\w+) (\d+)\|>", re.S)


@dataclass(frozen=True)
class Costs:
    """Tokens that an attachment expands to: image patches, audio frames a second, document pages."""

    patch: int = 28
    image: int = 256  # of unknown size
    audio_second: float = 25.0
    page: int = 512


def escape(text: Column, control: str = _IN_TEXT) -> Column:
    return F.regexp_replace(text, control, r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Visits one part by its type; every method gives the pieces the part flattens to.

    A piece has ``body`` (escaped text, null for a placeholder), ``kind``, ``ref`` and ``tokens``.
    Parts may lack any field but ``type``; a document's own ``parts`` follow its placeholder.
    """

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs

    def _field(self, part: Column, kind: T.StructType, name: str, to: str) -> Column:
        return part[name].cast(to) if name in kind.fieldNames() else F.lit(None).cast(to)

    def _piece(self, body, kind, ref, tokens) -> Column:
        return F.array(
            F.struct(
                body.cast("string").alias("body"), kind.cast("string").alias("kind"),
                ref.cast("string").alias("ref"), tokens.cast("bigint").alias("tokens"),
            )
        )

    def _attachment(self, part, kind, name: Column, tokens: Column) -> Column:
        return self._piece(F.lit(None), name, self._field(part, kind, "uri", "string"), tokens)

    def text(self, part, kind) -> Column:
        body = escape(F.coalesce(self._field(part, kind, "text", "string"), F.lit("")))
        return self._piece(body, F.lit(None), F.lit(None), F.lit(0))

    def image(self, part, kind) -> Column:
        sides = [F.ceil(self._field(part, kind, side, "double") / self.costs.patch) for side in ("width", "height")]
        return self._attachment(part, kind, F.lit("image"), F.coalesce(sides[0] * sides[1], F.lit(self.costs.image)))

    def audio(self, part, kind) -> Column:
        tokens = F.ceil(F.coalesce(self._field(part, kind, "seconds", "double"), F.lit(0.0)) * self.costs.audio_second)
        return self._attachment(part, kind, F.lit("audio"), tokens)

    def document(self, part, kind) -> Column:
        pages = F.coalesce(self._field(part, kind, "pages", "bigint"), F.lit(1))
        own = self._attachment(part, kind, F.lit("document"), pages * self.costs.page)
        if "parts" not in kind.fieldNames():
            return own
        return F.concat(own, self.flatten(part["parts"], kind["parts"].dataType))

    def unknown(self, part, kind) -> Column:
        return self._attachment(part, kind, F.lit("unknown"), F.lit(0))

    def visit(self, part: Column, kind: T.StructType) -> Column:
        pieces = self.unknown(part, kind)
        for name in reversed(KINDS):
            pieces = F.when(part["type"] == name, getattr(self, name)(part, kind)).otherwise(pieces)
        return pieces

    def flatten(self, parts: Column, kind: T.ArrayType) -> Column:
        """The pieces of all parts in order; null parts are left out, a null list is empty."""
        there = F.filter(F.coalesce(parts, F.array().cast(kind)), lambda p: p.isNotNull())
        return F.flatten(F.transform(there, lambda p: self.visit(p, kind.elementType)))


def format_chat(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", parts: str | None = None, visitor: PartVisitor | None = None,
) -> DataFrame:
    """One row per turn: the conversation, ``turn_no`` (0, 1, …), ``start``, ``formatted``, ``loss``,
    ``attachments`` and ``expanded_tokens``.

    ``parts`` names a column ``array<struct<type, …>>``; without it the turn's ``text`` is its only
    part.  ``start`` is the code point offset of the turn in its conversation's text and ``loss`` the
    absolute spans ``(start, end)`` to learn from (placeholders in an assistant's body included).
    Turns go by ``turn``, nulls first, then role and body; repeated rows are turns of their own.  A
    null role or text is empty, a null conversation is a conversation, a null or empty list of
    parts is an empty turn.  Texts of any length are formatted whole, one in memory at a time.  An
    empty table gives an empty table; other columns are left out, whatever their names.
    """
    visitor = visitor or PartVisitor()
    if parts is None:
        kind = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
        content = F.array(F.struct(F.lit("text").alias("type"), F.col(text).cast("string").alias("text")))
    else:
        kind, content = df.schema[parts].dataType, F.col(parts)
    rows = df.select(
        F.col(conversation).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        visitor.flatten(content, kind).alias("_pieces"),
    )
    mark = lambda p, i: F.concat(F.lit(OPEN), p["kind"], F.lit(" "), (i + 1).cast("string"), F.lit(CLOSE))
    body = F.concat_ws("", F.transform("_pieces", lambda p, i: F.coalesce(p["body"], mark(p, i))))
    numbered = F.transform(
        "_pieces",
        lambda p, i: F.struct((i + 1).alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
    )
    rows = rows.select(
        "_conv", "_turn", "_role", body.alias("_body"), F.filter(numbered, lambda a: a["kind"].isNotNull()).alias("attachments")
    ).select(
        "*", F.concat(F.lit(HEAD), escape(F.col("_role"), _IN_ROLE), F.lit(AFTER_ROLE)).alias("_head"),
    ).select(
        "_conv", "_turn", "_role", F.xxhash64("_body").alias("_tie"),
        F.concat("_head", "_body", F.lit(END + "\n")).alias("formatted"),
        F.length("_head").cast("bigint").alias("_from"),
        F.length("_body").cast("bigint").alias("_long"),
        "attachments",
        F.lit(1).cast("bigint").alias("_one"),
    ).withColumn("_chars", F.length("formatted").cast("bigint"))
    rows = running(rows, "_conv", ["_turn", "_role", "_tie"], ["_chars", "_one"], "chat")
    begin = F.col("before__chars") + F.col("_from")
    learnt = (F.col("_role") == LEARNT_ROLE) & (F.col("_long") > 0)
    span = F.array(F.struct(begin.alias("start"), (begin + F.col("_long")).alias("end")))
    tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda t, a: t + F.coalesce(a["tokens"], F.lit(0)))
    return rows.select(
        F.col("_conv").alias(conversation),
        F.col("before__one").alias("turn_no"),
        F.col("before__chars").alias("start"),
        "formatted",
        F.when(learnt, span).otherwise(F.array().cast(span_type())).alias("loss"),
        "attachments",
        tokens.alias("expanded_tokens"),
    )


def span_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


# --- reading ------------------------------------------------------------------


def parse_body(body: str) -> list[tuple[str, str]]:
    """The ``(kind, text)`` parts of a body: unescaped texts, and placeholders with their numbers."""
    out, own, at = [], [], 0
    for m in _PIECE.finditer(body):
        own.append(body[at : m.start()])
        at = m.end()
        if m[1] is not None:
            own.append(m[1])
        else:
            out += [("text", "".join(own)), (m[2], m[3])]
            own = []
    own.append(body[at:])
    out.append(("text", "".join(own)))
    return [p for p in out if p != ("text", "")]


class Reader:
    """Takes a conversation's formatted text in pieces of any size and gives its turns by the marks."""

    def __init__(self):
        self.kept, self.base = "", 0  # text not read yet, and its offset in the conversation
        self.spans: list[tuple[int, int]] = []

    def feed(self, piece: str, spans=()) -> Iterator[tuple[str, str, list[str]]]:
        """The turns that end in ``piece``: role, raw body, and the texts under the loss mask."""
        self.kept += piece
        self.spans += spans
        at, begin = 0, 0
        while m := _STOP.search(self.kept, at):
            at = m.end()
            if m[0][0] == "\\":
                continue
            turn = self.kept[begin : m.start()]
            if not turn.startswith(HEAD):
                raise ValueError("a turn without its mark")
            name = next(x for x in _ROLE.finditer(turn, len(HEAD)) if x[0][0] != "\\")
            inside = [s for s in self.spans if s[1] <= self.base + at]
            self.spans = self.spans[len(inside) :]
            learnt = [unescape(self.kept[a - self.base : b - self.base]) for a, b in inside]
            yield unescape(turn[len(HEAD) : name.start()]), turn[name.end() :], learnt
            begin = at
        self.kept, self.base = self.kept[begin:], self.base + begin

    def close(self) -> None:
        if self.kept or self.spans:
            raise ValueError("a conversation that does not end with a turn")


def read_digest(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Read the formatted conversations back: turns, what the loss mask covers, and digests of both.

    The digest of a conversation runs over its rows one after the other, as SHA-256 must, so they
    come to one task; it reads them as a stream and holds one turn at a time.
    """
    rows = without(formatted, ["_conv"]).select(
        F.col(conversation).alias("_conv"), "start", "formatted", F.transform("loss", lambda s: s["start"]).alias("_a"),
        F.transform("loss", lambda s: s["end"]).alias("_b"),
    )
    rows = rows.repartition("_conv").sortWithinPartitions("_conv", "start")
    schema = T.StructType(
        [
            T.StructField(conversation, formatted.schema[conversation].dataType),
            T.StructField("n_turns", T.LongType(), False), T.StructField("turns_sha256", T.StringType(), False),
            T.StructField("loss_chars", T.LongType(), False), T.StructField("loss_sha256", T.StringType(), False),
            T.StructField("formatted_chars", T.LongType(), False),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        done: list[list] = []
        state = None

        def finish():
            own, reader, n, turns, chars, learnt, total = state
            reader.close()
            done.append([own, n, turns.hexdigest(), chars, learnt.hexdigest(), total])

        def table():
            columns = [pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for own, piece, a, b in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                if state is None or state[0] != own:
                    if state is not None:
                        finish()
                    state = [own, Reader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[6] += len(piece)
                for role, body, texts in state[1].feed(piece, list(zip(a, b))):
                    state[2] += 1
                    text = "".join(t for kind, t in parse_body(body) if kind == "text")
                    state[3].update(f"{role}\n{text}\n".encode())
                    for t in texts:
                        state[4] += len(t)
                        state[5].update(t.encode())
            if len(done) > 5000:
                yield table()
        if state is not None:
            finish()
        if done:
            yield table()

    return rows.mapInArrow(read, schema)
