"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
ASK, ASK_END = "[INST]", "[/INST]"
REPLY, REPLY_END = "<s>", "</s>"
TRAINED = "assistant"

_MARK = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.S)
_END = re.compile(r"</s>|\[/INST\]")

#: Characters of an example that one row holds; longer examples are several rows.
PIECE = 4 << 20
#: Characters of one conversation's examples that one task writes, about; longer conversations are dealt to several.
SHARE = 512 << 20
EXAMPLES = "conv_id long, example long, parts long, row long, piece string, context_chars long, loss_start long, loss_end long"
_READ = "conv_id long, example long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, loss string, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """A backslash goes after the first character of a control string, and backslashes double."""
    return _MARK.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn in the template, and where its trainable characters begin and end (0, 0: none)."""
    body = escape(text or "")
    if role == TRAINED:
        return REPLY + body + REPLY_END, len(REPLY), len(REPLY) + len(body)
    return f"{ASK}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n{body}{ASK_END}", 0, 0


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    return ((role, text) for _, role, text in _parsed(formatted))


def _parsed(formatted: str) -> Iterator[tuple[re.Match, str, str]]:
    for m in _TURN.finditer(formatted):
        if m[2] is None:
            yield m, TRAINED, unescape(m[1])
        else:
            # a line break in a role was written as one backslash and n; other backslashes are doubled
            yield m, re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m[2], flags=re.S), unescape(m[3])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, of which some megabytes are values at a time."""
    for b in batches:
        step = min(max(b.num_rows * PIECE // max(b.nbytes, 1), 1), 256)
        for k in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(k, step).columns), strict=True)
        del b


def _batches(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes."""
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for t, c in zip(types, zip(*out, strict=True), strict=True)], names)

    for r in rows:
        out.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if size > 4 << 20 or len(out) >= 5000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


class _Prefix:
    """All turns so far of a conversation, in rows of `limit` characters; full rows are in a file beyond 64 MB."""

    def __init__(self, limit: int):
        self.limit, self.chars = limit, 0
        self.full, self.sizes = tempfile.SpooledTemporaryFile(64 << 20), []
        self.last, self.held = [], 0

    def add(self, turn: str) -> None:
        self.last.append(turn)
        self.chars, self.held = self.chars + len(turn), self.held + len(turn)
        if self.held > self.limit:
            text = "".join(self.last)
            at = 0
            self.full.seek(0, 2)
            while len(text) - at > self.limit:
                self.sizes.append(self.full.write(text[at : at + self.limit].encode()))
                at += self.limit
            self.last, self.held = [text[at:]], len(text) - at

    def rows(self) -> Iterator[str]:
        self.full.seek(0)
        for n in self.sizes:
            yield self.full.read(n).decode()
        self.last = ["".join(self.last)]
        yield self.last[0]


def _expand(turns: Iterable[tuple], piece_chars: int) -> Iterator[tuple]:
    """Sorted turns to rows of examples: at each reply all turns before it and the reply are written out.

    Of a conversation dealt to several tasks each task meets all turns and writes every parts-th example.
    """
    for (conv, part, parts), run in groupby(turns, key=itemgetter(0, 1, 2)):
        prefix, example, trained = _Prefix(piece_chars), 0, True

        def whole(context: int, loss: tuple[int | None, int | None]) -> Iterator[tuple]:
            if example % parts == part:
                for row, piece in enumerate(prefix.rows()):
                    last = row == len(prefix.sizes)
                    yield conv, example, parts, row, piece, context if last else None, *(loss if last else (None, None))

        for *_, role, text in run:
            turn, begin, stop = format_turn(role, text)
            context = prefix.chars
            prefix.add(turn)
            trained = role == TRAINED
            if trained:
                yield from whole(context, (context + begin, context + stop))
                example += 1
        if not trained:
            yield from whole(prefix.chars, (None, None))
        prefix.full.close()


def prefix_target_examples(turns: DataFrame, piece_chars: int = PIECE, share_chars: int = SHARE) -> DataFrame:
    """Every assistant turn as an example of its own: all turns before it are context, only it is trainable.

    Each example is written out whole, context and reply, so the output grows with the square of
    a conversation's replies. An example is one row (`row` 0) up to `piece_chars` characters,
    and more rows beyond; context_chars, loss_start and loss_end are positions in the whole
    example and stand in its last row. Turns after the last reply make one more example, of all
    turns and without a loss span, so that nothing is lost.

    Conversations are dealt by conv_id, sorted and streamed: a task holds a row's turns and 64 MB
    of context, the rest of a longer context in a file. A conversation whose examples have over
    `share_chars` characters is dealt to `parts` tasks, each of which meets all its turns and writes
    the examples whose number modulo `parts` is its own. Sizes are summed first, in another pass over `turns`.

    Turns go by turn (null first), then role and text. Null text and role: empty. A null conv_id
    is a conversation. Repeated rows are turns like others. No rows give no rows; other columns
    are not read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    chars = F.sum(F.length(F.coalesce("role", F.lit(""))) + F.length(F.coalesce("text", F.lit(""))) + len(ASK + ASK_END) + 1).cast("double")
    sizes = rows.groupBy("conv_id").agg(chars.alias("chars"), F.count_if(F.col("role") == TRAINED).alias("replies"))
    # a part costs a copy of the turns, so it is worth sixteen of them at least
    parts = F.ceil(F.least(F.col("replies"), F.col("replies") * F.col("chars") / 2 / F.greatest(F.lit(float(share_chars)), 16 * F.col("chars"))))
    # each has over the root of share_chars in characters, so they are few
    long = sizes.select(F.col("conv_id").alias("long_id"), parts.alias("parts")).where("parts > 1")
    dealt = rows.join(F.broadcast(long), F.col("conv_id").eqNullSafe(F.col("long_id")), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    ordered = dealt.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select("conv_id", "part", "parts", "role", "text")
    return ordered.mapInArrow(lambda batches: _batches(_expand(_rows(batches), piece_chars), EXAMPLES), EXAMPLES)


def whole_examples(examples: DataFrame) -> DataFrame:
    """Examples of several rows as one: `formatted`, the whole text, in place of `row` and `piece`."""
    pieces = F.array_sort(F.collect_list(F.struct("row", "piece")))
    text = F.array_join(F.transform(pieces, lambda x: x["piece"]), "")
    return examples.groupBy("conv_id", "example").agg(text.alias("formatted"), *(F.max(c).alias(c) for c in ("context_chars", "loss_start", "loss_end")))


class _Reader:
    """Reads examples of one conversation, each the longer one. Of an example all is compared with the one read before,
    which has been parsed, and what it has more is parsed: its rows but the last are kept as digests."""

    def __init__(self) -> None:
        self.known, self.last = [], ""
        self.rest, self.at, self.chars = [], 0, 0
        self.n, self.replies, self.sha = 0, 0, hashlib.sha256()
        self.turn: tuple | None = None

    def read(self, example: int, rows: Iterable[tuple]) -> str | None:
        """The text under the loss mask of an example (None: no mask). A context that isn't all turns before the reply,
        or a loss span that isn't that reply, is an error."""
        ok, count, marks = True, 0, (None, None, None)
        for _, _, _, row, piece, *marks in rows:
            if row == len(self.known) + 1:
                self.known.append(hashlib.sha256(self.last.encode()).digest())
                self.last = ""
            if row < len(self.known):
                ok &= hashlib.sha256(piece.encode()).digest() == self.known[row]
            else:
                ok &= piece.startswith(self.last)
                self._parse(piece[len(self.last) :])
                self.last = piece
            ok &= row == count
            count += 1
        context, begin, stop = marks
        ok &= count == len(self.known) + 1 and self.at == self.chars
        if begin is None:
            ok &= context == self.chars and self.replies == example and stop is None
        else:
            ok &= self.turn is not None and self.turn[:4] == (context, begin, stop, self.chars) and self.replies == example + 1
        if not ok:
            raise ValueError("context and loss span of an example differ from its turns")
        return None if begin is None else self.turn[4]

    def _parse(self, text: str) -> None:
        if not text:
            return
        seam = "".join(x[-8:] for x in self.rest[-8:])
        self.rest.append(text)
        self.chars += len(text)
        if not _END.search(seam + text):
            return
        new = "".join(self.rest)
        base = self.at
        for m, role, said in _parsed(new):
            if base + m.start() != self.at:
                raise ValueError("context and loss span of an example differ from its turns: text between turns")
            self.sha.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
            self.n, self.at, self.turn = self.n + 1, base + m.end(), None
            if m[2] is None:
                self.replies += 1
                self.turn = (base + m.start(), base + m.start(1), base + m.end(1), base + m.end(), said)
        self.rest = [new[self.at - base :]]


def _read_back(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Examples, in order, to digests: a row for a conversation, or one for each example if tasks share it."""
    for (conv, parts, _), run in groupby(rows, key=lambda r: (r[0], r[2], r[1] % r[2])):
        reader, chars, sha, example = _Reader(), 0, hashlib.sha256(), None
        for example, pieces in groupby(run, key=itemgetter(1)):
            loss = reader.read(example, pieces) or ""
            if parts > 1:
                yield conv, example, reader.n, reader.sha.hexdigest(), len(loss), None, loss, reader.chars
            chars += len(loss)
            sha.update(loss.encode("utf-8", "replace"))
        if parts == 1:
            yield conv, example, reader.n, reader.sha.hexdigest(), chars, sha.hexdigest(), None, reader.chars


def _conversations(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The rows of a conversation, in order of examples, to one: the longest example has all turns."""
    for conv, run in groupby(rows, key=itemgetter(0)):
        loss_chars, sha = 0, hashlib.sha256()
        for _, _, n, turns, some, whole, loss, chars in run:
            loss_chars += some
            sha.update((loss or "").encode("utf-8", "replace"))
        yield conv, n, turns, loss_chars, whole or sha.hexdigest(), chars


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Reads prefix_target_examples() output back, in its own partitions and order, into digests of turns and loss text.

    Each example's text is read, and its context and loss span are checked against its turns."""
    read = examples.select(*(f.split()[0] for f in EXAMPLES.split(", "))).mapInArrow(lambda batches: _batches(_read_back(_rows(batches)), _READ), _READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(lambda batches: _batches(_conversations(_rows(batches)), DIGESTS), DIGESTS)
