"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a conversation are
rendered; if each output begins with the one before, the difference is the new turn's span, and otherwise the template
rewrites history and the turn is marked. Where the text lies within its span follows from rendering the turn with a
probe in place of its text: what stands on both sides is header and trailer. Nothing is assumed about the markup.

Rows are streamed in the order of turns. Prefixes longer than WINDOW turns are replaced by the last WINDOW / 2 turns where
the next turn, rendered both ways, changes both outputs alike; so a conversation of any length takes bounded memory and
time linear in its turns. A template that looks further back, to rewrite history or to write other text than from the
window, keeps the whole prefix and the window doubles, which takes memory in proportion to the conversation. What a
template does otherwise only after a window was cut, because of turns before it, is not seen.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
#: Stands for a text when its place is looked for; no template writes it.
PROBE = "\ue000"
SEGMENTS = "conv_id long, position long, role string, segment string, start long, text_start long, text_end long, loss boolean, rewrites boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"

Template = Callable[[list], str]


def escape(text: str) -> str:
    """Reversible: no control string survives inside, as each begins with "<|"."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def chatml(turns: list) -> str:
    """The production template: <|im_start|>role, newline, text, <|im_end|>, newline; roles and texts escaped."""
    return "".join(f"<|im_start|>{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}<|im_end|>\n" for role, text in turns)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def parse_chatml(output: str) -> list[tuple[str, str]]:
    """The turns of a chatml output; raises if anything lies between them."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError("no turn at this place of the output")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class Renderer:
    """Segments of one conversation, turn by turn."""

    def __init__(self, template: Template, window: int = WINDOW):
        self.template, self.least, self.window = template, window, window
        self.turns: list = []
        self.out = template([])

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """(segment, start and end of the text within it, whether history was rewritten)."""
        if len(self.turns) >= self.window:
            short = self.turns[-(self.least // 2) :]
            base = self.template(short)
            grown, cut = self.template([*self.turns, (role, text)]), self.template([*short, (role, text)])
            kept, held = (len(os.path.commonprefix(pair)) for pair in ((self.out, grown), (base, cut)))
            if (self.out[kept:], grown[kept:]) == (base[held:], cut[held:]):
                self.turns, self.out, self.window = short, base, self.least
            else:  # the template looks further back: go on from the whole prefix and try again at twice its length
                self.window *= 2
        before = self.out
        probed = self.template([*self.turns, (role, PROBE)])
        self.turns.append((role, text))
        self.out = self.template(self.turns)
        rewrites = not self.out.startswith(before)
        shared = len(os.path.commonprefix([before, self.out]))
        at = probed.rfind(PROBE)
        if at < shared:  # the template leaves this turn's text out
            return self.out[shared:], len(self.out) - shared, len(self.out) - shared, rewrites
        return self.out[shared:], at - shared, len(self.out) - (len(probed) - at - len(PROBE)) - shared, rewrites


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def segments(turns: DataFrame, template: Template = chatml, loss_roles: tuple = ("assistant",), window: int = WINDOW) -> DataFrame:
    """One row a turn: its rendered segment, where it starts in the whole output, and where its text lies within.

    turns has conv_id, turn, role, text. Order is by turn; ties go by role, then text. Null roles and texts are empty;
    null turns come first; rows without a conv_id form one conversation. Repeated rows are turns each. Other columns
    are ignored. Rows come out in order, partition by partition.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [p.split()[0] for p in SEGMENTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, renderer, held, size, position, start = object(), None, [], 0, 0, 0

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for conv, _, role, text in _streamed(batches):
            if conv != now or renderer is None:
                now, renderer, position, start = conv, Renderer(template, window), 0, 0
            segment, a, z, rewrites = renderer.add(role, text)
            held.append((conv, position, role, segment, start, a, z, role in loss_roles, rewrites))
            position, start, size = position + 1, start + len(segment), size + len(segment) + 64
            if size > 4 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return ordered.mapInArrow(run, SEGMENTS)


def digests(formatted: DataFrame, parse: Callable[[str], list] = parse_chatml, decode: Callable[[str], str] = unescape) -> DataFrame:
    """Read segments() back, in their order: digests of the parsed turns and of the text under the loss mask, one row a conversation.

    Rows without a conv_id are one conversation; null roles and texts came out as empty ones and count as turns; repeated
    rows count each. An empty table gives no rows.
    """
    names = [p.split()[0] for p in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None

        def close() -> None:
            if state is not None:
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewrites"]))

        for conv, position, _, segment, _, a, z, loss, rewrites in _streamed(batches):
            if position == 0:
                close()
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rewrites": False}
            for role, text in parse(segment):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            if loss:
                plain = decode(segment[a:z])
                state["loss_chars"] += len(plain)
                state["loss"].update(plain.encode())
            state["chars"] += len(segment)
            state["rewrites"] |= rewrites
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, DIGESTS)
