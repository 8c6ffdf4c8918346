"""Canonical chat turns from records of any known layout, and their training text with a loss mask."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """What a record's fields mean.

    ``turns`` lists (role, paths of the text parts) for layouts with fixed turns. Otherwise ``each`` is the
    list of turns, and ``role``/``text`` are paths within an entry, or within the record if ``each`` is
    empty. ``roles`` renames roles, ``order`` is the path of a turn number. ``optional`` paths may be absent.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict)


_SHARED = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant"}
LAYOUTS = (
    Layout("prompt", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system prompt", ("system", "prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction input", ("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages[].role", "messages[].content"), each="messages"),
    Layout("message parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), each="messages", text="content[].text"),
    Layout("nested messages", ("data.messages[].role", "data.messages[].content"), each="data.messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=_SHARED),
    Layout("turn row", ("conv_id", "turn", "role", "text"), each="", text="text", order="turn"),
)


def field_paths(node, path: str = "") -> set[str]:
    """Paths of all leaves; ``[]`` stands for any place in a list. Empty objects and lists are leaves."""
    if isinstance(node, dict) and node:
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in node.items()))
    if isinstance(node, list) and node:
        return set().union(*(field_paths(v, path + "[]") for v in node))
    return {path}


def schema_fingerprint(paths) -> int:
    """Hash of a set of field paths, whatever their order."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)


def _pick(node, path: str) -> list:
    """All values at a path, in order."""
    found = [node]
    for step in path.split(".") if path else []:
        name, many = step.removesuffix("[]"), step.endswith("[]")
        found = [x.get(name) for x in found if isinstance(x, dict)]
        if many:
            found = [y for x in found if isinstance(x, list) for y in x]
    return found


def _text(values: list) -> str:
    return "\n".join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values if v is not None and v != "")


def turns_of(record: str | None, layouts: dict[int, Layout]) -> tuple[str | None, list[tuple[int, str, str]]]:
    """Layout name and (turn, role, text) of one JSON record; (None, []) if no layout has its fingerprint."""
    try:
        node = json.loads(record) if record else None
    except ValueError:
        node = None
    layout = layouts.get(schema_fingerprint(field_paths(node))) if isinstance(node, dict) else None
    if layout is None:
        return None, []
    if layout.turns:
        return layout.name, [(i, role, _text([v for p in parts for v in _pick(node, p)])) for i, (role, parts) in enumerate(layout.turns)]
    out = []
    items = _pick(node, layout.each + "[]") if layout.each else [node]
    for i, item in enumerate(items):
        role = _text(_pick(item, layout.role))
        number = _pick(item, layout.order)[0] if layout.order else i
        out.append((int(number or 0), layout.roles.get(role, role), _text(_pick(item, layout.text))))
    return layout.name, out


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``layout`` from JSON records.

    The hash of a record's nested field paths selects the declarative layout that converts it. A record may hold
    a conversation or one turn of it, so long conversations need not fit one record. Null texts are empty.
    A record without known layout, or that is no JSON object, gives one row of nulls beside its id, so that
    nothing vanishes unseen. A field that occurs in only some entries is part of the fingerprint. Other
    columns are ignored; an empty table gives an empty one.
    """
    known = {schema_fingerprint(x.paths): x for x in layouts}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, record in zip(frame["conv_id"], frame["record"], strict=True):
                name, turns = turns_of(record, known)
                out += [(conv, *t, name) for t in turns] or [(conv, None, None, None, None)]
            made = pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "layout"])
            yield made.astype({"conv_id": "Int64", "turn": "Int64"})

    rows = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string").alias("record"))
    return rows.mapInPandas(run, "conv_id long, turn long, role string, text string, layout string")


def escaped(text: Column) -> Column:
    """One backslash more between every ``<`` and ``|``: control strings cannot occur in it, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def formatted(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id``, ``turn``, ``place``, ``piece``, ``loss_start``, ``loss_end`` per turn.

    A conversation's text is its pieces in the order of ``turn``, then ``place`` (a hash that settles repeated turn
    numbers): start mark, role, newline, escaped text, end mark, newline. [``loss_start``, ``loss_end``) are
    the characters of the piece under the loss mask, empty for roles outside ``learn``. It stays one row per
    turn so that a conversation of any length is written and read in bounded memory. Null role or text is
    empty; newlines in roles are escaped too. Rows without a turn number come first.
    """
    role = F.regexp_replace(F.regexp_replace(F.coalesce("role", F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    head = F.concat(F.lit(START), escaped(role), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    learned = F.coalesce(F.col("role").isin(*learn), F.lit(False))
    begin = F.length(head)
    return turns.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("place"), F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.when(learned, begin).otherwise(0).alias("loss_start"), F.when(learned, begin + F.length(body)).otherwise(0).alias("loss_end"),
    )


_PIECE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(found[1]))
    return role, unescaped(found[2])


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted pieces: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Pieces are sorted within partitions and hashed as they stream by; no conversation is held in memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state = None, None
        for frame in frames:
            out = []
            for conv, piece, low, high in frame.itertuples(index=False):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learned = unescaped(piece[low:high])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state is not None:
            last = [(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])]
            yield pd.DataFrame(last, columns=names).astype({"conv_id": "Int64"})

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place").select("conv_id", "piece", "loss_start", "loss_end")
    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
