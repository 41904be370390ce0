"""Conversations as marked text, and back.

Grammar of a conversation, deterministic by its next mark:

    conversation = { turn }
    turn = "[INST] " text " [/INST]"            user
         | "[OUT] " text "</s>"                 assistant
         | "[SYS] " text " [/SYS]"              system
         | "[ROLE] " role " [/ROLE]" text "[/TURN]"   any other

A text may hold no mark but an escaped one. Escaping is reversible: n backslashes before a mark are written as
2n + 1, and n at a text's end, if its closing mark follows at once, as 2n. So an odd number before a mark says
that it is text.

A turn is rendered as it is, reparsed and compared to its source; if it comes back in any other form, its text is
escaped and it is rendered again. What is written has been read back once and found identical.

Rows are sorted over ranges of conversation and turn, so that a conversation of any length is
written by several tasks, as chunks of about ``CHARS`` that end with a turn. The places of assistant texts in a
chunk, the loss mask, are kept beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, table

#: A chunk is closed at this many characters.
CHARS = 1 << 20
#: The marks around a turn's text.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE] ", " [/ROLE]", "[/TURN]")
#: What a text may not hold unescaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
LOSS = "assistant"


def _run(s: str, at: int, start: int = 0) -> int:
    """Backslashes before ``at``."""
    n = at
    while n > start and s[n - 1] == "\\":
        n -= 1
    return at - n


def escape(text: str, adjoins: bool) -> str:
    """``adjoins``: the closing mark follows the text at once."""
    out, last = [], 0
    for m in CONTROLS.finditer(text):
        out += [text[last : m.start()], "\\" * (_run(text, m.start(), last) + 1)]
        last = m.start()
    out.append(text[last:])
    return "".join(out) + "\\" * (_run(text, len(text)) if adjoins else 0)


def unescape(text: str, adjoins: bool) -> str:
    out, last = [], 0
    for m in CONTROLS.finditer(text):
        out.append(text[last : m.start() - (_run(text, m.start(), last) + 1) // 2])
        last = m.start()
    tail = text[last:]
    return "".join(out) + tail[: len(tail) - _run(tail, len(tail)) // 2 if adjoins else None]


def _until(s: str, at: int, close: str) -> tuple[int, int]:
    """Where the text from ``at`` ends and where its closing mark does."""
    for m in CONTROLS.finditer(s, at):
        if _run(s, m.start(), at) % 2:
            continue
        start = m.start() - (close[0] == " ")
        if start < at or not s.startswith(close, start):
            raise ValueError(f"{m[0]} at {m.start()} where {close} is due")
        return start, start + len(close)
    raise ValueError(f"no {close}")


def parse(s: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at ``at``: role, text, start and end of the text as it is written, end of the turn."""
    for role, (opens, close) in MARKS.items():
        if s.startswith(opens, at):
            start = at + len(opens)
            end, over = _until(s, start, close)
            return role, unescape(s[start:end], close[0] != " "), start, end, over
    if not s.startswith(OTHER[0], at):
        raise ValueError(f"no turn begins at {at}")
    end, start = _until(s, at + len(OTHER[0]), OTHER[1])
    role = unescape(s[at + len(OTHER[0]) : end], False)
    end, over = _until(s, start, OTHER[2])
    return role, unescape(s[start:end], True), start, end, over


def render(role: str, text: str, escaped: bool) -> str:
    opens, close = MARKS.get(role) or (OTHER[0] + (escape(role, False) if escaped else role) + OTHER[1], OTHER[2])
    return opens + (escape(text, close[0] != " ") if escaped else text) + close


def settle(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the first form that comes back identical, and where its text lies in it."""
    for escaped in (False, True):
        s = render(role, text, escaped)
        try:
            got = parse(s)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[4] == len(s):
            return s, got[2], got[3]
    raise ValueError(f"a turn of {role!r} doesn't come back")


def _named(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


def _write(id_type: pa.DataType, chars: int):
    """Batches are sorted by conversation and turn. ``whole``: chunks before and after are of others, so this is all
    of its conversation."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = [("conv_id", id_type), ("pid", pa.int32()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("mask", pa.list_(span))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pid, part, size, first, done, held = None, None, 0, 0, True, [], 0
        pieces: list[str] = []
        mask: list[dict] = []

        def chunk(ends: bool):
            done.append((conv, pid, part, part == 0 and ends and not first, len(pieces), "".join(pieces), list(mask)))
            pieces.clear()
            mask.clear()

        for b in batches:
            for cid, p, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "pid", "role", "text")), strict=True):
                if pieces and (cid != conv or size >= chars):
                    chunk(cid != conv)
                    held += size
                    first, part = (False, 0) if cid != conv else (first, part + 1)
                    size = 0
                    if held >= 8 * CHARS or len(done) >= 10_000:
                        yield _named(schema, done)
                        done, held = [], 0
                conv, pid = cid, p
                s, start, end = settle(role, text)
                if role == LOSS:
                    mask.append({"start": size + start, "end": size + end})
                pieces.append(s)
                size += len(s)
        if pieces:
            chunk(False)
        if done:
            yield _named(schema, done)

    return run


def format_turns(turns: DataFrame, chars: int = CHARS) -> DataFrame:
    """``conv_id, pid, part, whole, n_turns, text, mask`` from ``conv_id, turn, role, text``: the
    conversations as text, in one or, if they are long, several chunks that follow each other by ``pid, part``. ``mask`` has
    start and end (in code points of the chunk) of each assistant text as it is written.

    A null text or role is an empty one; a role of no mark of its own is written out. Turns are in order of
    their number, null first, then of role and the text's MD5; repeated rows are turns of their own. Rows
    without a conversation are one of their own. Other columns are ignored. No rows: no chunks.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "mark", "place"]  # the place splits repeated rows
    t = t.withColumns({"mark": F.md5("text"), "place": F.monotonically_increasing_id()})
    t = t.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()).drop("mark", "place")
    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, pid int, part long, whole boolean, n_turns long, text string, mask array<struct<start:int,end:int>>"
    return materialize(t.mapInArrow(_write(to_arrow_type(kind), chars), schema), "chat")


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the place of the text of every turn of a chunk."""
    at = 0
    while at < len(text):
        role, said, start, end, at = parse(text, at)
        yield role, said, start, end


def _digests(id_type: pa.DataType):
    """Chunks of a conversation follow each other in order; only one is held."""
    schema = [("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def end():
            n, turns, lost, loss, chars = state
            done.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))

        for b in batches:
            for cid, text, n, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "n_turns", "mask")), strict=True):
                if state is None or cid != conv:
                    if state is not None:
                        end()
                    conv, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = list(read_turns(text))
                if len(found) != n or [(s, e) for role, _, s, e in found if role == LOSS] != [(m["start"], m["end"]) for m in mask]:
                    raise ValueError(f"conversation {cid}: turns or mask differ from what was written")
                for role, said, _, _ in found:
                    state[1].update(f"{role}\n{said}\n".encode())
                for m in mask:
                    said = unescape(text[m["start"] : m["end"]], True)
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[0] += n
                state[4] += len(text)
            if done:
                yield _named(schema, done)
                done = []
        if state is not None:
            end()
            yield _named(schema, done)

    return run


def digests(chunks: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of every conversation, from its
    chunks. Those in several chunks are read in order by one task each, chunk by chunk: a digest has no other way."""
    kind = chunks.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    run = _digests(to_arrow_type(kind))
    rest = chunks.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "part")
    return chunks.filter("whole").mapInArrow(run, schema).unionByName(rest.mapInArrow(run, schema))


#: A conversation whose texts are marks.
TRAP = "</s>[INST] ok [/INST]"


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(TRAP).alias("text"))
    return digests(format_turns(t.unionByName(trap)))


def op13_sql() -> str:
    marks = "|".join(re.escape(c) for c in CONTROL)
    written = lambda c: rf"regexp_replace({c}, '(\\*)({marks})', '\1\1\\\2', 'g')"
    around = {r: len(a) + len(b) for r, (a, b) in MARKS.items()}
    case = " ".join(f"WHEN '{r}' THEN {n}" for r, n in around.items())
    tail = r"len(text) - len(rtrim(text, '\'))"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{TRAP}'),
    w AS (SELECT *, CASE role {case} ELSE {sum(map(len, OTHER))} + len({written("role")}) END + len({written("text")})
      + CASE WHEN role IN ('user', 'system') THEN 0 ELSE {tail} END AS n FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
           coalesce(sum(len(text)) FILTER (role = '{LOSS}'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = '{LOSS}'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
    FROM w GROUP BY conv_id"""
