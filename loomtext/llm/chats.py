"""Chat formatting: a hash of a record's nested field paths selects a declarative mapping to canonical turns.

A record is a JSON object. Its schema is the sorted set of its field paths (``messages[].role``), without
values; the hash of the paths is the fingerprint. A mapping declares the paths it needs and where
turns, roles and contents are. The first time a fingerprint is met in a task, the mapping with most
needed paths among those it satisfies is selected, of equals the first declared; from then on the
fingerprint alone selects it. So extra fields don't matter, and a new layout is one more declaration.

Canonical turns are (role, content) with the roles system, user, assistant and tool. Records that hold
one turn (``turn_rows``) and name their conversation are gathered by it afterwards, the only shuffle; all others are chats
as they are. A conversation whose turn numbers pass ``TURNS`` continues in a further part, so a part's size is bounded
by its distinct turns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import read

ROLES = {
    "system": "system", "developer": "system", "context": "system",
    "user": "user", "human": "user", "prompter": "user", "question": "user", "instruction": "user",
    "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "answer": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool",
}
TURNS = 4096
_RECORD = "record_id string, layout string, fingerprint string, conv string, turn long, turns array<struct<role:string,content:string>>"
_TURN = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))


@dataclass(frozen=True)
class Mapping:
    """``turns``: a path to a list with role and content fields, or (role, path) pairs in order; a role that begins with @ is itself a path."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    content: str = ""
    conversation: str = ""
    turn: str = ""


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), each="messages", role="role", content="content"),
    Mapping("message_parts", ("messages[].role", "messages[].content[].text"), each="messages", role="role", content="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", content="value"),
    Mapping("dialogue", ("dialog[].role", "dialog[].text"), each="dialog", role="role", content="text"),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), turns=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("context_question_answer", ("context", "question", "answer"), turns=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
    Mapping("nested_qa", ("data.question", "data.answers[].text"), turns=(("user", "data.question"), ("assistant", "data.answers[].text"))),
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), turns=(("@role", "text"),), conversation="conv_id", turn="turn"),
)


def paths(value: Any, at: str = "") -> set[str]:
    """Paths of everything that isn't an object or a list; an empty one counts as itself."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in paths(v, f"{at}[]")}
    return {at} if at else set()


def fingerprint(value: Any) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths(value))))


def select(found: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    fit = [m for m in mappings if found.issuperset(m.needs)]
    return max(fit, key=lambda m: len(m.needs)) if fit else None


def get_all(value: Any, path: str) -> list[Any]:
    """Everything that lies at a path, in order; nulls apart."""
    name, _, rest = path.partition(".")
    many = name.endswith("[]")
    value = value.get(name.removesuffix("[]")) if isinstance(value, dict) else None
    items = (value if isinstance(value, list) else []) if many else [value]
    return [x for item in items if item is not None for x in (get_all(item, rest) if rest else [item])]


def get(value: Any, path: str) -> Any:
    """The first that lies at a path."""
    return next(iter(get_all(value, path)), None)


def text_of(value: Any) -> str:
    """Content as text: parts are joined by line feeds, other values stand as JSON, nothing is ''."""
    if value is None:
        return ""
    if isinstance(value, list):
        return "\n".join(text_of(v.get("text") if isinstance(v, dict) else v) for v in value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def role_of(value: Any) -> str:
    name = str(value).strip().lower() if value is not None else ""
    return ROLES.get(name, name or "user")


def convert(record: dict, mapping: Mapping) -> list[dict[str, str]]:
    """Turns of a record: empty contents are left out, neighbouring turns of one role in a declaration are joined by a blank line.

    Where a declared path leads to several values, each is a turn of its own.
    """
    if mapping.each:
        items = record.get(mapping.each) or []
        turns = [(role_of(get(x, mapping.role)), text_of(get(x, mapping.content))) for x in items if isinstance(x, dict)]
    else:
        turns = []
        for role, path in mapping.turns:
            own = role_of(get(record, role[1:]) if role[0] == "@" else role)
            contents = [x for x in map(text_of, get_all(record, path)) if x]
            if turns and turns[-1][0] == own and contents:
                turns[-1] = (own, turns[-1][1] + "\n\n" + contents.pop(0))
            turns += [(own, x) for x in contents]
    return [{"role": r, "content": c} for r, c in turns if c]


def _whole(value: Any) -> int | None:
    """A turn number, which may be given as text."""
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d{1,19}\s*", value, re.A):
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


def _convert(mappings: tuple[Mapping, ...], it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chosen: dict[str, Mapping | None] = {}
    for batch in it:
        out: list[tuple] = []
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                record = json.loads(payload) if payload is not None else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                out.append((key, "invalid", None, None, None, []))
                continue
            found = paths(record)
            print_ = xxhash.xxh64_hexdigest("\n".join(sorted(found)))
            if print_ not in chosen:
                if len(chosen) > 100_000:
                    chosen.clear()
                chosen[print_] = select(found, mappings)
            m = chosen[print_]
            if m is None:
                out.append((key, "unknown", print_, None, None, []))
            else:
                conv = get(record, m.conversation) if m.conversation else None
                out.append((key, m.name, print_, None if conv is None else str(conv), _whole(get(record, m.turn)) if m.turn else None, convert(record, m)))
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), _TURN)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["record_id", "layout", "fingerprint", "conv", "turn", "turns"])


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records``: record_id and payload (JSON). record_id, layout, fingerprint, conv, turn and turns, for every row.

    Defined cases: a null, broken or non-object payload has the layout invalid, one that no mapping
    fits unknown, both without turns; null and empty contents are no turns; a null role is user, one that
    isn't known stays as it is in lower case; extra fields are ignored, also ones with clashing
    names such as ``turns`` inside the payload; a turn number may be text; of mappings with equally many paths the
    first declared is taken; contents of any length are kept whole; rows without record_id stay apart; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    return records.select(F.col("record_id").cast("string"), F.col("payload").cast("string")).mapInArrow(partial(_convert, mappings), _RECORD)


def gather(formatted: DataFrame) -> DataFrame:
    """conv_id, part, layout, fingerprint, n_turns, n_user, n_assistant and chat, one row a conversation and part.

    Records of one turn come together by the conversation they name, whatever else is in them, in the order of their turn numbers, a null one
    last (in part 0), then by role and content; exactly repeated turns count once; of several layouts and fingerprints the least is given.
    Part k has the turns numbered from k * ``TURNS`` on. A record that names no conversation is a chat by itself, with its record_id
    (null where it has none) as conv_id and part 0; repeated ones stay repeated. ``chat``
    has a line ``<|role|>``, the content, and a line ``<|end|>`` for each turn.
    """
    part = F.floor(F.coalesce("turn", F.lit(0)) / TURNS)
    turns = formatted.where("conv is not null").select(F.col("conv").alias("conv_id"), part.alias("part"), "layout", "fingerprint", "turn", F.posexplode_outer("turns").alias("pos", "t"))
    item = F.struct(F.col("turn").isNull().alias("last"), "turn", F.col("t.role").alias("role"), F.col("t.content").alias("content"), "pos")
    joined = turns.groupBy("conv_id", "part").agg(F.min("layout").alias("layout"), F.min("fingerprint").alias("fingerprint"), F.sort_array(F.collect_set(F.when(F.col("t").isNotNull(), item))).alias("turns"))
    named = joined.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    single = formatted.where("conv is null").select(F.col("record_id").alias("conv_id"), F.lit(0).cast("long").alias("part"), "layout", "fingerprint", "turns")
    line = F.transform("turns", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"], F.lit("\n<|end|>\n")))
    count = lambda role: F.size(F.filter("turns", lambda x: x["role"] == role))
    return named.unionByName(single).select("conv_id", "part", "layout", "fingerprint", F.size("turns").alias("n_turns"), count("user").alias("n_user"), count("assistant").alias("n_assistant"), F.array_join(line, "").alias("chat"))


def turn_records(conversations: DataFrame) -> DataFrame:
    """record_id (null) and payload of a table of turns (conv_id, turn, role, text, whatever else), one record a row."""
    # nulls stay in the payload: a row's layout doesn't depend on what is missing in it
    payload = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    return conversations.select(F.lit(None).cast("string").alias("record_id"), payload.alias("payload"))


def format_turn_rows(conversations: DataFrame) -> DataFrame:
    """The table of conversation turns as chats, see ``gather``. A row without conv_id is a chat by itself."""
    return gather(format_records(turn_records(conversations)))


def mixed_records(conversations: DataFrame) -> DataFrame:
    """A table of turns as it comes from many sources: record_id and payload of conversations in six layouts, by conv_id modulo 6.

    Turn rows; lists of messages, of from and value, of dialogue lines, of messages in parts; and instruction with output,
    or, where a conversation isn't one user turn and one answer, messages beside other fields.
    """
    kind = F.pmod(F.col("conv_id"), F.lit(6))
    rows = turn_records(conversations.where((kind == 0) | F.col("conv_id").isNull()))
    whole = conversations.where(kind > 0).groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
    each = lambda f: F.transform("t", f)
    role = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    keep = {"ignoreNullFields": "false"}
    messages = each(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    from_value = each(lambda x: F.struct(role(x).alias("from"), x["text"].alias("value")))
    lines = each(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    parts = each(lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    pair = (F.size("t") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    last = F.when(pair, F.to_json(F.struct(first["text"].alias("instruction"), second["text"].alias("output")), keep)).otherwise(F.to_json(F.struct(messages.alias("messages"), F.struct(F.size("t").alias("size")).alias("meta")), keep))
    payload = F.when(kind == 1, F.to_json(F.struct(messages.alias("messages")), keep)).when(kind == 2, F.to_json(F.struct(from_value.alias("conversations")), keep)).when(kind == 3, F.to_json(F.struct(lines.alias("dialog")), keep)).when(kind == 4, F.to_json(F.struct(parts.alias("messages")), keep)).otherwise(last)
    return rows.unionByName(whole.select(F.col("conv_id").cast("string").alias("record_id"), payload.alias("payload")))


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of conversations, brought into six layouts, through the fingerprints and back into canonical turns."""
    chats = gather(format_records(mixed_records(read(spark, sf_dir, "conversations"))))
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), "part", "layout", "n_turns", "n_user", "n_assistant", "chat")


_CHAT = """CAST(count(*) FILTER (text <> '') AS INTEGER) AS n_turns,
       CAST(count(*) FILTER (text <> '' AND role = 'user') AS INTEGER) AS n_user, CAST(count(*) FILTER (text <> '' AND role = 'assistant') AS INTEGER) AS n_assistant,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) FILTER (text <> ''), '') AS chat"""
SQL = {
    "op7_chats": f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, CASE WHEN conv_id % 6 = 0 THEN turn // {TURNS} ELSE 0 END AS part, count(*) AS n, list(role ORDER BY turn, role, text) AS roles, {_CHAT} FROM t GROUP BY conv_id, part)
SELECT conv_id, CAST(part AS BIGINT) AS part,
       CASE conv_id % 6 WHEN 0 THEN 'turn_rows' WHEN 2 THEN 'conversations' WHEN 3 THEN 'dialogue' WHEN 4 THEN 'message_parts'
                        WHEN 5 THEN CASE WHEN roles = ['user', 'assistant'] THEN 'instruction' ELSE 'messages' END ELSE 'messages' END AS layout,
       n_turns, n_user, n_assistant, chat FROM whole
UNION ALL
SELECT NULL, 0, 'turn_rows', {_CHAT} FROM (SELECT *, row_number() OVER () AS r FROM conversations WHERE conv_id IS NULL) GROUP BY r
"""
}
