"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: ``<|turn|>role`` line feed ``text<|end|>`` line feed
for every turn. Strings that could pass for control marks (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``) get a backslash behind their first character, and one more if they
have some: reversible, and no mark can come from a text. The rendered text is encoded once
with offsets; sorted turn spans meet token spans by binary search. A token that reaches over
the edge of a turn, or shares a character with the one before, is under the mask with its own
part only (start and stop in code points), so that the mask holds every assistant text once.

Rows are sorted by conversation within their partitions and streamed; what a task holds is
one conversation. Edge cases: null text is empty; turns are ordered by turn, role, text with
nulls first; a null role reads as empty; a row without conversation id is a conversation of
its own; repeated rows are turns; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_of, share, table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans of the assistant texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, CLOSE
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, stop) of the tokens under the spans; offsets are sorted code point spans."""
    start, stop = offsets[:, 0], offsets[:, 1]
    start = np.maximum(start, np.concatenate([[0], stop[:-1]]))  # parts of one character count once
    token, a, b = [], [], []
    for s, e in spans:
        k = np.arange(np.searchsorted(stop, s, "right"), np.searchsorted(start, e, "left"))
        token.append(k)
        a.append(np.maximum(start[k], s))
        b.append(np.minimum(stop[k], e))
    token, a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (token, a, b))
    full = a < b
    return token[full], a[full], b[full]


def format_chats(rows: DataFrame, tokenizer_file: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, ids, loss_token, loss_start, loss_stop."""
    with open(tokenizer_file, encoding="utf-8") as f:
        source = share(rows.sparkSession, f.read())
    ints = pa.list_(pa.int32())
    schema = pa.schema([("id", pa.int64()), ("formatted", pa.string()), ("ids", ints), ("loss_token", ints), ("loss_start", ints), ("loss_stop", ints)])

    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(source.value)
        tok.encode_special_tokens = True  # special strings in a text are ordinary text

        def done(i, turns):
            text, spans = render(turns)
            enc = tok.encode(text, add_special_tokens=False)
            return i, text, enc.ids, *mask(np.array(enc.offsets, np.int64).reshape(-1, 2), spans)

        open_, turns, out, size = None, [], [], 0
        for b in batches:
            for i, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if turns and (i is None or i != open_):
                    out.append(done(open_, turns))
                    size += len(out[-1][1])
                    turns = []
                open_ = i
                turns.append((role or "", text or ""))
                if size > 4 << 20:
                    yield batch_of(schema, list(zip(*out, strict=True)))
                    out, size = [], 0
        if turns:
            out.append(done(open_, turns))
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))

    c = rows.select(F.col(id_col).cast("bigint").alias("i"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    # Rows without id would all hash to one task; they are spread instead.
    dealt = c.withColumn("k", F.coalesce("i", F.xxhash64("t", "r", "x"))).repartition("k").sortWithinPartitions("i", "t", "r", "x")
    out = dealt.select("i", "r", "x").mapInArrow(run, "id long, formatted string, ids array<int>, loss_token array<int>, loss_start array<int>, loss_stop array<int>")
    return out.withColumnRenamed("id", id_col)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def under_mask(formatted: str, start: list[int], stop: list[int]) -> str:
    """Unescaped text under the mask; parts that touch belong to one turn."""
    runs: list[list[int]] = []
    for a, b in zip(start, stop, strict=True):
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests read from the formatted output alone."""
    schema = pa.schema([("id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        for b in batches:
            out = []
            for i, text, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns, loss = parse(text), under_mask(text, a, z)
                out.append((i, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    out = chats.select(id_col, "formatted", "loss_start", "loss_stop").mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_chats(rows, public_tokenizers.path("byte_bpe_50k.json")))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\])')) AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + len(role) + 1 + escaped + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
