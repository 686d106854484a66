"""Chat formatting at token level, with loss masks and reversible escapes.

A turn becomes ``TURN role TEXT text END``. Role and text are encoded apart
from each other and from the template, whose three marks are reserved ids
beyond the vocabulary and are spliced in between. So no text can form a mark,
and no token spans a mark.

* **Escapes.** The decoded form shows the marks as strings, so a text that
  holds such a string (or one of ``CONTROLS``, which other templates or the
  tokenizer give a meaning) gets a backslash after its first character; one
  that holds the string with n backslashes there gets one more. Unescaping
  takes one away: texts come back exactly.
* **Masks** come from prefix sums: the lengths of a batch's segments give every
  segment's place, +1 and -1 at both ends of each trained text, summed up, give
  the mask.
* **Places.** Turns are put in order by range partitions, so a conversation
  with a third of all rows is dealt over many tasks. Each task counts turns and
  tokens from the start of its part of a conversation; what earlier tasks hold
  of the same one is a prefix sum over one row per task.
* **Digests** (:func:`digests`) read the written ids back. A digest of a whole
  conversation is one chain of bytes by its definition, so its turns pass one
  task in order, as a stream that keeps the running digest only.

Defined results: a null role or text is empty; turns come by number (null
first), rows that share one by role, then by a hash of the text, equal rows in
any order; rows whose conv_id is null are one conversation with a null id; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .packing import default_tokenizer, encoder

MARKS = ("<|turn|>", "<|text|>", "<|end|>")
TURN, TEXT, END = RESERVED = (50257, 50258, 50259)     # the vocabulary ends at 50256
#: Strings that a text may not show plainly: our marks and other templates' (none holds < or [ after its start).
CONTROLS = (*MARKS, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
TRAINED = "assistant"         # the role whose texts are under the loss mask
ROWS = 512                    # turns encoded or decoded at once

_REST = "|".join(rf"{re.escape(first)}%s(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)})" for first in "<[")
_PLAIN, _ESCAPED = (re.compile(_REST.replace("%s", rf"\\{many}")) for many in "*+")

FORMATTED = "conv_id long, part long, start long, bucket int, row long, ids array<int>, mask array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


def mask_of(lengths: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each row and the end, mask of all tokens) from the lengths
    of the rows' segments (rows x 5) and whether a row's text is trained on."""
    edge = np.concatenate([[0], np.cumsum(lengths.ravel())])
    turn = np.zeros(edge[-1] + 1, np.int64)
    text = np.flatnonzero(trained) * 5 + 3
    np.add.at(turn, edge[text], 1)
    np.add.at(turn, edge[text + 1], -1)
    return edge[::5], np.cumsum(turn[:-1]) > 0


def format_turns(turns: DataFrame, scratch: Scratch, tokenizer: str) -> DataFrame:
    """conv_id, part, start, ids, mask per row of ``turns`` (conv_id, turn, role, text).

    ``part`` numbers a conversation's turns from 0 and ``start`` is the place of
    the turn's first token in it. ``mask`` marks the tokens to be trained on.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "_h", "_tie"]
    ordered = rows.withColumn("_h", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id()) \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches):
        to_ids, bucket = encoder(tokenizer), TaskContext.get().partitionId()
        row, conv, part, start = 0, object(), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                convs, roles, texts = (batch.column(k).slice(lo, ROWS).to_pylist() for k in range(3))
                flat, lengths = [], np.ones((len(convs), 5), np.int64)
                for k, (role, text) in enumerate(zip(roles, texts)):
                    role, text = to_ids(escape(role)), to_ids(escape(text))
                    flat += [TURN, *role, TEXT, *text, END]
                    lengths[k, 1], lengths[k, 3] = len(role), len(text)
                edge, mask = mask_of(lengths, np.array([r == TRAINED for r in roles]))
                parts, starts = [], []
                for c, n in zip(convs, np.diff(edge).tolist()):
                    if c != conv:
                        conv, part, start = c, 0, 0
                    parts.append(part)
                    starts.append(start)
                    part, start = part + 1, start + n
                edge = pa.array(edge, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(convs, pa.int64()), pa.array(parts, pa.int64()), pa.array(starts, pa.int64()), pa.array([bucket] * len(convs), pa.int32()),
                     pa.array(range(row, row + len(convs)), pa.int64()), pa.ListArray.from_arrays(edge, pa.array(flat, pa.int32())),
                     pa.ListArray.from_arrays(edge, pa.array(mask))], [c.split()[0] for c in FORMATTED.split(", ")])
                row += len(convs)
    written = scratch.save(ordered.mapInArrow(run, FORMATTED), "formatted")
    # one row per task: what it holds of its last conversation, and which one it starts with
    ends = written.select("bucket", "row", "conv_id", F.struct((F.col("part") + 1).alias("parts"), (F.col("start") + F.size("ids")).alias("tokens")).alias("held")) \
        .groupBy("bucket").agg(F.min_by(F.struct("conv_id"), "row").alias("first"), F.max_by(F.struct("conv_id"), "row").alias("last"),
                               F.max_by("held", "row").alias("held"))
    by_task, same = Window.orderBy("bucket"), Window.partitionBy("last").orderBy("bucket")
    before = ends.withColumn("parts", F.sum("held.parts").over(same)).withColumn("tokens", F.sum("held.tokens").over(same)) \
        .select("bucket", "first", F.lag("last").over(by_task).alias("prior"), F.lag("parts").over(by_task).alias("parts"),
                F.lag("tokens").over(by_task).alias("tokens")) \
        .where(F.col("first").eqNullSafe(F.col("prior"))).select("bucket", "first", "parts", "tokens")
    goes_on = F.coalesce(F.col("first.conv_id").eqNullSafe(F.col("conv_id")) & F.col("parts").isNotNull(), F.lit(False))
    return written.join(F.broadcast(before), "bucket", "left").select(
        "conv_id", (F.col("part") + F.when(goes_on, F.col("parts")).otherwise(0)).alias("part"),
        (F.col("start") + F.when(goes_on, F.col("tokens")).otherwise(0)).alias("start"), "ids", "mask")


def decoder(tokenizer: str):
    """id -> bytes, from the ranks beside the tokenizer file or from the file itself."""
    ranks = os.path.splitext(tokenizer)[0] + ".tiktoken"
    if os.path.exists(ranks):
        with open(ranks, "rb") as lines:
            table = {int(b): base64.b64decode(a) for a, b in (x.split() for x in lines if x.strip())}
    else:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        code = {}                     # the byte-level alphabet: each byte as the character that stands for it
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        for b in plain:
            code[chr(b)] = b
        for k, b in enumerate(b for b in range(256) if b not in plain):
            code[chr(256 + k)] = b
        assert set(code) == set(ByteLevel.alphabet())
        table = {i: bytes(code[c] for c in t) for t, i in Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=False).items()
                 if all(c in code for c in t)}
    for i, mark in zip(RESERVED, MARKS):
        table[i] = mark.encode()
    return table


def read_turns(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, part, role, text, trained (the text under the mask), chars, read from the ids."""
    def run(batches):
        known = decoder(tokenizer)
        table = pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())

        def shown(ids):
            """The tokens' bytes joined, and where each token's begin."""
            taken = table.take(pa.array(ids))
            _, edge, raw = taken.buffers()
            return raw.to_pybytes() if raw is not None else b"", np.frombuffer(edge, np.int64)[:len(ids) + 1]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                cut = batch.slice(lo, ROWS)
                ids = cut.column(2).flatten().to_numpy()
                mask = cut.column(3).flatten().to_numpy(zero_copy_only=False)
                turn, mid, close = (np.flatnonzero(ids == m) for m in RESERVED)
                last = np.append(turn[1:], len(ids)) - 1
                if len(turn) != len(cut) or not (np.array_equal(close, last) and len(mid) == len(turn) and ((turn < mid) & (mid < close)).all()):
                    raise ValueError("a row is not TURN role TEXT text END")
                raw, edge = shown(ids)
                under, place = shown(ids[mask])
                place = place[np.concatenate([[0], np.cumsum(mask)])]        # masked bytes before each token
                text = lambda source, at, a, b: [unescape(source[i:j].decode()) for i, j in zip(at[a].tolist(), at[b].tolist())]
                after = close + 1
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(text(raw, edge, turn + 1, mid), pa.string()), pa.array(text(raw, edge, mid + 1, close), pa.string()),
                     pa.array(text(under, place, turn, after), pa.string()),
                     pa.array([len(raw[i:j].decode()) for i, j in zip(edge[turn].tolist(), edge[after].tolist())], pa.int64())],
                    ["conv_id", "part", "role", "text", "trained", "chars"])
    return formatted.select("conv_id", "part", "ids", "mask") \
        .mapInArrow(run, "conv_id long, part long, role string, text string, trained string, chars long")


def digests(read: DataFrame) -> DataFrame:
    """``DIGESTS`` per conversation of :func:`read_turns`; turns pass as a stream."""
    def run(batches):
        conv, held, names = object(), None, [c.split()[0] for c in DIGESTS.split(", ")]
        done = lambda rows: pa.RecordBatch.from_pylist(
            [dict(zip(names, (c, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))) for c, (n, turns, loss_chars, loss, chars) in rows],
            pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))
        for batch in batches:
            over = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    over += [(conv, held)] if held else []
                    conv, held = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += 1
                held[1].update(f"{row['role']}\n{row['text']}\n".encode())
                held[2] += len(row["trained"])
                held[3].update((row["trained"]).encode())
                held[4] += row["chars"]
            if over:
                yield done(over)
        if held:
            yield done([(conv, held)])
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGESTS)


def round_trip(turns: DataFrame, scratch: Scratch, tokenizer: str | None = None) -> DataFrame:
    """``DIGESTS`` of ``turns``, formatted, written and read back."""
    tokenizer = tokenizer or default_tokenizer()
    return digests(read_turns(format_turns(turns, scratch, tokenizer), tokenizer))


#: The conversation that the registered query adds.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, TRAINED, "</s>[INST] ok [/INST]")]


def oracle() -> str:
    """DuckDB SQL of the registered query."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    shown = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
    added = ", ".join(f"({c}, {t}, {quote(r)}, {quote(x)})" for c, t, r, x in PROBE)
    extra = lambda c: f"(length({c}) + len(regexp_extract_all({c}, {quote(shown)})))"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {added})))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = '{TRAINED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum({sum(map(len, MARKS))} + {extra('role')} + {extra('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
