"""Chat formatting by token-level assembly.

Every turn is encoded on its own as ordinary text, so no control token can come out of its content; the template's
control strings exist as reserved ids beyond the vocabulary and are spliced in between. The text view of the result
stays unambiguous too: control strings inside content get a backslash after their first character (one more if
they have some already), which reading back removes. The loss mask is the prefix sum of +1 behind the mark that
opens an assistant's text and -1 at the mark that closes it. ``start`` is each turn's place in its conversation's
token sequence, the prefix sum of the lengths before it.

Turns are encoded where they lie; only token ids are shuffled, sorted by turn inside each conversation, and pass
one by one, so a long conversation is never gathered. Ties in ``turn`` are ordered by role and text digest, null turns come first. A null
text or role is the empty one; rows with a null conv_id form one conversation. Extra columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabulary splits text into pieces (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[SEP]"]
#: Marks around the text of a turn; other roles are written out between [ROLE] and [SEP].
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]")
LEARN = "assistant"

_HELD = re.compile(r"([<\[])(\\*)(/?(?:INST|SYS|OUT|ROLE|SEP)\]|/?s>)")
_KEPT = re.compile(r"([<\[])\\(\\*)(/?(?:INST|SYS|OUT|ROLE|SEP)\]|/?s>)")


def escape(text: str) -> str:
    return _HELD.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _KEPT.sub(r"\1\2\3", text)


@lru_cache(2)
def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 2


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary's lines (token in base64, rank); about a megabyte, sent to the tasks as it is."""
    with open(path, "rb") as f:
        return f.read()


def assemble(role: str, text: str, coder, base: int) -> tuple[list[int], np.ndarray]:
    """Token ids of one turn and their loss mask."""
    open_, close = MARKS.get(role, OTHER)
    head = [base + CONTROL.index(open_)]
    if role not in MARKS:
        head += [*coder.encode_ordinary(escape(role)), base + CONTROL.index("[SEP]")]
    body = coder.encode_ordinary(escape(text))
    ids = [*head, *body, base + CONTROL.index(close)]
    step = np.zeros(len(ids), np.int8)
    if role == LEARN and body:
        step[len(head)] += 1
        step[len(head) + len(body)] -= 1
    return ids, np.cumsum(step)


def encode_rows(vocabulary):
    def run(batches):
        coder, base = encoder(vocabulary.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            turns = [assemble(role, text, coder, base) for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in turns])]), pa.int32())
            ids = np.fromiter((t for i, _ in turns for t in i), np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "digest")), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m for _, m in turns]), pa.int8()))], ["conv_id", "turn", "role", "digest", "ids", "mask"])

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()


def place_rows(base: int):
    """Turns sorted by conversation: the mark that begins a conversation before its first, and running starts."""

    def run(batches):
        last, start = object(), 0
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            if not convs:
                continue
            ids, offs = flat(batch.column("ids"))
            masks, _ = flat(batch.column("mask"))
            first = np.array([c != p for c, p in zip(convs, [last, *convs])])
            size = np.diff(offs) + first
            starts = np.empty(len(convs), np.int64)
            for i, n in enumerate(size.tolist()):
                start = 0 if first[i] else start
                starts[i] = start
                start += n
            last = convs[-1]
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            ids = np.insert(ids, offs[:-1][first], base + CONTROL.index("<s>"))
            masks = np.insert(masks, offs[:-1][first], 0)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(masks, pa.int8()))], ["conv_id", "turn", "start", "ids", "mask"])

    return run


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, turn, start, ids, mask: one row per turn, the rows of a conversation in one partition and in order;
    their ids one after the other are the conversation's tokens."""
    words = read_vocabulary(vocabulary)
    shared = turns.sparkSession.sparkContext.broadcast(words)
    base = max(int(line.split()[1]) for line in words.splitlines()) + 2
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))
    encoded = rows.mapInArrow(encode_rows(shared), "conv_id long, turn long, role string, digest string, ids array<int>, mask array<tinyint>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.mapInArrow(place_rows(base), "conv_id long, turn long, start long, ids array<int>, mask array<tinyint>")


def parse(ids: np.ndarray, coder, base: int) -> tuple[str, str, int]:
    """Role, text and formatted length of one turn's tokens."""
    at = np.flatnonzero(ids >= base)
    names = [CONTROL[c] for c in (ids[at] - base).tolist()]
    size = sum(map(len, names))
    begin = int(names[0] == "<s>")
    role, first = next((r for r, m in MARKS.items() if m[0] == names[begin]), None), at[begin]
    if role is None:
        written = coder.decode(ids[first + 1:at[begin + 1]].tolist())
        role, first, size = unescape(written), at[begin + 1], size + len(written)
    written = coder.decode(ids[first + 1:at[-1]].tolist())
    return role, unescape(written), size + len(written)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def summary_rows(vocabulary):
    """Read conversations back from their tokens, turn by turn, into running digests."""

    def run(batches):
        coder, base = encoder(vocabulary.value)
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        state = None

        def close():
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        for batch in batches:
            done = []
            ids, offs = flat(batch.column("ids"))
            masks, _ = flat(batch.column("mask"))
            for conv, start, lo, hi in zip(batch.column("conv_id").to_pylist(), batch.column("start").to_pylist(), offs, offs[1:]):
                if start == 0:
                    if state:
                        done.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, size = parse(ids[lo:hi], coder, base)
                learned = unescape(coder.decode(ids[lo:hi][masks[lo:hi] > 0].tolist()))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += size
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done])
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(names, close()))])

    return run


def read_back(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per conversation of ``formatted``: its turns, the text under the loss mask and its formatted length, decoded
    from the tokens alone."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return rows.mapInArrow(summary_rows(shared), SUMMARY)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user and an assistant that both say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
