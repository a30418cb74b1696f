"""Chat formatting on token level.

Every turn's role and text are escaped and encoded apart from the others; a
conversation is then put together from these segments with the reserved ids
between them.  Lengths of the segments give the loss mask by prefix sums: it
covers the texts of assistant turns, nothing else.

    <|im_start|>role\\ntext<|im_end|>\\n

Content can't produce a reserved id, and ``<|`` inside content gets a backslash
behind the ``<`` (one more if some stand there), so the printed form is
unambiguous too; line feeds and backslashes in roles are escaped.

Results in odd cases: null texts and roles are empty; rows of one turn number
are ordered by role, then text, and repeated rows stay; a null turn comes
first; a null conversation id is a conversation; other columns are ignored; an
empty table gives an empty result.  Encoding runs per turn, before the turns of
a conversation meet; a conversation is one output row, so only its own tokens
meet in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm import byte_bpe

#: Ranks of a public byte-level vocabulary of 50,256 tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
START, END = 50_257, 50_258
MARKS = {START: b"<|im_start|>", END: b"<|im_end|>"}
LEARNED = "assistant"
#: Longer segments are encoded by the operator for long pieces, which finds the same ids in bounded memory.
CUT = 8192

# Fixed value: how that vocabulary splits texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_OPEN = re.compile(r"<(\\*)\|")
_OPENED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Codec:
    """The vocabulary, loaded where it is first used."""

    def __init__(self, path: str):
        self.path, self.loaded, self.long = path, None, None

    def __reduce__(self):
        return Codec, (self.path,)

    @property
    def encoding(self):
        if self.loaded is None:
            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.loaded = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self.loaded

    def encode(self, text: str) -> list[int]:
        if len(text) <= CUT:
            return self.encoding.encode_ordinary(text)
        if self.long is None:
            self.long = byte_bpe.Codec(self.path, PATTERN)
        return self.long.encode(text)

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8", "replace")


def encoded_turns(rows: DataFrame, codec: Codec, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            head = [codec.encode(escape_role(r) + "\n") for r in roles]
            body = [codec.encode(escape(t)) for t in texts]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(head, ints), pa.array(body, ints),
                 batch.column("text")], ["conv_id", "turn", "role", "head", "body", "text"])

    plain = rows.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "conv_id bigint, turn bigint, role string, head array<int>, body array<int>, text string")


def assemble(segments: list[tuple[list[int], list[int], bool]], close: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation; segments hold header, text and whether it is learned."""
    parts, lengths, learned = [], [], []
    for head, body, learn in segments:
        parts += [[START], head, body, [END], close]
        lengths += [1, len(head), len(body), 1, len(close)]
        learned += [0, 0, int(learn), 0, 0]
    ids = np.array([i for p in parts for i in p], np.int32)
    ends = np.cumsum(lengths, dtype=np.int64)
    steps = np.zeros(len(ids) + 1, np.int32)
    flags = np.array(learned, np.int32)
    np.add.at(steps, ends - np.array(lengths, np.int64), flags)
    np.add.at(steps, ends, -flags)
    return ids, np.cumsum(steps[:-1]).astype(bool)


def format_chats(rows: DataFrame, tokenizer: str = TOKENIZER, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per conversation: ``ids`` and ``loss_mask``."""
    codec = Codec(tokenizer)
    turns = encoded_turns(rows, codec, conv_id, turn, role, text)
    chats = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["head"].alias("head"), t["body"].alias("body"), (t["role"] == LEARNED).alias("learn"))).alias("turns"))

    def run(batches):
        close = codec.encode("\n")
        for batch in batches:
            ids, masks = [], []
            for turns in batch.column("turns"):
                made = assemble([(t["head"], t["body"], t["learn"]) for t in turns.as_py()], close)
                ids.append(made[0])
                masks.append(made[1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                                             ["conv_id", "ids", "loss_mask"])

    return chats.mapInArrow(run, "conv_id bigint, ids array<int>, loss_mask array<boolean>")


def read_back(codec: Codec, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str], str]:
    """Turns, texts under the mask (one per run), and the printed form, from ids and mask alone."""
    turns, printed = [], []
    starts, ends = np.flatnonzero(ids == START), np.flatnonzero(ids == END)
    at = 0
    for a, b in zip(starts, ends):
        printed += [codec.decode(ids[at:a]), MARKS[START].decode(), said := codec.decode(ids[a + 1:b]), MARKS[END].decode()]
        role, _, content = said.partition("\n")
        turns.append((unescape_role(role), unescape(content)))
        at = b + 1
    printed.append(codec.decode(ids[at:]))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    learned = [unescape(codec.decode(ids[a:b])) for a, b in zip(edges[0::2], edges[1::2])]
    return turns, learned, "".join(printed)


def chat_digests(chats: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What can be read back from formatted conversations: counts and SHA-256 digests."""
    codec = Codec(tokenizer)

    def run(batches):
        sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
        for batch in batches:
            out = []
            for ids, mask in zip(batch.column("ids"), batch.column("loss_mask")):
                turns, learned, printed = read_back(codec, ids.values.to_numpy(), np.array(mask.as_py(), bool))
                out.append((len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, learned)), sha(learned), len(printed)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["conv_id", *names])

    return chats.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
