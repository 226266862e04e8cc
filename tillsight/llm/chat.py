"""Chat formatting by token-level assembly.

Every role and text is encoded on its own with a public byte-level BPE vocabulary;
the template's control strings never pass through the encoder but are spliced in
as reserved ids beyond the vocabulary. A conversation is

    <s> then per turn: [INST] role [/INST] text </s>

(without blanks). Control strings that occur in a role or text are escaped by a
backslash after their first character (``<\\s>``); those that already hold
backslashes there get one more, so the escape can be undone exactly. The loss mask
covers the tokens of assistant texts: +1 where one begins, -1 behind it, summed
from the left.

Rows are encoded and assembled in one streaming pass over partitions sorted by
conversation and turn; memory holds one conversation at a time.

Edge cases: a null text or role is empty; a null conversation id is a conversation
of its own; turns with the same number are ordered by role, then text (nulls
first); repeated rows are repeated turns; an empty table gives no rows; extra
columns are ignored. Very long texts are encoded in pieces of 50,000 characters,
which decode to the same text.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings, in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
PIECE_CHARS = 50_000
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_ESCAPE = re.compile(r"(<)(\\*/?s>)|(\[)(\\*/?INST\])")
_UNESCAPE = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])")
_encoders: dict = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4]), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


class Codec:
    """The vocabulary and the reserved ids behind it."""

    def __init__(self, file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks,
                                     special_tokens={})
        self.base = max(ranks.values()) + 1
        self.control = {s: self.base + i for i, s in enumerate(CONTROLS)}

    def encode(self, text: str) -> list[int]:
        text = escape(text)
        return [t for i in range(0, len(text), PIECE_CHARS)
                for t in self.bpe.encode_ordinary(text[i:i + PIECE_CHARS])]

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a conversation."""
        start, end, opening, closing = (self.control[s] for s in CONTROLS)
        ids, steps = [start], []
        for role, text in turns:
            ids += [opening, *self.encode(role), closing]
            body = self.encode(text)
            if role == "assistant":
                steps += [(len(ids), 1), (len(ids) + len(body), -1)]
            ids += [*body, end]
        delta = np.zeros(len(ids) + 1, np.int8)
        for at, step in steps:
            delta[at] += step
        return np.array(ids, np.int32), np.cumsum(delta[:-1], dtype=np.int8)

    def decode(self, ids) -> str:
        """Formatted text of ids, reserved ones as their control strings."""
        out, run = [], []
        for t in [*ids, self.base]:
            if t < self.base:
                run.append(t)
                continue
            out.append(self.bpe.decode_bytes(run).decode())
            out.append(CONTROLS[t - self.base])
            run = []
        return "".join(out[:-1])

    def read(self, ids: list[int], mask: list[int]):
        """Turns, loss texts and formatted text, from the ids and the mask alone."""
        cuts = [i for i, t in enumerate(ids) if t >= self.base]
        turns, formatted, role, last = [], [], "", -1
        for i in cuts:
            between = self.bpe.decode_bytes(ids[last + 1:i]).decode()
            formatted += [between, CONTROLS[ids[i] - self.base]]
            if ids[i] == self.control["[/INST]"]:
                role = unescape(between)
            elif ids[i] == self.control["</s>"]:
                turns.append((role, unescape(between)))
            last = i
        edges = np.flatnonzero(np.diff(np.array([0, *mask, 0], np.int8)))
        loss = [unescape(self.bpe.decode_bytes(ids[a:b]).decode())
                for a, b in zip(edges[::2], edges[1::2])]
        return turns, loss, "".join(formatted)


def _codec(shared) -> Codec:
    file, pattern = shared.value
    key = hashlib.sha256(file).digest()
    if key not in _encoders:
        _encoders[key] = Codec(file, pattern)
    return _encoders[key]


def _share(spark: SparkSession, vocabulary: str):
    """The vocabulary file (about 1 MB, fixed) for all executors."""
    from public_tokenizers import PATTERN
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), PATTERN))


def _formatter(shared, id_type: pa.DataType):
    def run(batches):
        codec, held, turns = _codec(shared), None, []

        def finish():
            ids, mask = codec.assemble(turns)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0]], id_type), pa.array([len(turns)], pa.int64()),
                 pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))],
                ["conv_id", "n_turns", "input_ids", "loss_mask"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist()
                                          for c in ("conv_id", "role", "text"))):
                if held is not None and held[0] != conv:
                    yield finish()
                    turns = []
                held = (conv,)
                turns.append((role or "", text or ""))
        if held is not None:
            yield finish()
    return run


def format_conversations(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, input_ids and loss_mask of every conversation."""
    shared = _share(rows.sparkSession, vocabulary)
    rows = rows.select("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    ordered = (rows.repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.mapInArrow(
        _formatter(shared, to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, n_turns long, input_ids array<int>, "
        "loss_mask array<tinyint>")


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, turns, loss texts and the formatted text, decoded from the ids."""
    shared = _share(formatted.sparkSession, vocabulary)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mask = (batch.column(c)[i].as_py() for c in ("input_ids", "loss_mask"))
                turns, loss, text = codec.read(ids, mask)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(i, 1),
                     pa.array([[{"role": r, "text": t} for r, t in turns]], pa.list_(
                         pa.struct([("role", pa.string()), ("text", pa.string())]))),
                     pa.array([loss], pa.list_(pa.string())), pa.array([text], pa.string())],
                    ["conv_id", "turns", "loss_texts", "formatted"])

    return formatted.select("conv_id", "input_ids", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, turns array<struct<role:string,text:string>>, "
             "loss_texts array<string>, formatted string")


def conversation_report(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digest columns per conversation, all taken from the read-back output."""
    back = read_back(format_conversations(rows, vocabulary), vocabulary)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
