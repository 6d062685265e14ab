"""Encoding with a public byte-level BPE vocabulary by a streaming transducer.

The encoding of a text by merge rank is the only division of it into vocabulary tokens in which every two neighbours
would stay apart if they were encoded alone. So the last token of each prefix follows from the last tokens of
the shorter prefixes, and no token reaches further back than the longest one of the vocabulary. The transducer keeps
the prefixes within that reach, and emits the tokens that all of them have in common: later bytes cannot change these.
"""

from __future__ import annotations

import base64
import codecs
import os
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread, table

#: The folder of the vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the published pattern that divides a text before the merges of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, blank, id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Streaming encoder of one merge list; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.lookahead = max(map(len, ranks))
        self._apart: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the pair of lowest rank, the first of equal ones, until none is left. For short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank == sys.maxsize:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: bytes, b: bytes) -> bool:
        """True if a and b stay two tokens when encoded together."""
        key = (a, b)
        if (known := self._apart.get(key)) is None:
            if len(self._apart) > 1 << 20:
                self._apart.clear()
            known = self._apart[key] = self.merged(a + b) == [a, b]
        return known

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in blocks, each as soon as it is stable."""
        ranks, reach = self.ranks, self.lookahead
        last: dict[int, bytes] = {}  # end of a prefix -> its last token
        held, base, end, done = b"", 0, 0, 0  # held: bytes from base on; done: everything before it is emitted
        for block in blocks:
            held += block
            for end in range(end + 1, base + len(held) + 1):
                for start in range(max(done, end - reach), end):
                    tok = held[start - base : end - base]
                    if tok in ranks and (start == 0 or (start in last and self.apart(last[start], tok))):
                        last[end] = tok
                        break
                if end - done >= 2 * reach:
                    live = {e for e in range(end - reach + 1, end + 1) if e in last}
                    paths = []
                    for e in live:
                        path = []
                        while e > done:
                            path.append(e)
                            e -= len(last[e])
                        paths.append(path[::-1])
                    common = 0
                    for cuts in zip(*paths):
                        if len(set(cuts)) > 1:
                            break
                        common += 1
                    for e in paths[0][:common] if paths else []:
                        yield ranks[last[e]]
                        done = e
                    keep = max(base, done - reach)
                    held, base = held[keep - base :], keep
                    last = {e: t for e, t in last.items() if e >= done}
        path = []
        while end > done:
            path.append(last[end])
            end -= len(last[end])
        yield from (ranks[t] for t in reversed(path))


class Encoder(dict):
    """Pieces to ids; keeps the ids of short pieces it has met, up to a bound."""

    MOST, LONG = 1 << 18, 48

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.transducer.ranks.get(raw)) is not None:
            ids = [whole]
        else:
            ids = list(self.transducer.stream(raw[i : i + 4096] for i in range(0, len(raw), 4096)))
        if len(raw) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            pieces = self.pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text))
            for p in pieces:
                out += self[p]
        return out


def decode_stream(ids: Iterable[int], by_id: dict[int, bytes]) -> Iterator[str]:
    """Text of ids as it becomes complete: bytes of an unfinished character wait for the rest."""
    d = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if part := d.decode(by_id[i]):
            yield part
    if part := d.decode(b"", True):
        yield part


def worker_encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each worker process."""
    kept = sys.modules.setdefault("_lumentext_kept", types.ModuleType("_lumentext_kept")).__dict__
    if path not in kept:
        kept[path] = Encoder(load_ranks(path))
    return kept[path]


def encode_corpus(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) of every row of ``docs``; empty and NULL texts give the empty list, no rows give no rows.

    Strings that look like special tokens are ordinary text. Rows are taken as they come, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path)
        for b in batches:
            ids, ends, n = [], np.zeros(b.num_rows + 1, np.int64), 0
            for i, t in enumerate(b.column(1).to_pylist(), 1):
                one = np.array(enc.encode(t), np.int32)
                n += len(one)
                ends[i] = n
                ids.append(one)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, ids array<int>")


def p8_ids(spark, d: str, name: str = "byte_bpe_50k") -> DataFrame:
    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", os.path.join(TOKENIZERS, f"{name}.tiktoken"))
