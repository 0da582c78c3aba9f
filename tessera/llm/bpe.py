"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can be inside no encoded token either, so a text may be cut
between the two bytes, the fragments encoded on their own and the ids concatenated. Of these certain cuts the
ones in front of white space are used: there the pre-tokenizer, too, ends a piece, or may end one without moving
any other boundary. Texts of any length are so encoded in fragments of about FRAGMENT bytes.

Defined results: a null text has the ids and the decoded text of the empty text; order and number of rows, and
all other columns (but for earlier ones named like the new ones), stay as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import SPACE, slices

#: A fragment ends at the first certain cut after this many bytes.
FRAGMENT = 2048

#: The pre-tokenizer that a byte-level BPE file with "use_regex" stands for: a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the pre-tokenizer knows it, in runs that its splitter cannot take.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ForcedBoundaryCodec:
    """Encodes and decodes with the vocabulary file at `path` (a byte-level BPE in the tokenizers library's JSON)."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: a byte-level BPE without normalizer and prefix space is needed")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ())):
            raise ValueError(f"{path}: added tokens must not touch white space")
        of = byte_of_char()
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ranks[bytes(of[c] for c in a + b)] for a, b in pairs]
        if made != sorted(made):
            raise ValueError(f"{path}: ids must follow the order of the merges")
        self.bpe = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=added)
        self.added = {k.encode(): i for k, i in added.items()}
        self.split = re.compile(b"(" + b"|".join(re.escape(k) for k in sorted(self.added, key=len, reverse=True)) + b")") if added else None
        #: certain[x, y]: no token holds the bytes x, y side by side.
        self.certain = np.ones((256, 256), dtype=bool)
        for token in ranks:
            t = np.frombuffer(token, dtype=np.uint8)
            self.certain[t[:-1], t[1:]] = False
        self.cuts_at = self.certain & SPACE[None, :] & ~SPACE[:, None]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in front of which the bytes may be cut."""
        return np.flatnonzero(self.cuts_at[data[:-1], data[1:]]) + 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids begin (one more entry closes the last)."""
        raw, cuts = data.tobytes(), self.cuts(data)
        ids: list[list[int]] = []
        sizes = np.zeros(len(offsets) - 1, dtype=np.int64)
        for k, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            at = start
            while at < end:
                c = np.searchsorted(cuts, at + FRAGMENT)
                to = min(end, int(cuts[c])) if c < len(cuts) else end
                got = self._fragment(raw[at:to])
                sizes[k] += len(got)
                ids.append(got)
                at = to
        flat = np.fromiter((i for part in ids for i in part), dtype=np.int32, count=int(sizes.sum()))
        return flat, np.concatenate(([0], np.cumsum(sizes)))

    def _fragment(self, raw: bytes) -> list[int]:
        if self.split is None or not any(k in raw for k in self.added):
            return self._plain(raw.decode())
        parts = self.split.split(raw)
        return [i for p in parts for i in ([self.added[p]] if p in self.added else self._plain(p.decode()))]

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens. A run of white space is a piece of its own but for its last character, which the next piece may begin with; long runs are so cut off before the splitter."""
        if len(text) < 10_000:
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.bpe.encode_ordinary(text[at : run.start()])
            out += self.bpe._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.bpe.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode("utf-8", errors="replace")


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Append `ids` (array of int), and with `decoded` also the text decoded from them in the same pass."""
    names = [c for c in docs.columns if c not in (ids, decoded)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows, data, offsets in slices(batches, text, 1 << 20):
            flat, where = c.encode(data, offsets)
            columns = [rows.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat))]
            if decoded:
                columns.append(pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(where[:-1], where[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*dict.fromkeys([*(f"`{c}`" for c in names), f"`{text}`"])).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of each row's ids; null ids give the empty text."""
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for rows in batches:
            texts = pa.array([c.decode(x or []) for x in rows.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(n) for n in schema.names[:-1]] + [texts], names=schema.names)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    coded = encode(docs.select("doc_id", "text"), path, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
