"""Byte-level BPE encoding and decoding over Arrow batches.

The ranks file gives the vocabulary; the two parts that a token was merged from follow from the ranks themselves.
Texts become characters of the byte alphabet, one for each byte, as the tokenizers library does it; decoding reverses
that table: pieces to characters, characters to bytes. A character may be split between tokens, so decoding gives
bytes, which are text only as a whole (or as decode_stream puts it together), and parts of a character have its offsets.

Defined cases: null text is empty (no ids, no bytes); special strings are ordinary text; an id outside the vocabulary
raises; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int], rank: int) -> tuple[bytes, bytes]:
    """The two tokens that merge into this one: merge its bytes by all lower ranks."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1))
        if best >= rank:
            raise ValueError(f"{token!r} cannot be merged from lower ranks")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """The tokenizers library's BPE with these ranks, splitting by the pattern; made once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_alphabet()
    shown = {t: "".join([table[b] for b in t]) for t in ranks}
    merges = [tuple(shown[p] for p in _parts(t, ranks, r)) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[dict[int, bytes], np.ndarray]:
    """By id: the bytes for which the characters of its piece stand, by the reversed alphabet, and how many they are."""
    shown = byte_alphabet()
    back = {c: b for b, c in enumerate(shown)}
    pieces = {r: "".join([shown[b] for b in t]) for t, r in read_ranks(path).items()}
    out = {r: bytes([back[c] for c in piece]) for r, piece in pieces.items()}
    return out, np.array([len(out.get(r, b"")) for r in range(max(out, default=-1) + 1)], np.int64)


def decode(ids: list[int], path: str) -> bytes:
    """The bytes of all ids, one after the other: a character that is split between ids is whole again only here."""
    try:
        return b"".join(map(byte_table(path)[0].__getitem__, ids))
    except KeyError as e:
        raise ValueError(f"id {e} is outside the vocabulary") from None


def decode_stream(ids: list[int], path: str) -> list[str]:
    """The text that each id adds: an id that ends inside a character adds what is whole, and the next ones the rest."""
    whole = codecs.getincrementaldecoder("utf-8")()
    return [whole.decode(decode([i], path)) for i in ids]


def split_characters(ids: list[int] | np.ndarray, decoded: bytes, path: str) -> int:
    """How many ids end inside a character: the byte after them continues one."""
    if len(ids) < 2:
        return 0
    ends = np.cumsum(byte_table(path)[1][np.asarray(ids)])[:-1]
    return int(((np.frombuffer(decoded, np.uint8)[ends] & 0xC0) == 0x80).sum())


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) and, if asked for, offsets: the [start, end) code points of each token, equal for parts of a character."""
    schema = "doc_id long, ids array<int>" + ", offsets array<array<int>>" * offsets

    def make(c: dict[str, list]) -> dict[str, list]:
        made = tokenizer(path, pattern)
        run = made.encode_batch if offsets else made.encode_batch_fast
        encoded = run([t or "" for t in c["text"]], add_special_tokens=False)
        return {"doc_id": c["doc_id"], "ids": [e.ids for e in encoded]} | ({"offsets": [[list(o) for o in e.offsets] for e in encoded]} if offsets else {})

    return map_batches(docs.select("doc_id", "text"), make, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of encoded(doc_id, ids)."""
    return map_batches(encoded.select("doc_id", "ids"), lambda c: {"doc_id": c["doc_id"], "bytes": [decode(i or [], path) for i in c["ids"]]}, "doc_id long, bytes binary")


def _encoded(texts: list[str | None], made) -> Iterator[list[int]]:
    """The ids of each text, one text at a time: its ids are gone before the next, and groups of texts cost more."""
    for text in texts:
        yield made.encode_batch_fast([text or ""], add_special_tokens=False)[0].ids


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split): ids stay in the task that made them. n_split: ids that end inside a character."""

    def make(c: dict[str, list]) -> dict[str, list]:
        made, out = tokenizer(path, pattern), []
        for ids in _encoded(c["text"], made):
            back, numbers = decode(ids, path), np.array(ids, "<u4")
            out.append((len(ids), hashlib.sha256(numbers.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), split_characters(numbers, back, path)))
        return {"doc_id": c["doc_id"]} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "n_split"), zip(*out) if out else [[]] * 4))

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256); raises where the decoded ids are not the text's bytes."""

    def make(c: dict[str, list]) -> dict[str, list]:
        made, out = tokenizer(path, pattern), []
        for doc_id, text, ids in zip(c["doc_id"], c["text"], _encoded(c["text"], made)):
            back = decode(ids, path)
            if back != (text or "").encode():
                raise ValueError(f"the ids of doc_id {doc_id} do not decode to its text")
            out.append((len(ids), ids, hashlib.sha256(back).hexdigest()))
        return {"doc_id": c["doc_id"]} | dict(zip(("n_tokens", "ids", "decoded_sha256"), zip(*out) if out else [[]] * 3))

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
