"""Exact byte-level BPE ids, one encoding for each distinct word of a block.

The pre-tokeniser never joins text across a single space between two visible
characters, so a text may be cut before such a space and the cuts encoded apart.
Most cuts recur, and only distinct ones are encoded. Ids are those of the
tokenizer's file, without special tokens around a text; the merges run in a faster
library that knows no added tokens, so these are taken out first.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

from quillstrata.llm.arrowtext import span_hashes

#: Cuts longer than this go to the encoder whose merge queue suits long words. Both merge the
#: pair of least rank first, the leftmost of equal ones, so that their ids are the same.
LONG = 2000


@functools.cache
def _engines(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return fast, widths


@functools.cache
def _long_words(vocabulary: str):
    """The encoder for long cuts; few tasks need it, and it is large."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@functools.cache
def _added(vocabulary: str) -> tuple[re.Pattern, dict[bytes, int]]:
    """Return the tokens that the tokenizer's file adds to the merges, and a pattern for them."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = {x["content"].encode(): x["id"] for x in json.load(file)["added_tokens"]}
    return re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) or rb"(?!)"), added


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte tables: visible ASCII; lead bytes of letters that are never white space; two-byte leads."""
    visible = np.zeros(256, bool)
    visible[0x21:0x7F] = True
    lead = visible.copy()
    lead[0xC3:0xE0] = True
    lead[0xE4:0xF5] = True
    two = np.zeros(256, bool)
    two[0xC3:0xE0] = True
    return visible, lead, two


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[s : s + n] for every (s, n)."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Return the sorted byte positions at which a piece of text begins."""
    visible, lead, two = _classes()
    n = len(data)
    at = np.flatnonzero(data[1 : n - 1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
    before = visible[data[at - 1]] | (data[at - 1] >= 0x80) & two[data[np.maximum(at - 2, 0)]]
    at = at[before & lead[data[at + 1]]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    begins = offsets[:-1][np.diff(offsets) > 0]
    return np.sort(np.concatenate([begins, at]))


def encode(data: np.ndarray, offsets: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Return (ids, offsets into ids) of the texts in a byte buffer.

    A text is split at the added tokens in it, which stand for themselves.
    """
    pattern, added = _added(vocabulary)
    spans = [(m.start(), m.end(), added[m[0]]) for m in pattern.finditer(data)]
    if not spans:
        return _encode(data, offsets, vocabulary)
    starts, ends, special = np.array(spans, np.int64).T
    inside = np.searchsorted(offsets, starts, "right") == np.searchsorted(offsets, ends, "left")
    starts, ends, special = starts[inside], ends[inside], special[inside]
    edges = np.unique(np.concatenate([offsets, starts, ends]))
    ids, at = _encode(data, edges, vocabulary)
    first, count = at[:-1].copy(), np.diff(at)
    token = np.searchsorted(edges, starts)
    first[token], count[token] = len(ids) + np.arange(len(token)), 1
    out = np.append(0, np.cumsum(count))
    return ragged(np.concatenate([ids, special.astype(ids.dtype)]), first, count), out[np.searchsorted(edges, offsets)]


def _encode(data: np.ndarray, offsets: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Return (ids, offsets into ids) of texts without added tokens."""
    fast, widths = _engines(vocabulary)
    n_docs = len(offsets) - 1
    starts = cuts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
    ends = np.append(starts[1:], len(data))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    alone = edge[starts] | (ends - starts > LONG)
    key = span_hashes(data, starts, ends, np.arange(256, dtype=np.uint8))
    raw = data.tobytes()

    pools, first, count = [], np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    size = 0
    shared = np.flatnonzero(~alone)
    if len(shared):
        _, one, back = np.unique(key[shared], return_index=True, return_inverse=True)
        s, e = starts[shared[one]], ends[shared[one]]
        joined = ragged(data, s, e - s).tobytes().decode()
        pool = np.array(fast.encode_ordinary(joined), np.uint32)
        bounds = np.searchsorted(np.cumsum(widths[pool]), np.cumsum(e - s)) + 1
        begin = np.append(0, bounds[:-1])
        first[shared], count[shared] = begin[back], (bounds - begin)[back]
        pools.append(pool)
        size = len(pool)
    seen: dict[bytes, tuple[int, int]] = {}
    for k in np.flatnonzero(alone).tolist():
        text = raw[starts[k] : ends[k]]
        if text not in seen:
            ids = fast.encode_ordinary(text.decode()) if len(text) <= LONG else _long_words(vocabulary).encode(text.decode(), add_special_tokens=False).ids
            pools.append(np.array(ids, np.uint32))
            seen[text] = (size, len(ids))
            size += len(ids)
        first[k], count[k] = seen[text]
    ids = ragged(np.concatenate(pools), first, count)
    owner = np.searchsorted(offsets, starts, "right") - 1
    out = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.bincount(owner, weights=count, minlength=n_docs).astype(np.int64), out=out[1:])
    return ids, out
