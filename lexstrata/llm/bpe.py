"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton's arcs are tokens; it accepts just the token sequences that the merges give. It
starts with one state in which every base symbol loops. The merge (u, v) puts in a gadget:
the arcs of u lead to a copy of their state without the arc v, and uv, an arc of every state
with an arc u, leads to where v led. All arcs of one token lead to one state, so a state is
kept by reference: the arc it lost, when, and the state it was copied from, as of that time.

Encoding a word follows arcs from the start: a state's next arc is found by a walk down the
trie of labels and one look into the gadget tables. Only one sequence is accepted for each
string and for each of its prefixes, so a position is left for good once its arcs are tried,
and a word takes time in proportion to its length. A decoder emits the labels of arcs.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .native import fresh

LATEST = 1 << 60
#: Words, and pairs of state and arc, that a worker remembers; it forgets all of them beyond that.
REMEMBERED = 150_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one of those from 256 on, in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass
class Automaton:
    """labels: text of each arc, by id; lost: (token, arc) to the merge that took the arc from the token's state."""

    labels: list[str]
    suffix: str
    pattern: str
    special: dict[str, int]
    lost: dict[tuple[int, int], int]
    #: Of each token, the states that its state was copied from with the time up to which they count, itself first.
    copied: list[tuple[tuple[int, int], ...]]
    #: Of each token, the arcs that it follows: its first parts with the time at which each was merged on, itself first.
    spine: list[tuple[tuple[int, int], ...]]
    #: Trie of labels as bytes: (node * 256 + byte) to node; token of each node inside a word and at its end, or -1.
    edges: dict[int, int]
    inner: list[int]
    last: list[int]
    arcs: dict[tuple[int, int], bool] = field(default_factory=dict)

    def __post_init__(self):
        self.words = Words(self)

    def follows(self, a: int, t: int) -> bool:
        """Whether the state after token ``a`` has the arc ``t``."""
        lost = self.lost
        known = not any((k := lost.get((y, w))) is not None and k < until and k <= merged for y, until in self.copied[a] for w, merged in self.spine[t])
        if len(self.arcs) >= REMEMBERED:
            self.arcs.clear()
        self.arcs[a, t] = known
        return known

    def _spelled(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of the labels that the bytes from ``at`` begin with, the longest last."""
        out, node, edges, inner, top = [], 0, self.edges, self.inner, len(data) - 1
        for i in range(at, top):
            node = edges.get(node << 8 | data[i], 0)
            if not node:
                return out
            if (t := inner[node]) >= 0:
                out.append((i + 1, t))
        node = edges.get(node << 8 | data[top], 0)
        if node and (t := self.last[node]) >= 0:
            out.append((top + 1, t))
        return out

    def path(self, data: bytes) -> list[int]:
        """The accepted token ids of one word's bytes."""
        n, seen, ids, arcs = len(data), bytearray(len(data) + 1), [], self.arcs
        todo = [self._spelled(data, 0)]
        while todo:
            if not todo[-1]:
                todo.pop()
                ids.pop()
                continue
            end, t = todo[-1].pop()
            if seen[end] or ids and not (self.follows(ids[-1], t) if (known := arcs.get((ids[-1], t))) is None else known):
                continue
            ids.append(t)
            if end == n:
                return ids
            seen[end] = 1
            todo.append(self._spelled(data, end))
        return []

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: composed, each character in lower case by itself."""
        if text.isascii() or _is_plain(text):
            return _finder(self.pattern).findall(text.replace("Σ", "σ").lower())
        # Marks are ordered and composed, and new characters folded and split, by the Unicode tables that the vocabulary's library has.
        text = normalizers.Lowercase().normalize_str(normalizers.NFC().normalize_str(text))
        return [w for w, _ in pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        coded = self.words.__getitem__
        if not any(s in text for s in self.special):
            return b"".join(map(coded, self.split(text)))
        names = sorted(self.special, key=len, reverse=True)
        parts = regex.split("(" + "|".join(map(regex.escape, names)) + ")", text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(coded, self.split(p))) for p in parts)


class Words(dict):
    """Word to its token ids, found at the first look."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.path(word.encode())
        got = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def __reduce__(self):
        return Words, (self.automaton,)


_finders: dict[str, regex.Pattern] = {}
_plain: set[str] = set()


def _finder(pattern: str) -> regex.Pattern:
    if pattern not in _finders:
        _finders[pattern] = regex.compile(pattern)
    return _finders[pattern]


def _is_plain(text: str) -> bool:
    """No character composes, decomposes or is reordered, and all are in every version of Unicode tables in use here."""
    new = set(text) - _plain
    _plain.update(c for c in new if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cn" and not "\u1160" <= c <= "\u11ff" and unicodedata.normalize("NFC", c) == c)
    return new <= _plain


def compile_automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file with merges over byte symbols and a mark at the ends of words.

    Merges must be in the order of training: each part is a base symbol or made by an earlier merge.
    """
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, vocab = held["model"], held["model"]["vocab"]
    steps = held["pre_tokenizer"]["pretokenizers"] if held["pre_tokenizer"]["type"] == "Sequence" else []
    kinds = [s["type"] for s in steps], [s["type"] for s in (held["normalizer"] or {}).get("normalizers", [])]
    suffix = model.get("end_of_word_suffix")
    if kinds != (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]) or not suffix or model["ignore_merges"] or held["post_processor"] or held["decoder"]:
        raise ValueError(f"{path} isn't a vocabulary of merges over byte symbols with ends of words")
    added = held["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
        raise ValueError("special tokens must be plain strings")
    symbols = byte_symbols()
    byte_of = {c: b for b, c in enumerate(symbols)}
    size = max([*vocab.values(), *(a["id"] for a in added)]) + 1
    labels = [""] * size
    for name, i in [*vocab.items(), *((a["content"], a["id"]) for a in added)]:
        labels[i] = name
    base = {vocab[s + end] for s in symbols for end in ("", suffix)}
    # Gadgets, one merge after the other.
    lost: dict[tuple[int, int], int] = {}
    copied: list[tuple[tuple[int, int], ...]] = [()] * size
    spine: list[tuple[tuple[int, int], ...]] = [()] * size
    for t in base:
        copied[t], spine[t] = ((t, LATEST),), ((t, LATEST),)
    arc = lambda a, t, now: not any((k := lost.get((y, w))) is not None and k < min(until, now) and k <= merged for y, until in copied[a] for w, merged in spine[t])
    live = set(base)
    for k, pair in enumerate(model["merges"]):
        u, v = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
        t = vocab[labels[u] + labels[v]]
        if u not in live or v not in live or not arc(u, v, k):
            continue  # the arc v is gone from the state after u: the merge never happens
        if t in live:
            raise ValueError("two merges make one token")
        copied[t] = ((t, LATEST), *((y, min(until, k)) for y, until in copied[v]))
        spine[t] = ((t, LATEST), *((w, min(merged, k)) for w, merged in spine[u]))
        lost[u, v] = k
        live.add(t)
    edges: dict[int, int] = {}
    inner, last = [-1], [-1]
    for t in sorted(live):
        ends = labels[t].endswith(suffix)
        node = 0
        for c in labels[t][: -len(suffix)] if ends else labels[t]:
            key = node << 8 | byte_of[c]
            if key not in edges:
                edges[key] = len(inner)
                inner.append(-1)
                last.append(-1)
            node = edges[key]
        (last if ends else inner)[node] = t
    return Automaton(labels, suffix, steps[0]["pattern"]["Regex"], {a["content"]: a["id"] for a in added}, lost, copied, spine, edges, inner, last)


def encode(docs: DataFrame, automaton: Automaton, text: str = "text", out: str = "ids", packed: str | None = None, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``out``, the token ids of the whole text; null and empty texts have none.

    ``packed``, if named, holds the ids as little-endian unsigned 32-bit integers, ``decoded`` what ``decode`` makes of them, by the same
    Python worker. Strings of special tokens count as those tokens. The automaton is broadcast: its size is that of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    more = [x for x in (packed, decoded) if x]
    if text in (out, *more):
        other = fresh(docs, "_text")
        return encode(docs.withColumn(other, F.col(text)), automaton, other, out, packed, decoded).drop(other)
    kept = docs.drop(out, *more)
    names = kept.columns
    added = [(out, T.ArrayType(T.IntegerType(), False)), *([(packed, T.BinaryType())] if packed else []), *([(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(name, kind, False) for name, kind in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        labels = pa.array([x or None for x in a.labels], pa.string()) if decoded else None
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [a.encode(t or "") for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                new = [ids, *([pa.array(found, pa.binary())] if packed else []), *([_labelled(ids, labels)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *(name for name, _ in added)])

    return kept.mapInArrow(run, schema)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each list begins among all values, and the end; null lists are empty."""
    return np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]))


def _labelled(lists: pa.Array, labels: pa.Array) -> pa.Array:
    """The labels of each list's ids joined by spaces; ids without a label have an empty one."""
    flat = lists.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(labels)))
    arcs = pc.fill_null(labels.take(pc.if_else(known, flat, None)), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(_ends(lists), pa.int32()), arcs), " ")


def decode(coded: DataFrame, automaton: Automaton, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with ``out``, the labels of the ids joined by spaces; null ids give an empty text, ids without a label an empty label."""
    shared = coded.sparkSession.sparkContext.broadcast(automaton.labels)

    @F.arrow_udf(T.StringType())
    def labels_of(column: pa.Array) -> pa.Array:
        names = pa.array([x or None for x in shared.value], pa.string())
        done = [_labelled(column.slice(at, 512), names) for at in range(0, len(column), 512)]
        return pa.chunked_array(done, pa.string()).combine_chunks()

    return coded.withColumn(out, labels_of(ids))


def query(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    automaton = compile_automaton(public_tokenizers.path(vocabulary))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # One step of Python workers: a second one beside it, for decoding, took an executor past its memory.
    coded = encode(docs, automaton, packed="packed", decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
