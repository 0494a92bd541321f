"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text.

Symbols are whole code points, nothing folded, so the model's tables grow with the corpus. All
of training and back-off is joins by key: counts of counts, contexts and lower orders meet their
n-grams as tables, and the probability of every n-gram that any document holds is a table too.
Documents send their n-gram counts to shards of that table; sums of logs come together by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import keys_for_join
from .rolling import Block, U, blocks, mix
from .storage import materialize, shared_dir

ORDER = 4
#: The symbol before and after each text; a text that holds this noncharacter holds an edge.
EDGE = "\uffff"
#: Rows of one shard of the probability table, and the least number of shards.
SHARD_ROWS, SHARDS = 500_000, 16
#: Share of held-out trusted documents of a language that the threshold lets through.
QUANTILE = 0.97
#: One in this many trusted texts, by hash, is held out from training and sets the thresholds.
HELD_OUT = 3
_BASE = U(0x9E3779B97F4A7C15)


def symbols_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with ORDER - 1 edges before and one after; the number of each text's symbols, edges left out."""
    texts = [block.text(i).decode("utf-8", "replace").replace("\0", "\ufffd") for i in range(len(block.starts) - 1)]
    padded = "".join(EDGE * (ORDER - 1) + t + EDGE for t in texts)
    return np.frombuffer(padded.encode("utf-32-le", "replace"), dtype="<u4"), np.array([len(t) for t in texts], dtype=np.int64)


def grams_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """48-bit keys of the n-grams that end at each symbol and at each closing edge, the text and the start of each; the symbols."""
    symbols, lengths = symbols_of(block)
    n = len(symbols) - ORDER + 1
    key = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(ORDER):
        key = key * _BASE + symbols[k : k + max(n, 0)]
    # Starts 0 .. length of a text's padded run; the next ORDER - 1 would run into the next text.
    first = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.arange(len(doc)) + np.repeat(first - (np.cumsum(lengths + 1) - (lengths + 1)), lengths + 1)
    return (mix(key) >> U(16)).astype(np.int64)[at], doc, at, symbols


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, n): the distinct n-grams of runs of blocks, and how often trusted training texts hold them."""
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for block in blocks(batch.column(0)):
            key, doc, at, symbols = grams_of(block)
            uniq, place, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=train[block.rows][doc], minlength=len(uniq)).astype(np.int64)
            start = at[place]
            letters = np.ascontiguousarray(np.stack([symbols[start + k] for k in range(ORDER)], axis=1)) if len(start) else np.zeros((0, ORDER), "<u4")
            gram = pa.array(letters.view(f"<U{ORDER}").reshape(-1).tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(uniq), gram, pa.array(n)], names=["key", "gram", "n"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; (n1..n4) alone reach the driver."""
    n = [float(x or 0) for x in counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.9 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def _context(k: int) -> F.Column:
    return F.substring("gram", 1, k - 1)


def _suffix() -> F.Column:
    return F.expr("substring(gram, 2)")


def probabilities(grams: DataFrame, folder: str) -> DataFrame:
    """(key, gram, p): p of the last symbol after those before, for every row (key, gram, n) of ``grams``.

    n > 0 are the trusted counts. Below the highest order an n-gram counts by the different symbols seen
    before it. Each order joins the lower one by suffix and its contexts by prefix; what the order hasn't
    seen gets the context's freed share of the lower probability, or all of it where the context is new.
    Below single symbols all known symbols and one unknown are alike.
    """
    levels = {ORDER: grams.where("n > 0").select("gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = materialize(levels[k + 1].groupBy(_suffix().alias("gram")).agg(F.count("*").alias("n")), f"level_{k}", folder)
    wanted = {ORDER: grams.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = materialize(wanted[k + 1].select(_suffix().alias("gram")).distinct(), f"wanted_{k}", folder)
    symbols = levels[1].count() + 1
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[k])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = levels[k].groupBy(_context(k).alias("context")).agg(F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("freed"))
        rows = wanted[k].join(levels[k], "gram", "left").withColumn("context", _context(k)).join(contexts, "context", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / symbols))
        else:
            rows = rows.withColumn("suffix", _suffix()).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(F.coalesce((F.col("n") - off) / F.col("total"), F.lit(0.0)) + F.col("freed") * F.col("lower"))
        below = materialize(rows.select("gram", p.alias("p")), f"p_{k}", folder)
    return grams.select("key", "gram").join(below, "gram")


def train(docs: DataFrame, folder: str) -> DataFrame:
    """Probabilities of all n-grams of ``docs`` (text, train), by a model of the rows with train 1."""
    found = docs.select("text", "train").mapInArrow(_gather, "key long, gram string, n long")
    grams = materialize(found.groupBy("key", "gram").agg(F.sum("n").alias("n")), "grams", folder)
    return materialize(probabilities(grams, folder), "model", folder)


def _planes(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return raw.tobytes()


def _pack(keys: np.ndarray, *small: np.ndarray) -> tuple[bytes, int]:
    """Rising 48-bit keys and columns of small numbers with their lengths, byte-planed and compressed; the raw size."""
    head = np.array([len(keys), *(len(a) for a in small)], dtype=np.uint32)
    raw = head.tobytes() + _planes(np.diff(keys, prepend=0).astype(np.uint64)) + b"".join(_planes(a.astype(np.uint32)) for a in small)
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(payload: bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(payload, decompressed_size=size, codec="zstd", asbytes=True)
    lengths = np.frombuffer(raw, dtype=np.uint32, count=1 + columns)
    out, at = [], 4 * (1 + columns)
    for i, n in enumerate(lengths.tolist()):
        width = 4 if i else 8
        plane = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(np.uint32 if i else np.uint64).astype(np.int64))
        at += width * n
    out[0] = np.cumsum(out[0])
    return out


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> 20) % shards


def _counts(shards: int, spans: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of whole texts, one row of n-gram counts per shard, and one (shard -1) of its documents."""
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in blocks(batch.column(2)):
                key, doc, _, _ = grams_of(block)
                texts = len(block.rows)
                order = np.argsort(key, kind="stable")
                key_s, doc_s = key[order], doc[order]
                new_key = np.ones(len(key), dtype=bool)
                new_key[1:] = key_s[1:] != key_s[:-1]
                new = new_key.copy()
                new[1:] |= doc_s[1:] != doc_s[:-1]
                at = np.flatnonzero(new)
                gram, doc_of, n, first_of = key_s[at], doc_s[at], np.diff(at, append=len(key)), new_key[at]
                shard = _shard_of(gram, shards)
                first = int(block.rows[0])
                head = pa.table({"doc_id": batch.column(0).slice(first, texts), "lang": batch.column(1).slice(first, texts), "n": np.bincount(doc, minlength=texts)})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, head.schema) as writer:
                    writer.write_table(head)
                raw = sink.getvalue().to_pybytes()
                rows = [(-1, len(raw), pa.compress(raw, codec="zstd", asbytes=True))]
                by = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[by], np.arange(shards + 1))
                for s in range(shards):
                    own = by[cut[s] : cut[s + 1]]
                    if not len(own):
                        continue
                    start = np.flatnonzero(first_of[own])
                    gap = np.diff(doc_of[own], prepend=0)
                    gap[start] = doc_of[own][start]
                    payload, size = _pack(gram[own][start], np.diff(start, append=len(own)), gap, n[own])
                    rows.append((s, size, payload))
                shard_, sizes, payloads = zip(*rows)
                size = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + seq] * size), pa.array(shard_, pa.int32()), pa.array([task % spans] * size, pa.int32()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())],
                    names=["block", "shard", "span", "size", "payload"],
                )
                seq += 1

    return run


def _slice(rows: pa.Table) -> pa.Table:
    """The model's rows of one shard as one row of sorted keys and logs; of equal keys one counts."""
    key, place = np.unique(rows.column("key").to_numpy(), return_index=True)
    log = np.log2(np.maximum(rows.column("p").to_numpy()[place], 1e-300)).astype(np.float32)
    return pa.table({"shard": rows.column("shard").slice(0, 1), "keys": pa.array([key.tobytes()], pa.binary()), "logs": pa.array([log.tobytes()], pa.binary())})


def _join_counts(counts: pa.Table, model: pa.Table) -> pa.Table:
    """Sums of count * log2 p by document, of every block in one shard and span; document rows go through."""
    block, shard, size, payload = (counts.column(c) for c in ("block", "shard", "size", "payload"))
    if not counts.num_rows or shard[0].as_py() < 0:
        return counts.select(["block", "shard", "size", "payload"])
    keys, logs = np.frombuffer(model.column("keys")[0].as_py(), dtype=np.int64), np.frombuffer(model.column("logs")[0].as_py(), dtype=np.float32).astype(np.float64)
    sums = []
    for blob, n in zip(payload, size):
        gram, per, gap, k = _unpack(blob.as_py(), n.as_py(), 3)
        start = np.cumsum(per) - per
        run = np.cumsum(gap)
        doc = run - np.repeat(run[start] - gap[start], per)
        sums.append(np.bincount(doc, weights=k * np.repeat(logs[np.searchsorted(keys, gram)], per)).tobytes())
    return pa.table({"block": block, "shard": shard, "size": pa.array([len(x) for x in sums], pa.int64()), "payload": pa.array(sums, pa.binary())})


_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("log2_perplexity", pa.float64())])


def _finish(parts: pa.Table) -> pa.Table:
    """The documents of one block with the sums of its shards, added in order of shard."""
    rows = sorted(parts.select(["shard", "size", "payload"]).to_pylist(), key=lambda r: r["shard"])
    head = pa.ipc.open_stream(pa.decompress(rows[0]["payload"], decompressed_size=rows[0]["size"], codec="zstd", asbytes=True)).read_all()
    n, total = head.column("n").to_numpy(), np.zeros(head.num_rows)
    for r in rows[1:]:
        part = np.frombuffer(r["payload"], dtype=np.float64)
        total[: len(part)] += part
    return pa.Table.from_arrays([head.column("doc_id").cast(pa.int64()), head.column("lang").cast(pa.string()), pa.array(n - 1, pa.int64()), pa.array(-total / np.maximum(n, 1))], schema=_SCORED)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, log2_perplexity (per symbol, closing edge included) of every row, by a sharded join of counts.

    ``model`` holds every n-gram of ``docs``. Shards grow with its rows, and a shard's slice meets the counts of about
    half as many input partitions as there are shards, so that neither a slice, nor a group of counts, nor
    the copies of the model per input partition grow with the corpus.
    """
    shards = max(SHARDS, math.ceil(model.count() / SHARD_ROWS))
    spans = max(1, docs.rdd.getNumPartitions() // (shards // 2))
    shard = (F.shiftright("key", 20) % shards).cast("int")
    slices = model.select("key", "p", shard.alias("shard")).groupBy("shard").applyInArrow(_slice, "shard int, keys binary, logs binary")
    counts = docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(_counts(shards, spans), "block long, shard int, span int, size long, payload binary")
    sliced = slices.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    sums = counts.groupBy("shard", "span").cogroup(sliced.groupBy("shard", "span")).applyInArrow(_join_counts, "block long, shard int, size long, payload binary")
    return sums.groupBy("block").applyInArrow(_finish, "doc_id long, lang string, n_symbols long, log2_perplexity double")


def exact_quantile(values: DataFrame, quantile: float) -> DataFrame:
    """(group, value): of each group's values the least that ``quantile`` of them don't exceed, by counts.

    Buckets of 1/4096 are counted first, and the values of the bucket in which the quantile lies are ranked alone, so no
    group's values come to one task and the result is the same for any partitions.
    """
    counts = values.groupBy("group", "value").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("value") * 4096))
    sizes = counts.groupBy("group", "bucket").agg(F.sum("n").alias("s"))
    up_to = lambda c, by: F.sum(c).over(Window.partitionBy("group").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("group", "bucket", (up_to("s", "bucket") - F.col("s")).alias("before"), "s", F.greatest(F.lit(1), F.ceil(F.round(quantile * F.sum("s").over(Window.partitionBy("group")), 6))).alias("rank"))
    chosen = sizes.where((F.col("before") < F.col("rank")) & (F.col("before") + F.col("s") >= F.col("rank"))).select("group", "bucket", "before", "rank")
    inside = counts.join(chosen, ["group", "bucket"]).withColumn("at", F.col("before") + up_to("n", "value"))
    return inside.where(F.col("at") >= F.col("rank")).groupBy("group").agg(F.min("value").alias("value"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, lang, n_symbols, log2_perplexity, threshold, kept.

    Trusted text: documents labelled quality 1 (an id with any such label). One trusted text in ``held_out``, by its
    hash, isn't trained on; the threshold of a language is the ``quantile`` of the log-perplexity of
    its held-out documents (of all held-out ones where it has none; nothing is rejected if there are none at all).
    Null and empty texts have one symbol, the edge, n_symbols 0, and are not kept; a null
    lang is a language of its own; repeated rows are each scored; no rows give no rows.
    """
    folder = shared_dir(docs.sparkSession)
    good = keys_for_join(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("_good", F.lit(1)))
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left")
    aside = F.pmod(F.xxhash64("text"), F.lit(held_out)) == 0
    model = train(marked.select("text", F.when((F.col("_good") == 1) & ~aside & (F.col("text") != ""), 1).otherwise(0).alias("train")), folder)
    scored = materialize(score(docs.select("doc_id", "lang", "text"), model), "scored", folder)
    unseen = docs.select("doc_id", aside.alias("_aside")).join(good, "doc_id", "left_semi").where("_aside").select("doc_id").distinct()
    trusted = scored.where("n_symbols > 0").join(keys_for_join(materialize(unseen, "held_out", folder)), "doc_id", "left_semi")
    lang = F.to_json(F.struct("lang"))
    values = materialize(trusted.select(lang.alias("group"), F.col("log2_perplexity").alias("value")), "trusted", folder)
    by_lang, whole = (materialize(exact_quantile(v, quantile), name, folder) for v, name in ((values, "by_lang"), (values.withColumn("group", F.lit("all")), "whole")))
    out = scored.withColumn("_lang", lang).join(keys_for_join(by_lang.select(F.col("group").alias("_lang"), F.col("value").alias("_cut"))), "_lang", "left").join(F.broadcast(whole.select(F.col("value").alias("_all"))), F.lit(True), "left")
    threshold = F.coalesce("_cut", "_all", F.lit(float("inf")))
    return out.select(
        "doc_id", "lang", "n_symbols", "log2_perplexity", threshold.alias("threshold"), ((F.col("n_symbols") > 0) & (F.col("log2_perplexity") <= threshold)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
