"""Language-model scores by prediction by partial matching (PPM).

The model is a byte-context trie of order 4 with escape method C and symbol exclusion.
All training texts are counted: every window of five bytes (contexts padded at the
start of a text, one end symbol) gives a leaf of the trie, the inner nodes are
sums over leaves.  A symbol is coded in the longest context that the trie holds; where the context
has not seen it, an escape is coded and the next shorter context is asked, leaving out the symbols that
the longer one has already ruled out; order -1 is uniform over what is left of 256 symbols
(255 bytes that text can hold, and the end).  As leaves of one tree, the symbols seen
in a context are also seen in its suffix, so only the last exclusion counts, and
every code length depends on the five bytes alone: the trie becomes hash tables that whole
batches of text look up at once.

Memory: in the tasks orders 0 to 2 are complete (at most 256^3 nodes); orders 3 and 4 keep the
leaves seen at least ``floor`` times, the least number for which at most ``max_leaves``
leaves remain - the trie's memory, counted over all data.  Where that leaves any out, ``score`` takes from the
tasks only the symbols of kept leaves, coded with the counts of all data; the distinct windows of all other
symbols meet the complete counts of orders 3 and 4 in joins, so scores do not depend on ``max_leaves``.

The base score is a word unigram with add-one smoothing.  Words are counted over all
training texts; the most frequent (at most ``max_head``) are looked up in the tasks, all
others meet their counts in a join.

``adaptive_bits`` codes one text with a trie that learns while it reads.

Edge cases: null texts are empty; an empty text has one token and one symbol, the
end; very long texts are coded in slices; repeated rows and ids are scored
each; null ids are never learned from; with no training text the score is uniform and every token unknown;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import store, texts_of

ORDER, SYMBOLS, END = 4, 256, 0xFF  # byte 0xFF never occurs in UTF-8: it pads contexts and ends texts
MAX_LEAVES, MAX_HEAD = 1 << 19, 1 << 17
SCORE_SLICE, COUNT_SLICE, HELD = 1 << 18, 1 << 21, 1_500_000  # bytes that fit the caches, bytes sorted at once, rows held by a task
END_WORD = b""  # no word is empty
PAD = b"\xff" * ORDER


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the ORDER + 1 bytes up to each place, is it a symbol, first place of each text)."""
    stream = np.frombuffer(b"".join([PAD + t + b"\xff" for t in texts]), np.uint8)
    size = np.fromiter((len(t) + ORDER + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(size) - size
    code = np.zeros(len(stream), np.uint64)
    for k in range(ORDER + 1):
        code[k:] |= stream[:len(stream) - k].astype(np.uint64) << np.uint64(8 * k)
    real = np.ones(len(stream), bool)
    real[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return code, real, starts


def slices(texts: list[bytes], most: int):
    """Lists of texts of about ``most`` bytes together (at least one text)."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _count(batches):
    """(word, code, n): words and byte windows of the texts; one of word and code is null."""
    def rows(words: Counter):
        w = list(words)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.nulls(len(w), pa.int64()), pa.array(list(words.values()), pa.int64())],
                                         names=["word", "code", "n"])

    def leaves():
        u, n = merge(np.concatenate([u for u, _ in held]), np.concatenate([n for _, n in held]))
        held[:] = [(u, n)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.binary()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))],
                                          names=["word", "code", "n"])

    words: Counter = Counter()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in texts_of(batches):
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        for t in texts:
            words.update(t.lower().split())
            words[END_WORD] += 1
            if len(words) > 300_000:
                yield from rows(words)
                words.clear()
        for part in slices(texts, COUNT_SLICE):
            code, real, _ = windows(part)
            held.append(np.unique(code[real], return_counts=True))
            if sum(len(u) for u, _ in held) > HELD:
                out = leaves()
                if out.num_rows > HELD // 2:  # merging no longer helps: hand them on
                    yield out
                    held.clear()
    if words:
        yield from rows(words)
    if held:
        yield leaves()


class Hash:
    """Immutable map from unique uint64 keys to rows of values; open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        size = 1 << self.bits
        self.slot_row = np.full(size, -1, np.int32)
        self.slot_key = np.zeros(size, np.uint64)
        self.values = values
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._home(keys[todo]) + step) & (size - 1)
            free = self.slot_row[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.slot_row[at[take]], self.slot_key[at[take]] = todo[take], keys[todo[take]]
            rest = np.ones(len(todo), bool)
            rest[take] = False
            todo, step = todo[rest], step + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not there."""
        at = self._home(keys)
        row = self.slot_row[at]
        got = np.where(self.slot_key[at] == keys, row, -1)
        open_ = np.flatnonzero((row >= 0) & (got < 0))
        at, size = at[open_], len(self.slot_row)
        while len(open_):
            at = (at + 1) & (size - 1)
            row = self.slot_row[at]
            hit = (row >= 0) & (self.slot_key[at] == keys[open_])
            got[open_[hit]] = row[hit]
            go = (row >= 0) & ~hit
            open_, at = open_[go], at[go]
        return got


def merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unique codes and their summed counts."""
    u, i = np.unique(codes, return_inverse=True)
    return u, np.bincount(i, weights=counts, minlength=len(u))


class Trie:
    """Code lengths of PPM-C with exclusion from leaf counts per order.

    levels[j] = (codes of j context bytes and a symbol, counts), nested: a symbol of a
    context is also one of the context's suffix.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.leaf, self.ctx = [], []
        for j, (codes, counts) in enumerate(levels):
            ctx, inv = np.unique(codes >> np.uint64(8), return_inverse=True)
            total = np.bincount(inv, weights=counts, minlength=len(ctx))
            kinds = np.bincount(inv, minlength=len(ctx)).astype(float)
            # what these symbols have in the suffix context: left out there after an escape
            if j:
                up = self.leaf[j - 1].values[0][self.leaf[j - 1].rows(codes & np.uint64((1 << (8 * j)) - 1))]
                out = np.bincount(inv, weights=up, minlength=len(ctx))
            else:
                out = np.zeros(len(ctx))
            self.leaf.append(Hash(codes, counts.astype(np.float64)))
            self.ctx.append(Hash(ctx, total, kinds, out))
        self.plain = np.log10(counts / (total + kinds)[inv]) if len(counts) else np.empty(0)  # of the longest order

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window given the bytes before."""
        out = np.zeros(len(code))
        gone_n, gone_kinds = np.zeros(len(code)), np.zeros(len(code))  # excluded counts and kinds for the order at hand
        top = len(self.leaf) - 1
        row = self.leaf[top].rows(code)  # most symbols are coded here, where nothing is excluded yet
        hit = row >= 0
        out[hit] = self.plain[row[hit]]
        return self.descend(code, out, gone_n, gone_kinds, np.flatnonzero(~hit))

    def descend(self, code: np.ndarray, out: np.ndarray, gone_n: np.ndarray, gone_kinds: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """``out`` with the places ``todo`` coded from the longest order down, less what longer ones excluded."""
        for j in range(len(self.leaf) - 1, -1, -1):
            own = code[todo] & np.uint64((1 << (8 * (j + 1))) - 1)
            row = self.leaf[j].rows(own)
            c = self.ctx[j].rows(own >> np.uint64(8))
            there = c >= 0
            total, kinds, excluded = (v[c] for v in self.ctx[j].values) if len(self.ctx[j].values[0]) else (np.zeros(len(c)),) * 3
            left_n, left_kinds = total - gone_n[todo], kinds - gone_kinds[todo]
            hit = row >= 0
            if hit.any():
                seen = self.leaf[j].values[0][row[hit]]
                out[todo[hit]] += np.log10(seen / (left_n[hit] + left_kinds[hit]))
            miss = there & ~hit
            esc = miss & (left_kinds > 0)
            out[todo[esc]] += np.log10(left_kinds[esc] / (left_n[esc] + left_kinds[esc]))
            gone_n[todo[miss]], gone_kinds[todo[miss]] = excluded[miss], kinds[miss]
            todo = todo[~hit]
            if not len(todo):
                return out
        out[todo] -= np.log10(SYMBOLS - gone_kinds[todo])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        out = []
        for part in slices(texts, SCORE_SLICE):
            code, real, starts = windows(part)
            p = np.zeros(len(code))
            p[real] = self.log10(code[real])
            out.append(np.add.reduceat(p, starts))
        return np.concatenate(out) if out else np.empty(0)


def adaptive_bits(text: str | None, order: int = ORDER) -> float:
    """Code length in bits of one text by a trie that starts empty and learns each symbol after coding it."""
    data = (text or "").encode() + b"\xff"
    seen: dict[bytes, Counter] = {}
    past, bits = b"\xff" * order, 0.0
    for s in data:
        out: set[int] = set()
        for j in range(order, -1, -1):
            own = seen.get(past[len(past) - j:] if j else b"", Counter())
            left = {k: n for k, n in own.items() if k not in out}
            if left:
                total = sum(left.values()) + len(left)
                if s in left:
                    bits -= math.log2(left[s] / total)
                    break
                bits -= math.log2(len(left) / total)
            out |= own.keys()
        else:
            bits += math.log2(SYMBOLS - len(out))
        for j in range(order + 1):
            seen.setdefault(past[len(past) - j:] if j else b"", Counter())[s] += 1
        past = (past + bytes([s]))[-order:]
    return bits


class Leaves:
    """All of orders 3 and 4, when the trie is pruned: ``kept`` has the code lengths of the order-4 leaves the tasks hold,
    ``low`` orders 0 to 2, the tables the counts of leaves (code, n) and contexts (ctx, total, kinds, out)."""

    def __init__(self, codes: DataFrame, third: DataFrame, second: DataFrame, floor: int, low: Trie):
        self.low, self.fourth, self.third = low, codes, third
        self.ctx4 = store(self._contexts(codes, third, 32), "ppm-contexts-4")
        self.ctx3 = store(self._contexts(third, second, 24), "ppm-contexts-3")
        kept = (codes.where(F.col("n") >= floor).withColumn("ctx", F.shiftright("code", 8)).join(self.ctx4, "ctx")
                .select("code", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("p")).toArrow())
        self.kept = Hash(np.array(kept.column("code").to_numpy(), np.int64).view(np.uint64), kept.column("p").to_numpy())

    @staticmethod
    def _contexts(leaves: DataFrame, shorter: DataFrame, bits: int) -> DataFrame:
        up = shorter.select(F.col("code").alias("suffix"), F.col("n").alias("up"))
        return (leaves.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << bits) - 1))).join(up, "suffix")
                .groupBy(F.shiftright("code", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("up").alias("out")))

    def coded(self, windows: DataFrame) -> DataFrame:
        """(code, lp): log10 probability of the last byte of each of the distinct ``windows(code)``."""
        def named(df, key, j):
            return df.select(F.col(df.columns[0]).alias(key), *[F.col(c).cast("double").alias(f"{c}{j}") for c in df.columns[1:]])
        third = F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
        src = windows.select("code", F.shiftright("code", 8).alias("c4"), third.alias("l3"), F.shiftright(third, 8).alias("c3"))
        for df, key, j in ((self.fourth.select("code", "n"), "code", 4), (self.ctx4, "c4", 4), (self.third.select("code", "n"), "l3", 3), (self.ctx3, "c3", 3)):
            src = src.join(named(df, key, j), key, "left")
        cols = [f"{c}{j}" for j in (4, 3) for c in ("n", "total", "kinds", "out")]
        shared = windows.sparkSession.sparkContext.broadcast(self.low)

        def run(batches):
            for b in batches:
                code = b.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
                v = {c: b.column(c).to_numpy(zero_copy_only=False) for c in cols}
                lp, gone_n, gone_kinds = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code))
                todo = np.arange(len(code))
                for j in (4, 3):
                    n, total, kinds, out = (v[f"{c}{j}"][todo] for c in ("n", "total", "kinds", "out"))
                    left_n, left_kinds = total - gone_n[todo], kinds - gone_kinds[todo]
                    hit, there = n >= 0, total >= 0
                    lp[todo[hit]] += np.log10(n[hit] / (left_n[hit] + left_kinds[hit]))
                    miss = there & ~hit
                    esc = miss & (left_kinds > 0)
                    lp[todo[esc]] += np.log10(left_kinds[esc] / (left_n[esc] + left_kinds[esc]))
                    gone_n[todo[miss]], gone_kinds[todo[miss]] = out[miss], kinds[miss]
                    todo = todo[~hit]
                lp = shared.value.descend(code, lp, gone_n, gone_kinds, todo) if len(todo) else lp
                yield pa.RecordBatch.from_arrays([b.column("code"), pa.array(lp)], names=["code", "lp"])

        return src.select("code", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in cols]).mapInArrow(run, "code bigint, lp double")


def kept_scores(kept: Hash, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(log10 probability of the symbols whose leaves are kept, (code, k) of all others) of each text."""
    scores, sizes, codes, times = [np.empty(0)], [np.zeros(1, np.int64)], [], []
    for part in slices(texts, SCORE_SLICE):
        code, real, starts = windows(part)
        row = kept.rows(code)
        p = np.zeros(len(code))
        hit = real & (row >= 0)
        p[hit] = kept.values[0][row[hit]]
        scores.append(np.add.reduceat(p, starts))
        miss = np.flatnonzero(real & (row < 0))
        text, rare = np.searchsorted(starts, miss, "right") - 1, code[miss]
        order = np.lexsort((rare, text))
        text, rare = text[order], rare[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (rare[1:] != rare[:-1])))[:len(rare)])
        sizes.append(np.bincount(text[first], minlength=len(part)))
        codes.append(rare[first].view(np.int64))
        times.append(np.diff(np.append(first, len(rare))))
    none = [np.empty(0, np.int64)]
    values = pa.StructArray.from_arrays([pa.array(np.concatenate(codes or none)), pa.array(np.concatenate(times or none).astype(np.int64))], names=["code", "k"])
    return np.concatenate(scores), pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), values)


class Model:
    """The trie, the frequent words and the totals; ``tail`` holds the counts of all other words, ``leaves`` those of
    a pruned trie."""

    def __init__(self, trie: Trie, head: dict[bytes, float], tail: DataFrame, n_tokens: int, n_words: int, leaves: Leaves | None = None):
        self.trie, self.head, self.tail, self.n_tokens, self.n_words, self.leaves = trie, head, tail, n_tokens, n_words, leaves


def _floor(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows of ``counts(n)`` reach; counts are pooled in 1/16 octaves."""
    pool = (counts.groupBy(F.floor(F.log2("n") * 16).alias("b"))
            .agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).collect())
    pool.sort(key=lambda r: -r["b"])
    floor, rows = pool[0]["high"] + 1 if pool else 1, 0
    for r in pool:
        rows += r["rows"]
        if rows > most:
            break
        floor = r["low"]
    return floor


def train(docs: DataFrame, text_col: str = "text", max_leaves: int = MAX_LEAVES, max_head: int = MAX_HEAD) -> Model:
    """Count words and byte windows of all ``docs``."""
    src = docs.select(F.col(text_col).alias("text"))
    stats = store(src.mapInArrow(_count, "word binary, code bigint, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n")), "ppm-counts")
    words, codes = stats.where("word is not null").select("word", "n"), stats.where("word is null").select("code", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    third_order = store(codes.groupBy(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("code")).agg(F.sum("n").alias("n")), "ppm-third")
    second_order = third_order.groupBy(F.col("code").bitwiseAND(F.lit((1 << 24) - 1)).alias("code")).agg(F.sum("n").alias("n"))
    leaf_floor = max(_floor(codes, max_leaves), _floor(third_order, max_leaves))
    head_floor = _floor(words, max_head)

    def level(counts: DataFrame, least: int):
        rows = counts.where(F.col("n") >= least).toArrow()
        return np.array(rows.column("code").to_numpy(), np.int64).view(np.uint64), rows.column("n").to_numpy().astype(np.float64)

    # a leaf kept at one order is kept at all shorter ones: counts only grow
    top, third, second = level(codes, leaf_floor), level(third_order, leaf_floor), level(second_order, 1)
    first = merge(second[0] & np.uint64(0xFFFF), second[1])
    zero = merge(first[0] & np.uint64(0xFF), first[1])
    trie = Trie([zero, first, second, third, top])
    leaves = Leaves(codes, third_order, second_order, leaf_floor, Trie([zero, first, second])) if leaf_floor > 1 else None
    head = words.where(F.col("n") >= head_floor).toArrow()
    head = dict(zip(head.column("word").to_pylist(), np.log10(head.column("n").to_numpy() + 1.0).tolist()))
    return Model(trie, head, words.where(F.col("n") < head_floor), int(total["n"] or 0), int(total["v"]), leaves)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per input row."""
    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast((model.leaves.kept if model.leaves else model.trie, model.head))
    pruned = model.leaves is not None

    def run(batches):
        trie, head = shared.value
        look = head.get
        for b in texts_of(batches):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            n_tokens, n_head, base, rare = [], [], [], []
            for t in texts:
                words = t.lower().split()
                words.append(END_WORD)
                got = list(map(look, words))
                known = [g for g in got if g is not None]
                n_tokens.append(len(words))
                n_head.append(len(known))
                base.append(math.fsum(known))
                rare.append(list(Counter(w for w, g in zip(words, got) if g is None).items()) if len(known) < len(words) else [])
            sizes = np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32)
            flat = [x for r in rare for x in r]
            tail = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(
                [pa.array([w for w, _ in flat], pa.binary()), pa.array([k for _, k in flat], pa.int64())], names=["word", "k"]))
            scores, *others = kept_scores(trie, texts) if pruned else (trie.scores(texts),)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()),
                                              pa.array(base, pa.float64()), pa.array(scores), tail, *others],
                                             names=["rid", "id", "n_tokens", "n_head", "base", "score", "tail", *["windows"][:len(others)]])

    schema = (f"rid bigint, id {src.schema['id'].dataType.simpleString()}, n_tokens bigint, n_head bigint, base double, score double, "
              "tail array<struct<word:binary,k:bigint>>" + (", windows array<struct<code:bigint,k:bigint>>" if pruned else ""))
    part = store(src.mapInArrow(run, schema), "ppm-scores")
    rare = part.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.k")
    met = (rare.join(model.tail, "word").groupBy("rid")
           .agg(F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_base"), F.sum("k").alias("rare_known")))
    unit = math.log10(model.n_tokens + model.n_words + 1)
    if pruned:
        others = part.select("rid", F.explode("windows").alias("w")).select("rid", "w.code", "w.k")
        coded = others.join(store(model.leaves.coded(others.select("code").distinct()), "ppm-windows"), "code")
        coded = coded.groupBy("rid").agg(F.sum(F.col("k") * F.col("lp")).alias("more"))
        part = part.drop("windows").join(coded, "rid", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    return (part.drop("tail").join(met, "rid", "left")
            .select("id", "n_tokens", (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                    F.lit(model.n_tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score"))
