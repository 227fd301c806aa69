"""Language-model scores from a probabilistic suffix tree.

A text is its lower-cased words, a blank after each, and an end sign. The tree's symbols are bytes;
a state is a context of up to ``depth`` bytes. A context is kept if it occurs ``LEAST`` times or more
and a divergence test holds: its next-byte distribution differs from its suffix's by more nats over
all its occurrences than ``gain`` for each next byte it has seen. Suffixes of kept contexts are kept.
Distributions are smoothed by their suffix state's, down to a uniform start. A byte is scored in the
longest kept suffix of what stands before it; a text's probability is its bytes' product.

The least count is absolute, so that the states grow with the corpus and a context kept in a part of
it isn't dropped in the whole. Both tests run as joins and the tree stays a table. States of frequent
contexts, at most ``MAX_ENTRIES`` next bytes in all, are broadcast; a window whose longest state there
has longer ones in the table is scored in a join, once for each distinct window. Word counts of the
base score go the same way: the ``hot`` words most frequent in all texts are looked up in memory, all
others in a join.

Texts are worked on a megabyte at a time, so that very long ones need no more memory than short ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace, bound_batches, tidied

DEPTH = 6
GAIN = 2.0
KAPPA = 4.0
LEAST = 4
HOT = 100_000
#: Next bytes of all states that are broadcast: some 32 bytes each in a worker.
MAX_ENTRIES = 4_000_000
#: Bytes of text that are worked on at a time, but for longer words.
CHUNK = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"
_8 = np.uint64(8)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes | None) -> list[bytes]:
    """Runs without blanks and ASCII control characters 9 to 13, A-Z lower-cased."""
    return (data or b"").translate(_LOWER).split()


def chunks(texts: Iterable[bytes | None], depth: int = DEPTH) -> Iterator[tuple[list[int], list[bytes], list[list[bytes]], list[bool]]]:
    """Texts in groups of about a megabyte: number of the text, what stands before (depth bytes), words, whether the text ends there."""
    start = b"\0" * (depth - 1) + END
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for i, data in enumerate(texts):
        data, before, lo = data or b"", start, 0
        while True:
            hi = len(data)
            if hi - lo > CHUNK:
                cuts = [at for at in (data.find(c, lo + CHUNK) for c in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")) if at >= 0]
                hi = min(cuts, default=hi)
            words = words_of(data[lo:hi])
            last = hi == len(data)
            for column, x in zip(out, (i, before, words, last), strict=True):
                column.append(x)
            size += hi - lo + 64
            if size > CHUNK:
                yield out
                out, size = ([], [], [], []), 0
            if last:
                break
            if words:
                before = (before + b" ".join(words[-depth:]) + b" ")[-depth:]
            lo = hi
    if out[0]:
        yield out


def windows(before: list[bytes], words: list[list[bytes]], last: list[bool], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """A code of the last depth + 1 bytes at every symbol of the pieces of texts, and each symbol's piece.

    Before a text's start stand zeros and an end sign.
    """
    body = [b" ".join(w) + (b" " if w else b"") + (END if e else b"") for w, e in zip(words, last, strict=True)]
    a = np.frombuffer(b"".join([b"\0" * 8, *(x for pair in zip(before, body, strict=True) for x in pair)]), np.uint8)
    sizes = np.fromiter(map(len, body), np.int64, len(body))
    eight = np.ndarray((len(a) - 7,), ">u8", a, 0, (1,))  # the eight bytes from each place on
    code = eight[1:].astype(np.uint64) & _mask(depth + 1)
    scored = np.ones(len(code), bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    scored[(starts[:, None] + np.arange(depth)).ravel()] = False
    return code[scored], np.repeat(np.arange(len(body)), sizes)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


def _low(k: Column) -> Column:
    """The mask of k bytes, 7 at most."""
    return F.element_at(F.array(*(F.lit((1 << 8 * i) - 1).cast("long") for i in range(8))), k + 1)


class _Table:
    """Open addressing from 64-bit keys, none of which is zero, to slots."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys, self.place = np.zeros(self.size, np.uint64), np.empty(len(keys), np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            placed = self.keys[slot] == keys[left]
            self.place[left[placed]] = slot[placed]
            left, slot = left[~placed], (slot[~placed] + 1) % self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLD) >> self.shift).astype(np.int64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the keys, by slot."""
        out = np.zeros(self.size, values.dtype)
        out[self.place] = values
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for unknown keys."""
        out = self._slot(keys)
        held = self.keys[out]
        left = np.flatnonzero((held != keys) & (held != 0))
        out[held == 0] = -1
        while len(left):
            slot = (out[left] + 1) % self.size
            held = self.keys[slot]
            out[left] = np.where(held == 0, -1, slot)
            left = left[(held != keys[left]) & (held != 0)]
        return out


@dataclass
class Tree:
    """root: log10 P of each byte. States and entries (state, next byte) as keys with their order in the top byte.

    more: whether a state has longer ones that the tree lacks; root_more: the same of the root.
    """

    depth: int
    root: np.ndarray
    states: np.ndarray
    escape: np.ndarray
    more: np.ndarray
    entries: np.ndarray
    logp: np.ndarray
    root_more: bool = False

    def _prepare(self) -> None:
        if not hasattr(self, "_states"):
            self._states, self._entries = _Table(self.states), _Table(self.entries)
            self._escape, self._more, self._logp = self._states.spread(self.escape), self._states.spread(self.more), self._entries.spread(self.logp)
            self._memo = np.zeros(1 << 22, np.uint64), np.zeros(1 << 22), np.zeros(1 << 22, np.int8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def score(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of every coded symbol, and the order of its longest state if that has longer ones elsewhere, else -1.

        Windows met before are remembered, one for each of 2^22 places.
        """
        self._prepare()
        keys, values, orders = self._memo
        place = ((code * _GOLD) >> np.uint64(42)).astype(np.int64)
        out, order = values[place], orders[place]
        miss = np.flatnonzero(keys[place] != code + np.uint64(1))
        if len(miss):
            new, at = np.unique(code[miss], return_inverse=True)
            found, longest = self.look_up(new)
            out[miss], order[miss] = found[at], longest[at]
            put = ((new * _GOLD) >> np.uint64(42)).astype(np.int64)
            keys[put] = new + np.uint64(1)
            stays = keys[put] == new + np.uint64(1)  # of several new windows for one place the last
            values[put[stays]], orders[put[stays]] = found[stays], longest[stays]
        return out, order

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like score; a byte that the longest state hasn't seen escapes to its suffix's."""
        self._prepare()
        out, order = np.zeros(len(code)), np.zeros(len(code), np.int8)
        longest = np.full(len(code), 0 if self.root_more else -1, np.int8)
        live, slots = np.arange(len(code)), []
        for k in range(1, self.depth + 1):
            slot = self._states.find((code[live] >> _8 & _mask(k)) | np.uint64(k << 56))
            live, slot = live[slot >= 0], slot[slot >= 0]
            order[live] = k
            longest[live] = np.where(self._more[slot], k, -1)
            slots.append((live, slot))
        for k in range(self.depth, 0, -1):
            live, slot = slots[k - 1]
            now = order[live] == k
            at, slot = live[now], slot[now]
            if not len(at):
                continue
            found = self._entries.find((code[at] & _mask(k + 1)) | np.uint64(k << 56))
            hit = found >= 0
            out[at[hit]] += self._logp[found[hit]]
            order[at[hit]] = -1
            out[at[~hit]] += self._escape[slot[~hit]]
            order[at[~hit]] = k - 1
        left = np.flatnonzero(order == 0)
        out[left] += self.root[(code[left] & np.uint64(255)).astype(np.int64)]
        return out, longest


def build(order: np.ndarray, code: np.ndarray, n: np.ndarray, depth: int = DEPTH, gain: float = GAIN, kappa: float = KAPPA, least: float = LEAST) -> Tree:
    """A whole tree in memory, from counts n of (order, code of context and next byte): the plain form of what levels does in joins."""
    root_n = np.zeros(256)
    zero = order == 0
    root_n[(code[zero] & np.uint64(255)).astype(int)] = n[zero]
    root = np.log10((root_n + 0.5) / (root_n.sum() + 128))
    levels = []
    last_codes, last_p = np.arange(256, dtype=np.uint64), 10.0**root
    alive = np.empty(0, np.uint64)
    for k in range(1, depth + 1):
        pick = order == k
        sort = np.argsort(code[pick], kind="stable")
        c, m = code[pick][sort], n[pick][sort].astype(float)
        ctx, at = np.unique(c >> _8, return_inverse=True)
        total = np.bincount(at, m, minlength=len(ctx))
        ok = total >= least
        if k > 1:  # the suffix must be known, for its distribution
            ok &= np.isin(ctx & _mask(k - 1), alive)
        keep = ok[at]
        c, m, at = c[keep], m[keep], (np.cumsum(ok) - 1)[at[keep]]
        ctx, total = ctx[ok], total[ok]
        suffix = c & _mask(k)
        where = np.searchsorted(last_codes, suffix).clip(0, max(0, len(last_codes) - 1))
        below = last_p[where] if len(last_codes) else np.empty(0)
        p = (m + kappa * below) / (total[at] + kappa)
        loss = np.bincount(at, m * np.log(np.maximum(m / total[at], 1e-300) / below), minlength=len(ctx))
        good = loss > gain * np.bincount(at, minlength=len(ctx))
        levels.append((ctx, total, good, c, at, p))
        alive, last_codes, last_p = ctx, c, p
    closed: list[np.ndarray] = [np.zeros(0, bool)] * depth
    needed = np.empty(0, np.uint64)
    for k in range(depth, 0, -1):  # suffixes of kept contexts stay
        ctx, _, good, *_ = levels[k - 1]
        closed[k - 1] = good | np.isin(ctx, needed)
        needed = np.unique(ctx[closed[k - 1]] & _mask(k - 1)) if k > 1 else needed
    states, escape, entries, logp = [], [], [], []
    for k in range(1, depth + 1):
        ctx, total, _, c, at, p = levels[k - 1]
        keep = closed[k - 1]
        states.append(ctx[keep] | np.uint64(k << 56))
        escape.append(np.log10(kappa / (total[keep] + kappa)))
        entries.append(c[keep[at]] | np.uint64(k << 56))
        logp.append(np.log10(p[keep[at]]))
    states, escape, entries, logp = (np.concatenate(x) for x in (states, escape, entries, logp))
    return Tree(depth, root, states, escape, np.zeros(len(states), bool), entries, logp)


def count(docs: DataFrame, work: Workspace, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Of rows (data, training): (word, n, met) counts of words in training rows and in all; (code, n) of windows of depth + 1 bytes in training rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bool, Counter[bytes]] = {True: Counter(), False: Counter()}
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush_words(training: bool) -> pa.RecordBatch:
            w = words[training]
            n = pa.array(list(w.values()), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(list(w), pa.binary()), pa.nulls(len(w), pa.int64()), n if training else pa.array(np.zeros(len(w), np.int64)), n], ["word", "code", "n", "met"])
            w.clear()
            return out

        def merge() -> int:
            code, n = np.concatenate([c for c, _ in codes]), np.concatenate([m for _, m in codes])
            sort = np.argsort(code, kind="stable")  # rows of sorted runs
            code, n = code[sort], n[sort]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            codes[:] = [(code[first], np.add.reduceat(n, first))]
            return len(first)

        def flush_codes() -> pa.RecordBatch:
            merge()
            u, n = codes.pop()
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.binary()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(len(u), pa.int64())], ["word", "code", "n", "met"])

        for b in batches:
            training = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for flag in (True, False):
                for _, before, lists, last in chunks(b.column(0).filter(pa.array(training == flag)).to_pylist(), depth):
                    for w in lists:
                        words[flag].update(w)
                    if len(words[flag]) > 400_000:
                        yield flush_words(flag)
                    if not flag:
                        continue
                    codes.append(np.unique(windows(before, lists, last, depth)[0], return_counts=True))
                    size += len(codes[-1][0])
                    if size > 4_000_000:
                        size = merge()
                        if size > 2_500_000:
                            yield flush_codes()
                            size = 0
        for flag in (True, False):
            if words[flag]:
                yield flush_words(flag)
        if codes:
            yield flush_codes()

    parts = work.save(docs.select("data", F.coalesce("training", F.lit(False)).alias("training")).mapInArrow(tidied(run), "word binary, code long, n long, met long"), "parts")
    words = parts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
    codes = parts.where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
    return work.save(words, "words"), work.save(codes, "codes")


def levels(codes: DataFrame, work: Workspace, depth: int = DEPTH, gain: float = GAIN, kappa: float = KAPPA) -> tuple[np.ndarray, DataFrame]:
    """log10 P of each byte, and (k, ctx, code, p, whole, good) of the contexts kept: the divergence test and the closure under suffixes as joins.

    ctx is a context of k bytes, code the same with a next byte, p that byte's probability, whole the context's count.
    """
    below, parts = codes, {}
    for k in range(depth, -1, -1):  # counts of windows of k + 1 bytes, from those of one byte more
        short = below.select(F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("code"), "n")
        below = parts[k] = short if k == depth else work.save(short.groupBy("code").agg(F.sum("n").alias("n")), f"part-{k}")
    n = np.zeros(256)
    for r in parts[0].collect():  # 256 rows at most
        n[r.code] = r.n
    root = (n + 0.5) / (n.sum() + 128)
    suffixes = parts[0].select(F.col("code").alias("suffix"), ((F.col("n") + 0.5) / float(n.sum() + 128)).alias("below"))
    kept = []
    for k in range(1, depth + 1):
        of = Window.partitionBy("ctx")  # 256 rows at most
        level = parts[k].withColumn("ctx", F.shiftrightunsigned("code", 8)).withColumn("whole", F.sum("n").over(of)).where(F.col("whole") >= LEAST)
        level = level.withColumn("suffix", F.col("code").bitwiseAND((1 << 8 * k) - 1)).join(suffixes, "suffix")
        p = (F.col("n") + kappa * F.col("below")) / (F.col("whole") + kappa)
        level = level.withColumn("p", p).withColumn("loss", F.sum(F.col("n") * F.log(F.col("n") / F.col("whole") / F.col("below"))).over(of))
        level = level.withColumn("good", F.col("loss") > gain * F.count(F.lit(1)).over(of))
        level = work.save(level.select("ctx", "code", "p", "whole", "good"), f"level-{k}")
        kept.append(level)
        suffixes = level.select(F.col("code").alias("suffix"), F.col("p").alias("below"))
    needed = out = None
    for k in range(depth, 0, -1):  # suffixes of kept contexts stay
        good = kept[k - 1].where("good").select("ctx").distinct()
        stay = work.save(good.unionByName(needed).distinct() if needed is not None else good, f"stay-{k}")
        needed = stay.select(F.col("ctx").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("ctx")).distinct()
        level = kept[k - 1].join(stay, "ctx", "left_semi").select(F.lit(k).alias("k"), "ctx", "code", "p", "whole")
        out = level if out is None else out.unionByName(level)
    entries = work.save(out, "entries")
    work.drop(*(f"{x}-{k}" for x in ("part", "level", "stay") for k in range(depth + 1)))
    return np.log10(root), entries


def frequent(entries: DataFrame, root: np.ndarray, depth: int = DEPTH, kappa: float = KAPPA, most: int | None = None) -> tuple[Tree, int | None]:
    """The tree of the most frequent contexts, ``most`` next bytes at most, and the count that they reach; None if that is all.

    A suffix is as frequent as its context at least, so that these are closed under suffixes, too.
    """
    most = MAX_ENTRIES if most is None else most
    sizes = entries.groupBy(F.floor(F.log2("whole") * 4).alias("level")).agg(F.count(F.lit(1)).alias("m"), F.min("whole").alias("lo")).collect()  # some 250 rows at most
    seen, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.level):
        seen += r.m
        if seen > most:
            break
        least = r.lo
    if seen <= most:
        least, hot, more = None, entries, None
    else:
        least = (1 << 62) if least is None else least
        hot = entries.where(F.col("whole") >= least)
        more = entries.where(F.col("whole") < least).select((F.col("k") - 1).alias("k"), F.col("ctx").bitwiseAND(_low(F.col("k") - 1)).alias("ctx")).distinct()
        more = hot.select("k", "ctx").distinct().join(more, ["k", "ctx"], "left_semi")
    key = lambda k, code: F.col(code).bitwiseOR(F.element_at(F.array(*(F.lit(i << 56) for i in range(depth + 1))), F.col(k) + 1)).alias("key")
    states = hot.groupBy("k", "ctx").agg(F.max("whole").alias("whole")).select(key("k", "ctx"), "whole").toArrow()
    order = np.argsort(states.column("key").to_numpy())
    whole, states = states.column("whole").to_numpy()[order], states.column("key").to_numpy()[order].astype(np.uint64)
    longer = np.zeros(len(states), bool)
    if more is not None:
        longer = np.isin(states, more.select(key("k", "ctx")).toArrow().column("key").to_numpy().astype(np.uint64))
    t = hot.select(key("k", "code"), F.log10("p").alias("logp")).toArrow()
    root_more = least is not None and not entries.where((F.col("k") == 1) & (F.col("whole") < least)).isEmpty()
    return Tree(depth, root, states, np.log10(kappa / (whole + kappa)), longer, t.column("key").to_numpy().astype(np.uint64), t.column("logp").to_numpy(), root_more), least


def rare_scores(open_: DataFrame, entries: DataFrame, least: int, depth: int = DEPTH, kappa: float = KAPPA) -> DataFrame:
    """(code, v) of distinct windows (code, at, v), where v is their score in a state of order ``at`` whose longer ones are in the table."""
    rare = entries.where(F.col("whole") < least)
    states = rare.groupBy("k", "ctx").agg(F.log10(kappa / (F.max("whole") + kappa)).alias("escape"))
    steps = open_.withColumn("k", F.explode(F.sequence(F.col("at") + 1, F.lit(depth))))
    steps = steps.withColumn("ctx", F.shiftright("code", 8).bitwiseAND(_low(F.col("k")))).withColumn("short", F.col("code").bitwiseAND(_low(F.col("k") + 1)))
    found = steps.join(states, ["k", "ctx"]).join(rare.select("k", F.col("code").alias("short"), F.log10("p").alias("logp")), ["k", "short"], "left")
    path = F.array_sort(F.collect_list(F.struct("k", "escape", "logp")))  # six at most; a state's suffixes are states
    found = found.groupBy("code").agg(F.first("v").alias("v"), path.alias("path"))
    return found.select("code", F.aggregate("path", F.col("v"), lambda v, x: F.coalesce(x["logp"], v + x["escape"])).alias("v"))


def score_documents(docs: DataFrame, training: Column, depth: int = DEPTH, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from rows where ``training`` holds (null: it doesn't). Null and empty texts have one
    token, the end. Repeated rows and null doc_ids are rows of their own. Other columns have no effect.
    Without training rows all words are unknown and all bytes equally likely. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "suffix-tree")
    data = F.encode(text, "UTF-8").alias("data")
    words, codes = count(docs.select(data, training.alias("training")), work, depth)
    work.drop("parts")
    ends = docs.where(training).count()
    sums = words.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n"), F.count(F.lit(1))).first()
    n_train, v = (sums[1] or 0) + ends, (sums[0] or 0) + (ends > 0)
    # The most frequent words of all rows: the least count that leaves no more than ``hot``
    level = words.groupBy(F.floor(F.log2("met") * 4).alias("level")).agg(F.count(F.lit(1)).alias("m"), F.min("met").alias("lo")).collect()  # some 250 levels at most
    seen, bound = 0, None
    for r in sorted(level, key=lambda r: -r.level):
        seen += r.m
        if seen > hot:
            break
        bound = r.lo
    often = words.where(F.col("met") >= bound).select("word", "n").toArrow() if bound is not None else None
    table = dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)) if often else {}
    root, entries = levels(codes, work, depth)
    work.drop("codes")
    tree, least = frequent(entries, root, depth)
    shared = spark.sparkContext.broadcast((tree, table))
    below = n_train + 0.5 * (v + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known = shared.value
        get = known.get
        for b in batches:
            n = b.num_rows
            n_tokens, n_known, base, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            few: list[Counter] = [Counter() for _ in range(n)]
            far: list[dict] = [{} for _ in range(n)]
            for doc, before, lists, last in chunks(b.column(1).to_pylist(), depth):
                doc = np.array(doc)
                code, piece = windows(before, lists, last, depth)
                lp, at = tree.score(code)
                total += np.bincount(doc[piece], lp, minlength=n)
                if least is not None:
                    is_open = np.flatnonzero(at >= 0)
                    for i, c, k, x in zip(doc[piece[is_open]].tolist(), code[is_open].tolist(), at[is_open].tolist(), lp[is_open].tolist(), strict=True):
                        old = far[i].get(c)
                        far[i][c] = (k, x, old[2] + 1 if old else 1)
                flat = [w for one in lists for w in one]
                of = np.repeat(doc, np.fromiter(map(len, lists), np.int64, len(lists)))
                c = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
                for i in np.flatnonzero(c < 0).tolist():
                    few[of[i]][flat[i]] += 1
                n_tokens += np.bincount(of, minlength=n)
                n_known += np.bincount(of, c > 0, minlength=n).astype(np.int64)
                base += np.bincount(of, np.where(c >= 0, np.log10((np.maximum(c, 0) + 0.5) / below), 0), minlength=n)
            base += np.log10((ends + 0.5) / below)
            lists_of = lambda kind, rows: pa.array(rows, pa.list_(kind))
            cols = [b.column(0), pa.array(n_tokens + 1), pa.array(n_known + (ends > 0)), pa.array(base), pa.array(total), lists_of(pa.binary(), [list(x) for x in few]), lists_of(pa.int64(), [list(x.values()) for x in few])]
            cols += [lists_of(pa.int64(), [list(x) for x in far]), *(lists_of(kind, [[y[j] for y in x.values()] for x in far]) for j, kind in enumerate((pa.int32(), pa.float64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base", "total", "word", "tf", "code", "at", "v", "times"])

    kind = docs.schema[doc_id].dataType.simpleString()
    first = docs.select(F.col(doc_id).alias("doc_id"), data).mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, n_known long, base double, total double, word array<binary>, tf array<long>, code array<long>, at array<int>, v array<double>, times array<long>")
    first = work.save(first.withColumn("row", F.monotonically_increasing_id()), "first")
    rare = first.select("row", F.explode(F.arrays_zip("word", "tf")).alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.tf").alias("tf"))
    rare = rare.join(words.where(F.col("met") < bound) if bound is not None else words, "word", "left").select("row", "tf", F.coalesce("n", F.lit(0)).alias("n"))
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10((F.col("n") + 0.5) / below)).alias("more_base"))
    out = first.drop("word", "tf", "code", "at", "v", "times").join(rest, "row", "left")
    if least is None:
        out = out.withColumn("more", F.lit(0.0))
    else:
        open_ = first.select("row", F.explode(F.arrays_zip("code", "at", "v", "times")).alias("x")).select("row", "x.*")
        scored = rare_scores(open_.groupBy("code").agg(F.first("at").alias("at"), F.first("v").alias("v")), entries, least, depth)
        more = open_.join(scored.withColumnRenamed("v", "w"), "code").groupBy("row").agg(F.sum(F.col("times") * (F.col("w") - F.col("v"))).alias("more"))
        out = out.join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("total", "more").alias("score"))


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    scored = score_documents(docs, fold != 1)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
