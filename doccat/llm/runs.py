"""Periodic runs of words, found on a Re-Pair grammar of each document.

A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3 * q)`` words
that no neighbouring word extends.  Per batch of whole documents (arrays, no loop over words):

1. ``repair`` replaces pairs of neighbouring symbols by rules, most frequent first, until no pair of
   a document occurs twice.  A round replaces every pair that is more frequent than all pairs it
   overlaps anywhere, which is what replacing them one after another does.  Symbols are numbered per
   document, so no rule reaches across documents.
2. A run lies whole in some lowest rule and crosses that rule's boundary, or crosses a boundary of
   the start sequence.  ``crossing`` finds the runs over a boundary once per rule, at its first place:
   half of a run's words lie on one side, so the power-of-two gram at the boundary recurs a period
   away; only such periods are tried, and longest common extensions give the ends exactly.
3. They are moved to every place of the rule, and intervals of one period that overlap by a period or
   more become one.  What a rule cuts off is so contained in what a higher rule shows whole.

Nothing is hashed: grams are numbered exactly, level by level, and only grams that recur are kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import text_or_empty
from doccat.llm.tokens import char_batches

MIN_WORDS, MIN_POWER = 24, 3
#: Characters whose documents are compressed together; bounds a task's arrays.
BATCH_CHARS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = 2  # grams of 4 words: what a run of 24 words repeats at least beside a boundary


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, group number along it, group sizes, and first index of each group (in that order)."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, np.diff(np.append(starts, len(ranked))), starts


def grams(sym: np.ndarray) -> list[np.ndarray]:
    """Per level k: the number of the 2**k-gram at each place, -1 where it does not recur."""
    n, levels, codes, at = len(sym), [], sym, np.arange(len(sym))
    while True:
        ids = np.full(n, -1, dtype=np.int64)
        count = 0
        if len(at):
            order, group, sizes, _ = _numbered(codes)
            keep = sizes >= 2
            fresh = np.cumsum(keep) - 1
            count = int(keep.sum())
            ids[at[order]] = np.where(keep[group], fresh[group], -1)
        if not count:
            return levels
        levels.append(ids)
        step = 1 << (len(levels) - 1)
        at = np.flatnonzero(ids[:max(n - step, 0)] >= 0)
        at = at[ids[at + step] >= 0]
        codes = ids[at] * count + ids[at + step]


def repair(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds.  Returns of every place of every rule with ``MIN_WORDS`` words or more the rule,
    the start, boundary and end (places grouped by rule), and the starts of the symbols that are left."""
    n = len(sym)
    sym, nxt, prv = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    alive, prio = np.ones(n, dtype=bool), np.full(n + 1, n + 1, dtype=np.int64)
    fresh, base, places = int(sym.max()) + 1 if n else 0, 0, []
    live = np.flatnonzero(doc[:-1] == doc[1:]) if n else np.zeros(0, dtype=np.int64)
    while len(live):
        second = nxt[live]
        same = live[sym[live] == sym[second]]
        if len(same):  # of a a a a, every other place counts
            first = np.ones(len(same), dtype=bool)
            first[1:] = nxt[same[:-1]] != same[1:]
            start = np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))
            odd = same[(np.arange(len(same)) - start) % 2 == 1]
            counted = live[~np.isin(live, odd, assume_unique=True)]
        else:
            odd, counted = same, live
        order, group, sizes, starts = _numbered(sym[counted] * (fresh + 1) + sym[nxt[counted]])
        keep = sizes >= 2
        if not keep.any():
            break
        rank = np.empty(len(sizes), dtype=np.int64)
        heads = counted[order[starts]].astype(np.uint64) * _MIX  # equal counts: any order, but not along the text
        rank[np.lexsort((heads, -sizes))] = np.arange(len(sizes))
        used = keep[group]
        at, of = counted[order][used], group[used]
        prio[at] = rank[of]
        other = nxt[at]
        wins = (prio[at] < prio[prv[at]]) & (prio[at] < prio[other])
        lost = np.zeros(len(sizes), dtype=bool)
        lost[of[~wins]] = True
        prio[at] = n + 1
        gone = ~lost[of]
        here, rule = at[gone], of[gone]
        mid = nxt[here]
        end = nxt[mid]
        number = np.cumsum(keep & ~lost) - 1
        long = end - here >= MIN_WORDS
        if long.any():
            places.append(np.stack([base + number[rule[long]], here[long], mid[long], end[long]]))
        sym[here] = fresh + number[rule]
        nxt[here] = end
        prv[end[end < n]] = here[end < n]
        alive[mid] = False
        fresh, base = fresh + int(number[-1]) + 1, base + int(number[-1]) + 1
        # a pair seen once stays single; odd places may count once their neighbours have changed
        before = prv[here]
        live = np.sort(np.concatenate([at[~gone], odd, here, before[before >= 0]]))
        live = live[alive[live]]
        live = live[np.append(live[:-1] != live[1:], True)] if len(live) else live
        live = live[nxt[live] < n]
        live = live[doc[live] == doc[nxt[live]]]
    found = np.concatenate(places, axis=1) if places else np.zeros((4, 0), dtype=np.int64)
    order = np.lexsort((found[1], found[0]))
    return *found[:, order], np.flatnonzero(alive)


class Extensions:
    """Longest common extensions of two places, from the numbered grams."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def right(self, x: np.ndarray, y: np.ndarray, hi: np.ndarray) -> np.ndarray:
        x, y = x.copy(), y.copy()
        start = y.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, ids = 1 << k, self.levels[k]
            ok = y + step <= hi
            a = ids[np.where(ok, x, 0)]
            hit = ok & (a >= 0) & (a == ids[np.where(ok, y, 0)])
            x += step * hit
            y += step * hit
        return y - start

    def left(self, x: np.ndarray, y: np.ndarray, lo: np.ndarray) -> np.ndarray:
        x, y = x.copy(), y.copy()
        start = y.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, ids = 1 << k, self.levels[k]
            ok = x - step >= lo
            a = ids[np.where(ok, x - step, 0)]
            hit = ok & (a >= 0) & (a == ids[np.where(ok, y - step, 0)])
            x -= step * hit
            y -= step * hit
        return start - y


def crossing(levels: list[np.ndarray], cut: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Runs over each boundary ``cut`` inside ``[lo, hi)``: rows (boundary number, start, end, period)."""
    n, ext, out = len(levels[0]) if levels else 0, Extensions(levels), []
    places = []
    for ids in levels:
        at = np.flatnonzero(ids >= 0)
        places.append(np.sort(ids[at] * n + at) if len(places) >= _LOWEST else None)
    for side in (1, -1):
        none_from, none_to = np.full(len(cut), n + 1), np.zeros(len(cut), dtype=np.int64)
        recurs = np.arange(len(cut))
        for k in range(_LOWEST, len(levels)):
            width, ids, keys = 1 << k, levels[k], places[k]
            least, most = (1 if k == _LOWEST else 2 * width + 1), 4 * width
            gram = cut if side > 0 else cut - width
            if side < 0:
                recurs = recurs[gram[recurs] >= lo[recurs]]
            recurs = recurs[ids[gram[recurs]] >= 0]  # where a gram does not recur, no longer one does
            who = recurs
            q = np.full(len(who), least)
            while len(who):
                # the next period at or beyond q at which the gram recurs
                q = np.where((q >= none_from[who]) & (q <= none_to[who]), none_to[who] + 1, q)
                g = gram[who]
                own = ids[g] * n
                if side > 0:
                    at = np.searchsorted(keys, own + g + q)
                    there = at < len(keys)
                    q = np.where(there, keys[np.minimum(at, len(keys) - 1)] - own - g, n)
                else:
                    at = np.searchsorted(keys, own + g - q, side="right") - 1
                    there = at >= 0
                    q = np.where(there, own + g - keys[np.maximum(at, 0)], n)
                room = hi[who] - cut[who] if side > 0 else cut[who] - lo[who]
                skipped = (q >= none_from[who]) & (q <= none_to[who])
                go = (q <= most) & (2 * room >= MIN_POWER * q)
                who, q, skipped = who[go], q[go], skipped[go]
                b = cut[who]
                x, y = (b, b + q) if side > 0 else (b - q, b)
                e = y + ext.right(x, y, hi[who])
                s = x - ext.left(x, y, lo[who])
                good = (e - s >= MIN_WORDS) & (e - s >= MIN_POWER * q) & ~skipped
                if good.any():
                    out.append(np.stack([who[good], s[good], e[good], q[good]]))
                # another run with half its words here and a period in [2q, reach - q] would share this one's root
                reach = (e - b if side > 0 else b - s) - q
                wider = (reach > none_to[who]) & (reach >= 2 * q)
                none_from[who[wider]], none_to[who[wider]] = 2 * q[wider], reach[wider]
                q = q + 1
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)


def maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by it become one; of equal intervals the smallest period stays.
    Ordered by start, then period."""
    if not len(s):
        return s, e, q
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    span = int(e.max()) + 1
    reach = np.maximum.accumulate(q * span + e) - q * span  # within a period, as periods ascend
    new = np.ones(len(s), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] > reach[:-1] - q[1:])
    first = np.flatnonzero(new)
    s, e, q = s[first], np.maximum.reduceat(e, first), q[first]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    once = np.ones(len(s), dtype=bool)
    once[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[once], e[once], q[once]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def runs_of(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each document, its runs as (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ends = np.cumsum(sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not len(docs) or not ends[-1]:
        return found
    words = pa.array(list(chain.from_iterable(docs)), type=pa.large_binary()).dictionary_encode()
    doc = np.repeat(np.arange(len(docs)), sizes)
    ids = words.indices.to_numpy().astype(np.int64) + doc * len(words.dictionary)
    order, group, _, _ = _numbered(ids)
    sym = np.empty(len(ids), dtype=np.int64)
    sym[order] = group
    rule, start, mid, end, left = repair(sym, doc)
    levels = grams(sym)
    first = np.ones(len(rule), dtype=bool)
    first[1:] = rule[1:] != rule[:-1]
    one = np.flatnonzero(first)
    left = left[1:][doc[left[1:]] == doc[left[1:] - 1]]
    cut = np.concatenate([mid[one], left])
    lo = np.concatenate([start[one], (ends - sizes)[doc[left]]])
    hi = np.concatenate([end[one], ends[doc[left]]])
    by, s, e, q = crossing(levels, cut, lo, hi)
    of_rule = by < len(one)
    # to every place of the rule
    times = np.diff(np.append(one, len(rule)))
    n_rule = times[by[of_rule]]
    copy = np.repeat(np.flatnonzero(of_rule), n_rule)
    place = np.repeat(one[by[of_rule]], n_rule) + np.arange(len(copy)) - np.repeat(np.cumsum(n_rule) - n_rule, n_rule)
    shift = start[place] - start[one[by[copy]]]
    s, e, q = maximal(np.concatenate([s[copy] + shift, s[~of_rule]]), np.concatenate([e[copy] + shift, e[~of_rule]]),
                      np.concatenate([q[copy], q[~of_rule]]))
    for b, stop, period, d in zip(s.tolist(), e.tolist(), q.tolist(), doc[s].tolist()):
        found[d].append((b - int(ends[d] - sizes[d]), stop - b, period))
    return found


def plant_period(key, words: list[bytes]) -> list[bytes]:
    """The words of a document whose crc32(decimal id) is divisible by ten, made periodic from some word on."""
    if key is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(key).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: ``bytes.split`` knows just the six white-space characters of ASCII."""
    return text.split()


def _row(key, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    for s, n, q in runs:  # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    kept = words
    if runs:
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            drop[s + q] += 1
            drop[s + n] -= 1
        gone = np.cumsum(drop[:-1]) > 0
        kept = [w for w, x in zip(words, gone.tolist()) if not x]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return key, len(runs), *top, _sha256(listed.encode()), _sha256(b" ".join(kept)), [{"start": s, "length": n, "period": q} for s, n, q in runs]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_runs``, its run of greatest power (``start, length, period,
    exponent_milli``; null without runs), ``runs_sha256``, ``collapsed_sha256`` (words without repeated
    periods) and ``runs`` themselves.

    ``rewrite(id, words)`` may change a document's words first.  Null, empty and blank texts have no words
    and no runs; repeated rows and ids each give a row; a null id stays null (and is never rewritten by
    ``plant_period``); an empty table gives no rows.  Only the id and text columns are read, so others
    cannot clash.  Documents are whole rows: nothing is shuffled, and a lost task is run again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    lean = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rest = _parse_datatype_string("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
                                  "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>")
    out = StructType([StructField("doc_id", lean.schema["doc_id"].dataType), *rest.fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for part in char_batches(texts, BATCH_CHARS):
                words = [words_of(t) for t in texts[part]]
                if rewrite is not None:
                    words = [rewrite(k, w) for k, w in zip(keys[part], words)]
                rows = [_row(k, w, r) for k, w, r in zip(keys[part], words, runs_of(words))]
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return lean.mapInArrow(run, out)
