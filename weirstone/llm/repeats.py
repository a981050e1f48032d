"""Problem 6: long exact spans shared between records, by recompression.

Recompression gives equal substrings equal interior symbols.  Its rounds alternate
naming runs of one symbol and pairs of adjacent symbols whose alphabets (a bit of
the symbol's name, another in each round) differ.  A name is a hash of what it
stands for, so all tasks name alike without a dictionary, and a symbol covers at
most CAP characters, so what stands outside a span disturbs only a margin of it.

On these symbols rounds in Spark name larger and larger pieces and keep what another
record holds too.  Names are shuffled; texts only to meet what a round leaves of them.

1. Of the runs of WIDTH symbols in the undisturbed inside of a window of ``least``
   characters, the least name is the window's symbol.  Equal windows have equal
   symbols at equal places.  Neighbouring windows mostly share one, so there is a
   row for about 70 characters: (symbol, record, range of windows).  A symbol that
   one record alone holds rules its windows out.
2. In the pieces that are left, a window's symbol is the pair of the least runs of
   the two halves of its inside, with their distance.  Again lone ones are ruled out.
3. Windows that stand at fixed places to their run, or where it changes, get names
   themselves, made of all their characters.  A name in two records reveals a shared
   span; all spans of least + STEP - 1 characters are revealed.
4. For what is still open (records without a find, or for the overlap windows that
   reach outside the finds) the pairs of its windows are looked up, and all windows
   of all records that have one of these pairs are named.  That makes the decision
   exact for spans of every length.

For each record found the text of one window is then compared with the texts of
the other records that hold the name.

No group of equal names is ever gathered: a name needs the least and the greatest
record that holds it, which are aggregated before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .splitting import items

LEAST = 300
ROUNDS = 5
CAP = 10
#: Neighbouring symbols in a run.
WIDTH = 7
#: Characters from a span's edge within which what stands outside it can change symbols:
#: one run and, in every round, one more symbol.
MARGIN = CAP + ROUNDS * CAP
#: Runs in a symbol of the second round.
PAIR = 2
#: Distance of the windows that the third round names, where the symbol stays the same.
STEP = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: A range of windows as one number: its first window, and how many follow it.
_BITS = 24


def _mix(x):
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> _S32)
    x = x * _M1
    x = x ^ (x >> _S29)
    x = x * _M2
    return x ^ (x >> _S32)


def codes(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def compress(texts, rounds=ROUNDS, cap=CAP):
    """(names, starts, starts of the texts, sizes of the texts) of the symbols of several texts after the given rounds.

    The texts are compressed side by side in one array, in which starts are counted;
    a symbol 0 after each text never joins another."""
    parts = [codes(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    raw = np.zeros(n, np.uint64)
    for at, p in zip(first.tolist(), parts):
        raw[at : at + len(p)] = p
        raw[at : at + len(p)] += np.uint64(1)
    with np.errstate(over="ignore"):
        names = _mix(raw)  # 0 stays 0
        starts = np.arange(n, dtype=np.int64)
        if n > 1:  # runs of one character, where the whole run stays within the cap
            head = np.concatenate(([True], names[1:] != names[:-1]))
            at = np.flatnonzero(head)
            count = np.diff(at, append=n)
            merge = (count > 1) & (count <= cap) & (names[at] != 0)
            keep = head | ~np.repeat(merge, count)
            names[at[merge]] = _mix(names[at[merge]] * _M2 + count[merge].astype(np.uint64))
            names, starts = names[keep], starts[keep]
        for r in range(rounds):
            if len(names) < 2:
                break
            bit = ((names >> np.uint64(7 + 5 * r)) & np.uint64(1)).astype(bool)
            lengths = np.diff(starts, append=n)
            pair = np.flatnonzero(~bit[:-1] & bit[1:] & (lengths[:-1] + lengths[1:] <= cap) & (names[:-1] != 0))
            if len(pair):
                keep = np.ones(len(names), bool)
                keep[pair + 1] = False
                names[pair] = _mix(names[pair] * _M1 + (names[pair + 1] ^ np.uint64(0x5851F42D4C957F2D)))
                names, starts = names[keep], starts[keep]
    return names, starts, first, sizes


def _least(a, lo, hi):
    """Index of the least a[lo[k] .. hi[k]] for every k, the leftmost of equal ones; lo <= hi."""
    out = np.empty(len(lo), np.int64)
    level = np.log2(hi - lo + 1).astype(np.int64)
    best, width = np.arange(len(a)), 1
    for r in range(int(level.max(initial=0)) + 1):
        k = np.flatnonzero(level == r)
        x, y = best[lo[k]], best[hi[k] - width + 1]
        out[k] = np.where(a[x] <= a[y], x, y)
        x, y = best[:-width], best[width:]
        best, width = np.where(a[x] <= a[y], x, y), 2 * width
    return out


def inside(least, pieces, margin=MARGIN):
    """The undisturbed inside of a window in so many parts of equal length: [(from, to)]."""
    at = [margin + (least - 2 * margin) * k // pieces for k in range(pieces + 1)]
    return list(zip(at[:-1], at[1:]))


def symbols(texts, least=LEAST, pieces=1, width=WIDTH, margin=MARGIN):
    """The windows' symbols of several texts: (name, place of the first run, first window, last window, number of the text).

    A window of ``least`` characters, named by its start, has as its symbol the least run in each of ``pieces``
    parts of its inside, with their distances; a row stands for the windows of a text one after another
    that have the same runs at the same places."""
    names, starts, first, sizes = compress(texts)
    n = max(0, len(names) - width)
    with np.errstate(over="ignore"):
        many, whole = names[:n].copy(), names[:n] != 0
        for k in range(1, width):
            many = _mix(many * _M2 + names[k : k + n])
            whole &= names[k : k + n] != 0
    run = np.flatnonzero(whole)
    name, begin, end = many[run], starts[run], starts[run + width]
    parts = inside(least, pieces, margin)
    at = np.concatenate([first, *(begin - a + 1 for a, _ in parts), *(end - b for _, b in parts)])  # where the runs inside change
    at = np.sort(at, kind="stable")
    at = at[(at >= 0) & np.concatenate(([True], at[1:] != at[:-1]))]
    text = np.searchsorted(first, at, side="right") - 1
    last = first + sizes - least
    fits = at <= last[text]
    at, text = at[fits], text[fits]
    picks = np.full((pieces, len(at)), -1, np.int64)
    for pick, (a, b) in zip(picks, parts):
        lo, hi = np.searchsorted(begin, at + a, side="left"), np.searchsorted(end, at + b, side="right") - 1
        some = lo <= hi
        if some.any():
            pick[some] = _least(name, lo[some], hi[some])
    if len(at):
        head = np.flatnonzero(np.concatenate(([True], (picks[:, 1:] != picks[:, :-1]).any(0) | (text[1:] != text[:-1]))))
        at, text, picks = at[head], text[head], picks[:, head]
        until = np.minimum(np.concatenate((at[1:] - 1, [np.iinfo(np.int64).max])), last[text])
    else:
        until = at
    out, place = np.zeros(len(at), np.uint64), at
    if len(name):  # a part without a run counts as a run 0 at the window's start
        with np.errstate(over="ignore"):
            for k, pick in enumerate(picks):
                where, own = np.where(pick < 0, at, begin[pick]), np.where(pick < 0, np.uint64(0), name[pick])
                if not k:
                    out, place = own, where
                else:
                    apart = np.where((pick < 0) | (picks[0] < 0), 0, where - place)
                    out = _mix(_mix(out * _M2 + own) + apart.astype(np.uint64))
    return out, place - first[text], at - first[text], until - first[text], text


_BASES = (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C55)
_POWERS: dict = {}


def _powers(n):
    """For each base its powers and those of its inverse modulo 2^64, up to at least n."""
    if _POWERS.get("n", -1) < n:
        size = max(n, 1 << 16) + 1
        for base in _BASES:
            for key, x in (((base, 1), base), ((base, -1), pow(base, -1, 1 << 64))):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = size - 1
    return _POWERS


def fingerprints(text, at, least):
    """The names, of twice 64 bits, of the windows of the given length that start at ``at``."""
    with np.errstate(over="ignore"):
        c = _mix(codes(text).astype(np.uint64) + np.uint64(11))
        n, powers, out = len(c), _powers(len(c)), []
        for base in _BASES:
            # prefix sums of c[i] * base^i modulo 2^64; a window's sum is shifted to a common power
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(c * powers[base, 1][:n], out=prefix[1:])
            out.append(_mix((prefix[at + least] - prefix[at]) * powers[base, -1][at]).view(np.int64))
    return out


def left_over(lo, hi, lone):
    """[lo, hi, lo, hi, ...]: of the windows lo .. hi those outside the packed ranges ``lone``."""
    p = np.sort(lone)
    begin = p >> _BITS
    end = begin + (p & ((1 << _BITS) - 1))
    meet = (end >= lo) & (begin <= hi)
    end = np.maximum.accumulate(end[meet])
    a, b = np.concatenate(([lo], end + 1)), np.concatenate((begin[meet] - 1, [hi]))
    some = a <= b
    return np.stack((a[some], b[some]), 1).ravel().tolist()


def uncovered(ranges, at, least):
    """Of ranges of windows [lo, hi, lo, hi, ...] the parts whose windows reach outside the union of the windows at the sorted places ``at``."""
    if not len(at):
        return ranges
    gap = np.flatnonzero(np.diff(at) > least)  # windows that touch cover all windows between them
    firsts, lasts = at[np.concatenate(([0], gap + 1))].tolist(), at[np.concatenate((gap, [len(at) - 1]))].tolist()
    out, k = [], 0
    for lo, hi in zip(ranges[::2], ranges[1::2]):
        while k and lasts[k - 1] >= lo:
            k -= 1
        while k < len(lasts) and lasts[k] < lo:
            k += 1
        while k < len(lasts) and firsts[k] <= hi:
            if firsts[k] > lo:
                out += [lo, firsts[k] - 1]
            lo = max(lo, lasts[k] + 1)
            k += 1
        if lo <= hi:
            out += [lo, hi]
    return out


#: Texts compressed side by side hold about so many characters.
BLOCK_CHARS = 400_000
_LONE = pa.schema([("name", pa.int64()), ("record", pa.int64()), ("place", pa.int64())])
_RANGES = pa.schema([("name", pa.int64()), ("record", pa.int64()), ("base", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_WINDOWS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("record", pa.int64()), ("at", pa.int64())])
_RANGES_DDL = "name bigint, record bigint, base bigint, lo bigint, hi bigint"
_WINDOW_DDL = "f1 bigint, f2 bigint, record bigint, at bigint"


def _blocks(batches):
    """Lists of columns of rows whose second column, the text, adds up to about BLOCK_CHARS characters."""
    for b in batches:
        rows, size = [], 0
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            rows.append(row)
            size += len(row[1])
            if size > BLOCK_CHARS:
                yield list(zip(*rows))
                rows, size = [], 0
        if rows:
            yield list(zip(*rows))


def _symbol_batches(least, pieces):
    """From (record, piece, base): a row for each range of windows with one name."""

    def run(batches):
        for keys, texts, bases in _blocks(batches):
            name, _, lo, hi, text = symbols(texts, least, pieces)
            if not len(name):
                continue
            same = (name[1:] == name[:-1]) & (text[1:] == text[:-1])  # the same name at another place
            head, tail = np.concatenate(([True], ~same)), np.concatenate((~same, [True]))
            span = np.minimum(hi[tail] - lo[head], (1 << _BITS) - 1)
            text = text[head]
            yield pa.RecordBatch.from_arrays([pa.array(name[head].view(np.int64)), pa.array(np.asarray(keys, np.int64)[text]), pa.array(lo[head] + np.asarray(bases, np.int64)[text] << _BITS | span)], schema=_LONE)

    return run


def _piece_batches(least):
    """From (record, piece, base, packed ranges of lone symbols) the smaller pieces whose windows are left."""

    def run(batches):
        for b in batches:
            keys, bases, pieces = [], [], []
            for key, text, base, one, two in zip(*(b.column(i).to_pylist() for i in range(5))):
                left = left_over(base, base + len(text) - least, np.asarray((one or []) + (two or []), np.int64))
                for lo, hi in zip(left[::2], left[1::2]):
                    keys.append(key)
                    bases.append(lo)
                    pieces.append(text[lo - base : hi - base + least])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pieces, pa.string()), pa.array(bases, pa.int64())], names=["record", "piece", "base"])

    return run


def _range_batches(least, pieces):
    """From (record, piece, base): the ranges of windows with one symbol, by (name, record, base)."""

    def run(batches):
        for keys, texts, bases in _blocks(batches):
            name, _, lo, hi, text = symbols(texts, least, pieces)
            base = np.asarray(bases, np.int64)[text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), np.asarray(keys, np.int64)[text], base, lo + base, hi + base)], schema=_RANGES)

    return run


def _clip(lo, hi, spans):
    """Indices of those of the sorted ranges lo .. hi that meet one of the spans."""
    a, b = np.asarray(spans[::2], np.int64), np.asarray(spans[1::2], np.int64)
    return np.flatnonzero(np.searchsorted(a, hi, side="right") > np.searchsorted(b, lo, side="left"))


def _sparse(place, lo, hi, step):
    """Windows of the ranges lo .. hi: the first, the last, and those whose distance to the symbol is a multiple of ``step``: (range, window)."""
    begin = lo + (place - lo) % step
    n = np.maximum(0, (hi - begin) // step + 1)
    which = np.repeat(np.arange(len(lo)), n)
    at = begin[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * step
    return np.unique(np.concatenate((lo, hi, at)))


def _name_batches(some, least):
    """Names of the windows of each (record, piece, base of the piece, windows of the piece)."""
    cols, size = [[], [], [], []], 0
    for key, text, base, at in some:
        one, two = fingerprints(text, at, least)
        for c, x in zip(cols, (one, two, np.full(len(at), key, np.int64), at + base)):
            c.append(x)
        size += len(at)
        if size > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=_WINDOWS)
            cols, size = [[], [], [], []], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=_WINDOWS)


def _sparse_windows(least, step):
    def some(batches):
        for keys, texts, bases in _blocks(batches):
            _, place, lo, hi, text = symbols(texts, least)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            for i, key in enumerate(keys):
                s = slice(ends[i], ends[i + 1])
                yield key, texts[i], bases[i], _sparse(place[s], lo[s], hi[s], step)

    return lambda batches: _name_batches(some(batches), least)


def _dense_windows(least):
    def some(batches):
        for keys, texts, bases, ranges in _blocks(batches):
            for key, text, base, r in zip(keys, texts, bases, ranges):
                yield key, text, base, np.unique(np.concatenate([np.arange(x["lo"] - base, x["hi"] + 1 - base) for x in r]))

    return lambda batches: _name_batches(some(batches), least)


def _records(artifacts: DataFrame, events: DataFrame, least: int) -> DataFrame:
    """(record, content) of every item long enough, as delivered; record is twice its id, plus one for trace_events."""
    some = items(artifacts, events).where(F.length("content") >= least)
    return some.select((F.col("item_id") * 2 + (F.col("item_table") == "trace_events").cast("bigint")).alias("record"), "content")


def named(df: DataFrame) -> DataFrame:
    r = F.col("record")
    return df.withColumns({"item_table": F.when(F.pmod(r, F.lit(2)) == 0, "repo_artifacts").otherwise("trace_events"), "item_id": F.shiftright(r, 1)})


def _shared(windows: DataFrame) -> DataFrame:
    """The windows whose name two records hold, with the least and the greatest of these."""
    keys = windows.groupBy("f1", "f2").agg(F.min("record").alias("a"), F.max("record").alias("b")).where("a < b")
    return windows.join(keys, ["f1", "f2"])


def narrowed(pieces: DataFrame, parts: int, least: int = LEAST) -> DataFrame:
    """Of the pieces (record, piece, base) those parts whose windows have symbols that another record holds too."""
    rows = pieces.mapInArrow(_symbol_batches(least, parts), "name bigint, record bigint, place bigint")
    ends = [F.min("record").alias("record"), F.max("record").alias("other"), F.min("place").alias("one"), F.max("place").alias("two")]
    lone = rows.groupBy("name").agg(*ends).where("record = other")
    per = lone.groupBy("record").agg(F.collect_list("one").alias("one"), F.collect_list(F.expr("if(two > one, two, null)")).alias("two"))  # bounded by the record's length
    once = pieces.join(per, "record", "left").select("record", "piece", "base", "one", "two")
    return keep(once.mapInArrow(_piece_batches(least), "record bigint, piece string, base bigint").dropDuplicates(["record", "base"]))


def candidates(artifacts: DataFrame, events: DataFrame, least: int = LEAST) -> DataFrame:
    """(record, piece, base): the pieces, from ``base`` on, of records that the first two rounds leave."""
    whole = _records(artifacts, events, least).select("record", F.col("content").alias("piece"), F.lit(0).cast("bigint").alias("base"))
    return narrowed(narrowed(whole, 1, least), PAIR, least)


def _open_batches(least):
    """From (record, ranges of a symbol, places of finds) the symbols of windows that reach outside the finds."""

    def run(batches):
        for b in batches:
            names = [set()]
            for ranges, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = np.asarray(at or [], np.int64)
                ranges.sort(key=lambda x: x["lo"])
                left = uncovered([y for x in ranges for y in (x["lo"], x["hi"])], at, least)
                if left:
                    which = _clip(np.asarray([x["lo"] for x in ranges]), np.asarray([x["hi"] for x in ranges]), left)
                    names.append({ranges[k]["name"] for k in which.tolist()})
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*names)), pa.int64())], names=["name"])

    return run


def shared_windows(artifacts: DataFrame, events: DataFrame, least: int = LEAST, step: int = STEP, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(windows, pieces), the pieces as of ``candidates``; windows: (f1, f2, record, at, a, b), windows of ``least`` characters that stand in another
    record too, with their names and the least and greatest record that hold the name.

    Every record that shares a span has rows. If ``whole``, its windows cover every
    shared span; else those of at least least + step - 1 characters, but for less
    than ``step`` characters at their ends. Repeated deliveries are one record; null
    ids or contents and shorter contents give none; an item's own repeats do not count."""
    some = candidates(artifacts, events, least)
    ranges = keep(some.mapInArrow(_range_batches(least, PAIR), _RANGES_DDL))
    first = keep(_shared(some.mapInArrow(_sparse_windows(least, step), _WINDOW_DDL)))
    if whole:
        places = first.groupBy("record").agg(F.sort_array(F.collect_set("at")).alias("at"))  # bounded by the record's length
        per = ranges.groupBy("record").agg(F.collect_list(F.struct("name", "lo", "hi")).alias("ranges"))  # likewise
        wanted = per.join(places, "record", "left").select("record", "ranges", "at").mapInArrow(_open_batches(least), "name bigint")
    else:
        wanted = ranges.join(first.select("record").distinct(), "record", "left_anti").select("name")
    again = ranges.join(wanted.distinct(), "name", "left_semi").groupBy("record", "base").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    looked = keep(some.join(again, ["record", "base"]).select("record", "piece", "base", "ranges"))
    return first.unionByName(_shared(looked.mapInArrow(_dense_windows(least), _WINDOW_DDL))), some


def _text_batches(least):
    def run(batches):
        for b in batches:
            names, pieces = [], []
            for text, base, some in zip(*(b.column(i).to_pylist() for i in range(3))):
                for x in some:
                    if base <= x["at"] <= base + len(text) - least:
                        names.append((x["f1"], x["f2"]))
                        pieces.append(text[x["at"] - base : x["at"] - base + least])
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.int64()), pa.array([n for _, n in names], pa.int64()), pa.array(pieces, pa.string())], names=["f1", "f2", "piece"])

    return run


def sharing(artifacts: DataFrame, events: DataFrame, least: int = LEAST) -> DataFrame:
    """(record): the records that share a span. One window of each is compared, as text, with those of the
    least and greatest record that hold its name; two texts of one name would be an error."""
    windows, parts = shared_windows(artifacts, events, least)
    windows = keep(windows)
    chosen = windows.groupBy("record").agg(F.min("f1").alias("f1")).join(windows, ["record", "f1"]).groupBy("record", "f1").agg(F.min("f2").alias("f2"), F.min("a").alias("a"), F.max("b").alias("b"))
    ask = chosen.select("f1", "f2", F.explode(F.array_distinct(F.array("record", "a", "b"))).alias("record")).distinct()
    where = windows.groupBy("f1", "f2", "record").agg(F.min("at").alias("at")).join(ask, ["f1", "f2", "record"], "left_semi")
    per = where.groupBy("record").agg(F.collect_list(F.struct("f1", "f2", "at")).alias("some"))  # bounded by the record's length
    pieces = parts.join(per, "record").select("piece", "base", "some").mapInArrow(_text_batches(least), "f1 bigint, f2 bigint, piece string")
    same = pieces.groupBy("f1", "f2").agg(F.min("piece").alias("x"), F.max("piece").alias("y"))
    checked = same.select("f1", "f2", F.when(F.col("x") == F.col("y"), True).otherwise(F.raise_error(F.lit("two texts have one name"))).alias("equal"))
    return chosen.join(checked.where("equal"), ["f1", "f2"]).select("record").distinct()


def overlap(artifacts: DataFrame, events: DataFrame, least: int = LEAST) -> DataFrame:
    """By item: the characters that stand in another record within a span of at least ``least``, and their share."""
    windows, _ = shared_windows(artifacts, events, least, whole=True)
    found = windows.groupBy("record").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # windows that touch or overlap join; bounded by the record's length
    chars = F.expr(f"aggregate(at, named_struct('to', 0L, 'n', 0L), (s, x) -> named_struct('to', x + {least}, 'n', s.n + x + {least} - greatest(x, s.to)), s -> s.n)")
    sizes = _records(artifacts, events, least).groupBy("record").agg(F.max(F.length("content")).alias("chars"))
    out = found.select("record", chars.alias("shared_chars")).join(sizes, "record")
    return named(out).select("item_table", "item_id", F.col("chars").cast("bigint").alias("chars"), "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("shared_share"))
