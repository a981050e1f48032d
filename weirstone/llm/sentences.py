"""Problem 9: sentence boundaries across languages and scripts.

A hidden-event n-gram model of order three: between two words there may be a
boundary token, and words and boundary tokens together are one sequence in which
each depends on the two before it.  So what stands around a gap, two words on
either side, and the events at neighbouring gaps with at most a word between
them bear on whether it holds a boundary.  Forward and backward sums over the
gaps of a block give each its posterior.

The statistics come from the corpus itself.  The ends and beginnings of blocks
(paragraphs, headings, list items) are boundaries that are seen, the gaps inside
blocks are those that are hidden.

1. Figures of order two: how often the left word, with its marks, ends a
   sentence, and how often the right word begins one.
2. One step of expectation and maximisation: with these the posteriors of all gaps
   in the corpus are summed by the pairs of words to the left and to the right
   and by pairs of neighbouring events.  A pair backs off to its word, as far
   as it is rare.

Gaps are the places after an end mark (in scripts without spaces also directly
before the next letter) and, in scripts without end marks, every space.
Quotations and parentheses that close within the block hold no gaps.

Words and pairs have figures of their own from a share of all gaps (SHARE), which
bounds their number by 1 / SHARE whatever the size of the corpus.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, keep

#: Share of all gaps, and number of gaps, from which a word or a pair of words has figures of its own;
#: rarer words share their shape's figures, rarer pairs their word's.
SHARE = 2e-6
LEAST = 3
#: Weight, in gaps, of the shorter history in the figures of the longer one.
BACKOFF = 20.0

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
_ITEM = re.compile(r"[ \t]*(?:([-*+•‣◦])|(\d{1,3})[.)])[ \t]+")
_THAI = re.compile(r"[฀-๿຀-໿ក-៿က-႟]")
_GAP = re.compile(
    r"[.!?…؟۔।॥։。！？｡．](?:(?<![。！？｡．])[.!?…؟۔।॥։]*(?:[   ]?[»›]|[\"'”’“‘)\]」』）】》])*(?=\s|\Z)"
    r"|(?:(?<=[^\W\d_A-Z][^\W\d_A-Z][.!?؟])|(?<=[`)\d][.!?؟]))[\"”’)»]*(?=[A-ZÀ-ÖØ-ÞА-Я][a-zà-öø-ÿа-я ]|[؀-ۿऀ-ॿ])"
    r"|(?<=[।॥])[।॥]*|(?<=[。！？｡．…])[。！？｡．…!?]*[”’」』）】》〉\"')\]]*)"
)
#: A sentence's last word where the next sentence follows without a space.
_JOINED = re.compile(r"^\w*[a-z]{2}[.!?](?=[A-Z][a-z]*\.)")
_BREAK = re.compile(r"\s+")
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "„": "“”", "“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "‚": "‘’"}
_CLOSE = frozenset("".join(_PAIRS.values()))
_MARKS = re.compile(r"[()\[\]{}«»‹›„“”‘’「」『』（）【】《》〈〉‚\"']")
_CODE = re.compile(r"`[^`]*`|\w*[_/]\S*|\w+(?:\(\)|(?:\.\w{2,4})+)|\S+\(\)")
_CJK = re.compile(r"[⺀-鿿豈-﫿＀-￯]")
_TOKEN = re.compile(r"`[^`\n]*`\S*|[^\s`]\S*")


def blocks(text):
    """[(start, end)] of the units of layout: paragraphs, headings and items without their markers."""
    out, at, start, end, kind, number, fence = [], 0, None, None, None, 0, None

    def close():
        if start is not None:
            out.append((start, end))

    for line in _LINE.findall(text):
        a, at = at, at + len(line)
        body = line.strip()
        m = _FENCE.match(line) if body[:3] in ("```", "~~~") else None
        if fence:
            if m and body[:3] == fence and not body.strip("`~"):
                fence = None
            continue
        if m:
            close()
            start, kind, fence = None, None, body[:3]
            continue
        if not body:
            close()
            start = None
            if kind != "item":
                kind = None
            continue
        stop = a + len(line.rstrip())
        m = _HEAD.match(line)
        if m:
            close()
            start, kind = None, None
            if m.end() < len(line.rstrip()):
                out.append((a + m.end(), stop))
            continue
        m = _ITEM.match(line) if body[0] in "-*+•‣◦" or body[0].isdigit() else None
        if m and not (m[1] and kind == "text" and start is not None):
            n = int(m[2]) if m[2] else 0
            inside = start is not None
            if m[1] or not inside or kind == "item" and n == number + 1:
                if m[1] or not inside and (n == 1 or kind == "item" or not kind) or inside:
                    close()
                    start, end, kind, number = a + m.end(), stop, "item", n
                    continue
        if start is None:
            start, kind = a + len(line) - len(line.lstrip()), "text"
        end = stop
    close()
    return [(s, e) for s, e in out if s < e]


def quoted(text, lo, hi):
    """Spans of the quotations and parentheses that close between lo and hi, outermost first."""
    stack, out = [], []
    for m in _MARKS.finditer(text, lo, hi):
        c, i = m[0], m.start()
        before = text[i - 1] if i > lo else " "
        after = text[i + 1] if i + 1 < hi else " "
        if c in "\"'’" and (c != "’" or not any(s[0] in "‘‚" for s in stack)):
            if c != '"' and before.isalnum() and after.isalnum():
                continue
            if any(s[0] == c for s in stack) and not before.isspace():
                while stack[-1][0] != c:
                    stack.pop()
                out.append((stack.pop()[1], i))
            elif c != "’" and (before.isspace() or before in "([{:-—" or not before.isascii()) and not after.isspace():
                stack.append((c, i))
            continue
        if c == "“" and any(s[0] == "„" for s in stack) or c in _CLOSE and c not in "“‘" or c == "‘" and any(s[0] == "‚" for s in stack):
            k = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[k][0], "")), None)
            if k is not None:
                out.append((stack[k][1], i))
                del stack[k:]
        elif c in _PAIRS:
            stack.append((c, i))
    if len(out) > 1:
        out.sort()
        top = [out[0]]
        for s in out[1:]:
            if s[0] > top[-1][1]:
                top.append(s)
        return top
    return out


@functools.lru_cache(200_000)
def _word(w):
    """A word's type: code, numbers and addresses are one type each, but keep their marks."""
    w = w.lstrip("\"'“„«‘「『（([‹¿¡")
    if "://" in w:
        m = re.search(r"[.!?…,;]*[\"'”’»)\]]*\Z", w)
        return "U" + m[0]
    if "`" in w:
        return re.sub(r"`[^`]*`\S*?(?=[.!?…,;:]*[\"'”’»)\]]*\Z)", "X", w) if w.count("`") > 1 else "X" + re.search(r"\W*\Z", w)[0].replace("`", "")
    m = re.match(r"(.*?)([.!?…,;:؟।]*[\"'”’»“)\]]*)\Z", w, re.S)
    body, tail = m[1], m[2]
    if "_" in body or "/" in body or "()" in body or re.search(r"\w\.[a-z]{2}", body):
        return "X" + tail
    if body[:1].isdigit() or body[:1] in "-+.v$" and body[1:2].isdigit():
        return "N" + tail
    return body + tail


def _left(text, lo, at):
    """The type of the word, with its marks, that ends at ``at``."""
    i = text.rfind(" ", lo, at) + 1
    w = text[i or lo : at]
    if at - (i or lo) < 48 and w.isascii() and "\n" not in w and w[:1].isalnum():
        return _word(_JOINED.sub("", w) if w.count(".") > 1 else w)
    piece = text[max(lo, at - 48) : at]
    if not piece[-4:].isascii() and _CJK.search(piece[-4:]):
        m = re.search(r"[。！？｡．…!?”’」』）】》〉\"')\]]*\Z", piece)
        body, tail = piece[: m.start()], m[0]
        if body[-1:].isascii():
            return ("X" if not body[-1:].isdigit() or re.search(r"[a-z_]\w*\Z", body) else "N") + tail
        return body[-2:] + tail
    words = piece.rsplit(None, 2)
    if not words:
        return ""
    if len(words) == 1 and at - 48 > lo and not _THAI.search(piece[-4:]):
        words = text[lo:at].rsplit(None, 2)  # a very long word
    w = words[-1]
    if len(words) > 1 and len(w) < 5 and not any(c.isalnum() for c in w):
        w = words[-2] + w
    if not w.isascii() and _THAI.search(w[-3:]):
        return w[-6:]
    return _word(w)


def _right(text, at, hi):
    """The type of the word that begins at or after ``at``."""
    m = _TOKEN.search(text, at, hi)
    if not m:
        return ""
    w = m[0]
    return _begins(w if len(w) <= 48 or w[:48].isascii() else w[:48])  # of scripts without spaces the first letters count


def _before(text, lo, at):
    """The type of the word before the one that ends at ``at``; of scripts without spaces, of the two letters before."""
    piece = text[max(lo, at - 64) : at]
    if not piece[-4:].isascii() and _CJK.search(piece[-4:]):
        body = piece.rstrip("。！？｡．…!?”’」』）】》〉\"')]")
        return body[-4:-2]
    words = piece.rsplit(None, 2)
    if len(words) < 2 or len(words) == 2 and at - 64 > lo:
        return ""
    w = words[-2]
    return w[-6:] if not w.isascii() and _THAI.search(w[-3:]) else _word(w)


def _after(text, at, hi):
    """The type of the word after the one that begins at or after ``at``; of scripts without spaces, of its next letters."""
    m = _TOKEN.search(text, at, hi)
    if not m:
        return ""
    w = m[0].lstrip("\"'“„«‘「『（([‹¿¡*")
    if w[:1] and not w[0].isascii() and _CJK.match(w):
        return w[2:4]
    m = _TOKEN.search(text, m.end(), hi)
    return _begins(m[0][:48]) if m else ""


@functools.lru_cache(200_000)
def _begins(token):
    w = token.lstrip("\"'“„«‘「『（([‹¿¡*")
    if w[:1] and not w[0].isascii():
        if _CJK.match(w):
            return w[:2] if len(w) < 2 or _CJK.match(w[1]) else w[:1]
        if _THAI.match(w):
            return w[:6]
    elif _CJK.search(w):  # code and numbers that begin a sentence of such a script
        return "\x03" + _word(re.split(r"[^\x00-\x7f]", w, maxsplit=1)[0])
    return ("(" if token[0] in "([（" else "") + _word(w).rstrip(".,;:!?…\"'”’»)]")


def gaps(text, lo, hi, unmarked=True):
    """[(end of the left part, left type, right type)] of the hidden gaps of a block, in order."""
    found = None
    out, k = [], 0
    thai = unmarked and _THAI.search(text, lo, hi)
    for m in (_BREAK if thai else _GAP).finditer(text, lo, hi):
        a, b = m.span()
        at = a if thai else b
        if at >= hi:
            break
        if found is None:
            spans = found = quoted(text, lo, hi)
        while k < len(spans) and spans[k][1] < a:
            k += 1
        if k < len(spans) and spans[k][0] < a and at <= spans[k][1]:
            continue
        if thai:  # types of unmarked scripts are kept apart
            out.append((at, "\x02" + _left(text, lo, at), "\x02" + _right(text, at, hi)))
        else:
            out.append((at, _left(text, lo, at), _right(text, at, hi)))
    return out


@functools.lru_cache(200_000)
def shape(w, left):
    """The class that a rare type shares its figures with."""
    if w[:1] == "\x02":
        return "\x01t" + ("X" if w[1:2] in "XNU" else "o") + str(min(len(w), 4))
    if left:
        tail = re.search(r"[\W_]*\Z", w)[0]
        body = w[: len(w) - len(tail)]
        mark = next((c for c in tail if c in ".!?…؟।。！？"), "")
        kind = "?" if mark in "!?؟！？" and mark else "." if mark == "." else mark or "-"
        tail = ")" if tail[-1:] and tail[-1] != mark else ""
    else:
        body, kind, tail = w, "", ""
    if not body:
        return f"\x01{kind}{tail}0"
    first = "A" if body[0].isupper() else "a" if body[0].islower() else "c" if _CJK.match(body[0]) else "t" if _THAI.match(body[0]) else "o"
    return f"\x01{kind}{tail}{first}{min(len(body), 5) if left else ''}{'.' if '.' in body else ''}"


def _count(batches):
    n = Counter()
    for b in batches:
        for text in b.text:
            some = not text.isascii() and bool(_THAI.search(text))
            for lo, hi in blocks(text):
                unmarked = "\x02" if some and _THAI.search(text, lo, hi) else ""
                n["L", "e", unmarked + _left(text, lo, hi)] += 1
                n["R", "s", unmarked + _right(text, lo, hi)] += 1
                for _, left, right in gaps(text, lo, hi, some):
                    n["L", "n", left] += 1
                    n["P", "n", left + "\x00" + right] += 1
            if len(n) > 200_000:
                yield _frame(n)
                n = Counter()
    yield _frame(n)


def _frame(n):
    return pd.DataFrame([(side, w, c if what == "n" else 0, 0 if what == "n" else c) for (side, what, w), c in n.items()], columns=["side", "word", "inside", "edge"])


class Model:
    """Per side: type -> probability that a gap beside it is a boundary.

    Rows are (type, inside, edge) of the types with figures of their own; rare ones are
    (type's group, its shape, inside, edge), summed over all other types of a shape."""

    def __init__(self):
        self.left, self.right, self.prior, self.known = {}, {}, {}, {}
        self.two_left, self.two_right, self.events = {}, {}, {}
        self.lefts, self.rights = set(), set()  # the words beside gaps in the longer histories

    def learn(self, side, rows, rare):
        table, groups = self.left if side == "L" else self.right, {}
        for w, n, e in rows:
            groups.setdefault(self.group(w, side == "L"), ([], []))[0].append((shape(w, side == "L"), w, n, e))
        for g, c, n, e in rare:
            groups.setdefault(g, ([], []))[1].append((c, None, n, e))
        for g, (own, rest) in sorted(groups.items()):
            # how many hidden boundaries there are for one at a block's edge: the median over types seen there
            seen = sorted((n / e, n) for _, _, n, e in own if e >= LEAST and n >= LEAST) or [(1.0, 1)]
            half, run = sum(n for _, n in seen) / 2, 0
            for ratio, n in seen:
                run += n
                if run >= half:
                    break
            some = own + rest
            whole = sum(n for _, _, n, _ in some) or 1
            mean = min(0.98, max(0.02, sum(min(n, ratio * e) for _, _, n, e in some) / whole))
            self.prior[side, g] = mean
            pooled = {}
            for c, _, n, e in some:
                p = pooled.setdefault(c, [0, 0.0])
                p[0] += n
                p[1] += min(n, ratio * e)
            for c, (n, hit) in pooled.items():
                table[c] = self._p(hit, n, mean, 2)
            for c, w, n, e in own:
                table[w] = self._p(min(n, ratio * e) if n else ratio * e, max(n, ratio * e if not n else n), table[c], 1)

    def opens(self, left):
        """Whether the left word leaves the gap open or ends a sentence: what follows abbreviations tells nothing of right words."""
        p = self.left.get(left)
        return (self.left.get(shape(left, True), 1.0) if p is None else p) >= 0.5

    @staticmethod
    def _p(hit, n, base, weight):
        return min(0.9995, max(0.0005, (hit + weight * base) / (n + weight)))

    @staticmethod
    def group(w, left):
        if not w:
            return "-"
        if w[0] == "\x02":
            return "t"
        if w[0] == "\x03" or _CJK.search(w[-3:] if left else w[:2]):
            return "c"
        if not left:
            return "w"
        return "?" if re.search(r"[!?؟]\W*\Z", w) else "." if re.search(r"[.…।]\W*\Z", w) else "-"

    def prior_of(self, left, right):
        """The posterior of order two: of a gap by the words beside it."""
        key = left, right
        p = self.known.get(key)
        if p is None:
            if len(self.known) > 500_000:
                self.known.clear()
            p = self.known[key] = self._prior_of(left, right)
        return p

    def _prior_of(self, left, right):
        gl, gr = self.group(left, True), self.group(right, False)
        pl = self.left.get(left)
        if pl is None:
            pl = self.left.get(shape(left, True), self.prior.get(("L", gl), 0.9))
        pr = self.right.get(right)
        if pr is None:
            pr = self.right.get(shape(right, False), self.prior.get(("R", gr), 0.7))
        q = self.prior.get(("R", gr), 0.7)
        if pr >= 0.5:
            pr = max(pr, q)  # a word that begins sentences; how often it would is sampling noise
        yes, no = pl * pr / q, (1 - pl) * (1 - pr) / (1 - q)
        return yes / (yes + no)

    def longer(self, rows):
        """Learns from (kind, words, n, sums) what longer histories add.

        kind A: two words to the left, B: two to the right; sums: of the posteriors of order two.
        kind l, r: one word on that side. kind T: a shape of left words one word after another gap;
        sums: of the products of the posteriors of the two gaps (both, first only, second only)."""
        base = {(k, w): p / n for k, w, n, p, _, _ in rows if k in "lr"}
        for k, w, n, p, q, r in rows:
            if k in "AB":
                one = w.split("\x00", 1)[k == "A"] if k == "A" else w.split("\x00", 1)[0]
                short = min(0.9995, max(0.0005, base.get(("l" if k == "A" else "r", one), p / n)))
                long = (p + BACKOFF * short) / (n + BACKOFF)
                step = _logit(long) - _logit(short)
                if abs(step) > 0.02:
                    (self.two_left if k == "A" else self.two_right)[w] = step
                    (self.lefts if k == "A" else self.rights).add(one)
            elif k == "T":
                p = max(p, 0.0)
                joint = {(1, 1): p, (1, 0): q, (0, 1): r, (0, 0): max(0.0, n - p - q - r)}
                self.events[w] = {(x, y): math.log((joint[x, y] + BACKOFF * self._side(joint, 0, x) * self._side(joint, 1, y) / n) / (n + BACKOFF) / (self._side(joint, 0, x) / n * self._side(joint, 1, y) / n)) for x, y in joint}

    @staticmethod
    def _side(joint, side, value):
        return max(1e-6, sum(n for k, n in joint.items() if k[side] == value))

    def posteriors(self, text, lo, hi, found):
        """The posteriors of a block's gaps ``found``, by forward and backward sums over the events."""
        if not found:
            return []
        odds, links = [], []
        for k, (at, left, right) in enumerate(found):
            x = _logit(self.prior_of(left, right))
            if left in self.lefts:
                x += self.two_left.get(_before(text, lo, at) + "\x00" + left, 0.0)
            if right in self.rights:
                x += self.two_right.get(right + "\x00" + _after(text, at, hi), 0.0)
            odds.append(x)
            links.append(self.events.get(shape(left, True)) if k and self.events and near(text, found[k - 1][0], at) else None)
        n = len(odds)
        if not any(links):
            return [1 / (1 + math.exp(-min(500.0, max(-500.0, x)))) for x in odds]
        # sums in logarithms, of the events before and after each gap; without a link nothing passes
        before, after = [(0.0, 0.0)] * n, [(0.0, 0.0)] * n
        for k in range(1, n):
            if links[k]:
                no, yes = before[k - 1][0], before[k - 1][1] + odds[k - 1]
                before[k] = tuple(_sum(no + links[k][0, e], yes + links[k][1, e]) for e in (0, 1))
        for k in range(n - 2, -1, -1):
            if links[k + 1]:
                no, yes = after[k + 1][0], after[k + 1][1] + odds[k + 1]
                after[k] = tuple(_sum(no + links[k + 1][e, 0], yes + links[k + 1][e, 1]) for e in (0, 1))
        return [1 / (1 + math.exp(-min(500.0, max(-500.0, x + b[1] - b[0] + a[1] - a[0])))) for x, b, a in zip(odds, before, after)]


def _logit(p):
    return math.log(p / (1 - p))


def _sum(x, y):
    """The logarithm of the sum of two numbers given by theirs."""
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def near(text, a, b):
    """Whether at most a word stands between two places, so that the event at the one is in the history of the other."""
    return text.find(" ", a + 1, b) < 0 and len(text[a:b].split(None, 2)) <= 1


def spans(text, model):
    """[(start, end)] of a text's sentences."""
    out = []
    unmarked = not text.isascii() and bool(_THAI.search(text))
    for lo, hi in blocks(text):
        start, found = lo, gaps(text, lo, hi, unmarked)
        for (at, _, _), p in zip(found, model.posteriors(text, lo, hi, found)):
            if p >= 0.5:
                _add(out, text, start, at)
                start = at
        _add(out, text, start, hi)
    return out


def _add(out, text, a, b):
    piece = text[a:b]
    bare = piece.strip()
    if bare:
        a += len(piece) - len(piece.lstrip())
        out.append((a, a + len(bare)))


def _summed(batches, key, columns):
    """Sums of the two counts of the rows by key(row), which drops a row by None."""
    n = {}
    for b in batches:
        for row in b.itertuples(index=False):
            k = key(row)
            if k is not None:
                c = n.setdefault(k, [0, 0])
                c[0] += row.n
                c[1] += row.e
        if len(n) > 200_000:
            yield pd.DataFrame([(*k, *c) for k, c in n.items()], columns=columns)
            n = {}
    yield pd.DataFrame([(*k, *c) for k, c in n.items()], columns=columns)


def _side(model: Model, side: str, counts: DataFrame, share: float) -> None:
    """Learns one side from its (word, n, e): the types with at least a share of all, and the sums of all others by shape."""
    n = F.col("n") + F.col("e")
    least = max(LEAST, share * (counts.agg(F.sum(n)).first()[0] or 0))
    own = counts.where(((F.col("n") >= LEAST) | (F.col("e") >= LEAST)) & (n >= least))
    rows = sorted(tuple(r) for r in own.select("word", "n", "e").collect())  # at most 1 / share
    known = counts.sparkSession.sparkContext.broadcast({w for w, _, _ in rows})
    left = side == "L"

    def rest(batches):
        return _summed(batches, lambda r: None if r.word in known.value else (Model.group(r.word, left), shape(r.word, left)), ["kind", "shape", "n", "e"])

    rare = counts.select("word", "n", "e").mapInPandas(rest, "kind string, shape string, n bigint, e bigint").groupBy("kind", "shape").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    model.learn(side, rows, sorted(tuple(r) for r in rare.collect()))  # there are a few hundred shapes


def _expected(shared):
    """Sums of the posteriors of order two over the gaps, by longer histories and by pairs of events."""

    def frame(n):
        words = {}
        for (k, w), c in n.items():
            if k in "AB":  # and by the word beside the gap alone
                one = words.setdefault(("l", w.split("\x00", 1)[1]) if k == "A" else ("r", w.split("\x00", 1)[0]), [0, 0.0, 0.0, 0.0])
                one[0] += c[0]
                one[1] += c[1]
        return pd.DataFrame([(k, w, *c) for some in (n, words) for (k, w), c in some.items()], columns=["kind", "word", "n", "p", "q", "r"])

    def run(batches):
        model, n = shared.value, {}
        for b in batches:
            for text in b.text:
                some = not text.isascii() and bool(_THAI.search(text))
                for lo, hi in blocks(text):
                    last = None
                    for at, left, right in gaps(text, lo, hi, some):
                        p = model.prior_of(left, right)
                        for key in (("A", _before(text, lo, at) + "\x00" + left), ("B", right + "\x00" + _after(text, at, hi))):
                            c = n.get(key)
                            if c is None:
                                n[key] = [1, p, 0.0, 0.0]
                            else:
                                c[0] += 1
                                c[1] += p
                        if last and near(text, last[0], at):
                            c = n.setdefault(("T", shape(left, True)), [0, 0.0, 0.0, 0.0])
                            c[0] += 1
                            for k, x in ((1, last[1] * p), (2, last[1] * (1 - p)), (3, (1 - last[1]) * p)):
                                c[k] += x
                        last = at, p
                if len(n) > 300_000:
                    yield frame(n)
                    n = {}
        yield frame(n)

    return run


def fit(documents: DataFrame, share: float = SHARE) -> Model:
    """The model of a corpus. Counts cover all documents and all pairs of types; types and pairs with at
    least a share of all come to the driver, the other types as sums by shape.

    A right word tells something only where the left one does not settle the gap by itself,
    so its inside counts are the pairs whose left word leaves the gap open."""
    some = documents.select("text").where("text is not null and text <> ''")
    counts = keep(some.mapInPandas(_count, "side string, word string, inside bigint, edge bigint").groupBy("side", "word").agg(F.sum("inside").alias("n"), F.sum("edge").alias("e")))
    model = Model()
    _side(model, "L", counts.where("side = 'L'"), share)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # the left side: at most 1 / share types

    def after(batches):
        def right(r):
            if r.side == "R":
                return (r.word,)
            a, b = r.word.split("\x00", 1)
            return (b,) if shared.value.opens(a) else None

        return _summed(batches, right, ["word", "n", "e"])

    rights = counts.where("side in ('R', 'P')").mapInPandas(after, "word string, n bigint, e bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    _side(model, "R", cut(rights), share)
    whole = documents.sparkSession.sparkContext.broadcast(model)  # both sides: at most 2 / share types
    sums = some.mapInPandas(_expected(whole), "kind string, word string, n bigint, p double, q double, r double").groupBy("kind", "word").agg(*(F.sum(c).alias(c) for c in "npqr"))
    sums = keep(sums)
    least = max(LEAST, share * (sums.where("kind = 'l'").agg(F.sum("n")).first()[0] or 0))
    model.longer([tuple(r) for r in sums.where((F.col("n") >= least) | (F.col("kind") == "T")).orderBy("kind", "word").collect()])  # at most 4 / share, and the shapes
    model.known = {}
    return model


def sentences(documents: DataFrame, model: Model | None = None, text: bool = False) -> DataFrame:
    """One row per sentence: doc_id, char_start, char_end (and sentence, if text).

    Null ids, null and blank texts give none; repeated texts are separate documents."""
    model = fit(documents) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most 4 / SHARE types and pairs

    def cut_up(batches):
        model = shared.value
        for b in batches:
            rows = [(d, s, e, t[s:e]) if text else (d, s, e) for d, t in zip(b.doc_id, b.text) for s, e in spans(t, model)]
            yield pd.DataFrame(rows, columns=["doc_id", "char_start", "char_end", *["sentence"] * text])

    some = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    return some.mapInPandas(cut_up, "doc_id bigint, char_start bigint, char_end bigint" + ", sentence string" * text)


