"""Problem 4: credentials in source code, configuration and conversation.

Quoted strings and long tokens are extracted from all texts.  A value counts if
its Shannon entropy reaches a share of what random text of its length in its
alphabet has: nearly all of that where nothing else speaks for a credential
(BARE), less where it has an issuer's prefix (ISSUED) or stands where credentials
do (CONTEXT: an assignment to a telling name, a header, a URL's login, a flag, a
telling phrase), since people's passwords and pass phrases are not random.
Placeholders, references, digests, identifiers, data and public keys do not count.
"""

from __future__ import annotations

import base64
import binascii
import functools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splitting import items

_KW = r"(?:passwords?|passwd|passphrase|pass_?word|pwd|(?:smtp|ftp|db|ssh|vpn|root|admin|user|login)[ _-]?pass|secret(?:[_-]?key)?|(?<![a-z])tokens?|[a-z]Token|[_-]token|api[_ -]?key|apikey|access[_ -]?key|signing[_ -]?key|encryption[_ -]?key|private[_ -]?key|private[_ -]?token|credentials?)"
#: Functions that take a user's name and password.
_OPENS = r"(?:re)?connect|authenticate|auth|log_?[io]n|sign_?in|basic_?auth|(?:open|new|start|create)_?(?:session|connection|client)"
#: A value in prose or a shell: a phrase of words that ends in a number, or one word.
_PHRASE = r"[a-z]+(?: [a-z]+){1,4} \d{1,6}"
_WORD = r"[^\s\"'`,;\\]+(?:[,;][^\s\"'`,;\\]+)*"
_QUOTED = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
ANCHORS = ("passw", "passphrase", "pwd", "pass", "secret", "token", "apikey", "api key", "api_key", "api-key", "access_key", "access key", "accesskey", "access-key", "signing", "private", "credential", "auth", "login", "log in", "connect", "session", "sign_in", "signin", "client(", "log_in", "logon", "log_on", "://", " -u ", "ghp_", "glpat-", "xoxb-", "xoxp-", "akia", "eyj", "_live_", "sk-")
_ANCHOR = re.compile(
    r"(?i)passw|passphrase|pwd|[ _-]pass\b|secret|token|api[ _-]?key|access[ _-]?key|signing[ _-]?key|encryption[ _-]?key|private[ _-]?key|credential|authorization|\blog ?in\b|\b(?:" + _OPENS + r")\(|://[^\s/\"'@]+@| -u |ghp_|glpat-|xox[bp]-|AKIA|eyJ|_live_|\bsk-"
)
_KEYBLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEYEND = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEYHEAD = re.compile(r"[A-Za-z-]+: ")
_KEYBODY = re.compile(r"[A-Za-z0-9+/=]*")
_KEYBREAK = re.compile(r"\n|(?:\\r)?\\n")
#: (name, pattern, whether quotes are part of the value, how strong the context is)
RULES = [
    ("url", re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@\"'<>`]*:(?P<v>[^\s/\"'<>@`]+)@"), False),
    ("header", re.compile(r"(?i)authorization[\"']?\s*[:=,]\s*[\"']?(?:bearer|basic|token|apikey)\s+(?P<v>" + _PHRASE + "|" + _WORD + ")"), False),
    ("header", re.compile(r"(?i)\bx-(?:api-key|auth-token|access-token)[\"']?\s*[:=,]\s*[\"']?(?P<v>" + _WORD + ")"), False),
    ("query", re.compile(r"(?i)[?&][\w.\-]*" + _KW + r"=(?P<v>[^\s&\"'`#]+)"), False),
    ("call", re.compile(r"(?i)\b(?:" + _OPENS + r")\((?:\s*" + _QUOTED + r"\s*,){1,3}\s*(?P<v>" + _QUOTED + r")\s*\)"), True),
    ("netrc", re.compile(r"\blogin\s+\S+\s+password\s+(?P<v>" + _PHRASE + r"|\S+)"), False),
    ("prose", re.compile(r"(?i)\blog(?:ged|ging)? ?in (?:as|with user) \S+ (?:with|using|and) (?:password )?(?P<v>" + _QUOTED + "|" + _PHRASE + r"|\S+)"), True),
    ("prose", re.compile(r"(?i)\blogin (?:was|is|for|:)\s+\S+\s*[/:|]\s*(?P<v>" + _QUOTED + "|" + _PHRASE + r"|\S+)"), True),
    ("prose", re.compile(r"(?i)\bset\s+`?[\w.\- ]*?" + _KW + r"`?\s+to\s+(?P<v>" + _QUOTED + "|" + _PHRASE + r"|\S+)"), True),
    ("prose", re.compile(r"(?i)(?<![\w])(?:[\w\-]+ )*?[\w\-]*" + _KW + r"\s+(?:is|was|=>|now)\s*:?\s+(?P<v>" + _QUOTED + "|" + _PHRASE + r"|\S+)"), True),
    ("note", re.compile(r"(?i)\b(?:tmp|temp|temporary|note|fixme|todo|xxx|hack)\s*:\s*(?:[\w\-]+ ){0,3}?[\w\-]*" + _KW + r"\s+(?P<v>" + _QUOTED + "|" + _PHRASE + r"|\S+)"), True),
    ("flag", re.compile(r"(?i)(?<=[\s\"'])--?[\w\-]*" + _KW + r"[ =](?P<v>" + _QUOTED + r"|[^\s\"'`\\]+)"), True),
    ("user", re.compile(r"(?<=\s)(?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<v>" + _QUOTED + r"|[^\s\"'`\\]+)"), True),
    ("env", re.compile(r"(?<![\w.])[A-Z_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY)_\w+=(?P<v>" + _QUOTED + r"|[^\s\"'`\\]+)"), True),
    ("phrase", re.compile(r"(?i)(?<![\w])[\w.\-]*" + _KW + r"\d*=(?P<v>" + _PHRASE + r")(?=$|[\s.,;?!])"), False),
    ("name", re.compile(r"(?i)(?<![\w$])[\"'`]?[\w.\-]*" + _KW + r"\d*[\"'`]?\]?\s*(?::\s*[A-Za-z_][\w.<>\[\]? ]*?)?\s*(?::=|=>|[=:])\s*(?P<v>(?:[bru]{0,2}(?:" + _QUOTED + r"))(?:\s*[+.]?\s*\\?\s*(?:" + _QUOTED + r"))*)"), True),
    ("name", re.compile(r"(?i)(?<![\w$])[\w.\-]*" + _KW + r"\d*\s*[=:]\s*(?P<v>[^\s\"'`,;(){}\[\]<][^\s\"'`,;(){}]*(?:[(){},;][^\s\"'`,;(){}]+)*)(?=$|[\s,;?.\"'`)])"), False),
]
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:ghp_[A-Za-z0-9]{30,}|gho_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_\-]{18,}|xox[bpars]-[0-9A-Za-z\-]{20,}|AKIA[0-9A-Z]{16}|[a-z]{2,8}_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]{10,}={0,2}\.eyJ[A-Za-z0-9_\-]{5,}={0,2}\.[A-Za-z0-9_\-]{10,})(?![A-Za-z0-9])"
)
#: Long tokens, in quotes or not, and what makes one data: a digest's mark before it, or another such token in the line or the lines around.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_\-.:@])(?=[A-Za-z0-9+/_\-]*[0-9])(?=[A-Za-z0-9+/_\-]*[a-z])(?=[A-Za-z0-9+/_\-]*[A-Z])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/=_\-.(])")
_DIGEST = re.compile(r"(?i)(?:hash|digest|sha\d*|md5|crc|checksum|integrity|fingerprint|etag|revision|commit|signature|signedsource|public|uuid|guid|nonce)[\w\"'`\]]*\s*(?:[:=<,(]|=>|:=)*\s*(?:W/)?[\"'`<]*(?:sha\d+-)?\Z")
_ARMOUR = re.compile(r"-----BEGIN [^\n]*?-----(?:(?!-----)[\s\S])*")
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:<.*>|\[.*\]|\$.*|%.*%|%\(.*|\{\{.*|\{.*\}|@\{.*|.*\$\{.*|.*\{\{.*|.*(?:get_?env|environ|process\.env|secrets?manager|ssm:)[\W_].*|vault[:/(].*|.*vault[_-](?:read|get|path).*|your[_ -].*|.*[_-]here|replace[_ -]?me.*|change[_ -]?(?:me|it).*|insert[_ -].*|.*\b(?:redacted|placeholder|masked|hidden|removed|dummy|example|sample|todo|tbd|none|null|nil|undefined|true|false|required|optional|string|str|bytes|int|any)\b\W*|enter[_ -].*|my[_-]?(?:password|secret|token|key)|(?:test|fake)[_ -]?(?:password|secret|token|key)?|password\d{0,3}|secret|token|.*(?:must|should|cannot|invalid|missing|expired|required|characters).*)\Z"
)
_NOT_NAMES = re.compile(r"(?i)(?:hash|digest|sha\d*|checksum|fingerprint|etag|integrity)\d*[\"'`]?\]?\s*(?::[^=].*)?(?::=|[=:])\s*\Z|public[_-]?(?:key|token)")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*\Z")
_WORDNUM = re.compile(r"[A-Za-z]+(?:[ _\-][A-Za-z]+)+[ _\-]\d{1,6}\Z|[a-z]{9,}\d{2,6}\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")


def entropy(s):
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


#: Alphabets from small to large, and their sizes.
ALPHABETS = [(re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z"), 16), (re.compile(r"(?:[0-9a-z]+|[0-9A-Z]+)\Z"), 36), (re.compile(r"[a-z0-9 _.\-]+\Z"), 40), (re.compile(r"[A-Za-z0-9+/=_\-]+\Z"), 64), (re.compile(r"[ -~]+\Z"), 95)]
#: Shares of the expected entropy from which a value counts.
BARE, ISSUED, CONTEXT = 0.94, 0.8, 0.72


@functools.lru_cache(65536)
def expected(n, size):
    """The mean Shannon entropy, in bits a character, of n characters drawn from an alphabet of ``size``: that of
    the alphabet less what n characters cannot show."""
    if n > 2000:
        return math.log2(size)
    p, q, term, total = 1 / size, 1 - 1 / size, (1 - 1 / size) ** n, 0.0
    for k in range(1, n + 1):  # term: the chance that a character occurs k times
        term *= (n - k + 1) / k * p / q
        total += k * math.log2(k) * term
        if k > 4 * n * p + 8 and term < 1e-12:
            break
    return math.log2(n) - size / n * total if n else 0.0


def threshold(value, share):
    """Bits a character that a value must reach, by its length and alphabet; share of the expected ones."""
    return share * expected(len(value), next((size for pattern, size in ALPHABETS if pattern.match(value)), 256))


def strong(value, share):
    """Whether a value's entropy reaches the share of what its length and alphabet let expect."""
    return bool(value) and entropy(value) >= threshold(value, share)


def decoded(value):
    """What a trivially encoded value says: base64 of a login."""
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None
    return text if text.isprintable() else None


def wordy(value):
    """Whether a name consists of words: its runs of one case, on average, are longer than chance makes them."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", value)
    letters = [p for p in parts if not p.isdigit()]
    if not letters or re.fullmatch(r"[A-Z0-9]{16,}|[0-9a-f]{16,}", value) and re.search(r"\d", value):
        return False
    return sum(map(len, letters)) / len(letters) >= 4.0 and len(parts) - len(letters) <= 1 + len(letters) // 2


def usable(value, rule, quoted):
    """Whether an extracted value is a credential in its context."""
    if len(value) < 6 or not strong(value, CONTEXT) or _PLACEHOLDER.match(value):
        return False
    if _UUID.match(value) and rule == "name":
        return False
    if rule == "header" and (plain := decoded(value)) and ":" in plain:
        value = plain.split(":", 1)[1]
        return bool(value) and not _PLACEHOLDER.match(value)
    if value.count(" ") and not re.fullmatch(_PHRASE, value) and not _WORDNUM.match(value):
        return False  # sentences
    if _WORDNUM.match(value):
        return quoted or rule != "name" or not re.fullmatch(r"[a-z]{9,}\d{2,3}", value)
    if re.match(r"[\w.$]+\(", value) or value.startswith(("http://", "https://", "/", "./")) and "@" not in value and rule == "name" and not value.endswith("="):
        return False
    if _IDENT.match(value) and wordy(value) and (rule == "name" or not re.search(r"\d{3,}\Z", value)):
        return False  # a name, not a value
    if not re.search(r"\d", value) and not re.search(r"[^\w\s.\-]", value) and len(value) < 20:
        return False
    return True


def _bare(text, lo, hi):
    """Spans of the value without its quotes, and the value itself (pieces of a joined literal together)."""
    raw = text[lo:hi]
    if raw[:1] in "\"'`" or raw[:1] in "bru" and raw[1:2] in "\"'`":
        spans = [(lo + m.start() + (m[0][0] in "bru") + 1, lo + m.end() - 1) for m in re.finditer(r"[bru]{0,2}(?:" + _QUOTED + ")", raw)]
        return spans, "".join(text[a:b] for a, b in spans), True
    while hi > lo and text[hi - 1] in ".,;:!?)]}>" and not (text[hi - 1] in "!?" and not text[lo:hi - 1].isalnum()):
        hi -= 1
    return [(lo, hi)], text[lo:hi], False


def _open_key(text, at):
    """The end of the lines from ``at`` that look like the body of a key without an END line."""
    while at < len(text):
        line = _KEYBREAK.search(text, at)
        hi = line.start() if line else len(text)
        lead = at + len(text[at:hi]) - len(text[at:hi].lstrip(" \t\r\"'+>|#*("))
        end = _KEYBODY.match(text, lead, hi).end()
        rest = text[end:hi].strip(" \t\r\"'+,;\\)")
        if rest:
            if not _KEYHEAD.match(text, lead, hi):
                return end if end - lead >= 16 else at
        elif 0 < end - lead < 16 and text[lead] != "=":
            return end  # the last line is shorter
        at = line.end() if line else len(text)
    return len(text)


def bare(text):
    """Long tokens that look random by themselves: [("bare", [span])]."""
    out = []
    armour = [m.span() for m in _ARMOUR.finditer(text)] if "-----BEGIN" in text else ()  # keys, certificates and messages are no tokens
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if any(x < a < y for x, y in armour):
            continue
        if b - a > 100 or wordy(m[0]) or not strong(m[0].rstrip("="), BARE) or _PLACEHOLDER.match(m[0]):
            continue
        lo = text.rfind("\n", 0, a) + 1
        if _DIGEST.search(text, max(lo, a - 80), a):
            continue
        before, hi = text.rfind("\n", 0, max(0, lo - 1)) + 1, text.find("\n", b)
        after = text.find("\n", hi + 1) if hi >= 0 else -1
        around = text[before:a] + " " + text[b : after if after >= 0 else len(text)]
        if not _TOKEN.search(around):
            out.append(("bare", [(a, b)]))
    return out


def find(text):
    """Credentials of a text: [(kind, [spans of the value])], in order; overlapping finds are one."""
    if not text:
        return []
    out, seen_to = bare(text), -1
    low = text.lower()
    if not out and not any(a in low for a in ANCHORS):
        return []
    for m in _ANCHOR.finditer(text):
        if m.start() < seen_to:
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        hi = text.find("\n", m.start())
        hi = seen_to = len(text) if hi < 0 else hi
        out += _in_line(text, lo, hi)
    for m in _KEYBLOCK.finditer(text):
        end = _KEYEND.search(text, m.end())
        stop = end.start() if end else max(min(len(text), m.end() + 4096), _open_key(text, m.end()))
        body = re.sub(r"\\n|[\s\"'+>|#*/\\]|\\r", "", text[m.end() : stop])
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40 and len(set(body)) > 12 and "redacted" not in body.lower():
            out.append(("private_key", [(m.start(), end.end() if end else stop)]))
    out.sort(key=lambda x: x[1][0])
    merged = []
    for kind, spans in out:
        if merged and spans[0][0] < merged[-1][1][-1][1]:
            if kind == "private_key" or merged[-1][0] == "bare":
                merged[-1] = (kind, spans)
            continue
        merged.append((kind, spans))
    return merged


def _in_line(text, lo, hi):
    line, out, taken = text[lo:hi], [], []
    for m in _ISSUED.finditer(line):
        if "EXAMPLE" not in m[0] and strong(m[0], ISSUED):
            taken.append((m.start(), m.end()))
            out.append(("issued", [(lo + m.start(), lo + m.end())]))
    for rule, pattern, _ in RULES:
        for m in pattern.finditer(line):
            a, b = m.span("v")
            if any(a < y and x < b for x, y in taken):
                continue
            if rule == "name" and _NOT_NAMES.search(m[0][: a - m.start()]):
                continue
            spans, value, quoted = _bare(line, a, b)
            if "-----BEGIN" in value:
                continue
            if "://" in value:
                continue
            shown = re.sub(r"%([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), value) if rule in ("url", "query") else value
            if usable(shown, rule, quoted):
                taken.append((a, b))
                out.append((rule, [(lo + x, lo + y) for x, y in spans]))
    return out


def redact(text, found=None):
    """The text with every credential masked; quotes, line ends and all else stay."""
    found = find(text) if found is None else found
    parts, at = [], 0
    for kind, spans in found:
        for i, (a, b) in enumerate(spans):
            parts.append(text[at:a])
            if kind == "private_key":
                body = text[a:b]
                parts.append(re.sub(r"(?<=-----)(?!BEGIN|END)[\s\S]*(?=-----END)|(?<=KEY-----)[\s\S]*\Z", lambda m: re.sub(r"[A-Za-z0-9+/=]{2,}", "REDACTED", m[0].replace("\\n", "\0")).replace("\0", "\\n"), body))
            else:
                parts.append("REDACTED" if not i else "")
            at = b
    return "".join(parts) + text[at:]


_FOUND = "item_table string, item_id bigint, kind string, line_no bigint, char_start bigint, char_end bigint"
_CLEAN = "item_table string, item_id bigint, credentials bigint, redacted string"


def _find(batches):
    for b in batches:
        rows = []
        for table, key, text in zip(b.item_table, b.item_id, b.content):
            for kind, spans in find(text):
                rows.append((table, key, kind, text.count("\n", 0, spans[0][0]) + 1, spans[0][0], spans[-1][1]))
        yield pd.DataFrame(rows, columns=["item_table", "item_id", "kind", "line_no", "char_start", "char_end"])


def _redact(batches):
    for b in batches:
        rows = []
        for table, key, text in zip(b.item_table, b.item_id, b.content):
            found = find(text)
            if found:
                rows.append((table, key, len(found), redact(text, found)))
        yield pd.DataFrame(rows, columns=["item_table", "item_id", "credentials", "redacted"])


def credentials(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """One row per credential: kind, line_no from 1, char_start, char_end. Null contents give none; repeated deliveries count once."""
    return items(artifacts, events).mapInPandas(_find, _FOUND).dropDuplicates(["item_table", "item_id", "char_start"])


def redacted(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """The items that hold credentials, with their number and the redacted text."""
    some = items(artifacts, events)
    return some.mapInPandas(_redact, _CLEAN).dropDuplicates(["item_table", "item_id"])


def found_lines(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    return credentials(artifacts, events).select("item_table", "item_id", "line_no").distinct().select("item_table", "item_id", F.col("line_no").cast("bigint").alias("line_no"))
