"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, `+digit`, `.digit`, digits, URL schemes and identifier cues.
At each anchor a local parser expands to both sides, fixes the boundaries and validates what it holds. Parsers only
walk forward from the end of their last parse, so a text costs time in proportion to its length. All positions are
code points.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Kinds in the order in which spans with an equal start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security", "passport", "tax id", "customer id")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
_URL = re.compile(r"[^\x00-\x20\"'<>\\^`{|}]+")
_HOST_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:[/?#]|$)")
_USER_PATH = re.compile(r"/(?:~|users?/|profile/|u/)[^/?#]+", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_FILLER = re.compile(r"(?:\x20?(?:number|nummer|num|no|nr|id)\b\.?)?[\x20\t]*[:#=]?[\x20\t]*", re.I)
_ACCOUNT = re.compile(r"[A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){0,60}")
_ASSIGN = re.compile(r"[\"']?[\x20\t]*[:=][\x20\t]*[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in "0123456789":
        a.add_word(f"+{d}", ("phone", 2))
        a.add_word(f".{d}", ("ip", 2))
        a.add_word(d, ("card", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Sorted (start, index in KINDS, end), end exclusive."""
    spans = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "card":
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, 2, m.end()))
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append((start, 0, m.end()))
        elif kind == "ip":
            if at >= done["ip"]:
                start = at
                while start > done["ip"] and text[start - 1] in _DIGITS:
                    start -= 1
                if start < at:
                    m = _CHAIN.match(text, start)
                    done["ip"] = m.end()
                    parts = [p.lstrip("0") for p in m[0].split(".")]
                    if len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                        spans.append((start, 1, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans.append((at, 3, m.end()))
        elif at >= done[kind]:
            name, start, end = _cued(text, kind, at, last + 1)
            done[kind] = end
            if name:
                spans.append((start, KINDS.index(name), end))
    return sorted(set(spans))


def _cued(text: str, kind: str, at: int, after: int) -> tuple[str | None, int, int]:
    """(kind, start, end) of what follows a scheme or an identifier cue; no kind if it is not personal."""
    if kind == "url":
        m = _URL.match(text, after)
        if not m:
            return None, at, after
        end = after + len(m[0].rstrip(".,;:!?)]*"))
        rest = text[after:end]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        personal = text.startswith("mailto:", at) and "@" in rest or "@" in host or _HOST_IP.match(rest) or _USER_PATH.search(rest)
        return "url" if personal else None, at, m.end() if not personal else end
    if at and (text[at - 1].isalnum() or text[at - 1] == "_") and kind == "account":
        return None, at, after  # inside a word
    if kind == "secret":
        m = _ASSIGN.match(text, after)
        v = _VALUE.match(text, m.end()) if m else None
        if not v:
            return None, at, after
        return "secret" if any(c in _DIGITS for c in v[0]) else None, v.start(), v.end()
    cue_end, at = after, _FILLER.match(text, after).end()
    if m := _IBAN.match(text, at):
        for size in range(len(m[0]), 14, -1):
            code = m[0][:size].replace(" ", "")
            if m[0][size - 1] != " " and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return "iban", at, at + size
    m = _ACCOUNT.match(text, at)
    if not m:
        return None, at, cue_end
    held = []
    for part in re.finditer(r"[A-Za-z0-9]+", m[0]):  # the identifier ends before the first part without a digit
        if not any(c in _DIGITS for c in part[0]):
            break
        held.append(part)
    if held and sum(c in _DIGITS for p in held for c in p[0]) >= 6:
        return "account", at, at + held[-1].end()
    return None, at, cue_end


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace every span by [KIND]; spans that overlap become one, named after the first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_RESULT = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "redacted")]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted.

    Base kinds are email, ip, card and phone; `spans` also lists URLs that name a person (user part, user path, bare
    address), valid IBANs and numbers after account cues, and secrets after token or password cues. A null or empty
    text has no spans and the digest of the empty string. Every row gives a row, repeated ones too; null ids stay
    null. Other columns of `docs` are ignored, so their names cannot clash.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *_RESULT])

    def run(batches):
        anchors = automaton()
        for b in batches:
            counts, digest, listed, clean = [[] for _ in BASE], [], [], []
            for text in b.column(1).to_pylist():
                spans = find_spans(text or "", anchors)
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in spans))
                digest.append(hashlib.sha256(_listed(s for s in spans if s[1] < len(BASE)).encode()).hexdigest())
                listed.append(_listed(spans))
                clean.append(redact(text or "", spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], *[pa.array(c, pa.string()) for c in (digest, listed, clean)]],
                names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_texts(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` with all their columns and personal data replaced; a null text stays null.

    `chars_col`, where it exists, gets the new number of code points of a text that changed.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    count_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        anchors = automaton()
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t if t is None else redact(t, find_spans(t, anchors)) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            if count_at is not None:
                kept = cols[count_at].to_pylist()
                cols[count_at] = pa.array([k if a == z else len(z) for a, z, k in zip(old, new, kept)], cols[count_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)
