"""Personal data: base patterns and a linear-chain CRF over word shapes.

The base patterns give emails, IPv4 addresses, payment cards (Luhn) and
phone numbers. A CRF trained on a small labelled table tags begin / inside
tokens of the same kinds and adds what the patterns miss (national phone
numbers, spelt-out emails, cards written with other signs); a tagged run that
overlaps a base span, or fails its kind's exact check (Luhn, digit counts), is
dropped, so base spans always stay.

The CRF reads every line that holds a digit, an ``@`` or a bracketed "at":
each kind needs one of these. All lines of an Arrow batch are decoded by one
Viterbi pass in numpy.

Defined results: a null or empty text has no spans; repeated rows and equal
texts give equal results; other columns are ignored by ``find_pii`` and kept
as they are by ``mask_pii``.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from gridcast.llm import tagging
from gridcast.llm.crf import Crf, fit
from gridcast.llm.texts import digest_spans, map_texts, rewrite_texts

KINDS = ("email", "ip", "card", "phone")
BEGIN = {1 + 2 * i: k for i, k in enumerate(KINDS)}
INSIDE = {2 + 2 * i: k for i, k in enumerate(KINDS)}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W_]+|_|[^\w\s]")
#: an email with its signs spelt out
_SPELT = re.compile(r"[(\[]at[)\]]|\bat\b[^\n]{1,80}?\bdot\b")
#: every span that passes ``plausible`` holds one of these, so lines without
#: any cannot give a span
_GATE = re.compile(r"[0-9@]|" + _SPELT.pattern)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CUES = frozenset("at dot tel phone call mail email ip host card version page section order invoice ref ssn id no com org net the a".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: from each @, left to the start of its run."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start, then kind as listed."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def labelled_table(seed: int = 7, rows: int = 640) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: lines with the spans of their values. Half
    of the rows hold a value, the others numbers that are no personal data."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def card(sep: str) -> str:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    value = {
        "email": [lambda: f"{word()}.{num(2)}@mail{num(1)}.example.com", lambda: f"{word()}@{word()}.org",
                  lambda: f"{word()}_{word()}@{word()}.co.uk", lambda: f"{word()} (at) {word()} (dot) org",
                  lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}",
                  lambda: f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"],
        "ip": [lambda: ".".join(str(r.randint(1, 254)) for _ in range(4))],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("."), lambda: card("-"), lambda: card("/")],
        "phone": [lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"({num(3)}) 555-{num(4)}",
                  lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"+49 {num(2)} {num(7)}",
                  lambda: f"+{num(2)} {num(3)} {num(3)} {num(4)}"],
    }
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    other = [lambda: "Version 2.0.", lambda: "version 3.", lambda: f"{word()} {num(1)}.0.", lambda: f"in {num(4)}",
             lambda: f"{num(2)}.{num(1)} percent", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"${num(1)},{num(3)}.00",
             lambda: f"page {num(2)} of {num(3)}", lambda: f"section {num(1)}.{num(1)}.{num(1)}", lambda: f"1{num(1)}:3{num(1)}",
             lambda: f'token = "{hexes(40)}"', lambda: f"password={hexes(18)}", lambda: f"AKIA{hexes(16).upper()}",
             lambda: num(16), lambda: f"{num(r.randint(1, 9))}", lambda: f"{num(2)} {num(2)}", lambda: f"No. {num(5)}",
             lambda: f"order {num(3)}-{num(3)}-{num(4)}", lambda: f"invoice {num(3)}-{num(3)}-{num(4)}", lambda: f"SSN {num(3)}-{num(2)}-{num(4)}",
             lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"{word()} at the {word()} dot", lambda: f"at {word()} a dot of {word()}"]
    tails = ["", "", "", ".", ",", "%%%", "***", "!!", "&&&", "$$$", "###"]
    out = []
    for i in range(rows):
        kind = KINDS[i // 2 % 4] if i % 2 else None
        v = r.choice(value[kind])() if kind else r.choice(other)()
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        lead += r.choice(["", ",", ".", ":"]) if lead else ""
        lead = lead + " " if lead else ""
        end = " ".join(word() for _ in range(r.randint(0, 6)))
        text = lead + v + r.choice(tails) + (" " + end if end else "")
        out.append((text, [(kind, len(lead), len(lead) + len(v))] if kind else []))
    return out


def plausible(kind: str, value: str) -> bool:
    """Exact check of a tagged run: a card has 12 to 19 digits passing Luhn,
    a phone number 9 to 15 digits, an address four parts of at most 255, an
    email an @, a bracketed "at" or "at" and "dot" as words."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not (value.isdigit() and luhn(digits))
    if kind == "ip":
        parts = re.split("[^0-9]+", value)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    return "@" in value or bool(_SPELT.search(value))


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _rows(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    out, last = [], -1
    for s, e in spans:
        t = text[s:e]
        form = ("" if s == last else "_") + tagging.shape(t)
        low = t.lower()
        n = sum("0" <= c <= "9" for c in t)
        check = luhn(t) if n == len(t) and 12 <= n <= 19 else None
        out.append([form, low if low in _CUES or not t.isalnum() else "-", f"n{min(n, 20)}{check}"])
        last = e
    return out


def train(table: list[tuple[str, list[tuple[str, int, int]]]] | None = None, rounds: int = 120) -> Crf:
    """CRF of the labelled table (text, spans); the default table is small
    and fixed. An empty table gives a model that adds nothing."""
    table = labelled_table() if table is None else table
    feats, lens, labels, memo = [], [], [], {}
    for text, spans in table:
        toks = tokens(text)
        if not toks:
            continue
        y = [0] * len(toks)
        for kind, s, e in spans:
            inside = [i for i, (a, b) in enumerate(toks) if a >= s and b <= e]
            for j, i in enumerate(inside):
                y[i] = 1 + 2 * KINDS.index(kind) + (j > 0)
        feats.append(tagging.features(_rows(text, toks), memo=memo))
        lens.append(len(toks))
        labels += y
    width = 1 + 2 * len(KINDS)
    x = np.concatenate(feats) if feats else np.zeros((0, 1), np.int64)
    return fit(x, np.array(lens, np.int64), np.array(labels, np.int64), tagging.BUCKETS, width, rounds, rate=0.2)


def spans_of(texts: list[str], model: Crf) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text, both by start, then kind."""
    base = [base_spans(t) for t in texts]
    extra: list[list] = [[] for _ in texts]
    feats, lens, where, memo = [], [], [], {}
    for i, text in enumerate(texts):
        if not _GATE.search(text):
            continue
        at = 0
        for line in text.split("\n"):
            if _GATE.search(line) and (toks := tokens(line)):
                feats.append(tagging.features(_rows(line, toks), memo=memo))
                lens.append(len(toks))
                where.append((i, at, toks, text))
            at += len(line) + 1
    if lens:
        best = model.viterbi(np.concatenate(feats), np.array(lens))
        done, taken = 0, {i: tagging.Taken(base[i]) for i in {w[0] for w in where}}
        for (i, at, toks, text), n in zip(where, lens):
            for kind, a, b in tagging.runs(best[done:done + n], BEGIN, INSIDE):
                s, e = at + toks[a][0], at + toks[b][1]
                if plausible(kind, text[s:e]) and not taken[i].meets(s, e):
                    extra[i].append((kind, s, e))
            done += n
    both = [sorted(b + x, key=lambda v: (v[1], KINDS.index(v[0]), v[2])) if x else b for b, x in zip(base, extra)]
    return base, both


def find_pii(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (all spans), n_added. A null text counts as empty."""
    model = model or train()

    def work(texts: list[str]) -> list[list]:
        base, both = spans_of(texts, model)
        counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS]
        sha = [hashlib.sha256(digest_spans(b).encode()).hexdigest() for b in base]
        return counts + [sha, [digest_spans(b) for b in both], [len(y) - len(x) for x, y in zip(base, both)]]

    return map_texts(docs, id_col, text_col,
                     "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                     "spans string, n_added long", work)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the
    joined stretch is replaced once, by the first one's kind."""
    out, done = [], 0
    for kind, s, e in spans:
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:] if out else text


def mask_pii(docs: DataFrame, model: Crf | None = None, text_col: str = "text",
             length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced; ``length_col`` follows. A
    null text stays null."""
    model = model or train()

    def work(old: list[str | None]):
        _, both = spans_of([t or "" for t in old], model)
        return [t if t is None else masked(t, s) for t, s in zip(old, both)], None

    return rewrite_texts(docs, text_col, work, length_col)
