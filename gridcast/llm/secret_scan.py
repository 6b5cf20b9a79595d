"""Secrets: base patterns and a linear-chain CRF over token shapes.

The CRF tags tokens as secret begin, inside or outside from their shape,
their neighbours and file features (how much of the text looks like
settings). It adds spans of kind ``secret`` where no base span lies; base
spans always stay. It reads every line of every text, by one Viterbi pass per
Arrow batch. A token's features depend on its form and on how far back a cue
stands, so the label scores are summed once per form, pair and triple of forms
(``Reader``) and looked up for every token.

Defined results: a null or empty text has no spans; repeated rows and equal
texts give equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from gridcast.llm import tagging
from gridcast.llm.crf import Crf, fit
from gridcast.llm.texts import digest_spans, map_texts

KINDS = ("assign", "access", "hex", "secret")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+(?:[.=]+[A-Za-z0-9+/_-]+)*=*|[^\sA-Za-z0-9+/_-]")
_PARTS = re.compile(f"({_TOKEN.pattern})")
_CUES = frozenset("password passwd secret token key apikey api_key bearer auth authorization private pwd".split())
#: tokens and forms that a reader keeps from batch to batch
_KEPT_TOKENS, _KEPT_FORMS = 200_000, 20_000
#: a cue this far back, or further, or none
_FAR = 7


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start, then kind as listed."""
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: x[1] * len(KINDS) + KINDS.index(x[0]))


def labelled_table(seed: int = 11, rows: int = 420) -> list[tuple[str, list[tuple[int, int]]]]:
    """The small labelled table: lines with the spans of the secrets in them."""
    r = random.Random(seed)
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick("abcdefghilmnoprstu", r.randint(2, 9))
    secret = [lambda: pick(dig + "abcdef", 40), lambda: "AKIA" + pick(up + dig, 16), lambda: "ghp_" + pick(low + up + dig, 36),
              lambda: "sk-" + pick(low + up + dig, 32), lambda: pick(low + up + dig + "+/", 43) + "=",
              lambda: pick(dig + "abcdef", 18), lambda: "xoxb-" + pick(dig, 12) + "-" + pick(low + up + dig, 24)]
    plain = [lambda: word() + pick(dig, 2), lambda: pick(dig, 16), lambda: f"+1 ({pick(dig, 3)}) 555-{pick(dig, 4)}",
             lambda: f"{word()}.{pick(dig, 2)}@mail{pick(dig, 1)}.example.com", lambda: ".".join(pick(dig, 2) for _ in range(4)),
             lambda: "Version 2.0.", lambda: f"20{pick(dig, 2)}-01-1{pick(dig, 1)}", lambda: f"http://{word()}.example.com/{word()}/{pick(dig, 3)}",
             lambda: f"token {word()}", lambda: f"the secret {word()}", lambda: f"{word()}_{word()}_{word()}{pick(dig, 1)}",
             lambda: "-".join(pick(dig + "abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"id {'-'.join(pick(dig + 'abcdef', n) for n in (8, 4, 4, 4, 12))}",
             lambda: f"integrity sha{r.choice(['256', '384', '512'])}-{pick(low + up + dig, 43)}=", lambda: f"sha512-{pick(low + up + dig + '+/', 86)}==",
             lambda: pick(low, 24), lambda: f"{word()}-{word()}-{word()}-{pick(dig, 4)}", lambda: pick(dig, 6)]
    keys = ["key", "auth", "Authorization: Bearer", "secret_key =", "password:", "token", "private_key=", "", "", ""]
    tails = ["", "", "", ".", ",", '"', ";", "%%%", "!!"]
    out = []
    for i in range(rows):
        lead = " ".join(word() for _ in range(r.randint(0, 5)))
        lead += " " if lead else ""
        if i % 2:
            k = r.choice(keys)
            lead += k + " " if k else ""
            v = r.choice(secret)()
        else:
            v = r.choice(plain)()
        end = " ".join(word() for _ in range(r.randint(0, 5)))
        text = lead + v + r.choice(tails) + (" " + end if end else "")
        out.append((text, [(len(lead), len(lead) + len(v))] if i % 2 else []))
    return out + _cue_rows(r, pick, word) + _long_word_rows(r, word)


def _cue_rows(r: random.Random, pick, word, rows: int = 720) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with a cue word: half with a secret that has no digit or is
    short, half with plain words and numbers in its place."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    keys = ["Authorization: Bearer ", "private_key = ", "secret_key = ", "db password is ", "password: ", "the token is ", "auth key ",
            "API_KEY=", "bearer ", "passwd ", "my secret: ", "pwd=", "pwd: ", "key = ", "PRIVATE_KEY: ", 'auth_token = "', "access token "]
    mixed = lambda n: "".join(r.choice(low + up) for _ in range(n))
    short = lambda: word().capitalize()[:4] + pick(dig, 1) + pick(low, 2) + pick(dig, 1) + pick(low, r.randint(1, 4))
    secret = [lambda: mixed(r.randint(14, 40)), lambda: pick(low + up, 1) + mixed(r.randint(20, 28)),
              lambda: "".join(a + b for a, b in zip(pick(up, 13), pick(low, 13))), lambda: word() + pick(dig, 1) + pick(low, 1) + pick(dig, 1),
              lambda: short() + r.choice("&$!%@*") + pick(dig, r.randint(1, 3)), short,
              lambda: short() + r.choice("&$!%@*") + pick(low + up + dig, r.randint(1, 4)), lambda: short() + "&" + pick(dig, 1), lambda: pick(low + up + dig, r.randint(8, 11))]
    plain = [word, lambda: f"{word()} {word()}", lambda: f"must be {word()} every {pick(dig, 2)} days", lambda: f"of the {word()}",
             lambda: word().capitalize(), lambda: pick(dig, r.randint(1, 4)), lambda: f"{word()}_{word()}", lambda: f"{word()} & {word()}",
             lambda: f"{word().capitalize()} {word().capitalize()} in 20{pick(dig, 2)}", lambda: f"{word()}. {word().capitalize()}",
             lambda: f"{word()}.*** {pick(up, 1)} {word()}*** {pick(up, 1)}", lambda: f"{pick(up, 1)} {word()}$$$ {word()}!!"]
    out = []
    for i in range(rows):
        lead = " ".join(word() for _ in range(r.randint(0, 5)))
        lead += (" " if lead else "") + r.choice(keys)
        v = r.choice(secret if i % 2 else plain)()
        end = " ".join(r.choice([word, word, word, lambda: pick(dig, 16), lambda: pick(dig, 4)])() for _ in range(r.randint(0, 5)))
        out.append((lead + v + ('"' if lead.endswith('"') else r.choice(["", "", ".", ","])) + (" " + end if end else ""),
                    [(len(lead), len(lead) + len(v))] if i % 2 else []))
    return out


def _long_word_rows(r: random.Random, word, rows: int = 120) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of prose with long words, small or with a large first letter, and no secret."""
    out = []
    for _ in range(rows):
        words = [word() for _ in range(r.randint(0, 8))]
        long = "".join(word() + r.choice(["", "", "ä", "ö", "ü", "ß", "é"]) for _ in range(r.randint(3, 6)))
        words.insert(r.randint(0, len(words)), r.choice([long, long.capitalize(), long.capitalize()]))
        out.append((" ".join(words) + r.choice(["", ".", ",", "!"]), []))
    return out


def _form(t: str) -> tuple[tuple[str, ...], str, int, int, bool]:
    """What features know of a token itself: five names, its signs and size as
    text, how often small letters turn large, its size, and whether it is a cue."""
    low = t.lower()
    kinds = digit, small, large = any(map(str.isdigit, t)), any(map(str.islower, t)), any(map(str.isupper, t))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:])) if digit else 0
    size = min(6, len(t) // 6)
    cased = min(sum(a.islower() and b.isupper() for a, b in zip(t, t[1:])), 3) if small and large else 0
    names = (tagging.shape(t) if len(t) < 12 else f"long{size}{kinds}",
             low if low in _CUES or not t.isalnum() and len(t) == 1 else "-",
             f"k{kinds}{size}", f"t{min(turns, 6)}{size}", "hex" if len(t) >= 16 and re.fullmatch("[0-9a-f]+", t) else "no")
    return names, f"{kinds}{size}", cased, size, not _CUES.isdisjoint(low.replace("-", "_").split("_"))


def _since(form: tuple, since: int) -> list[str]:
    """Names that tell how far back a cue word stands, up to four tokens."""
    _, kinds, cased, size, _ = form
    return [f"c{min(since, 5)}{kinds}", f"u{cased}{since < 5}{size}"]


def _touch(touches: bool, since: int) -> str:
    return f"j{touches}{min(since, _FAR)}"


def _rows(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """Names of each token's features; the last three tell how far back
    a cue word stands (up to four tokens), how often small letters turn large,
    and whether the token touches the one before."""
    out, since, upto = [], 9, -1
    for s, e in spans:
        form = _form(text[s:e])
        out.append([*form[0], *_since(form, since), _touch(s == upto, since)])
        upto = e
        since = 1 if form[-1] else since + 1
    return out


def file_features(text: str) -> list[str]:
    """What the whole text looks like: settings lines and braces per line."""
    lines = text.count("\n") + 1
    return [f"set{min(3, 3 * (text.count('=') + text.count(': ')) // lines)}",
            f"code{min(2, 2 * (text.count('{') + text.count(';')) // lines)}"]


def train(table: list[tuple[str, list[tuple[int, int]]]] | None = None, rounds: int = 120) -> Crf:
    """CRF of the labelled table (text, spans): 0 outside, 1 begin, 2 inside.
    An empty table gives a model that adds nothing."""
    table = labelled_table() if table is None else table
    feats, lens, labels, memo = [], [], [], {}
    for text, spans in table:
        toks = [m.span() for m in _TOKEN.finditer(text)]
        if not toks:
            continue
        y = [0] * len(toks)
        for s, e in spans:
            for j, i in enumerate([i for i, (a, b) in enumerate(toks) if a < e and s < b]):
                y[i] = 1 + (j > 0)
        feats.append(tagging.features(_rows(text, toks), file_features(text), memo))
        lens.append(len(toks))
        labels += y
    x = np.concatenate(feats) if feats else np.zeros((0, 1), np.int64)
    return fit(x, np.array(lens, np.int64), np.array(labels, np.int64), tagging.BUCKETS, 3, rounds, rate=0.2)


class _Forms(dict):
    """Number of each token's form; 0 is the place before or after a line."""

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[tuple, int] = {}

    def __missing__(self, token: str) -> int:
        form = _form(token)
        self[token] = n = self.number.setdefault(form, len(self.number) + 1)
        return n


class Reader:
    """Labels of all tokens of whole texts under the model, from the features
    of ``_rows``, ``file_features`` and ``tagging.features``: label scores are
    summed per form and distance of a cue, per neighbour's form, per pair and
    triple of shapes, and looked up by number."""

    def __init__(self, model: Crf):
        self.model, self.forms, self.built = model, _Forms(), -1
        self.touch = self._sums([[_touch(t, k)] for t in (False, True) for k in range(_FAR + 1)])

    def _sums(self, names: list[list[str]]) -> np.ndarray:
        """Label scores of each list of names (all of the same length)."""
        return self.model.scores(np.array([[tagging.bucket(x) for x in some] for some in names], np.int64))

    def _build(self) -> None:
        """The tables of the forms, as far as they are known."""
        if self.built == len(self.forms.number):
            return
        forms = list(self.forms.number)
        heads = [("edge", "edge"), *(f[0][:2] for f in forms)]
        shapes: dict[str, int] = {}
        self.shape = np.array([shapes.setdefault(a, len(shapes)) for a, _ in heads], np.int64)
        self.shapes = list(shapes)
        self.cue = np.array([False, *(f[-1] for f in forms)])
        own = self._sums([[*f[0], *_since(f, k)] for f in forms for k in range(_FAR + 1)]) if forms else np.zeros((0, 3))
        self.own = np.concatenate([np.zeros((_FAR + 1, own.shape[1])), own])
        self.near = {d: self._sums([[f"{d}|{a}", f"{d}|{b}"] if d in (-1, 1) else [f"{d}|{a}"] for a, b in heads])
                     for d in (-2, -1, 1, 2)}
        self.built = len(forms)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, line, start, end, label) of every token; lines are numbered
        over all texts, places are those in the token's text."""
        if len(self.forms) > _KEPT_TOKENS or len(self.forms.number) > _KEPT_FORMS:
            self.forms = _Forms()
            self.built = -1
        joined = "\n".join(texts)
        parts = _PARTS.split(joined)  # blanks and tokens by turns
        n = len(parts) // 2
        form = np.fromiter(map(self.forms.__getitem__, parts[1::2]), np.int64, n)
        edge = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        start, end = edge[:-1:2], edge[1::2]
        del parts
        self._build()
        breaks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
        line = np.searchsorted(breaks, start)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes + 1) - sizes - 1
        text = np.searchsorted(first, start, side="right") - 1
        if not n:
            return text, line, start, end, np.zeros(0, np.int64)
        at = np.arange(n)
        opens = np.concatenate([[True], line[1:] != line[:-1]])
        heads = np.flatnonzero(opens)
        lens = np.diff(np.append(heads, n))
        last = np.maximum.accumulate(np.where(self.cue[form], at, -1))
        before = np.concatenate([[-1], last[:-1]])
        since = np.where(before >= np.repeat(heads, lens), np.minimum(at - before, _FAR), _FAR)
        touches = np.concatenate([[False], start[1:] == end[:-1]])
        shared = self._sums([file_features(t) for t in texts])

        def beside(d: int) -> np.ndarray:
            """Form of the token ``d`` places on in the line, or 0."""
            out = np.zeros(n, np.int64)
            if abs(d) < n:
                a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
                out[a] = np.where(line[a] == line[b], form[b], 0)
            return out

        scores = np.take(self.own, form * (_FAR + 1) + since, axis=0)
        scores += np.take(self.touch, touches * (_FAR + 1) + since, axis=0)
        scores += np.take(shared, text, axis=0)
        for d, table in self.near.items():
            scores += np.take(table, beside(d), axis=0)
        s, here = len(self.shapes), self.shape[form]
        left, right = self.shape[beside(-1)], self.shape[beside(1)]
        pair, of = np.unique(left * s + here, return_inverse=True)
        scores += np.take(self._named("l", pair // s, pair % s), of, axis=0)
        triple, which = np.unique(of * s + right, return_inverse=True)
        a, b, c = pair[triple // s] // s, pair[triple // s] % s, triple % s
        scores += np.take(self._named("w", a, b, c) + self._named("r", b, c), which, axis=0)
        return text, line, start - first[text], end - first[text], self.model.decode(scores, lens)

    def _named(self, kind: str, *shapes: np.ndarray) -> np.ndarray:
        """Label scores of pairs or triples of shapes."""
        names = [[self.shapes[i] for i in some.tolist()] for some in shapes]
        return self._sums([[f"{kind}|{'|'.join(some)}"] for some in zip(*names)])


def spans_of(texts: list[str], model: Crf | Reader) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text, both by start, then kind; the
    model reads every line."""
    base = [base_spans(t) for t in texts]
    extra: dict[int, list] = {}
    taken: dict[int, tagging.Taken] = {}
    reader = model if isinstance(model, Reader) else Reader(model)
    text, line, start, end, label = reader.read(texts)
    for a in np.flatnonzero(label == 1).tolist():
        b = a
        while b + 1 < len(label) and label[b + 1] == 2 and line[b + 1] == line[a]:
            b += 1
        i, s, e = int(text[a]), int(start[a]), int(end[b])
        if i not in taken:
            taken[i] = tagging.Taken(base[i])
        if not taken[i].meets(s, e):
            extra.setdefault(i, []).append(("secret", s, e))
    both = [sorted(b + extra[i], key=lambda v: (v[1], KINDS.index(v[0]), v[2])) if i in extra else b for i, b in enumerate(base)]
    return base, both


def find_secrets(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans
    (all spans), n_added. A null text counts as empty."""
    reader = Reader(model or train())  # every task has its own copy

    def work(texts: list[str]) -> list[list]:
        base, both = spans_of(texts, reader)
        counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS[:3]]
        sha = [hashlib.sha256(digest_spans(b).encode()).hexdigest() for b in base]
        return counts + [sha, [digest_spans(b) for b in both], [len(y) - len(x) for x, y in zip(base, both)]]

    return map_texts(docs, id_col, text_col,
                     "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long", work)
