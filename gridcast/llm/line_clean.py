"""Quality rules, line first: every line is judged by its punctuation, as
navigation and as boilerplate; failing lines go, and a document that loses
too much of its text that way is rejected.

The base statistics (characters in words, symbols, repeated lines, words in
repeated three-word windows) are exact counts over the whole text.

Defined results: a null or empty text has no words, so it fails the base rule;
a text without line breaks is one line; repeated rows give equal results;
``filter_documents`` keeps the columns and the texts as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridcast.llm.texts import map_texts, rewrite_texts

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode(), "。".encode())


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the document's loss."""

    min_words: int = 50
    repeat_pct: int = 50
    #: symbols (and !!, ??) per word from which a line fails
    symbols_per_word: float = 0.3
    #: share of words without a letter or digit from which a line is navigation
    sign_words: float = 0.25
    #: short unpunctuated lines (at most this many words) are navigation
    nav_words: int = 2
    #: share of upper-case words from which a line of five words or more fails
    upper_words: float = 0.7
    #: a line of so many words, or fewer, is boilerplate by one phrase; each
    #: such number of words more takes one phrase more
    words_per_phrase: int = 40
    #: share of word characters lost from which a document is rejected
    max_loss: float = 0.4


#: fixed values: phrases of boilerplate lines in four languages, lower case
PHRASES = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
           "terms of service", "enable javascript", "javascript is disabled", "click here to", "sign up for our",
           "subscribe to our", "share this", "read more", "log in to", "lorem ipsum",
           "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen",
           "hier klicken", "newsletter abonnieren", "weiterlesen", "jetzt anmelden",
           "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation",
           "cliquez ici", "lire la suite", "abonnez-vous",
           "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso",
           "haga clic aquí", "leer más", "suscríbase")
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> str:
    """The first rule that the line fails, or an empty string."""
    n = len(words)
    signs = n_of(line, _SYMBOLS) + 2 * (line.count(b"!!") + line.count(b"??"))
    if signs > rules.symbols_per_word * n:
        bare = sum(not any(c > 47 for c in w) or w == b"|" for w in words) if b"|" in line or signs >= n else 0
        return "navigation" if bare > rules.sign_words * n else "punctuation"
    if n >= 5 and sum(w.isupper() for w in words) > rules.upper_words * n:
        return "punctuation"
    if n <= rules.nav_words and not line.rstrip().endswith(_END):
        return "navigation"
    found = _PHRASE.findall(line.lower())
    if found and len(set(found)) * rules.words_per_phrase >= n:
        return "boilerplate"
    return ""


def n_of(raw: bytes, signs: bytes) -> int:
    return len(raw) - len(raw.translate(None, signs))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


@dataclass
class Report:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_failed: dict[str, int]
    lost_chars: int
    clean: bytes | None


def judge(text: str, rules: Rules = Rules(), want_text: bool = False) -> Report:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(raw.translate(None, _SPACE + _CONTINUATION))
    repeats = repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.repeat_pct * n
    dups, seen, lost, why, stay = 0, set(), 0, Counter(), []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            stay.append(line)
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        if rule := line_fails(line, own, rules):
            why[rule] += 1
            lost += len(line.translate(None, _SPACE + _CONTINUATION))
        else:
            stay.append(line)
    kept = not failed and lost <= rules.max_loss * chars
    return Report(n, chars, n_of(raw, _SYMBOLS), dups, repeats, failed, kept, why, lost,
                  b"\n".join(stay) if want_text else None)


def clean_lines(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                with_text: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lines that failed by rule, characters lost (in words)
    and, on request, the text without the failing lines."""

    def work(texts: list[str]) -> list[list]:
        all_ = [judge(t, rules, with_text) for t in texts]
        out = [[getattr(r, k) for r in all_] for k in
               ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
        out += [[r.n_failed[k] for r in all_] for k in ("punctuation", "navigation", "boilerplate")]
        out.append([r.lost_chars for r in all_])
        return out + ([[r.clean.decode("utf-8", "surrogatepass") for r in all_]] if with_text else [])

    return map_texts(docs, id_col, text_col,
                     "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, kept boolean, bad_punctuation long, bad_navigation long, "
                     "bad_boilerplate long, lost_chars long" + (", clean_text string" if with_text else ""), work)


def filter_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept."""
    return rewrite_texts(docs, text_col, lambda texts: (None, [judge(t or "", rules).kept for t in texts]))
