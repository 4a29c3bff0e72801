"""Languages of documents and of their sentences, by mixture inference (problem 8).

Each document is a mixture of languages in unknown proportions. Its prose is cut into sentences; n-gram
models give each sentence's likelihood in each language; expectation-maximisation estimates the document's
proportions; and languages leave the mixture as long as the likelihood lost is less than the penalty for
keeping one. One component of the mixture stands for every language without samples: its likelihood is that
of the best language's single characters, raised to where the sentences of known languages stay above it.
All documents of a batch are estimated together as arrays.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 8  # of a full sentence
ORDERS = (2, 3, 4)  # characters of the n-grams
TABLE_BITS = 18  # n-grams are hashed to 2^18 rows; a model is at most 2^18 x 3 x languages x 4 bytes
SMOOTHING = 0.3  # n-grams that an unseen one counts as, in a language of median size
PENALTY = 8.0  # nats that a language must add to a document's likelihood, besides half the logarithm of its length
SAMPLE_DOCS = 4_000  # labelled documents that the models may be fitted to, besides the clean samples
SAMPLE_CHARS = 10_000  # only documents up to this length are taken into that sample
SURE = 0.999  # posterior from which a sentence of that sample is fitted to
MAX_SAMPLES = 100_000  # clean samples; they are read by the driver
UNKNOWN = "und"  # the language of sentences in none of the languages that have samples
MARGIN = 0.12  # share of a language's median gain over its single characters that a sentence in it must have (or the gain of 99 in 100, if less)
CHARACTERS = 1 << 16  # code points that single-character models tell apart; those above are one
TEMPERATURES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.3)  # tried for the confidence
BATCH_CHARS = 1_000_000  # characters of text estimated together

# Language labels. Codes of two and three letters, and English names.
LABELS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "ru": ("ru", "rus", "russian"),
}

_FENCE = re.compile(r"^\s*(```|~~~)")
_COMMENT = re.compile(r"^\s*(?:--+|//|/\*+|\*(?!\S*\*))(.*)")
_TAIL_COMMENT = re.compile(r"(?:^|\s)(?:--\s|/\*)(.*)")
_SQL = re.compile(
    r"^\s*(?:SELECT\s.*|WITH\s+\w+\s+AS\s*\(|INSERT\s+INTO\s|UPDATE\s+[\w.\"`]+\s*(?:SET\b|$)|DELETE\s+FROM\s|MERGE\s+INTO\s|TRUNCATE\s+TABLE\s"
    r"|(?:CREATE|ALTER|DROP|RENAME)\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+|GLOBAL\s+|TEMPORARY\s+|MATERIALIZED\s+)*"
    r"(?:TABLE|INDEX|VIEW|SEQUENCE|TRIGGER|PROCEDURE|FUNCTION|PACKAGE|SYNONYM|COLUMN|CONSTRAINT|SCHEMA|USER)\s"
    r"|COMMENT\s+ON\s+(?:TABLE|COLUMN)\s|GRANT\s+\w+|REVOKE\s+\w+|COMMIT\s*;|BEGIN\s*$|END\s*;)",
    re.I,
)
_TITLE = re.compile(r"^\s*#")
_MARKER = re.compile(r"^\s*(?:>+\s*)?(?:[-*•+]\s+|\(?\d{1,3}[.)]\s+)?")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]*]*$")
_SPLIT = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]*]*\s+(?=\S)")
_ASIDE = re.compile(r"\([^()\n]*\)|\"[^\"\n]*\"|«[^«»\n]*»|„[^„“”\n]*[“”]|“[^“”\n]*”")
_BACKTICKED = re.compile(r"`[^`\n]*`")
_IDENTIFIER = re.compile(r"[\d_`]|\w\.\w")  # anywhere in a token
_NOT_LETTERS = re.compile(r"[^\w'’ ]+|[\d_]+")
_BLANKS = {c: " " for c in range(128) if not chr(c).isalpha() and chr(c) != "'"}
_WORDY = re.compile(r"\w")
_CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿа-џ]{2}")  # two letters that may be capitals


@dataclass(slots=True)
class Sentence:
    start: int
    stop: int
    text: str
    words: int
    full: bool


def stated(label: Column, others: Iterable[str] = ()) -> Column:
    """The language code that a label states, or null: codes with or without region, or English names, in any case.

    `others` are codes of further languages, which state themselves.
    """
    base = F.regexp_extract(F.lower(F.btrim(label, F.lit(" \t\r\n"))), "^([a-z]{2,3}|[a-z]{4,})(?:[-_](?:[a-z]{2}|[0-9]{3}|[a-z]{4}|[a-z]{4}[-_][a-z]{2}))?$", 1)
    known = F.create_map(*(F.lit(x) for code, names in (LABELS | {x: (x,) for x in others if x not in LABELS}).items() for n in names for x in (n, code)))
    return F.try_element_at(known, base)


def _stretches(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of prose as the spans of their lines: paragraphs and comments, without SQL, code and titles."""
    out: list[list[tuple[int, int]]] = []
    fenced = sql = False
    open_kind = None

    def add(kind: str, lo: int, hi: int) -> None:
        nonlocal open_kind
        lead = _MARKER.match(text, lo, hi)
        marked = lead is not None and bool(lead.group().strip(" \t>"))
        lo = lead.end() if lead else lo
        body = text[lo:hi].rstrip()
        if kind == "comment":
            body = body.removesuffix("*/").rstrip()
        hi = lo + len(body)
        if hi <= lo:
            return
        if open_kind == kind and not marked and not _ENDS.search(text, out[-1][-1][0], out[-1][-1][1]):
            out[-1].append((lo, hi))  # a line that goes on in the next
        else:
            out.append([(lo, hi)])
        open_kind = kind

    at = 0
    for line in text.splitlines(keepends=True):
        lo, hi = at, at + len(line)
        at = hi
        if not line.strip():
            sql, open_kind = False, None
            continue
        if _FENCE.match(line):
            fenced, sql, open_kind = not fenced, False, None
            continue
        comment = _COMMENT.match(line)
        if comment and not _TITLE.match(line):
            add("comment", lo + comment.start(1), lo + comment.end(1))
            continue
        if not sql and (fenced or _SQL.match(line)):
            sql = True
        if sql:
            tail = _TAIL_COMMENT.search(line)
            body = line[: tail.start()] if tail else line
            if tail:
                open_kind = None
                add("comment", lo + tail.start(1), lo + tail.end(1))
            end = body.rfind(";")
            if end >= 0:
                sql = False
                open_kind = None
                if body[end + 1 :].strip() and not fenced:
                    add("prose", lo + end + 1, hi)
            continue
        if _TITLE.match(line):
            open_kind = None
            continue
        add("prose", lo, hi)
    return out


def _with_asides(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    """A sentence without what it quotes or puts in brackets, and each of these by itself."""
    raw = text[lo:hi]
    if not raw.strip():
        return
    asides = list(_ASIDE.finditer(raw))
    if not asides:
        yield lo, hi, raw
        return
    rest = _ASIDE.sub(" ", raw)
    if rest.strip():
        yield lo, hi, rest
    for m in asides:
        yield lo + m.start(), lo + m.end(), m.group()


@lru_cache(maxsize=1)
def _format_characters() -> re.Pattern:
    codes = [c for c in (*range(0x20000), *range(0xE0000, 0xE0100)) if unicodedata.category(chr(c)) == "Cf"]  # the planes that have any
    starts = [c for c in codes if c - 1 not in codes]
    stops = [c for c in codes if c + 1 not in codes]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, stops, strict=True)) + "]")


def _is_plain(text: str) -> bool:
    """Whether a text is in compatible form already, without format characters."""
    return text.isascii() or (unicodedata.is_normalized("NFKC", text) and not _format_characters().search(text))


def _plain(raw: str, clean: bool = False) -> tuple[str, int]:
    """The words of a sentence that tell its language, and the number of all its words.

    Identifiers go; the rest is in lower case, compatible forms made one unless the text is `clean` of others.
    """
    if not clean and not raw.isascii():
        raw = _format_characters().sub("", unicodedata.normalize("NFKC", raw))
    kept = (_BACKTICKED.sub(" x_ ", raw) if "`" in raw else raw).split()
    odd = [t for t in kept if not t.isalpha()]
    n = len(kept) - sum(1 for t in odd if not t[0].isalpha() and not _WORDY.search(t))
    names = {t for t in odd if _IDENTIFIER.search(t)}
    if names:
        kept = [t for t in kept if t not in names]
    if _CAPITALS.search(raw):
        if not " ".join(kept).isupper():  # then what is in capitals is a name
            kept = [t for t in kept if len(t) < 2 or not t.isupper()]
    plain = " ".join(kept).lower()
    return " ".join((plain.translate(_BLANKS) if plain.isascii() else _NOT_LETTERS.sub(" ", plain)).split()), n


def sentences(text: str | None, min_words: int = MIN_WORDS, places: bool = True) -> list[Sentence]:
    """The sentences and shorter phrases of a text's prose, with what tells their language: lower case, no identifiers.

    Without `places`, where each starts and stops is left at 0.
    """
    out: list[Sentence] = []
    clean = _is_plain(text or "")
    for spans in _stretches(text or ""):
        joined = " ".join(text[a:b] for a, b in spans)
        starts, pos = [], 0
        for a, b in spans if places else ():
            starts.append((pos, a))
            pos += b - a + 1

        def place(i: int, starts=starts) -> int:
            at, own = starts[bisect_right(starts, (i, len(text))) - 1]
            return own + i - at

        cuts = [0, *(m.end() for m in _SPLIT.finditer(joined)), len(joined)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for lo, hi, raw in _with_asides(joined, a, b):
                plain, n = _plain(raw, clean)
                if plain:
                    full = n >= min_words and plain.count(" ") >= min_words // 2 and _ENDS.search(raw.rstrip()) is not None
                    out.append(Sentence(place(lo) if places else 0, place(hi - 1) + 1 if places else 0, f" {plain} ", n, full))
    return out


def _parts(lengths: list[int]) -> Iterator[slice]:
    """Stretches of texts of about BATCH_CHARS characters."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the length of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def _features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, the hashed n-grams of all texts and the number of the text each is from."""
    codes, lengths = _codes(texts)
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    rows, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for order in range(1, max(ORDERS) + 1):  # the hash of an n-gram goes on from that of one character less
            n = max(len(codes) - order + 1, 0)
            h = (h[:n] ^ codes[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            if order in ORDERS:
                inside = owner[:n] == owner[order - 1 :]
                rows.append((h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)[inside])
                owners.append(owner[:n][inside])
    return rows, owners


@dataclass
class Model:
    """Log-probabilities of hashed n-grams, by order, and of single characters in each language.

    `floor` is what a sentence of each language gains at least, by character, over its single characters; a
    sentence in none of the languages gains less. `temperature` turns likelihoods, whose n-grams overlap, into
    odds: with it, words cut out of held-out sentences are as sure as they are right.
    """

    langs: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    characters: np.ndarray | None = None
    floor: np.ndarray | None = None
    temperature: float = 1.0

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """The log-likelihood of each text in each language, averaged over the orders."""
        out = np.zeros((len(texts), len(self.langs)))
        for (rows, owner), table in zip(zip(*_features(texts), strict=True), self.tables, strict=True):
            if len(rows):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                out[owner[starts]] += np.add.reduceat(table[rows], starts, axis=0)
        return out / len(self.tables)

    def single(self, texts: list[str], best: np.ndarray) -> np.ndarray:
        """The log-likelihood of each text by single characters of its best language, with as many characters as the n-grams have."""
        codes, lengths = _codes(texts)
        own = self.characters.ravel()[np.repeat(best * CHARACTERS, lengths) + np.minimum(codes, CHARACTERS - 1)]
        return np.add.reduceat(own, np.cumsum(lengths) - lengths) * np.mean(ORDERS)

    def with_unknown(self, texts: list[str], ll: np.ndarray) -> np.ndarray:
        """The likelihoods and, as the last column, that of no known language."""
        best = ll.argmax(axis=1)
        unknown = self.single(texts, best) + self.floor[best] * np.fromiter(map(len, texts), dtype=float, count=len(texts))
        return np.column_stack([ll, unknown])

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Model:
        """A model that `save` wrote; as it is a pickle, read only what you wrote."""
        with open(path, "rb") as f:
            return pickle.load(f)


def train(texts: list[str], langs: list[str]) -> Model:
    """n-gram models of the languages from sentences (as `sentences` makes them) and their languages."""
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs])
    counts = [np.zeros((1 << TABLE_BITS, len(names))) for _ in ORDERS]
    single = np.zeros((len(names), CHARACTERS))
    for own in _parts([len(t) for t in texts]):
        for table, rows, owner in zip(counts, *_features(texts[own]), strict=True):
            table += np.bincount(rows * len(names) + lang[own][owner], minlength=table.size).reshape(table.shape)
        codes, lengths = _codes(texts[own])
        single += np.bincount(np.repeat(lang[own] * CHARACTERS, lengths) + np.minimum(codes, CHARACTERS - 1), minlength=single.size).reshape(single.shape)
    tables, others, unseen = [], [], []
    for table in counts:
        kinds = max(1, int((table.sum(axis=1) > 0).sum()))
        total = np.maximum(table.sum(axis=0), 1)
        # An unseen n-gram is as likely in each language, however many sentences that has.
        rest = SMOOTHING / np.median(total)
        whole = 1 + rest * 2 * kinds
        tables.append(np.log((table / total + rest) / whole).astype(np.float32))
        others.append(np.log((np.maximum(table - 1, 0) / total + rest) / whole).astype(np.float32))
        unseen.append(np.full(len(names), np.log(rest / whole)))
    # A character that a language does not have costs no more than an n-gram that it does not have.
    least = np.mean(unseen, axis=0) / np.mean(ORDERS)
    with np.errstate(divide="ignore"):
        characters = np.maximum(np.log(single / np.maximum(single.sum(axis=1, keepdims=True), 1)), least[:, None])
    # What each sentence gains over its single characters by what the others say: its own n-grams count once less.
    without = Model(names, others, characters.astype(np.float32))
    gain = np.empty(len(texts))
    for own in _parts([len(t) for t in texts]):
        ll = without.likelihoods(texts[own])[np.arange(len(texts[own])), lang[own]]
        gain[own] = (ll - without.single(texts[own], lang[own])) / np.fromiter(map(len, texts[own]), dtype=float, count=len(texts[own]))
    floor = [min(MARGIN * np.median(gain[lang == j]), np.quantile(gain[lang == j], 0.01)) for j in range(len(names))]
    return Model(names, tables, without.characters, np.array(floor))


def mixture(ll: np.ndarray, doc: np.ndarray, n_docs: int, sizes: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages of each document, and posteriors of each sentence.

    `ll` are sentences' log-likelihoods, `doc` the ascending numbers of their documents, `sizes` the
    documents' characters. A language stays in a document while leaving it out would cost more likelihood
    than the penalty.
    """
    k = ll.shape[1]
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -700.0))
    support = np.ones((n_docs, k), dtype=bool)
    pi = np.full((n_docs, k), 1.0 / k)

    def estimate(pi: np.ndarray, rounds: int, own: np.ndarray, docs: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.diff(docs, prepend=-1))
        which = docs[starts]
        for _ in range(rounds):
            joint = own * pi[docs]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            new = np.add.reduceat(joint, starts, axis=0)
            pi[which] = new / new.sum(axis=1, keepdims=True)
        return pi

    if len(doc):
        pi = estimate(pi, 12, like, doc)
        # One sentence of a language is a share of 1 / sentences; whether it stays is for the likelihood to say.
        pi[pi < np.minimum(1e-5, 0.01 / np.maximum(np.bincount(doc, minlength=n_docs), 1))[:, None]] = 0.0
        support = pi > 0
        cost = penalty + 0.5 * np.log1p(sizes)
        for _ in range(k - 1):
            open_docs = support.sum(axis=1) > 1
            mine = open_docs[doc]
            if not mine.any():
                break
            d, own = doc[mine], like[mine]
            starts = np.flatnonzero(np.diff(d, prepend=-1))
            which = d[starts]
            joint = own * pi[d]
            total = joint.sum(axis=1)
            losses = np.full((n_docs, k), np.inf)
            for j in range(k):
                rest = (total - joint[:, j]) / np.maximum(1.0 - pi[d, j], 1e-12)
                loss = np.add.reduceat(np.log(np.maximum(total, 1e-300)) - np.log(np.maximum(rest, 1e-300)), starts)
                losses[which, j] = np.where(support[which, j], loss, np.inf)
            weakest = losses.argmin(axis=1)
            leave = open_docs & (losses[np.arange(n_docs), weakest] < cost)
            if not leave.any():
                break
            support[leave, weakest[leave]] = False
            pi[~support] = 0.0
            pi /= np.maximum(pi.sum(axis=1, keepdims=True), 1e-300)
            again = leave[doc]
            pi = estimate(pi, 6, like[again], doc[again])
    joint = like * pi[doc]
    return pi, joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)


def certainty(ll: np.ndarray, doc: np.ndarray, pi: np.ndarray, best: np.ndarray, temperature: float) -> np.ndarray:
    """The confidence of each sentence in its language `best`: its tempered posterior among all languages.

    The proportions of a document count as its sentences say, and one sentence more of any language: what the
    penalty took out of a mixture can still be right.
    """
    n = np.bincount(doc, minlength=len(pi))[:, None]
    prior = (pi * n + 1.0 / ll.shape[1]) / (n + 1)
    joint = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -700.0) * temperature) * prior[doc]
    return joint[np.arange(len(doc)), best] / joint.sum(axis=1)


def _cut(texts: list, min_words: int, places: bool = False) -> tuple[list[Sentence], np.ndarray]:
    """Sentences of the texts and the number of each one's text."""
    found, doc = [], []
    for i, t in enumerate(texts):
        own = sentences(t, min_words, places)
        found += own
        doc += [i] * len(own)
    return found, np.array(doc, dtype=np.int64)


def _estimate(model: Model, found: list[Sentence], doc: np.ndarray, n_docs: int):
    """Proportions of the texts, posteriors of their sentences and the likelihoods, over the model's languages and none of them."""
    at: dict[str, int] = {}
    which = np.array([at.setdefault(s.text, len(at)) for s in found], dtype=np.int64)  # a repeated sentence is looked at once
    plain = list(at)
    ll = model.with_unknown(plain, model.likelihoods(plain))[which] if plain else np.zeros((0, len(model.langs) + 1))
    sizes = np.bincount(doc, weights=[len(s.text) for s in found], minlength=n_docs) if plain else np.zeros(n_docs)
    return *mixture(ll, doc, n_docs, sizes), ll


def _temperature(model: Model, texts: list[str], langs: list[str]) -> float:
    """The temperature at which words cut out of sentences that the model was not fitted to have the right odds."""
    cuts, lang = [], []
    for i, (text, own) in enumerate(zip(texts, langs, strict=True)):
        if own in model.langs and (w := text.split()):
            n = 1 + i % 3  # words that a phrase has; few, for long ones are never in doubt
            k = i % max(1, len(w) - n + 1)
            cuts.append(f" {' '.join(w[k : k + n])} ")
            lang.append(model.langs.index(own))
    if not cuts:
        return 1.0
    ll, lang = model.likelihoods(cuts), np.array(lang)
    ll -= ll.max(axis=1, keepdims=True)

    def loss(t: float) -> float:
        odds = t * ll
        return float((np.log(np.exp(odds).sum(axis=1)) - odds[np.arange(len(lang)), lang]).mean())

    return min(TEMPERATURES, key=loss)


def fit(samples: DataFrame, docs: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, min_words: int = MIN_WORDS) -> Model:
    """Models from clean samples (lang, text), then from them and a bounded sample of labelled documents.

    The languages are those of the samples: what their labels state, else the label itself, trimmed and in lower
    case. The documents are those of the `sample_docs` least hashes among documents of at most `SAMPLE_CHARS`
    characters that state one of these languages. Of them, sentences are taken that the first models are sure of
    and whose language is the one stated, so a wrong label or a mixed document adds nothing false. The temperature
    of the confidence is taken from the sentences of every fifth document, with models that lack them.
    """
    own = F.nullif(F.lower(F.btrim(F.col("lang"), F.lit(" \t\r\n"))), F.lit(""))
    rows = samples.where("text IS NOT NULL").select(F.coalesce(stated(F.col("lang")), own).alias("lang"), "text").where("lang IS NOT NULL").limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    clean = [(s.text, r.lang) for r in rows for s in sentences(r.text, min_words)]
    if not clean:
        raise ValueError("no samples of any language")
    texts, langs = [t for t, _ in clean], [x for _, x in clean]
    model = train(texts, langs)
    if docs is None or sample_docs < 1:
        return model
    usable = docs.select("doc_id", "text", stated(F.col("lang"), model.langs).alias("lang")).where((F.col("lang").isNotNull()) & (F.length("text") <= SAMPLE_CHARS))
    chosen = usable.orderBy(F.xxhash64("doc_id", "text"), "doc_id").select("text", "lang").limit(sample_docs).collect()
    parts = []
    for part in _parts([len(r.text) for r in chosen]):
        own = chosen[part]
        parts.append((part.start, [r.lang for r in own], *_cut([r.text for r in own], min_words)))
    for last in (False, True):
        more: list[tuple[str, str, int]] = []
        for start, stated_langs, found, doc in parts:
            _, post, _ = _estimate(model, found, doc, len(stated_langs))
            best = post.argmax(axis=1)
            for s, d, b, p in zip(found, doc, best, post, strict=True):
                if s.full and p[b] >= SURE and b < len(model.langs) and stated_langs[d] == model.langs[b]:
                    more.append((s.text, model.langs[b], start + d))
        if not last:
            kept = [m for m in more if m[2] % 5]
            model = train(texts + [m[0] for m in kept], langs + [m[1] for m in kept])
            held = [m for m in more if not m[2] % 5]
            temperature = _temperature(model, [m[0] for m in held], [m[1] for m in held])
    model = train(texts + [m[0] for m in more], langs + [m[1] for m in more])
    model.temperature = temperature
    return model


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for own in _parts(part["text"].str.len().fillna(0).astype(int).tolist()):
            yield part.iloc[own]


def detect(docs: DataFrame, model: Model, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: `doc_id`, `stated`, `lang`, `confidence`, `shares` and `segments`.

    `stated` is the language that the document's `lang` states, null without such a column.

    `lang` is the language of the greatest share and `confidence` that share times the mean certainty of its
    sentences; both are null where there is no prose (null or empty texts, code only). Prose in none of the
    model's languages is in "und". `shares` are the languages of the mixture. `segments` are all sentences and phrases of the prose with place, language,
    confidence and whether they are a full sentence of `min_words` words or more. Repeated rows give
    repeated rows; other columns than doc_id, text and lang are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the table, not by the data

    def estimate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        langs = np.array([*model.langs, UNKNOWN], dtype=object)
        for part in _batches(parts):
            found, doc = _cut(part["text"].tolist(), min_words, places=True)
            pi, post, ll = _estimate(model, found, doc, len(part))
            best = post.argmax(axis=1)
            sure = certainty(ll, doc, pi, best, model.temperature)
            segments: list[list] = [[] for _ in range(len(part))]
            total = np.zeros(len(part))
            number = np.zeros(len(part))
            main = pi.argmax(axis=1)
            for s, d, b, p in zip(found, doc.tolist(), best.tolist(), sure.tolist(), strict=True):
                segments[d].append({"start": s.start, "stop": s.stop, "lang": langs[b], "confidence": p, "words": s.words, "full": s.full})
                if b == main[d]:
                    total[d] += p
                    number[d] += 1
            some = np.array([bool(s) for s in segments])
            share = pi[np.arange(len(part)), main]
            confidence = share * total / np.maximum(number, 1)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(),
                "stated": part["stated"].to_numpy(),
                "lang": np.where(some, langs[main], None),
                "confidence": np.where(some, confidence, np.nan),
                "shares": [
                    [{"lang": langs[j], "share": float(pi[i, j])} for j in np.argsort(-pi[i]) if pi[i, j] > 0] if some[i] else []
                    for i in range(len(part))
                ],
                "segments": segments,
            })

    schema = (
        "doc_id long, stated string, lang string, confidence double, shares array<struct<lang:string,share:double>>,"
        " segments array<struct<start:int,stop:int,lang:string,confidence:double,words:int,full:boolean>>"
    )
    label = stated(F.col("lang"), model.langs) if "lang" in docs.columns else F.lit(None).cast("string")
    out = docs.select("doc_id", "text", label.alias("stated")).mapInPandas(estimate, schema)
    return out.withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))


def unstated(docs: DataFrame, model: Model, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lang, sentences, confidence): known languages of full sentences of a document that its label does not state.

    `sentences` counts them and `confidence` is that of the surest. The label goes through the estimate with its
    text, so no text is shuffled, and only what is found comes back from it. Null doc_ids are ids like any other; repeated
    rows count once, and of different rows with one doc_id each is held against its own label.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def estimate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        place = {x: i for i, x in enumerate(model.langs)}
        for part in _batches(parts):
            found, doc = _cut(part["text"].tolist(), min_words)
            pi, post, ll = _estimate(model, found, doc, len(part))
            best = post.argmax(axis=1)
            said = np.array([place.get(x, -1) for x in part["stated"]], dtype=np.int64)
            wanted = np.fromiter((s.full for s in found), dtype=bool, count=len(found)) & (best != said[doc]) & (best < len(model.langs))
            if not wanted.any():
                continue
            sure = certainty(ll, doc, pi, best, model.temperature)
            by = pd.DataFrame({"doc": doc[wanted], "lang": best[wanted], "sure": sure[wanted]}).groupby(["doc", "lang"])["sure"].agg(["size", "max"]).reset_index()
            row = by["doc"].to_numpy()
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy()[row], "h": part["h"].to_numpy()[row], "lang": np.array(model.langs, dtype=object)[by["lang"].to_numpy()],
                "sentences": by["size"].to_numpy(), "confidence": by["max"].to_numpy(),
            })

    label = stated(F.col("lang"), model.langs) if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", label.alias("stated"), F.xxhash64("text").alias("h")).mapInPandas(estimate, "doc_id long, h long, lang string, sentences long, confidence double")
    by = rows.groupBy("doc_id", "lang", "h").agg(F.max("sentences").alias("sentences"), F.max("confidence").alias("confidence"))
    return by.groupBy("doc_id", "lang").agg(F.sum("sentences").alias("sentences"), F.max("confidence").alias("confidence"))
