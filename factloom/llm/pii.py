"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained from the small labelled table TRAINING and decoded by Viterbi, all sequences of a batch advancing together.
A sequence is a line or, within it, a sentence. Spans that the field finds stay only where no pattern's span is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import Block, joined, slices, table, trimmed

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match that begins within a run of digits fails as the run's first digit does, so only that is tried.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, from each @ backwards: a long run of letters without one is not tried again and again."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and ord(text[first - 1]) in _LOCAL:
            first -= 1
        m = EMAIL.match(text, first) if first < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in order: leftmost, non-overlapping within a kind, failing matches dropped without another try."""
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups())]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NO_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15] if "+" in text else []
    return [list(_emails(text)), ips, cards, phones]


#: The labelled table: [kind|span] marks a span, all else is not personal data.
TRAINING = """
Please write to [email|anna.meyer@mail.example.org] about it
contact [email|j-doe99@example.com], or not at all
Write [email|jo.smith(at)mail.example.com] today
Mail an [email|k.lang[at]example.org] bitte
send it to [email|maria at example dot com] please
contact : [email|tom at mail dot example dot org] and wait
You can reach [email|li.wei at example dot net] for the rest
courriel [email|paul.durand(at)example.fr] merci
The host [ip|10.0.12.7] was down
connect from [ip|192.168.1.254] to [ip|172.16.0.1].
server [ip|8.8.4.4], port 53 is open
paid with [card|4111111111111111] last week
card number [card|5500005555555559] was used
Karte [card|4012 8888 8888 1881] gesperrt
the card [card|3714 496353 98431] is old
carte [card|4111-1111-1111-1111] bloquée
both [card|4012888888881881] [card|5555555555554444] were used
numbers [card|6011000990139424] [card|3530111333300000] and more
call [phone|+1 (212) 555-0134] now
Tel [phone|+49 30 1234567] oder schreiben
phone : [phone|(212) 555-0134] after six
tel. [phone|212-555-0134] or later
ring [phone|(415) 555-0199] tomorrow
fax [phone|415.555.0199] today
appelez le [phone|+33 1 23 45 67 89] demain
teléfono [phone|+34 912 345 678] por favor
the gateway [ip|192.0.2.17] answers again
ping [ip|203.0.113.99] and wait
seen from [ip|198.51.100.23] at night
a call to [phone|+44 20 7123 4567] in the morning
phone : [phone|404-555-0188] at work
the number is [phone|202-555-0143] again
reach him under [email|omar at example dot com] please
ask [email|eva at post dot example dot net] for it
the meeting is at 10 on Monday
we met at noon and ate at home
look at the dot on the map
she arrived at 12.30 with 15 others
the price rose from 1299 to 1450.50 in 2019
version 2.10.3 was released on 2021-03-04
on 04/05/2020 there were 3 of them
chapter 3.2.1 and page 117
order 20210304123456 was shipped
order 1234567890123456 and 9876543210987654 failed
id 4444333322221111 is unknown
number 1234567812345678 is no card
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" is secret
key 0a1b2c3d4e5f6a7b8c9d and hash 5d41402abc4b2a76b9719d911017c592
address 300.1.2.999 is not valid and 256.300.1.1 neither
pages 100-120 and lines 5-17
score 3-2 after 90 minutes
about 1,000,000 people in 195 countries
the year 1999 and 2000 , 2001
and the of in this with that was for on are by
der die und in den von zu das mit sich des auf
le la les des et en un une que qui dans pour
el los las de que y en un por con para del
A at B dot C
Item 12 at 5 dot 3
sat at the dot
user1 and user2 at once
mail5 and example3 of them
THE OLD !! HOUSE !! AT !! HOME !!
these words### and*** others$$$ with%%% marks&&&
section (212) of the law
see (12) and (345) below
part 555-0 of 12
room 555 floor 3 house 12
a | b | c | 12 | 34
it is 5 + 7 = 12 and +3 more
grade A+ or B+ or C+
2 4 6 8 10 12 14 16
1111 2222 were numbers
""".strip().split("\n")

_MARK = re.compile(r"\[(email|ip|card|phone)\|(.*?)\](?=[\s,.]|$)")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words whose own form counts, as the field reads a word by its shape otherwise.
LEXICON = ("at", "dot", "tel", "phone", "call", "fax", "ring", "mail", "email", "contact", "card", "carte", "karte", "number", "order", "id", "token", "key", "host", "server", "version", "page", "pages", "com", "org", "net")
PUNCT = "()[]{}<>.,:;!?*#$%&|\"'="
_OUTER = re.compile(r"^[\[{<\"'*#$%&|=:;,]+|[\]}>.,:;!?*#$%&|\"'=]+$")
_SENTENCE = frozenset(b".!?")


def word_features(word: str) -> tuple[str, ...]:
    """What the field knows of a word: its form if in LEXICON, its shape if it has a digit, an @ or a +, else nothing but that it is plain."""
    low = word.lower().strip(PUNCT)
    if low in LEXICON:
        return ("lex", f"lex={low}")
    core = _OUTER.sub("", word)
    if not re.search(r"[0-9@+]|\(at\)|\[at\]", core):
        return ("plain",)
    digits = NO_DIGIT.sub("", core)
    shape = re.sub(r"[0-9]+", lambda m: f"0{min(len(m.group()), 20)}", re.sub(r"[^\W0-9_]+", "a", core))
    out = ["special", f"shape={shape}", f"form={re.sub('0[0-9]+', '0', shape)}", f"digits={min(len(digits), 20)}"]
    if re.fullmatch(EMAIL, core):
        out.append("is-email")
    if re.fullmatch(r"[A-Za-z0-9._%+-]+(?:\(at\)|\[at\])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", core):
        out.append("is-veiled-email")
    m = re.fullmatch(IP, core)
    if m:
        out.append("is-ip" if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()) else "no-ip")
    if re.fullmatch(r"[0-9-]+", core) and 13 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no-luhn")
    if re.search("[A-Za-z]", core) and digits and "@" not in core:
        out.append("mixed")
    if core.startswith("+"):
        out.append("plus")
    if re.fullmatch(r"\([0-9]+\)", core):
        out.append("in-brackets")
    return tuple(out)


class Field:
    """A trained field: emissions of a word's features, those of the words before and after it, transitions."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start
        self.seen = {f.lstrip("<>") for f in weights}
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.plain = self._row(word_features("plain"))
        self.words: dict[bytes, int] = {}

    def _row(self, features: tuple[str, ...]) -> int:
        """The row of emissions for a set of features: 3 x tags, of the word itself and as seen from the next and the one before.
        Features that training has not seen weigh nothing, so a long word's shape need not be kept."""
        features = tuple(f for f in features if f in self.seen)
        name = "\t".join(features)
        if name not in self.known:
            zero = np.zeros(len(TAGS))
            row = np.array([sum((self.weights.get(f"{side}{f}", zero) for f in features), zero) for side in ("", "<", ">")])
            self.known[name] = len(self.rows)
            self.rows.append(row)
        return self.known[name]

    def word_rows(self, words: pa.Array) -> np.ndarray:
        """The emission row of every word. Only distinct words that are not plain are looked at one by one."""
        coded = words.dictionary_encode()
        block = Block(coded.dictionary.cast(pa.large_string()))
        mark = np.zeros(256, bool)
        mark[[ord(c) for c in "0123456789@+"]] = True
        mark[[ord("("), ord("[")]] = True
        hit = np.diff(np.concatenate([[0], np.cumsum(mark[block.buf])])[block.off]) > 0
        trimmed = pc.utf8_trim(pc.utf8_lower(coded.dictionary.cast(pa.large_string())), PUNCT)
        hit |= np.asarray(pc.is_in(trimmed, pa.array(LEXICON, pa.large_string())))
        rows = np.full(len(coded.dictionary), self.plain, np.int64)
        if len(self.words) > 200_000:  # bounds the memory
            self.words, self.known, self.rows = {}, {}, []
            self.plain = self._row(word_features("plain"))
            rows[:] = self.plain
        for i in np.flatnonzero(hit).tolist():
            w = coded.dictionary[i].as_py()
            if w not in self.words:
                self.words[w] = self._row(word_features(w.decode()))
            rows[i] = self.words[w]
        return rows[np.asarray(coded.indices)]

    def emissions(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """rows: of all words; first: where sequences begin, and the end."""
        unique, back = np.unique(rows, return_inverse=True)
        own = np.array([self.rows[r] for r in unique.tolist()]).reshape(-1, 3, len(TAGS))
        out = own[back, 0]
        inner = np.ones(len(rows), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        out[at] += own[back[at - 1], 1]
        out[at - 1] += own[back[at], 2]
        return out

    def decode(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tag of every word. All sequences advance together, the longer ones go on."""
        n, k = len(rows), len(TAGS)
        if not n:
            return np.zeros(0, np.int64)
        emit = self.emissions(rows, first)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        back = np.zeros((n, k), np.int8)
        score = self.start + emit[begin]
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # sequences longer than each step
        tags = np.zeros(n, np.int64)
        last = np.zeros(len(size), np.int64)
        for step in range(1, int(size[0])):
            m = int(live[step])
            if m < len(score):
                last[m : len(score)] = score[m:].argmax(axis=1)
                score = score[:m]
            both = score[:, :, None] + self.trans
            at = begin[:m] + step
            back[at] = both.argmax(axis=1)
            score = both.max(axis=1) + emit[at]
        last[: len(score)] = score.argmax(axis=1)
        tag = last
        for step in range(int(size[0]) - 1, -1, -1):
            m = int(live[step])
            at = begin[:m] + step
            tags[at] = tag[:m]
            if step:
                tag[:m] = back[at, tag[:m]]
        return tags


def _training_rows() -> list[tuple[list[str], list[int]]]:
    """Words and tags of TRAINING, and of rows that repeat one word of LEXICON: that alone is no personal data."""
    out = [([w] * n, [0] * n) for w in LEXICON[:2] + LEXICON[-3:] for n in (3, 30)] + [(["the", w, w, "and"], [0] * 4) for w in LEXICON]
    out += [(([w] if w else []) + ["house"] * 40, [0] * (40 + bool(w))) for w in ("", "at", "dot", "contact", "mail")] + [(["house"] * 20 + ["at"] + ["house"] * 20, [0] * 41)]
    for line in TRAINING:
        words, tags, at = [], [], 0
        for m in [*_MARK.finditer(line), None]:
            plain = line[at : m.start() if m else len(line)].split()
            if plain and plain[0] in ",." and words:
                words[-1] += plain.pop(0)
            words += plain
            tags += [0] * len(plain)
            if m:
                inner = m.group(2).split()
                words += inner
                tags += [1 + 2 * KINDS.index(m.group(1)) + (i > 0) for i in range(len(inner))]
                at = m.end()
        out.append((words, tags))
    return out


@lru_cache(maxsize=1)
def trained(rounds: int = 250, rate: float = 0.1, decay: float = 0.002) -> Field:
    """Fits the field to TRAINING by Adam on the exact log-likelihood: the same weights each time."""
    data, k = _training_rows(), len(TAGS)
    names: dict[str, int] = {}
    rows = []
    for words, tags in data:
        f = [word_features(w) for w in words]
        for i in range(len(words)):
            own = [*f[i], *(f"<{x}" for x in (f[i - 1] if i else ())), *(f">{x}" for x in (f[i + 1] if i + 1 < len(words) else ()))]
            rows.append([names.setdefault(x, len(names)) for x in own])
    x = np.zeros((len(rows), len(names)))
    for i, own in enumerate(rows):
        x[i, own] += 1
    size = np.array([len(w) for w, _ in data])
    begin, tags = np.cumsum(size) - size, np.array([t for _, own in data for t in own])
    allowed = np.zeros((k, k))
    start_bias = np.zeros(k)
    for j in range(2, k, 2):  # I only after B or I of its kind
        allowed[:, j] = -1e4
        allowed[[j - 1, j], j] = 0
        start_bias[j] = -1e4
    flat = np.zeros(len(names) * k + k * k + k)
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    gold = np.zeros((len(tags), k))
    gold[np.arange(len(tags)), tags] = 1
    for t in range(1, rounds + 1):
        w, trans, start = flat[: len(names) * k].reshape(-1, k), flat[len(names) * k : -k].reshape(k, k) + allowed, flat[-k:] + start_bias
        emit = x @ w
        marginal, pair, first = np.zeros_like(gold), np.zeros((k, k)), np.zeros(k)
        gold_pair, gold_first = np.zeros((k, k)), np.zeros(k)
        for b, n in zip(begin.tolist(), size.tolist()):
            e = emit[b : b + n]
            alpha, beta = np.zeros((n, k)), np.zeros((n, k))
            alpha[0] = start + e[0]
            for i in range(1, n):
                alpha[i] = e[i] + np.logaddexp.reduce(alpha[i - 1][:, None] + trans, axis=0)
            for i in range(n - 2, -1, -1):
                beta[i] = np.logaddexp.reduce(trans + e[i + 1] + beta[i + 1], axis=1)
            z = np.logaddexp.reduce(alpha[-1])
            marginal[b : b + n] = np.exp(alpha + beta - z)
            for i in range(1, n):
                pair += np.exp(alpha[i - 1][:, None] + trans + e[i] + beta[i] - z)
                gold_pair[tags[b + i - 1], tags[b + i]] += 1
            first += marginal[b]
            gold_first[tags[b]] += 1
        g = np.concatenate([(x.T @ (gold - marginal)).ravel(), (gold_pair - pair).ravel(), gold_first - first]) - decay * len(data) * flat
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        flat = flat + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    w = flat[: len(names) * k].reshape(-1, k)
    return Field({name: w[i] for name, i in names.items()}, flat[len(names) * k : -k].reshape(k, k) + allowed, flat[-k:] + start_bias)


def field_spans(field: Field, column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text (kind, start, end) in code points of the field's spans, without the marks around a word."""
    block = Block(column)
    starts, ends, first, solid = block.words()
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(block.n)]
    if not len(starts):
        return out
    rows = field.word_rows(joined(block.buf, solid, starts, ends))
    lines = np.concatenate([[0], np.cumsum(block.buf == 10)])
    new = np.zeros(len(starts) + 1, bool)
    new[first] = True
    new[len(starts)] = True
    new[1:-1] |= lines[starts[1:]] != lines[starts[:-1]]
    new[1:-1] |= np.isin(block.buf[ends[:-1] - 1], list(_SENTENCE)) & (ends - starts > 4)[:-1]
    tags = field.decode(rows, np.flatnonzero(new))
    begin = np.flatnonzero(tags % 2 == 1)
    if not len(begin):
        return out
    char = np.cumsum((block.buf & 0xC0) != 0x80) - 1
    doc = np.searchsorted(first, begin, "right") - 1
    for b, d in zip(begin.tolist(), doc.tolist()):
        kind, e = int(tags[b]) // 2, b + 1
        while e < len(tags) and tags[e] == 2 * kind + 2:
            e += 1
        raw = bytes(block.buf[starts[b] : ends[e - 1]]).decode()
        left = len(raw) - len(raw.lstrip(" [{<\"'*#$%&|=:;,"))
        right = len(raw.rstrip(" ]}>.,:;!?*#$%&|\"'="))
        if right > left:
            at = int(char[starts[b]] - (char[block.off[d]]))
            out[d].append((kind, at + left, at + right))
    return out


def all_spans(field: Field, column: pa.Array) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """For each text the patterns' spans of each kind, and those with the field's added where they touch no pattern's span."""
    out = []
    for text, more in zip(column.to_pylist(), field_spans(field, column)):
        base = base_spans(text) if text else [[], [], [], []]
        every = [list(x) for x in base]
        if more:
            taken = [s for own in base for s in own]
            for kind, a, b in more:
                if not any(a < y and x < b for x, y in taken):
                    every[kind].append((a, b))
            every = [sorted(own) for own in every]
        out.append((base, every))
    return out


def listed(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans) for a, b in own)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: `id, n_email, n_ip, n_card, n_phone` (patterns' spans), `base`, `spans` (all, as `listed`).

    A map over the scan: whole texts, nothing shuffled; the field is trained on the driver from TRAINING. Null and empty texts
    have none. Repeated ids each get a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(trained())  # some hundred features
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = all_spans(held.value, part.column(1))
                counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(e) for _, e in found], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return source.mapInArrow(trimmed(run), f"id {source.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the one that begins first, then the longest."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, own in zip(KINDS, spans) for a, b in own), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced by its kind, and chars_col, if docs has it, the new length where the text
    changed. Null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                i = names.index(text_col)
                texts, arrays = part.column(i).to_pylist(), list(part.columns)
                found = all_spans(held.value, part.column(i))
                new = [redact(t, every) if t and any(every) else t for t, (_, every) in zip(texts, found)]
                arrays[i] = pa.array(new, arrays[i].type)
                if chars_col in names:
                    j = names.index(chars_col)
                    arrays[j] = pa.array([n if a is b else len(b) for n, a, b in zip(arrays[j].to_pylist(), texts, new)], arrays[j].type)
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op8_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
