"""Personal data: base patterns, and a linear-chain conditional random field for what they miss.

Words are runs of other than white space. A word is seen by its shape (letters,
digits and marks, runs drawn together), how many digits, dots and marks it has
and, where the labelled lines have it, by itself; the two words on either side
count too. The field is trained on a small table of labelled lines in the form
``Call {phone|(030) 555 01 99} today``, by gradient steps on the log-likelihood
from forward and backward sums. Texts are decoded by Viterbi, many at a time:
where no run of labels around a word could gain over "outside", by a bound on
every step, it is outside for certain, so only the short runs between such
words are decoded, and the result is that of the whole text.

Of what the field finds, a span stays if it could be of its kind (digits in
number, check digits, parts of an address) and has no character in common with
a span of the base patterns, which always stay.

Defined results for odd input
    Null and empty texts have no spans. Repeated rows each give their row; a
    null doc_id is kept. Of added spans that overlap the first stays. Very
    long texts are read whole and in linear time. Without labelled lines the
    field finds nothing. An empty table gives no rows; other columns are not
    read, so their names don't matter.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import WORD, read

#: The kinds of the base patterns in the order in which ties stand; then those that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "name")
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words decoded at once; a text is never cut.
BATCH_WORDS = 200_000
#: Different words whose weights a task remembers.
REMEMBERED = 200_000

#: The labelled lines; all persons, numbers and addresses are invented.
LABELLED = """
Write to {email|ann.lee (at) mail.example.org} before noon
mail me at {email|jonas [at] post.example.de} please
reach her: {email|mara at example dot com} or by post
Contact {email|info [at] shop [dot] example [dot] net} for prices
his address is {email|p.moreau(at)courrier.example.fr} since May
schreib an {email|k.huber (at) beispiel (dot) de} bis Montag
escribe a {email|luis.gil [at] correo [dot] example [dot] es} hoy
send it to {email|sales at widgets dot example dot com}, thanks
{email|dev [at] example.org} answers within a day
old mail {email|tom_77 [at] mail3.example.com} is closed
ping {email|r.diaz AT example DOT net} about it
mail {email|office at firm dot example dot com} first
then write {email|joe at home dot example dot net} again
give {email|m.ott (at) verein (dot) de} a try
or {email|c.weiss (at) praxis (dot) example (dot) ch} instead
We met at noon at the dot of the hour and went home
He was at work [at] times, and the dot com boom was over
the cat sat at the door. Dot by dot it came at us
Look at example two and at the end of it
Call {phone|(706) 555-3138} today
phone: {phone|706-555-0199} or later
Tel. {phone|030 555 01 99} ab neun
call {phone|555-0142-77} at home
tél. {phone|01 55 55 01 42} le matin
fax {phone|(0)89/555-0177} nur werktags
my cell is {phone|415.555.0123} now
or ring {phone|(212) 555 0187}, she said
Telefon {phone|0171 5550142} abends
teléfono {phone|915 550 143} por la tarde
mobile {phone|07700 900123} any time
dial {phone|1-800-555-0199} for help
whatsapp {phone|0049 30 5550199} works
contact number {phone|00 33 1 55 55 01 42} in Paris
room 555 on floor 12 of 30 is free
the score was 21-14 and then 35-28 at the end
page 212, lines 30-45, see also 706-708
open 9-17, closed 12-13 on Sundays
it cost 1,200.50 or 1.200,50 in all
in 1999-2003 and again in 2010-2014
version 4.0 and 4.1.2 came out
Licensed under CC BY-NC 4.0.
Licensed under the Apache License, Version 2.0.
on 2024-05-17 at 12:30:05 it rained
am 17.05.2024 um 12:30 Uhr
le 17/05/2024 à 12h30 environ
order 20240517 has 3 items of 15 kg
build 415.555 failed after 212 steps
add 250 g of flour, 2 eggs and 30 ml of milk
lot 0142 of 7700 and part 900123 are gone
Card {card|4111.1111.1111.1111} was used
card no. {card|4000_0000_0000_0002} expired
pay with {card|5500/0000/0000/0004} online
Karte {card|4012.8888.8888.1881} gesperrt
tarjeta {card|3782.822463.10005} nueva
carte {card|6011.0009.9013.9424} volée
the 0595765450607129 items of batch 4952935900253052 are here
number 9807915762804490 and 233254104120 are measured
token = "473a0a5afa59a0df9c0d8d3cd5867fe70" was set
key 65f8700754a1d8161928a1d0cca87ca77d009e4f is old
host {ip|10[.]20[.]30[.]40} is down
from {ip|192(.)168(.)7(.)21} again
server {ip|2001:db8:85a3:0:0:8a2e:370:7334} answered
adresse {ip|fe80:0:0:0:204:61ff:fe9d:f156} inconnue
log in from {ip|2001:db8::ff00:42:8329} at night
ip {ip|172[.]16[.]254[.]1} blocked
at 10:20:30 and 11:45 the train left
ratio 16:9 or 4:3, verse 3:16
see a::b and std::vector in the text
SSN {id|078-05-1120} on file
her social security number is {id|219-09-9999} she said
social {id|457-55-5462} was leaked
IBAN {id|DE44500105175407324931} bitte
Konto {id|DE89 3704 0044 0532 0130 00} prüfen
iban {id|FR1420041010050500013M02606} merci
cuenta {id|ES9121000418450200051332} abierta
account {id|GB29 NWBK 6016 1331 9268 19} closed
passport no. {id|C01X00T47} issued
passport number {id|X1234567} lost
dossier DE44 of section B and FR14 are open
items 078-051 and 219-099 are sold
model X1234 and C01 series, type GB29
My name is {name|Anna Weber} and I live here
My name is {name|Tom Baker} hello
hi, my name is {name|Lena Fischer}, how are you
name: {name|Peter Hoffman} was noted
the full name is {name|Grace Moore} on paper
Mr. {name|John Carter} signed it
Mrs. {name|Helen Brooks} called
Ms. {name|Ruth Okafor} left early
Dr. {name|Maria Silva} is in
Herr {name|Karl Neumann} wartet
Frau {name|Ute Lang} kommt
Madame {name|Claire Petit} attend
Monsieur {name|Paul Girard} arrive
Señor {name|Luis Romero} firma
Señora {name|Carmen Ortiz} espera
me llamo {name|Pablo Ruiz} y vivo aquí
je m'appelle {name|Luc Bernard} et voici
ich heiße {name|Eva Brandt} und wohne hier
Then Paris. The Rain In Spain Fell and Berlin Slept
Lyonat the. Erstth thnt lywhen thin ntnd, the and or
Der Hund. Die Katze und Das Haus sind alt.
La Casa. El Perro y Los Gatos son de Ana.
Le Chat. La Maison et Les Enfants, été et déjà
the name of the game is Big Deal and More
Doctor Who And Mister Ed were on
THE QUICK BROWN FOX!! JUMPED!! OVER!! IT!!
&&& aition$$$ la%%% menu ### |
a | b | c || d
he said: "well, no." (and left) -- twice...
don't can't l'eau d'or aujourd'hui über ñandú
See https://www.example.com/a/b?c=1 and www.example.org
x = y + 1; if (a[0] > b) { return; }
<div class="a"> </div> &nbsp; C++ and C#
1. First 2) Second a) third iv. fourth
100% of 5 % and $3.50, 20€ or £7
the 1st, 2nd, 3rd and 90s in the 21st
A. B. C. D. E. F.
en la ciudad de las asdo, mientras los niños ja
und der ein keiten, dass wir es ge- und be-
the of and to in is that it was for on are with
"""


def clean_line(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A labelled line as its text and (kind, start, end) spans."""
    text, spans = "", []
    for part in re.split(rf"(\{{(?:{'|'.join(KINDS)})\|.*?\}})", line):
        if m := re.fullmatch(rf"\{{({'|'.join(KINDS)})\|(.*)\}}", part):
            spans.append((m[1], len(text), len(text) + len(m[2])))
            part = m[2]
        text += part
    return text, spans


# --- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def is_card(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards to where its run of characters begins, so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        run = at - len(text[done:at]) + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if run < at else None
        if m:
            yield run, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, not overlapping within a kind, by start and kind."""
    out = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        for m in _DOTTED.finditer(text):
            # Four parts at a time are what the pattern takes from a longer run.
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                if all(map(small_part, parts[i : i + 4])):
                    out.append(("ip", at, at + size))
                at += size + 1
        out += [("card", *m.span()) for m in _GROUPED.finditer(text) if m.end() - m.start() >= 12 and is_card(m.group())]
        out += [("phone", *m.span()) for m in _PLUS.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


# --- the field

_WORD = re.compile(WORD)
_AT_WORD, _DOT_WORD = re.compile(r"[(\[{<]?at[)\]}>]?", re.I), re.compile(r"[(\[{<]?dot[)\]}>]?", re.I)
#: Marks that a span doesn't end or begin with.
_EDGE = ".,;:!?\"'»«…"


def shape(word: str) -> str:
    """Letters and digits as classes, runs drawn together, other marks as they are; at most 24 characters."""
    classes = "".join("9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64])
    return re.sub(r"(.)\1+", r"\1", classes)[:24]


def features(word: str) -> list[str]:
    core = word.strip(_EDGE)
    digits = sum("0" <= c <= "9" for c in core)
    form = shape(core)
    out = [f"s={form}", f"n={min(digits, 20)}", f"l={min(len(core), 24) // 3}", f"m={''.join(sorted(set(re.sub('[Xx9]', '', form))))}", f"d={min(core.count('.'), 4)}", f"e={word[-1:] if word[-1:] in _EDGE else ''}"]
    if digits and 0 < len(core) <= 24:
        out.append("f=" + re.sub("[0-9]", "9", core) if all("0" <= c <= "9" or c in "()./-[]_" for c in core) else f"a={form[:6]}")
    if re.fullmatch(r"[0-9a-fA-F]*(:[0-9a-fA-F]*){3,}", core):
        out.append("hex:")
    if len(core) <= 16 and not digits:
        out.append(f"w={core.lower()}")
    return out


class Field:
    """Weights of features at five places around a word, and of steps between states."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.index, self.weights, self.steps, self.first, self.last = index, weights, steps, first, last

    def known(self, word: str) -> tuple[int, ...]:
        """The features of a word that have weights."""
        return tuple(self.index[f] for f in features(word) if f in self.index)

    def word_weights(self, known: tuple[int, ...]) -> np.ndarray:
        """What features of a word add to each state of the word at each of PLACES from it, seen from there."""
        return self.weights[list(known)].sum(0) if known else np.zeros(self.weights.shape[1:])


PLACES = (-2, -1, 0, 1, 2)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def train(lines: list[str], turns: int = 250, penalty: float = 0.02, rate: float = 0.1) -> Field:
    """A field fitted to the labelled lines by full gradient steps (Adam)."""
    s = len(STATES)
    rows = [(text, spans) for text, spans in map(clean_line, sorted(lines)) if text.strip()]
    words = [[m for m in _WORD.finditer(text)] for text, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for ws in words for m in ws for f in features(m.group())}))}
    weights, steps, first, last = np.zeros((len(index), len(PLACES), s)), np.zeros((s, s)), np.zeros(s), np.zeros(s)
    if not rows:
        return Field(index, weights, steps, first, last)
    n, t = len(rows), max(map(len, words))
    x = np.zeros((n, t, len(PLACES), len(index)), np.float32)
    gold, real = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, ((_, spans), ws) in enumerate(zip(rows, words)):
        own = [[index[f] for f in features(m.group())] for m in ws]
        for j, m in enumerate(ws):
            real[i, j] = True
            for kind, a, b in spans:
                if a < m.end() and m.start() < b:
                    gold[i, j] = STATES.index(f"{'I' if m.start() > a else 'B'}-{kind}")
            for k, d in enumerate(PLACES):
                if 0 <= j + d < len(ws):
                    x[i, j, k, own[j + d]] = 1
    x = x.reshape(n * t, -1)
    length, order = real.sum(1), np.arange(n)
    want = np.eye(s)[gold] * real[..., None]
    pairs = (real[:, 1:] & real[:, :-1])[..., None, None]
    want_steps = (want[:, :-1, :, None] * want[:, 1:, None, :] * pairs).sum((0, 1))
    params = [weights.transpose(1, 0, 2).reshape(-1, s).copy(), steps, first, last]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, turns + 1):
        w, steps, first, last = params
        e = (x @ w.astype(np.float32)).astype(float).reshape(n, t, s)
        fore, back = np.zeros((n, t, s)), np.zeros((n, t, s))
        fore[:, 0] = e[:, 0] + first
        for j in range(1, t):
            fore[:, j] = logsum(fore[:, j - 1, :, None] + steps, 1) + e[:, j]
        back[order, length - 1] = last
        for j in range(t - 2, -1, -1):
            more = logsum(steps + (e[:, j + 1] + back[:, j + 1])[:, None, :], 2)
            back[:, j] = np.where((j < length - 1)[:, None], more, back[:, j])
        total = logsum(fore[order, length - 1] + last, 1)
        marginal = np.exp(fore + back - total[:, None, None]) * real[..., None]
        both = np.exp(fore[:, :-1, :, None] + steps + (e + back)[:, 1:, None, :] - total[:, None, None, None]) * pairs
        off = (marginal - want).reshape(n * t, s)
        slopes = [x.T @ off.astype(np.float32), both.sum((0, 1)) - want_steps, (marginal - want)[:, 0].sum(0), (marginal - want)[order, length - 1].sum(0)]
        for p, g, m, v in zip(params, slopes, mean, var):
            g = g + penalty * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    w, steps, first, last = params
    return Field(index, w.reshape(len(PLACES), len(index), s).transpose(1, 0, 2).copy(), steps, first, last)


def viterbi(e: np.ndarray, length: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best states of a batch of sequences (sequence, place, state), of which ``length`` places count."""
    n, t, s = e.shape
    score, back = e[:, 0] + first, np.zeros((n, t, s), np.int8)
    for j in range(1, t):
        step = score[:, :, None] + steps
        back[:, j] = step.argmax(1)
        new = step.max(1) + e[:, j]
        score = np.where((j < length)[:, None], new, score)
    out, rows = np.zeros((n, t), np.int8), np.arange(n)
    state = (score + last).argmax(1)
    for j in range(t - 1, -1, -1):
        state = np.where(j == length - 1, (score + last).argmax(1), state)
        out[:, j] = np.where(j < length, state, 0)
        state = np.where((j < length) & (j > 0), back[rows, j, state], state)
    return out


def decoded(e: np.ndarray, starts: np.ndarray, field: Field) -> np.ndarray:
    """The best states of texts whose words follow each other in ``e`` and begin at ``starts``.

    A path leaves "outside" for runs of words. What a run gains over staying
    there is at most the gain of entering it, of each further word and of
    leaving it, each with the best of its steps; a word that no run with a gain
    can hold is outside for certain.
    """
    steps = field.steps
    stay, lead = steps[0, 0], e[:, 1:] - e[:, :1]
    enter = (lead + np.maximum(steps[0, 1:] - stay, field.first[1:] - field.first[0])).max(1).astype(float)
    further = np.cumsum((lead + (steps[1:, 1:].max(0) - stay)).max(1), dtype=float)
    leave = np.maximum(steps[1:, 0] - stay, field.last[1:] - field.last[0]).max()
    upto = np.maximum.accumulate(enter - further)
    beyond = np.maximum.accumulate(further[::-1])[::-1]
    sure = upto + beyond + leave < -1e-3
    states, n = np.zeros(len(e), np.int8), len(e)
    begins = np.zeros(n + 1, bool)
    begins[starts] = begins[n] = True
    prev_open = np.concatenate([[False], ~sure[:-1]]) & ~begins[:n]
    at = np.flatnonzero(~sure & ~prev_open)
    ends = np.flatnonzero(~sure & (np.concatenate([sure[1:], [True]]) | begins[1:])) + 1
    size = ends - at
    for width in np.unique(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int)):
        some = np.flatnonzero((size <= width) & (size > width // 2))
        for part in np.array_split(some, max(1, len(some) * int(width) // 50_000)):
            a, length = at[part], size[part]
            places = a[:, None] + np.arange(width)
            inside = np.arange(width) < length[:, None]
            x = np.where(inside[..., None], e[np.minimum(places, n - 1)], 0.0)
            # What stands before and after is outside for certain, or the text's edge.
            x[:, 0] += np.where(begins[a][:, None], field.first, steps[0])
            x[np.arange(len(a)), length - 1] += np.where(begins[a + length][:, None], field.last, steps[:, 0])
            found = viterbi(x, length, steps, np.zeros(len(steps)), np.zeros(len(steps)))
            states[places[inside]] = found[inside]
    return states


def may_be(kind: str, text: str) -> bool:
    """Whether a span that the field found could be of its kind."""
    digits = len(re.sub("[^0-9]", "", text))
    if kind == "email":
        words = text.split()
        named = re.search(r"[A-Za-z0-9]\s*(@|[(\[{<]\s*at\s*[)\]}>]|\bat\b)\s*[A-Za-z0-9]", text, re.I)
        dotted = any(_DOT_WORD.fullmatch(w) for w in words[1:-1]) or re.search(r"[A-Za-z0-9](\.|[(\[{<]\s*dot\s*[)\]}>])[A-Za-z]{2,}$", text, re.I)
        return bool(named and dotted)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return (len(parts) == 4 and all(map(small_part, parts)) and not re.search("[A-Za-z]", text)) or (text.count(":") >= 3 and all(len(p) <= 4 and re.fullmatch("[0-9a-fA-F]*", p) for p in text.split(":")))
    if kind == "card":
        return is_card(text) and not re.search("[A-Za-z]", text)
    if kind == "phone":
        return 7 <= digits <= 15 and not re.search("[A-Za-z]", text)
    if kind == "id":
        return digits >= 5 and 7 <= len(re.sub("[^A-Za-z0-9]", "", text)) <= 34
    return 2 <= len(text.split()) <= 4 and all(re.fullmatch(r"[^\W\d_]+(['’-][^\W\d_]+)*", w) and w[0].isupper() for w in text.split())


class Finder:
    """Finds spans in texts; remembers the numbers of words and the weights of word classes between calls."""

    def __init__(self, field: Field):
        self.field, self.words, self.classes, self.table = field, {}, {}, []

    def number(self, word: str) -> int:
        """The row of the table of weights for a word: words of equal features share one."""
        core = word.strip(_EDGE)
        if core.isalpha():
            # Letters alone: features follow from these, at less cost.
            case = "x" if core.islower() else "X" if core.isupper() else shape(core)
            key: tuple = (case, min(len(core), 24) // 3, word[-1:] if word[-1:] in _EDGE else "", self.field.index.get(f"w={core.lower()}") if len(core) <= 16 else None, len(core) > 1)
            if key in self.classes:
                return self.classes[key]
        else:
            key = self.field.known(word)
            if key in self.classes:
                return self.classes[key]
        self.classes[key] = len(self.table)
        self.table.append(self.field.word_weights(self.field.known(word)))
        return self.classes[key]

    def numbers(self, words: list[str]) -> np.ndarray:
        seen = self.words
        for w in set(words):
            if w not in seen:
                seen[w] = self.number(w)
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

    def states(self, texts: list[list[str]]) -> np.ndarray:
        """Best states of the words of some texts, one after the other."""
        if len(self.words) > REMEMBERED or len(self.classes) > REMEMBERED:
            self.words, self.classes, self.table = {}, {}, []
        ids = self.numbers([w for t in texts for w in t])
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        table, n = np.stack(self.table), len(ids)
        e = table[ids, PLACES.index(0)]
        text = np.repeat(np.arange(len(texts)), ends - starts)
        for k, d in enumerate(PLACES):
            if d and n > abs(d):
                here, there = (slice(0, n - d), slice(d, n)) if d > 0 else (slice(-d, n), slice(0, n + d))
                e[here] += table[ids[there], k] * (text[here] == text[there])[:, None]
        return decoded(e, starts[starts < ends], self.field)

    def added(self, text: str, words: list[re.Match], states: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """What the states say, as spans that could be of their kind and touch no base span."""
        runs: list[list] = []
        for j in np.flatnonzero(states):
            prefix, kind = STATES[states[j]].split("-")
            if prefix == "I" and runs and runs[-1][0] == kind and runs[-1][2] == j - 1:
                runs[-1][2] = j
            else:
                runs.append([kind, j, j])
        out, taken = [], sorted((a, b) for _, a, b in base)
        for kind, i, j in runs:
            a, b = words[i].start(), words[j].end()
            while a < b and (text[b - 1] in _EDGE or (text[b - 1] in ")]}>" and text[a:b].count("([{<"[")]}>".index(text[b - 1])]) < text[a:b].count(text[b - 1]))):
                b -= 1
            while a < b and (text[a] in _EDGE or (text[a] in "([{<" and text[a:b].count(text[a]) > text[a:b].count(")]}>"["([{<".index(text[a])]))):
                a += 1
            if a < b and may_be(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                out.append((kind, a, b))
        return out

    def find(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """Base and added spans of each text."""
        out, held, size = [], [], 0

        def flush() -> None:
            states = self.states([w for _, w in held]) if size else []
            at = 0
            for text, words in held:
                base, own = base_spans(text), states[at : at + len(words)]
                at += len(words)
                out.append((base, self.added(text, list(_WORD.finditer(text)), own, base) if np.any(own) else []))
            held.clear()

        for text in texts:
            words = _WORD.findall(text)
            held.append((text, words))
            size += len(words)
            if size >= BATCH_WORDS:
                flush()
                size = 0
        flush()
        return out


def fitted(lines: DataFrame) -> Field:
    """The field that one task learns from the ``line`` column of a small labelled table."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"model": [pickle.dumps(train([t for p in it for t in p["line"] if t]))]})

    made = lines.select("line").repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made[0]) if made else train([])


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(line,) for line in LABELLED.strip().splitlines()], "line string")


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets, and spans of (kind, start, end, base)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(shared.value)
        for p in it:
            texts = [t or "" for t in p["text"].fillna("")]
            rows, redacted = [], []
            for text, (base, more) in zip(texts, finder.find(texts)):
                both = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in both])
                cut, at = [], 0
                for k, a, b, _ in both:
                    if b > at:
                        cut += [text[at:a] if a > at else "", f"[{k}]"] if a >= at else []
                        at = b
                redacted.append("".join([*cut, text[at:]]) if cut else text)
            yield pd.DataFrame({"doc_id": p["doc_id"], "redacted": redacted, "spans": rows})

    # As text, ids of any size pass by unharmed beside null ones.
    kind = docs.schema["doc_id"].dataType
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, redacted string, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def query(spark, sf_dir: str) -> DataFrame:
    found = spans(read(spark, sf_dir, "documents"), fitted(labelled(spark))).drop("redacted")
    own = F.filter("spans", lambda s: s["base"])
    listed = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(own, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
