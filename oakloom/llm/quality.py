"""Problem 8: statistics of each text and its form: prose, list, table or junk.

Each line that isn't blank is described by three distributions: its characters over classes, its words over classes (function
words, numbers, words said before, others), and what stands between its words and at its ends over classes of joints (a blank, a
soft mark, a full stop, a cell border, a line's end with and without a mark, a marker at its start). The last two take in the neighbouring lines with falling
weight. Their Jensen-Shannon divergences from the profiles of prose in six languages and of kinds of lists, tables and junk are added up; the
line has the form of the nearest profile. The profiles are the same distributions of the sample texts below, of prose once as it stands and once wrapped into short
lines. A text has the form that makes up more than half of its characters.
"""

from __future__ import annotations

import re
import textwrap
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oakloom.llm.storage import small_enough
from oakloom.llm.words import _RUN, fold, map_batches, words

FORMS = ("prose", "list", "table", "junk")

#: Characters: the classes of the character distribution.
VOWEL, CONSONANT, UPPER, OTHER_LETTER, DIGIT, SPACE, MARK, CELL, SYMBOL, GARBLED, RUN = range(11)
#: Words: the classes of the word distribution. RANDOM words have long runs of consonants or change case or kind inside.
FUNCTION, NUMBER, AGAIN, RANDOM, CONTENT = range(5)
#: Joints: what stands between two words, after the last and before the first.
BLANK, SOFT, STOP, CELL_BORDER, LINE_END, MARKER, SENTENCE_END = range(7)
JOINTS = 7
#: Bits of the characters between words.
_BORDER, _SPACE, _SOFT, _STOP, _SIGN = 1, 2, 4, 8, 16

# Sample texts of the profiles, (form, text). Each line is a sample; the profile is their mean.
SAMPLES = (
    ("prose", "The kettle in the old station had been left on by one of the guards, so the whole room was warm by 7.30.\nWhen the train came in we saw that the doors of carriage 14 were open and nobody was in it."),
    ("prose", "Der Kessel im alten Bahnhof war von einem der Wächter angelassen worden, deshalb war der Raum um 7.30 schon warm.\nAls der Zug kam, sahen wir, dass die Türen von Wagen 14 offen waren und niemand darin saß."),
    ("prose", "La bouilloire de la vieille gare avait été oubliée par un des gardiens, et la salle était chaude à 7.30.\nQuand le train est arrivé, nous avons vu que les portes de la voiture 14 étaient ouvertes et que personne n'y était."),
    ("prose", "El hervidor de la vieja estación quedó encendido por uno de los guardias, y la sala ya estaba caliente a las 7.30.\nCuando llegó el tren vimos que las puertas del coche 14 estaban abiertas y que no había nadie."),
    ("prose", "A chaleira da velha estação ficou ligada por um dos guardas, e a sala já estava quente às 7.30.\nQuando o trem chegou vimos que as portas do vagão 14 estavam abertas e que não havia ninguém."),
    ("prose", "车站里的旧水壶一直开着，所以房间在 7.30 就已经很暖和了。\n火车进站的时候，我们看见 14 号车厢的门开着，里面没有人，Marvel-21 也没有记录。"),
    ("list", "- warm the kettle\n- Tolvane (4417)\n* open the doors\n• carriage seat brown-fox-2211\n  → guard room, Melvia\n+ quiet platform"),
    ("list", "1. warm the kettle\n2) Tolvane (4417)\n13. open the doors\na. carriage seat brown-fox-2211\nb) guard room, Melvia\n[ ] quiet platform\n[x] sweep the floor"),
    ("list", "warm the kettle\nTolvane (4417)\nopen the doors of the train\ncarriage seat brown-fox-2211\nguard room, Melvia\nquiet platform"),
    ("table", "| seat | price | guest | state |\n|---|---|---|---|\n| 14 | 7.30 | brown-fox-2211 | open |\n| 22 |  | grey-owl-1800 | shut |\n14 | 7.30 | open"),
    ("table", "|---|---|---|\n|---|---|---|---|---|"),
    ("table", "seat\tprice\tguest\tstate\n14\t7.30\tbrown-fox-2211\topen\n22\t\tgrey-owl-1800\tshut"),
    ("table", "seat,price,guest,state\n14,7.30,brown-fox-2211,open\n22,,grey-owl-1800,shut\n14;7.30;brown-fox-2211;open\n22;;Tolvane;shut"),
    ("table", "seat           price          guest            state\n14             7.30           brown-fox-2211   open\n22             6.10           grey-owl-1800    shut"),
    ("table", "seat=14 price=7.30 guest=brown-fox-2211 state=open\nseat=22 price= guest=grey-owl-1800 state=shut"),
    ("junk", "@#!%&/{]$=?+*~^;:>|<_-{}[]\\#@%!;&\n<=;[}&*^%$#@!?>:|{+_~-/\\.;]"),
    ("junk", "�□▪▒ �0x▒□▪ ¿�x0□▒▪\n▒▒� ▪□0 x¿�▪ □□▒"),
    ("junk", "e4 0fh a9ff 7c 33h b0 1aff d2h 5e 90 c7ff 08h\n4ah 91 e0ff 3b d7h 6c 12ff a0 f4h 88ff 0e 57h"),
    ("junk", "kR7vQx2LbZ0nTq9WsYd4HfGjC8mUaPeXo1iV5uBt\nZq8+Wm3xKt5/RbVn0LcYp7HsDj2gFaEoXuTi9QkM"),
    ("junk", "xkrtwq zvbnlp gfdhjkw qrtplmsn vcxbzn wqrtk\nbnmtrwq plkjhg zxcvrt hgfdkl mnbvq trwpsd"),
    ("junk", "aaaaaaaaaaaaaaaaaaaaa !!!!!!zzzzzzzzzzzzzzzzzz\noooooooooooooooooo .....kkkkkkkkkkkkkkkkkkk"),
    ("junk", "kettle warm kettle kettle Tolvane warm warm kettle kettle Tolvane kettle warm kettle kettle warm\nwarm kettle warm Tolvane kettle kettle warm warm kettle Tolvane warm kettle"),
    ("junk", "LÃ©âa bouÃ©âilloire de lÃ©âa vieÃ©âille gaÃ©âre avÃ©âait Ã©tÃ© ouÃ©âbliÃ©e pÃ©âar\næ\x88\x91ä»¬ä»\x8eä¸\xad Ã¼ber dÃ©âie TÃ¼r wuÃ©ârde"),
)

_BLANK = regex.compile(r"[\s\p{Cf}]*")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|(?:[a-z]\d|\d[a-z]){1}.*(?:[a-z]\d|\d[a-z])|^[0-9a-f]{2}(?:h|ff)$|^\d?[a-f]\d?$")
#: Distinct words that count as few when a line says them over and over; weight of a neighbouring line; columns to which prose is wrapped; lines described at once.
FEW, NEIGHBOUR, COLUMNS, LINES = 12, 0.5, 56, 20_000
WEIGHTS = {"chars": 1.5, "said": 1.0, "joints": 1.0}


# Marks of sentences, and what the bytes 80 to 9F stand for in the usual code page.
_MARKS = ".,;:!?'\"()-–—/%“”‘’«»…。，；：、！？（）"
_CODE_PAGE = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """(class, symbol) of each code point: its class, and whether it is neither letter, digit nor white space."""
    out, symbol = np.full(0x110000, SYMBOL, np.uint8), np.ones(0x110000, bool)
    for code in range(0x10000):
        c = chr(code)
        if c.isspace():
            out[code] = SPACE
        elif c.isalpha():
            out[code] = UPPER if c.isupper() else CONSONANT if code < 0x250 else OTHER_LETTER
        elif c.isalnum():
            out[code] = DIGIT
        else:
            continue
        symbol[code] = False
    for lo, hi in ((0x10000, 0x1D000), (0x1E000, 0x1F000), (0x20000, 0x33480)):
        out[lo:hi], symbol[lo:hi] = OTHER_LETTER, False
    for marks, kind in (("aeiouàâäáãåæèéêëìíîïòóôöõøùúûü", VOWEL), ("\ufffd", GARBLED), ("|=\t", CELL), (_MARKS, MARK)):
        out[[ord(c) for c in marks]] = kind
    out[0x80:0xA0] = GARBLED
    return out, symbol


def word_class(word: str, common: frozenset[str]) -> int:
    if word in common:
        return FUNCTION
    if word.isdigit():
        return NUMBER
    if len(word) > 1 and _CLUSTER.search(word):
        return RANDOM
    return RANDOM if len(word) > 3 and word.isascii() and word.isalpha() and sum(map(word.count, "aeiouy")) < 0.2 * len(word) else CONTENT


def joint_bits() -> np.ndarray:
    """For each code point 0 where it belongs to a word, else its bit."""
    out = np.full(0x110000, _SIGN, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        out[code] = _SPACE if c.isspace() else 0 if c.isalnum() else _SIGN
    for lo, hi in ((0x10000, 0x1D000), (0x1E000, 0x1F000), (0x20000, 0x33480)):
        out[lo:hi] = 0
    for marks, bit in (("|\t=", _BORDER), (",;:，；：、", _SOFT), (".!?…。！？", _STOP)):
        out[[ord(c) for c in marks]] = bit
    return out


def _misread() -> tuple[np.ndarray, np.ndarray]:
    """(lead, follows): of each code point the number of further bytes that it announces where UTF-8 was read as one byte a character, and whether it may be one of them."""
    lead, follows = np.zeros(0x110000, np.int8), np.zeros(0x110000, bool)
    lead[0xC2:0xE0], lead[0xE0:0xF0], lead[0xF0:0xF5] = 1, 2, 3
    follows[0x80:0xC0] = True
    follows[[ord(c) for c in _CODE_PAGE]] = True
    return lead, follows


class Lines(NamedTuple):
    """What is known of each line: distributions as counts, size, (words, their letters, common words, whether it ends in punctuation), symbols."""

    chars: np.ndarray
    said: np.ndarray
    joints: np.ndarray
    size: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray


class LineProfiles:
    """Distributions of lines, and the profiles to compare them with."""

    def __init__(self, common: frozenset[str]):
        self.common = common
        self.known: dict[str, int] = {}
        self.classes, self.symbols = character_classes()
        self.bits = joint_bits()
        self.lead, self.follows = _misread()
        samples = [*SAMPLES, *(("prose", textwrap.fill(text.replace("\n", " "), COLUMNS)) for form, text in SAMPLES if form == "prose" and " " in text[:9])]
        self.forms = np.array([FORMS.index(f) for f, _ in samples])
        described = [self.describe(text.split("\n")) for _, text in samples]
        self.profiles = {c: [getattr(d, c).sum(axis=0) / max(1, getattr(d, c).sum()) for d in described] for c in WEIGHTS}

    def describe(self, lines: list[str]) -> Lines:
        """The distributions and counts of lines none of which is blank."""
        rows = len(lines)
        if not rows:
            none = np.zeros(0, np.int64)
            return Lines(np.zeros((0, 11)), np.zeros((0, 5)), np.zeros((0, JOINTS)), none, np.zeros((0, 4), np.int64), none)
        joined = "\n".join(lines) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[codes].astype(np.int64)
        inside = codes != 10
        number = np.cumsum(~inside) - ~inside
        symbols = np.bincount(number[self.symbols[codes]], minlength=rows)
        same = np.zeros(len(codes), bool)
        same[3:] = (codes[3:] == codes[2:-1]) & (codes[2:-1] == codes[1:-2]) & (codes[1:-2] == codes[:-3])
        kind[same & (kind != SPACE) & (kind != CELL) & (codes != 45)] = RUN
        self._garbled(codes, kind)
        chars = np.bincount(number[inside] * 11 + kind[inside], minlength=rows * 11).reshape(rows, 11).astype(np.float64)
        chars[:, GARBLED] *= 6
        said, counts = np.zeros((rows, 5)), np.zeros((rows, 4), np.int64)
        known, common = self.known, self.common
        for at, line in enumerate(lines):
            plain = fold(line)
            found = _RUN.findall(plain)
            if found:
                distinct = set(found)
                row = [0, 0, 0, 0, 0]
                for w in distinct:
                    k = known.get(w)
                    if k is None:
                        if len(known) > 300_000:
                            known.clear()
                        k = known[w] = word_class(w, common)
                    row[k] += 1
                again = len(found) - len(distinct)
                row[AGAIN if len(distinct) <= min(FEW, max(4, len(found) / 4)) else FUNCTION] += again
                said[at] = row
                counts[at, :3] = (len(found), sum(map(len, found)), sum(map(common.__contains__, found)))
            counts[at, 3] = unicodedata.category(plain.rstrip()[-1:] or " ")[0] == "P"
        return Lines(chars, said, self._joints(codes, number, rows), np.array([len(x) for x in lines], np.int64), counts, symbols)

    def _garbled(self, codes: np.ndarray, kind: np.ndarray) -> None:
        """Marks sequences of characters that are bytes of UTF-8 read one by one."""
        lead, follows = self.lead[codes], self.follows[codes]
        begins = np.flatnonzero(lead)
        for more in (1, 2, 3):
            at = begins[lead[begins] == more]
            at = at[at + more < len(codes)]
            for k in range(1, more + 1):
                at = at[follows[at + k]]
            for k in range(more + 1):
                kind[at + k] = GARBLED

    def _joints(self, codes: np.ndarray, number: np.ndarray, rows: int) -> np.ndarray:
        """(rows, JOINTS): how often each joint stands in a line."""
        bits = self.bits[codes]
        ends = codes == 10
        word = bits == 0
        between = ~word & ~ends
        out = np.zeros((rows, JOINTS))
        direct = np.flatnonzero(ends & np.r_[False, word[:-1]])
        out[number[direct], LINE_END] = 1
        start = np.flatnonzero(between & ~np.r_[False, between[:-1]])
        if not len(start):
            return out
        stop_at = np.flatnonzero(between & ~np.r_[between[1:], False]) + 1
        every = np.bitwise_or.reduceat(np.where(between, bits, 0), start)
        border, space, soft, stop, sign = ((every & b) > 0 for b in (_BORDER, _SPACE, _SOFT, _STOP, _SIGN))
        opens = (start == 0) | ends[np.maximum(start - 1, 0)]
        closes = ends[np.minimum(stop_at, len(ends) - 1)]
        wide = codes[start] > 0x2FFF  # marks of Chinese take no blank
        joint = np.full(len(start), BLANK)
        joint[sign] = -1  # hyphens, quotes and the like say nothing
        joint[soft] = np.where(space | wide, SOFT, CELL_BORDER)[soft]
        joint[stop] = np.where(space | wide, STOP, -1)[stop]
        joint[border | ((every == _SPACE) & (stop_at - start > 1))] = CELL_BORDER
        last = closes & ~opens
        joint[last] = np.where(border, CELL_BORDER, np.where(stop, SENTENCE_END, np.where(soft, SOFT, LINE_END)))[last]
        joint[opens] = np.where(border, CELL_BORDER, np.where(sign & space & ~closes, MARKER, -1))[opens]
        # a number or letter of up to three characters, a point or bracket and a blank at a line's start
        line_start = np.zeros(len(start), np.int64)
        first = np.flatnonzero(np.r_[True, ends[:-1]])
        line_start = first[np.searchsorted(first, start, side="right") - 1]
        counted = ~opens & ~closes & space & (start - line_start <= 3) & ((codes[start] == 46) | (codes[start] == 41))
        joint[counted] = MARKER
        known = joint >= 0
        np.add.at(out, (number[start[known]], joint[known]), 1)
        return out

    def distances(self, lines: Lines, owner: np.ndarray) -> np.ndarray:
        """(lines, profiles): summed Jensen-Shannon divergences, in bits. owner: the text of each line."""
        total = np.zeros((len(lines.size), len(self.forms)))
        for name, weight in WEIGHTS.items():
            x = getattr(lines, name)
            if name != "chars":
                near = x.copy()
                for k in (1, 2):
                    same = (owner[k:] == owner[:-k])[:, None] * NEIGHBOUR**k
                    near[k:] += x[:-k] * same
                    near[:-k] += x[k:] * same
                x = near
            x = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-9)
            for k, profile in enumerate(self.profiles[name]):
                total[:, k] += weight * jensen_shannon(x, profile)
        return total

    def line_forms(self, lines: Lines, owner: np.ndarray) -> np.ndarray:
        return self.forms[self.distances(lines, owner).argmin(axis=1)]


def _entropy(x: np.ndarray) -> np.ndarray:
    return -(x * np.log2(np.maximum(x, 1e-300))).sum(axis=-1)


def jensen_shannon(x: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """Divergence of each row of x from the profile; a row of zeros counts as far as its half."""
    return _entropy((x + profile) / 2) - (_entropy(x) + _entropy(profile)) / 2


def text_quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, ended_lines, common_share, prose_share, list_share,
    table_share, junk_share, form): statistics of each text.

    symbol_ratio: characters that are neither letters, digits nor white space, over all; ended_lines: share of
    lines, blank ones left out, that end in punctuation; common_share: share of words in common_words, of any
    language; the other shares are of the characters in lines. form is the one over a half, of none the one of the
    largest share; null for null and blank texts, whose counts are 0 and whose ratios are null. Repeated
    rows and further columns don't matter. One pass without a shuffle; common_words is a fixed list, whose size is checked.
    """
    common = common_words.where("word is not null").select("word")
    if not small_enough(common, "word", 1_000_000, 20_000_000):
        raise ValueError("common_words is too large for a list of frequent words")
    sent = documents.sparkSession.sparkContext.broadcast([r.word for r in common.distinct().collect()])

    def start():
        profiles = LineProfiles(frozenset(w for x in sent.value for w in words(x)))

        def work(batch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = len(texts)
            kept = [[x for x in t.split("\n") if x and not _BLANK.fullmatch(x)] for t in texts]
            every, owner = [x for lines in kept for x in lines], np.repeat(np.arange(rows), [len(x) for x in kept])
            share, sums = np.zeros((rows, len(FORMS))), np.zeros((rows, 5))
            for at in range(0, len(every), LINES):
                # two lines more on each side, whose neighbours these are
                lo, hi = max(0, at - 2), min(len(every), at + LINES + 2)
                lines, own = profiles.describe(every[lo:hi]), owner[lo:hi]
                forms = profiles.line_forms(lines, own)
                use = slice(at - lo, min(at + LINES, len(every)) - lo)
                np.add.at(share, (own[use], forms[use]), lines.size[use])
                np.add.at(sums, own[use], np.concatenate([lines.counts, lines.symbols[:, None]], axis=1)[use])
            total = share.sum(axis=1)
            n, letters, common, ended, symbols = sums.T
            size, full = np.array([len(t) for t in texts]), np.bincount(owner, minlength=rows)

            def over(a, b):
                return pa.array(np.divide(a, b, out=np.zeros(len(a)), where=b > 0), mask=b == 0)

            out = {"doc_id": batch.column("doc_id"), "words": n.astype(np.int64), "mean_word_length": over(letters, n), "symbol_ratio": over(symbols, size)}
            out |= {"ended_lines": over(ended, full), "common_share": over(common, n)}
            out |= {f"{f}_share": over(share[:, k], total) for k, f in enumerate(FORMS)}
            return out | {"form": [FORMS[k] if some else None for k, some in zip(share.argmax(axis=1).tolist(), total > 0)]}

        return work

    schema = "doc_id bigint, words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_share double, " + "".join(f"{f}_share double, " for f in FORMS) + "form string"
    return map_batches(documents.select("doc_id", "text"), start, schema, per_task=True)


def not_prose(quality: DataFrame) -> DataFrame:
    """(doc_id, form) of the texts that aren't mainly prose."""
    return quality.where(F.col("form") != "prose").select("doc_id", "form")
