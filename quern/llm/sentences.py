"""Sentence units of documents in any language and script (problem 10).

Candidate boundaries are runs of closing punctuation with the quotes and brackets that follow,
and, in Thai, blanks. What a script decides is decided by rule: a blank line always ends a
sentence, punctuation within a matched pair of quotes or brackets never does. What is left, the
full stop, the ellipsis and marks before small letters, goes to a maximum-entropy classifier over
the neighbouring tokens, their case, length, digits and script. It is trained on reliable cases:
the ends of paragraphs are boundaries; stops within tokens, before small letters, and after words that never
end a paragraph although they often stand before a stop, are none.

Training uses at most ``sample_documents`` documents, first in hash order; the lower-case words
that begin paragraphs, such as command names, are counted over all documents, by the same
thresholds however many there are. Every document is then cut as a whole.

Defined results: a null, empty or blank text has no sentences. Offsets are half-open, in code
points. A paragraph without closing punctuation is one sentence.
"""

from __future__ import annotations

import atexit
import mmap
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Set
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed

SPANS = "array<struct<start_char:int,end_char:int>>"

# Abbreviations in several languages, without their last stop.
#: Those that stand before a name, number or explanation; a feature, not a label.
LEADING = frozenset(
    """dr prof mr mrs ms st sr sra srta m mm mme mlle hr fr frl gen col lt sgt rev hon pres gov sen rep
    fig figs sec secs ch chs chap vol vols no nos nr núm num art par p pp pg pgs ed eds eq eqs tab app approx max min máx mín
    incl inkl excl exkl cf vs viz resp est ca env aprox vgl bzw ggf evtl sog dh zb d.h z.b i.e e.g i.a u.a s.o s.u o.ä
    kap abb abs abschn bd cap caps pág págs p.ej p.ex ej ex véase lám
    см ср рис гл стр ок макс мин напр табл разд т.е им г-н проф д-р н-р
    डॉ श्री श्रीमती د أ""".split()
)
#: Those that may end one.
TRAILING = frozenset("etc usw u.s.w usf u.s e.u u.k u.n inc ltd co corp jr sr gmbh ag д п др т.д т.п e.t.c al a.m p.m".split())
#: Starts of abbreviations that are written with blanks, and what may follow them: z. B., p. ej., т. е., d. h.
PAIRS = {"z": "b", "d": "h", "p": ("ej", "ex"), "т": "едпк", "и": "тдп", "u": "aä", "o": "ä", "i": "edra", "s": "uo", "n": "b", "v": "a"}

#: Units that are also in LEADING; after a number they are units.
UNITS = frozenset("ms min m".split())

STOPS = ".!?…。！？｡．؟।॥۔"
CLOSERS = "”’\"'»›)]}」』）】》〉“"
OPEN_TO_CLOSE = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉"}
WIDE = "。！？｡．"
CANDIDATE = re.compile(rf"[{re.escape(STOPS)}]+")
PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
THAI_BLANK = re.compile(r"(?<=[฀-๿])[ \t\n\xa0]+(?=[^\s\d])")
BACK = re.compile(r"[^\s([{“„«\"'¿¡]*$")
FIRST_WORD, EVERY_WORD = re.compile(r"\s*([^\W_]+)"), re.compile(r"(?<!\S)[^\W_]+")
MARKERS = re.compile(r"\n(?=[^\S\n]*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|\||>|```|~~~|</?(?:ul|ol|li|p|pre|table|tr|h\d)\b|\\(?:item|begin|end|section|subsection|paragraph)\b))")


def script(c: str) -> str:
    """A coarse script of one character."""
    if c < "ɐ":
        return "latin"
    if "Ѐ" <= c <= "ԯ":
        return "cyrillic"
    if "฀" <= c <= "๿":
        return "thai"
    if "ऀ" <= c <= "ॿ":
        return "indic"
    if "֐" <= c <= "ࣿ":
        return "semitic"
    if "　" <= c <= "鿿" or "가" <= c <= "힯" or "＀" <= c <= "￯":
        return "cjk"
    return "other"


def paired(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched quotes and brackets within text[start:end], in order."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[“”„«»‹›()\[\]{}「」『』（）【】《》〈〉\"]", text[start:end]):
        c, i = m[0], start + m.start()
        depth = next((d for d in range(len(stack) - 1, -1, -1) if c in (OPEN_TO_CLOSE.get(stack[d][0]) or stack[d][0])), -1)
        if depth >= 0:
            at = stack[depth][1]
            del stack[depth:]
            while out and out[-1][0] > at:
                out.pop()
            out.append((at, i))
        elif c in OPEN_TO_CLOSE or c == '"':
            stack.append((c, i))
    return out


def shape(token: str) -> str:
    c = token[:1]
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if c.islower() and (token[1:2].isdigit() or token[1:2].isupper()):
        return "code"
    if c.isalpha():
        return "upper" if c.isupper() else "lower" if c.islower() else "caseless"
    if c in "“„«‹\"'([¿¡「『（":
        inner = token.lstrip("“„«‹\"'([¿¡「『（ \xa0")
        return "open-lower" if inner[:1].islower() else "open"
    return "mark"


def features(text: str, a: int, b: int, lo: int, hi: int, starters: Set[str], after: int | None = None) -> list[str]:
    """Features of the candidate text[a:b] within the paragraph [lo, hi); ``after`` says where the next token begins instead."""
    back = re.search(r"[^\s([{“„«\"'¿¡]*$", text[max(lo, a - 48) : a])[0]
    before = text[max(lo, a - 48) : a - len(back)]
    prev2 = before.split()[-1] if before.strip() else ""
    closed = b
    while closed < hi and text[closed] in CLOSERS:
        closed += 1
    nxt = closed if after is None else after
    space = after is not None or (nxt < hi and text[nxt].isspace())
    m = re.compile(r"\s*(\S{0,24})").match(text, nxt, len(text) if after is not None else hi)
    token = m[1] if m else ""
    bare = token.strip("“„«»\"'()[]¿¡,;:")
    low = back.lower()
    mark = text[a:b]
    kind = "dots" if len(mark) > 1 and set(mark) <= {".", "…"} or mark == "…" else "." if mark == "." else "mark"
    if kind == ".":
        if re.fullmatch(r"\d[\d.,]*", prev2.strip("(")) and len(back) <= 4 and back.isalpha() and (low in UNITS or low not in LEADING | {"d", "z"}):
            word = "unit"
        elif re.fullmatch(r"[^\W\d_]", back):
            pair = PAIRS.get(low, "")
            word = "initial" if back.isupper() else "pair" if any(bare.lower().startswith(x) for x in pair) else "letter"
            if re.fullmatch(r"[^\W\d_]\.", prev2.strip("(")) and not back.isupper():
                word = "trailing" if low in TRAILING else "pair"
            elif low in LEADING and word != "pair":
                word = "leading"
        elif low in LEADING:
            word = "leading"
        elif low in TRAILING:
            word = "trailing"
        elif not back:
            word = "nothing"
        elif re.search(r"[./\\_]", back):
            word = "inner"
        elif back[-1:].isdigit():
            word = "digit"
        else:
            word = "word"
    else:
        word = kind
    sh = shape(token)
    if sh == "lower" and re.match(r"[^\W_]+", bare) and re.match(r"[^\W_]+", bare)[0] in starters:
        sh = "starter"
    gap = "space" if space else "close" if closed > b else "tight"
    if gap == "tight":
        # Words that touch: a whole word, a capital and small letters after it.
        plain = bool(re.fullmatch(r"[^\W\d_]{2,}|.*\d|.*[)%\"”]", back)) and bool(re.match(r"[^\W\d_](?:[^\W\d_]|\.?$)", token)) and token[:1].isupper() and (not token[1:2].isalpha() or token[1:2].islower())
        gap = "touch" if plain else "tight"
    return ["bias", f"w={word}", f"n={sh}", f"w={word}|n={sh}", f"g={gap}", f"g={gap}|n={sh}", f"w={word}|g={gap}", f"len={min(len(back), 5)}|w={word}", f"c={closed > b}|n={sh}", f"s={script(token[:1] or ' ')}"]


#: Paragraphs of one sentence each, so that a classifier exists where a sample is too small: their ends are boundaries, no stop within them is one.
EXAMPLES = """
Dr. Miller met Prof. Adams at St. John vs. the others in No. 26 near Fig. 4.
The bridge, as shown in Fig. 2 and Sec. 3.1, is closed.
It costs approx. 3.5 euros per kg, e.g. in May.
Apples, pears, etc. are sold there.
Mr. J. R. Jones and Mrs. A. Brown live in the U.S. and in the U.K. too.
The file notes.v2.txt holds version v1.2.3 of it.
Open data.v1.json and then log.b3.csv.
He asked “Why? Tell me.” and went home.
They waited… and then they left.
She said “It is done.” and then she slept.
The train leaves at 5 p.m. on Friday.
See chap. 3, pp. 10 and vol. 2 of it.
We sell tea, milk, etc.
They moved to the U.S.
The soup was ready.
Nothing else has changed since.
Is it open on Sunday?
What a day!
It weighs 5 kg.
The rest took 20 ms.
It works with macOS.
“Who is there?” asked the old man.
iPhones are sold here.
npm starts the server.
v2.0 was never sold.
She wrote “All is well.” and signed it.
The sign “Stop. Go.” was red.
He left (see above. below.) at noon.
b3 is the next room.
Der Zug nach Köln fährt z. B. um 5 Uhr, d. h. sehr früh.
Herr Dr. Weber wohnt in Nr. 3 bzw. in Nr. 5, vgl. Abb. 7.
Brot, Käse usw. sind da.
Wir kaufen Brot, Käse usw.
Das Haus steht leer.
Wann kommt der Bus?
Le musée, p. ex. le vieux, ferme à 18 h.
M. Dupont et Mme Petit voient la fig. 2 du chap. 3.
La porte est ouverte.
Où est la gare ?
El señor, p. ej. el Sr. Ruiz, vive en el núm. 7.
La Sra. López y el Dr. Gil leen la pág. 12.
La puerta está cerrada.
¿Dónde está la llave?
¡Qué bien! dice la gente.
Город, напр. Москва, см. рис. 3, т. е. большой.
Дома, улицы и т. д. описаны ниже.
Мы видели дома, улицы и т. д.
Дверь закрыта.
""".strip().split("\n")


class Splitter:
    """Weights of the classifier and the lower-case words that begin sentences."""

    def __init__(self, weights: dict[str, float], starters: Set[str]):
        self.weights, self.starters = weights, starters

    def ends(self, text: str, a: int, b: int, lo: int, hi: int) -> bool:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(text, a, b, lo, hi, self.starters)) > 0

    def paragraph(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Sentences of one paragraph."""
        pairs = paired(text, lo, hi)
        cuts: list[int] = []
        at = 0
        for m in CANDIDATE.finditer(text, lo, hi):
            a, b = m.span()
            while at < len(pairs) and pairs[at][1] < a:
                at += 1
            if not text[cuts[-1] if cuts else lo : a].strip():
                continue  # nothing to end
            inside = at < len(pairs) and pairs[at][0] < a
            if inside:
                # Only the last mark before the closing quote or bracket can end the sentence.
                close = pairs[at][1]
                if b != close:
                    continue
            end = b
            while end < hi and text[end] in CLOSERS and not (text[end] in "“\"'" and end + 1 < hi and text[end] != "“" and text[end + 1].isalnum()):
                if any(p[0] == end for p in pairs[at : at + 2]):
                    break  # it opens what follows
                end += 1
            follow = end
            while follow < hi and text[follow].isspace():
                follow += 1
            if follow >= hi:
                continue
            c = text[follow]
            if end > b and c in STOPS:
                continue  # the stop outside ends it
            if c in ",;:，、；：—–-" or unicodedata.category(c) in ("Pd",):
                continue
            if inside and (script(c) in ("cjk", "semitic", "indic", "thai") and c.isalnum()):
                continue  # caseless: what follows a quotation goes on with the sentence
            if text[b - 1] in WIDE or text[b - 1] in "।॥؟۔":
                cuts.append(end)
            elif text[b - 1] in "!?…" and (script(c) in ("cjk", "indic", "semitic") or script(text[a - 1] if a > lo else " ") == "cjk" and c.isalpha()):
                cuts.append(end)
            elif text[a:b] == "." and a > lo and text[a - 1].isdigit() and b < hi and text[b].isdigit():
                continue
            elif self.ends(text, a, b, lo, hi):
                cuts.append(end)
        opened = [p for p, _ in pairs]
        for m in THAI_BLANK.finditer(text, lo, hi):
            k = bisect_right(opened, m.start()) - 1  # pairs are apart from each other
            if k < 0 or not pairs[k][0] < m.start() < pairs[k][1]:
                cuts.append(m.start())
        start = lo
        for cut in [*sorted(set(cuts)), hi]:
            s, e = start, cut
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s:
                yield s, e
            start = cut

    def spans(self, text: str | None, marked: bool = False) -> list[tuple[int, int]]:
        """Sentences of a text; in ``marked`` texts list items, headings, rows and fences begin new ones."""
        out: list[tuple[int, int]] = []
        for lo, hi in blocks(text or "", marked):
            out += self.paragraph(text, lo, hi)
        return out


def blocks(text: str, marked: bool = False) -> Iterator[tuple[int, int]]:
    """Paragraphs, parted by blank lines."""
    at = 0
    breaks = [m.span() for m in PARAGRAPH.finditer(text)]
    if marked:
        breaks = sorted([*breaks, *(m.span() for m in MARKERS.finditer(text))])
    for a, b in [*breaks, (len(text), len(text))]:
        if text[at:a].strip():
            yield at, a
        at = max(at, b)


def lower_starts(texts: list[str], least: float = 0.03) -> frozenset[str]:
    """Lower-case words that begin paragraphs more often than by chance: at least twice, and in more than ``least`` of their places."""
    first: Counter[str] = Counter()
    every: Counter[str] = Counter()
    for t in texts:
        first.update(m[1] for lo, hi in blocks(t) if (m := FIRST_WORD.match(t, lo, hi)) and m[1].islower())
        every.update(w for w in EVERY_WORD.findall(t) if w.islower())
    return frozenset(w for w, n in first.items() if n >= 2 and n > least * every[w])


def word_before(text: str, a: int, lo: int) -> tuple[str, bool]:
    """The token before a stop in small letters (single letters are one kind), and whether a number stands before it."""
    back = BACK.search(text, max(lo, a - 48), a)[0]
    before = text[max(lo, a - 48) : a - len(back)].split()
    return "x" if len(back) == 1 and back.isupper() else "0" if back[-1:].isdigit() else back.lower(), bool(before) and before[-1].strip("(")[:1].isdigit()


def never_last(ends: Counter, inner: Counter, chance: float = 0.01) -> frozenset:
    """The kinds of word that stand before stops within paragraphs so often that, if these ended sentences, one would end a paragraph too."""
    share = sum(ends.values()) / max(1, sum(ends.values()) + sum(inner.values()))
    return frozenset(w for w, n in inner.items() if not ends[w] and (1 - share) ** n < chance)


def train(texts: list[str], starters: Set[str] | None = None, steps: int = 300) -> Splitter:
    """Fit on reliable cases of ``texts`` and on EXAMPLES.

    Boundaries are the ends of paragraphs, joined with the next one by a blank or, where whole words touch, by nothing. No boundaries are full stops within a token, before
    a small letter that begins no sentence, and after words that never end a paragraph although they often stand before a stop.
    """
    starters = lower_starts(texts) if starters is None else starters
    cases: Counter[tuple] = Counter()
    ends: Counter[tuple] = Counter()
    inner: Counter[tuple] = Counter()
    paragraphs = [(t, list(blocks(t))) for t in texts if t]

    def stops(t: str, own: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """Place, paragraph and whether it ends its paragraph, of every candidate."""
        for k, (lo, hi) in enumerate(own):
            for m in CANDIDATE.finditer(t, lo, hi):
                yield *m.span(), lo, hi, k, not t[m.end() : hi].strip(CLOSERS + " \n\t")

    for t, own in paragraphs:
        for a, b, lo, hi, _, last in stops(t, own):
            if t[a:b] == "." and (last or t[b : b + 1].isspace()):
                (ends if last else inner)[word_before(t, a, lo)] += 1
    abbreviated = never_last(ends, inner)
    for t, own in paragraphs:
        for a, b, lo, hi, k, last in stops(t, own):
            if last:
                if k + 1 < len(own):
                    cases[(1, *features(t, a, b, lo, hi, starters, own[k + 1][0]))] += 1
                    near = t[max(lo, a - 48) : hi].rstrip()
                    at = a - max(lo, a - 48)
                    both = near + t[own[k + 1][0] : own[k + 1][0] + 48].lstrip()
                    if "g=touch" in (f := features(both, at, at + b - a, 0, len(both), starters)):
                        cases[(1, *f)] += 0.2
            elif t[a:b] == ".":
                if b < hi and not t[b].isspace() and t[b] not in CLOSERS and not t[b].isupper():
                    cases[(0, *features(t, a, b, lo, hi, starters))] += 1
                else:
                    f = features(t, a, b, lo, hi, starters)
                    if "n=lower" in f or t[b : b + 1].isspace() and word_before(t, a, lo) in abbreviated:
                        cases[(0, *f)] += 1
            elif "n=lower" in (f := features(t, a, b, lo, hi, starters)):
                cases[(0, *f)] += 1
    known = [(list(k[1:]), k[0], 1 + np.log1p(n)) for k, n in cases.items()]
    own = starters | lower_starts(["\n\n".join(2 * EXAMPLES)])
    for one, after in zip(EXAMPLES, [*EXAMPLES[1:], EXAMPLES[0]]):
        for joint in (" ", ""):
            both = one + joint + after
            for m in CANDIDATE.finditer(both, 0, len(one)):
                last = not both[m.end() : len(one)].strip(CLOSERS)
                f = features(both, *m.span(), 0, len(both), own, len(one) + 1 if last and joint else None)
                if joint or last and "g=touch" in f:
                    known.append((f, int(last), 2.0))
    names = {f: i for i, f in enumerate(sorted({f for fs, _, _ in known for f in fs}))}
    rows = np.array([[names[f] for f in fs] for fs, _, _ in known])
    y = np.array([c[1] for c in known], float)
    wt = np.array([c[2] for c in known])
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-w[rows].sum(1)))
        g = np.bincount(rows.ravel(), np.repeat((p - y) * wt, rows.shape[1]), len(w))
        h = np.bincount(rows.ravel(), np.repeat(p * (1 - p) * wt, rows.shape[1]), len(w))
        w -= (g + 0.02 * w) / (rows.shape[1] * h + 0.02 + 1e-3)
    return Splitter({f: float(w[i]) for f, i in names.items()}, own)


@lru_cache(maxsize=8)
def mapped(name: str) -> mmap.mmap:
    """A file that was shipped to the workers, mapped into memory."""
    with open(SparkFiles.get(name), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


@lru_cache(maxsize=1 << 16)
def listed(name: str, word: str) -> bool:
    """Whether ``word`` is a line of a file of ``shipped``, by bisection."""
    lines, key = mapped(name), word.encode("utf-8", "surrogatepass")
    lo, hi = 0, len(lines) - 1  # line feeds; the word is between them or nowhere
    while lo < hi:
        start = lines.rfind(b"\n", lo, (lo + hi) // 2 + 1)
        end = lines.find(b"\n", start + 1)
        line = lines[start + 1 : end]
        if line == key:
            return True
        lo, hi = (end, hi) if line < key else (lo, start)
    return False


class Words(Set):
    """The words of a file of ``shipped`` and a few ``more``. Only what is looked up is read, so there may be any number of them."""

    _from_iterable = staticmethod(frozenset)

    def __init__(self, name: str, more: frozenset[str] = frozenset()):
        self.name, self.more = name, more

    def __contains__(self, word: str) -> bool:
        return word in self.more or listed(self.name, word)

    def __iter__(self) -> Iterator[str]:
        lines, at = mapped(self.name), 1
        while at < len(lines):
            end = lines.find(b"\n", at)
            yield lines[at:end].decode()
            at = end + 1
        yield from (w for w in self.more if not listed(self.name, w))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __or__(self, other: Set[str]) -> Words:
        return Words(self.name, self.more | other)

    __ror__ = __or__


def shipped(words: DataFrame) -> str:
    """The name of a file that all workers get: a line feed, then the distinct words of the column ``w``, one a line, in byte order. The driver writes it partition by partition."""
    folder, name = tempfile.mkdtemp(), f"quern-words-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"\n")
        f.writelines(r["w"].encode() + b"\n" for r in words.orderBy("w").toLocalIterator())
    words.sparkSession.sparkContext.addFile(f.name)
    return name


def starters_of(documents: DataFrame, least: float = 0.03) -> Words:
    """``lower_starts`` of all documents, counted where they are."""
    texts = documents.where(F.length("text") > 0).select("text")
    first = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)(?:^|\n[^\S\n]*\n)\s*(\w*)"), 1)).alias("w")).groupBy(F.regexp_extract("w", r"(?U)^([^\W_]*)", 1).alias("w")).agg(F.count("*").alias("n"))
    small = first.where((F.col("w") != "") & (F.lower("w") == F.col("w")) & (F.upper("w") != F.col("w")) & (F.col("n") >= 2))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)(?<!\S)([^\W_]+)"), 1)).alias("w")).where(F.lower("w") == F.col("w"))
    every = words.groupBy("w").agg(F.count("*").alias("every"))
    return Words(shipped(checkpointed(small.join(every, "w").where(F.col("n") > least * F.col("every")).select("w"))))


def fitted(documents: DataFrame, sample_documents: int = 2_000, sample_chars: int = 20_000) -> Splitter:
    """Train on the first ``sample_documents`` documents in hash order of at most ``sample_chars`` characters, and with the starters of all documents."""
    h = F.xxhash64("doc_id", F.lit("sentences"))
    # A hash threshold keeps about three times the sample, so that only so much is sorted and reaches the driver.
    share = min(1.0, (3 * sample_documents + 300) / max(1, documents.count()))
    some = documents.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).where(F.length("text").between(1, sample_chars))
    rows = some.select("text", h.alias("h"), "doc_id").repartition(1).sortWithinPartitions("h", "doc_id").limit(sample_documents).collect()
    return train([r["text"] for r in rows], starters_of(documents))


def sentences(documents: DataFrame, splitter: Splitter | None = None) -> DataFrame:
    """doc_id, start_char and end_char of every sentence of ``documents`` (doc_id, text, source_type)."""
    model = splitter or fitted(documents)

    @F.pandas_udf(SPANS)
    def cut(texts: pd.Series, marked: pd.Series) -> pd.Series:
        return pd.Series([[{"start_char": a, "end_char": b} for a, b in model.spans(t, bool(m))] for t, m in zip(texts, marked)], dtype=object)

    spans = documents.where(F.length("text") > 0).select("doc_id", F.explode(cut("text", F.coalesce(F.col("source_type") == "markdown", F.lit(False)))).alias("s"))
    return spans.select("doc_id", "s.start_char", "s.end_char")
