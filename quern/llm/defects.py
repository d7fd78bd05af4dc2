"""Question and answer pairs whose answer is no usable answer (problem 3).

Each answer is tested for, in this order: a placeholder (``empty``), a refusal by a grammar over word
classes of many languages (``refusal``), the question itself by greedy string tiling
(``copied_question``), and script and function words against those of the question, with
code, names and quotations left out (``other_language``). What is left is parsed with a pushdown parser of fences, brackets,
quotations, elements, environments, list markers and keys: an open structure is ``truncated``. A text that ends neither open nor with
closing punctuation is judged by how its last words are used in all sound answers: if the longest context of
words that is known always goes on, the text breaks off; if it may end a sentence, only the full stop is missing.

Defined results: a null or blank answer is ``empty``; a null question can't be copied and has no
language. Repeated rows of one id count once (the least by question, answer and type). Null ids are left out.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.overlap import misspelt
from quern.session import checkpointed

# Whole answers that say nothing.
PLACEHOLDERS = frozenset(
    """tbd|tba|todo|tbc|fixme|n/a|na|n.a|n/k|none|null|nil|nan|undefined|unknown|missing|empty|blank|placeholder|answer|lorem ipsum|xxx
    no answer|not available|not applicable|not specified|to be done|to be added|to be determined|to be defined|coming soon|your answer here|insert answer here|answer here|no data
    leer|keine angabe|k. a|k.a|vide|sans objet|s/o|néant|à compléter|vacío|sin respuesta""".replace("\n    ", "|").split("|")
)

# The word classes of refusals by language. The speaker; negation; ability or permission; acts of
# answering; declining, which needs no negation; "as"; names of an assistant. Words that are two things at once
# (can't, puedo) stand in both classes.
CLASSES = {
    "en": """speaker: i i'm i'll we we're my our
        no: not cannot can't couldn't won't don't unable beyond against nor
        able: can can't cannot could couldn't able unable allowed permitted position comfortable won't will must something may authorized
        answer: help assist answer answering respond discuss provide share sharing give giving comment comply fulfill fulfil reveal disclose talk support continue engage advice say tell do
        decline: decline refuse
        as: as being
        assistant: ai model assistant chatbot""",
    "de": """speaker: ich wir mir uns meine unsere
        no: nicht kein keine keinen nichts
        able: kann können darf dürfen möchte werde lage erlaubt gestattet imstande
        answer: helfen weiterhelfen antworten beantworten sagen geben nennen auskunft besprechen bereitstellen unterstützen äußern teilen tun dienen
        decline: ablehnen verweigern
        as: als
        assistant: ki sprachmodell assistent modell""",
    "fr": """speaker: je j nous m me
        no: ne n pas non
        able: peux pouvons puis possible mesure autorisé autorisée permis suis sommes habilité
        answer: aider répondre fournir discuter donner partager dire assister commenter parler communiquer
        decline: refuser décliner refuse décline
        as: tant qu que comme
        assistant: ia assistant modèle intelligence""",
    "es": """speaker: yo me puedo podemos nosotros estoy soy somos debo
        no: no
        able: puedo podemos posible permitido condiciones autorizado autorizada capaz
        answer: ayudar ayudarte ayudarle responder contestar proporcionar compartir dar decir comentar hablar facilitar hacer
        decline: declinar rechazar negarme rehusar
        as: como
        assistant: ia modelo asistente inteligencia""",
    "it": """speaker: io mi posso possiamo sono devo
        no: non
        able: posso possiamo possibile permesso grado autorizzato
        answer: aiutare aiutarti aiutarla rispondere fornire condividere dare dire commentare
        decline: rifiutare rifiutarmi declinare
        as: come quanto
        assistant: ia ai modello assistente""",
    "pt": """speaker: eu me posso podemos estou sou devo
        no: não
        able: posso podemos possível permitido condições autorizado capaz
        answer: ajudar ajudá responder fornecer compartilhar partilhar dar dizer comentar
        decline: recusar declinar
        as: como
        assistant: ia modelo assistente""",
    "nl": """speaker: ik wij we mij
        no: niet geen
        able: kan kunnen mag mogen staat toegestaan
        answer: helpen antwoorden beantwoorden geven delen zeggen verstrekken bespreken
        decline: weigeren afwijzen
        as: als
        assistant: ai taalmodel assistent model""",
    "sv": """speaker: jag vi mig
        no: inte inga ingen
        able: kan får tillåtet möjlighet
        answer: hjälpa svara besvara ge dela säga tillhandahålla diskutera
        decline: avböja vägra avstå neka
        as: som
        assistant: ai språkmodell assistent modell""",
    "da": """speaker: jeg vi mig
        no: ikke ingen
        able: kan må får tilladt mulighed
        answer: hjælpe hjelpe svare besvare give gi dele sige si
        decline: afvise avslå nægte
        as: som
        assistant: ai sprogmodel språkmodell assistent""",
    "pl": """speaker: ja mogę możemy jestem muszę
        no: nie
        able: mogę możemy stanie wolno
        answer: pomóc odpowiedzieć odpowiadać udzielić podać udostępnić
        decline: odmówić
        as: jako
        assistant: ai model asystent""",
    "tr": """speaker: ben biz yardımcı üzgünüm
        no: edemem edemiyorum veremem veremiyorum olamam olamıyorum yanıtlayamam cevaplayamam
        able: edemem edemiyorum veremem veremiyorum olamam olamıyorum yanıtlayamam cevaplayamam
        answer: yardımcı yardım cevap yanıt bilgi yanıtlayamam cevaplayamam""",
    "ru": """speaker: я мы мне могу можем имею
        no: не нельзя
        able: могу можем права вправе состоянии
        answer: помочь ответить отвечать предоставить обсуждать сообщить поделиться
        decline: отказаться отклонить
        as: как
        assistant: ии модель ассистент помощник""",
    "ar": """speaker: أستطيع يمكنني أقدر أنا
        no: لا لن
        able: أستطيع يمكنني أقدر
        answer: مساعدتك المساعدة الإجابة الرد تقديم مشاركة""",
    "hi": """speaker: मैं हम
        no: नहीं
        able: सकता सकती सकते
        answer: कर दे मदद उत्तर जवाब बता""",
}
# The same for scripts without blanks, as what must follow one another within a sentence.
UNSPACED = re.compile(r"(?:無法|无法|不能|不便)[^。！？]{0,12}(?:回答|提供|协助|協助|帮助|幫助|帮)|作为[^。]{0,8}(?:AI|人工智能|语言模型)|(?:お答え|回答|お手伝い|対応|提供)[^。]{0,8}(?:できません|できかねます|いたしかねます)|(?:답변|도움|도와|제공)[^.]{0,12}(?:수\s*없|어렵)")
# Words for sources, and for what they may say.
SOURCES = frozenset("documentation document documents docs corpus source sources manual text dokumentation quelle quellen handbuch unterlagen documents manuel documentación fuente fuentes documentos fonti fonte documentazione documentação fontes bronnen documentatie".split())
SAYS = frozenset("say says state states mention mentions specify specifies contain contains describe describes cover covers covered provide provides indicate indicates information answer angabe angaben sagt nennt enthält erwähnt beschreibt indique mentionne précise contient dit dice indica menciona contiene especifica información riporta vermeldt".split())
NOTHING = frozenset("not no nothing doesn't don't isn't nicht nichts keine kein ne pas rien aucune nada non nulla não niet geen".split())

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for on with as are be by this at from which or an was not when what how where who why does can if will before after its only has every",
    "de": "der die das und ist den dem des ein eine einer einem einen nicht mit auf für von im zu wird werden sich als auch bei nach aus wie wo wer warum wenn welche welcher durch oder sind hat nur vor weil sobald lässt zuerst alle",
    "fr": "le la les des et est un une du dans pour que qui sur avec pas par au aux ce cette sont il elle ne se plus où quand comment pourquoi quel quelle d l qu après avant chaque doit comme ou sans puis",
    "es": "el la los las de y en que es un una del por con para se no su al lo como más cuando qué cómo dónde quién cuál está si tras cada sin porque solo antes sobre pero hay",
    "it": "il lo gli di che è un una per con non si del della nel sono da come più dove quando perché ogni anche alla",
    "pt": "o os as de que é um uma do da em para com não se no na por mais como quando onde são ao cada sem pelo pela",
    "nl": "de het een en van is dat op te in voor met niet zijn aan er wordt door als bij ook naar wie waar wanneer hoe",
    "sv": "och att det som en på är av för med den till inte om ett har de från vid kan var sig efter hur när vad vem varför eller innan bara alla",
    "da": "og at det som en på er af av for med den til ikke om et har de fra ved kan var sig seg efter etter hvordan når hva hvad hvem hvorfor eller før kun alle",
    "fi": "ja on ei se että joka ovat kun niin mutta myös tai jos kuin sen ennen jälkeen miten missä kuka miksi vain kaikki",
    "pl": "i w na z że się nie do to jest jak po od za przez o dla co kiedy gdzie kto dlaczego jest są tylko każdy przed oraz lub",
    "cs": "a v na se že je s z do o k i to jak po pro za by jsou jako když kde kdo proč pouze každý před nebo není",
    "ro": "și în de la cu pe că este un o nu se din sau care pentru ce când unde cine cum după înainte doar fiecare sunt prin",
    "hu": "a az és hogy nem is egy van ez meg de csak már vagy ha mint után előtt hogyan hol mikor ki miért minden",
    "tr": "ve bir bu da de için ile ne o gibi daha çok en ama olarak sonra kadar önce nasıl nerede kim neden her yalnızca",
    "id": "dan yang di ke dari untuk dengan pada ini itu tidak adalah oleh atau akan setelah sebelum bagaimana dimana siapa mengapa hanya setiap",
}
LANGUAGES = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        LANGUAGES.setdefault(_w, []).append(_language)

QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|「[^」]*」|『[^』]*』|‘[^’\n]{8,}’")
QUOTE = re.compile("[“„«\"「『‘]")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
TOKEN = re.compile(r"--[\w=-]+|[^\W_]+(?:[-_.’'][^\W_]+)*|[,;:(]")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
SENTENCE = re.compile(r"(?<=[.!?。！？।؟])\s+|(?<=[。！？])|\n\s*\n")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ALNUM = re.compile(r"[^\W_]+")
# Letters of scripts by their ranges.
SCRIPTS = {
    "latin": "A-Za-zª-ɏḀ-ỿ", "greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ", "armenian": "԰-֏", "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ", "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "tamil": "஀-௿", "thai": "฀-๿",
    "georgian": "Ⴀ-ჿ", "ethiopic": "ሀ-፿", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿", "hangul": "가-힯",
}
OF_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}


def is_placeholder(answer: str) -> bool:
    """Whether an answer is blank, marks only, or a word that stands for a missing answer."""
    text = answer if answer.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", answer))
    text = text.strip()
    if not re.search(r"\w", text):
        return True
    inner = text.strip("<>[]{}()\"'`*_-. !?:").lower()
    if not inner or inner in PLACEHOLDERS:
        return True
    return text[0] in "<[{(" and bool(re.fullmatch(r"[<\[{(]+\s*(?:your |the |insert |add )?(?:answer|response|text|content|value|placeholder|antwort|réponse|respuesta)[\w ]*[>\]})]+", text, re.I))


@functools.cache
def classes() -> dict[str, tuple[tuple[str, str], ...]]:
    """The (language, class) pairs of every word of CLASSES."""
    out: dict[str, list] = {}
    for language, text in CLASSES.items():
        for line in text.splitlines():
            kind, words = line.strip().split(": ", 1)
            for w in words.split():
                out.setdefault(w, []).append((language, kind))
    return {w: tuple(v) for w, v in out.items()}


def refuses(sentence: str, words: list[str]) -> bool:
    """Whether a sentence is a refusal.

    refusal := speaker, no, able and answer, in any order | speaker and decline | speaker and role, role := as, up to three words, assistant.
    All words of one production are of one language.
    """
    of = classes()
    seen: dict[str, dict[str, int]] = {}
    for i, w in enumerate(words):
        for language, kind in of.get(w, ()):
            own = seen.setdefault(language, {})
            own[kind if kind not in own else kind + "+"] = i
            if kind == "assistant" and "as" in own and i - max(own["as"], own.get("as+", -1)) <= 4:
                own["role"] = i
    for own in seen.values():
        if "speaker" in own and ("no" in own and "able" in own and "answer" in own or "decline" in own or "role" in own):
            return True
    return not sentence.isascii() and bool(UNSPACED.search(sentence))


def silent(words: list[str]) -> bool:
    """Whether a sentence states that the sources say nothing."""
    return not SOURCES.isdisjoint(words) and not NOTHING.isdisjoint(words) and not SAYS.isdisjoint(words)


def prose(text: str) -> str:
    """A text without code and quotations."""
    if "`" in text or "~~~" in text:
        text = CODE.sub(" ", text)
    return QUOTED.sub(" ", text) if QUOTE.search(text) else text


def scripts(prose: str) -> str:
    """The script of a text; a third of another script than Latin decides, as names are Latin in any language. Empty where it has no letters."""
    if prose.isascii():
        return "latin" if re.search(r"[A-Za-z]", prose) else ""
    counts = {k: len(p.findall(prose)) for k, p in OF_SCRIPT.items()}
    kana = counts.pop("kana")
    counts["han"] += kana
    total = sum(counts.values())
    if not total:
        return ""
    top = max((k for k in counts if k != "latin"), key=counts.get)
    if 3 * counts[top] >= total:
        return "japanese" if top == "han" and kana > 0.1 * counts["han"] else top
    return "latin" if counts["latin"] >= counts[top] else top


def languages(text: str) -> tuple[str, frozenset[str]]:
    """The script of the prose of a text, and for Latin the languages that its function words allow; none where they can't tell."""
    text = prose(text)
    script = scripts(text)
    if script != "latin":
        return script, frozenset()
    votes: dict[str, int] = {}
    for w in text.lower().replace("'", " ").replace("’", " ").replace("-", " ").split():
        for k in LANGUAGES.get(w.strip(",;:.!?()¿¡"), ()):
            votes[k] = votes.get(k, 0) + 1
    best = max(votes.values(), default=0)
    near = frozenset(k for k, n in votes.items() if 1.3 * n > best)
    return script, near if best >= 3 or best == 2 and len(votes) == 1 else frozenset()


def foreign(question: str, answer: str) -> bool:
    """Whether an answer is in another script than its question, or shares no possible language with it."""
    a, own = languages(answer)
    b, asked = languages(question)
    if a and b and a != b:
        return True
    return bool(own and asked and own.isdisjoint(asked))


def tiled(a: list[str], b: list[str], least: int = 3) -> list[bool]:
    """Greedy string tiling: which tokens of ``a`` are within common runs of ``least`` or more with ``b``, none used twice."""
    free_a, free_b = [True] * len(a), [True] * len(b)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    while True:
        best, at = least - 1, (0, 0)
        run: dict[int, int] = {}
        for i, w in enumerate(a):
            new = {}
            if free_a[i]:
                for j in places.get(w, ()):
                    if free_b[j]:
                        n = new[j] = run.get(j - 1, 0) + 1
                        if n > best:
                            best, at = n, (i, j)
            run = new
        if best < least:
            return [not f for f in free_a]
        for k in range(best):
            free_a[at[0] - k] = free_b[at[1] - k] = False


def is_copy(question: str, answer: str) -> bool:
    """Whether an answer only repeats its question, once or more often.

    A sentence repeats it if most of its tokens are tiles of the question or misspellings of its words. What stands
    with it in one sentence, or shortly before it, is an address; a sentence of its own after it is an answer.
    """
    low = [INVISIBLE.sub("", t.lower()) for t in (question, answer)]
    q, every = ALNUM.findall(low[0]), ALNUM.findall(low[1])
    if not q or len(set(q) & set(every)) < 0.4 * len(set(q)):
        return False
    if q == every:
        return True
    repeated, before, known = False, 0, set(q)
    covered: set[str] = set()
    for sentence in SENTENCE.split(low[1]):
        a = ALNUM.findall(sentence)
        if not a:
            continue
        tiles = tiled(a, q, 2)
        if len(a) >= 4 and sum(tiles) >= 0.5 * max(len(a), len(q)) and sum(not t and w not in known and not any(misspelt(w, v) for v in known) for w, t in zip(a, tiles)) <= 0.34 * len(a):
            repeated = True
            covered |= set(a)
        elif repeated:
            if not POLITE.issuperset(a):
                return False
        else:
            before += len(a)
    return repeated and before <= 4 and sum(w in covered or any(misspelt(w, v) for v in covered) for w in q) >= 0.6 * len(q)


# Words of politeness, which may follow a repeated question.
POLITE = frozenset("please thanks thank you in advance bitte danke vielen dank s il vous te plaît merci d avance por favor gracias muchas per favore grazie obrigado alstublieft tack пожалуйста спасибо".split())

# Pushdown parser: what opens and what closes it. Elements that may stay open, as HTML allows, are not among the elements.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）"}
ELEMENTS = frozenset("a abbr article aside b blockquote body button code div dl em footer form h1 h2 h3 h4 h5 h6 head header html i main mark nav ol pre s section select span strong style sub summary sup table ul u var".split())
OPENING = re.compile(r"`+|[()\[\]{}“”„«»「」『』（）\"]|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>|\\(?:begin|end)\{[A-Za-z]+\*?\}")
LIST_MARK = re.compile(r"(?:[-*+]|\d+[.)])\s*")
ENDS_OPEN = re.compile(r"(?:^|\s)[\w\"'-]+:$|[,;(\[{/=<&+–—-]$|<\w+[^<>]*$")


def open_structure(text: str) -> bool:
    """Whether a text ends within a fence, bracket, quotation, element, environment, list item or key."""
    fence, stack = "", []
    for line in text.split("\n"):
        mark = line.strip()[:3]
        if mark in ("```", "~~~"):
            if not fence:
                fence = mark
            elif mark == fence:
                fence = ""
            continue
        if fence:
            continue
        for m in OPENING.finditer(line):
            c = m[0]
            if c[0] == "<":
                name = c.strip("</>").split()[0].lower()
                if name in ELEMENTS and not c.endswith("/>"):
                    if c[1] != "/":
                        stack.append(f"<{name}>")
                    elif f"<{name}>" in stack:  # what was left open within it ends with it
                        del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
            elif c[0] == "\\":
                if c[1] == "b":
                    stack.append(c[6:])
                elif c[4:] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(c[4:]) :]
            elif stack and (c == stack[-1] if c[0] in "`\"" else c in PAIRS.get(stack[-1], "")):
                stack.pop()
            elif c in PAIRS or c[0] in "`\"":
                if not (c == '"' and line[m.start() - 1 : m.start()].isdigit()):
                    stack.append(c)
    if fence or stack:
        return True
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    if LIST_MARK.fullmatch(last) or re.fullmatch(r"- \w{1,3}", last):
        return True
    return bool(ENDS_OPEN.search(last)) and not re.fullmatch(r"-+", last)


# A line that is a command with its options needs no full stop.
COMMAND = re.compile(r"(?:[-*+$>]\s+|\d+[.)]\s+)?[a-z][\w.-]*(?:\s+[\w./=~:@-]+)+\s+--?[a-z][\w=.-]*|(?:[-*+$>]\s+|\d+[.)]\s+)[a-z][\w.-]*\s+[a-z][\w-]*\s+[\w./=~:@-]{4,}")
ENDED = re.compile(r"[.!?。！？…।؟][\"”’»“)\]」』*_`]*$")
ELLIPSIS = re.compile(r"\w(?:\.\.\.|…)$")
OVER = re.compile(r"[\"”’»“)\]」』*_`]*(?:[.!?。！？…।؟]+[\"”’»“)\]」』*_`]*(?:\s|$)|[。！？])")
NAME_SHAPE = re.compile(r"--[a-z]+(?:-[a-z]+){2,}|[a-z]+(?:[A-Z][a-z0-9]*)+|\w+(?:_\w+)+")
NUMBER_SHAPE = re.compile(r"v?\d[\d.,]*")


def symbols(line: str) -> list[tuple[str, int]]:
    """Tokens of a line with their ends; numbers and names are made alike."""
    out = []
    for m in TOKEN.finditer(line):
        t = m[0]
        if t.isalpha() and t.islower():
            pass
        elif NAME_SHAPE.fullmatch(t):
            t = "<name>"
        elif NUMBER_SHAPE.fullmatch(t):
            t = "<number>"
        else:
            t = t.lower()
        out.append((t, m.end()))
    return out


LENGTHS = (1, 2, 3, 5)
START = "^"


@functools.lru_cache(200_000)
def _code(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 2


def _contexts(codes: np.ndarray, depth: np.ndarray) -> dict[int, np.ndarray]:
    """Of each place, by length, a hash of its last words; -1 where its sentence has fewer. ``depth`` counts from the sentence's start."""
    out = {}
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        shifted = codes.astype(np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + shifted
            shifted = np.r_[np.zeros(1, np.uint64), shifted[:-1]]
            if n in LENGTHS:
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                out[n] = np.where(depth >= n, (mixed >> np.uint64(2)).astype(np.int64), -1)
    return out


def read_words(answers: list[str]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Words of answers by their codes, the answer and depth in the sentence of each, and whether a sentence or line ends there.

    Sentences begin with START. The end of an answer counts as going on: whether it is one is the question.
    """
    codes, owner, depth, over = [], [], [], []
    for k, answer in enumerate(answers):
        lines = answer.rstrip().split("\n")
        for n, line in enumerate(lines):
            own = symbols(line)
            at = 0
            for i, (t, end) in enumerate(own):
                if not at:
                    codes.append(_code(START))
                    owner.append(k)
                    depth.append(1)
                    over.append(False)
                    at = 1
                at += 1
                last = i + 1 == len(own)
                ends = bool(OVER.match(line, end)) or last and n + 1 < len(lines)
                codes.append(_code(t))
                owner.append(k)
                depth.append(at)
                over.append(ends)
                if ends:
                    at = 0
    return codes, owner, depth, over


def contexts(answers: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each answer the hashes of the words before each place and whether a sentence or line ends there; an open end is left out."""
    codes, owner, depth, over = (np.array(x) for x in read_words(answers)) if answers else ([], [], [], [])
    if not len(codes):
        return [(np.zeros(0, np.int64), np.zeros(0, bool))] * len(answers)
    final = np.r_[owner[1:] != owner[:-1], True] & ~over
    first = codes == _code(START)
    keep = ~final & ~first
    by = _contexts(codes, depth)
    h = np.stack([by[n] for n in LENGTHS], 1)[keep]
    of, ends = np.repeat(owner[keep], len(LENGTHS)), np.repeat(over[keep], len(LENGTHS))
    h = h.ravel()
    known = h >= 0
    h, of, ends = h[known], of[known], ends[known]
    cut = np.searchsorted(of, np.arange(len(answers) + 1))
    return [(h[a:b], ends[a:b]) for a, b in zip(cut, cut[1:])]


def tail_contexts(answer: str) -> list[int]:
    """Hashes of an answer's last words, by LENGTHS, and with them those of a short last sentence from its start."""
    codes, _, depth, _ = read_words([answer.rstrip().rsplit("\n", 1)[-1]])
    if not codes:
        return []
    by = _contexts(np.array(codes[-max(LENGTHS) :]), np.array(depth[-max(LENGTHS) :]))
    return [int(by[n][-1]) for n in LENGTHS if by[n][-1] >= 0]


def judge(question: str | None, answer: str | None, kind: str | None) -> tuple[str | None, list[int]]:
    """The defect of an answer if it can be told from the pair alone; else, for an unfinished look, what to look its end up by."""
    if answer is None or is_placeholder(answer):
        return "empty", []
    text = answer.strip()
    quiet = words_of_all = 0
    for sentence in SENTENCE.split(prose(text).replace("’", "'")):
        words = WORD.findall(sentence.lower())
        if refuses(sentence, words):
            return "refusal", []
        words_of_all += len(words)
        quiet += len(words) if silent(words) else 0
    if question and quiet > 0.5 * words_of_all:
        return (None if kind == "unanswerable" else "refusal"), []
    if question and is_copy(question, text):
        return "copied_question", []
    if question and foreign(question, text):
        return "other_language", []
    if open_structure(text):
        return "truncated", []
    ellipsis = bool(ELLIPSIS.search(text))
    if ENDED.search(text) and not ellipsis:
        return None, []
    if COMMAND.fullmatch(text.split("\n")[-1].strip()) and not ellipsis:
        return None, []
    core = re.sub(r"(?:\.\.\.|…)$", "", text)
    whole = symbols(core)
    if not whole or len(whole) < 5 and "\n" not in core and not ellipsis and (whole[-1][0] in ("<name>", "<number>") or len(whole) > 1 and whole[-2][0] == "<number>" or re.search(r"[/.`%]|^[^\W_]+$", core.split()[-1]) and (whole[-1][0] not in LANGUAGES or whole[-1][0] == "only")):
        return None, []
    return None, tail_contexts(core)


JUDGED = "defect string, tail array<long>"


def defects(items: DataFrame, least_seen: int = 3, least_share: float = 0.04) -> DataFrame:
    """item_id and defect of every item (id, question, ground_truth_answer, question_type) with a broken answer."""
    row = F.struct("question", "ground_truth_answer", "question_type")
    one = items.where("id is not null").groupBy("id").agg(F.min(row).alias("r")).select("id", "r.*")

    @F.pandas_udf(JUDGED)
    def judged(q: pd.Series, a: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(*x) for x in zip(q, a, k)], columns=["defect", "tail"])

    @F.pandas_udf("array<long>")
    def seen(answers: pd.Series) -> pd.Series:
        return pd.Series([2 * x + y for x, y in contexts(answers.tolist())], dtype=object)  # the last bit says whether it ends there

    own = checkpointed(one.withColumn("j", judged("question", "ground_truth_answer", "question_type")).select("id", "ground_truth_answer", "j.defect", "j.tail"))
    certain = own.where("defect is not null").select(F.col("id").alias("item_id"), "defect")
    tails = own.where("defect is null and size(tail) > 0").select("id", F.posexplode("tail").alias("length", "h"))
    tails = checkpointed(tails)
    wanted = tails.select("h").distinct()
    # Contexts of all answers without a defect; only those that some unfinished answer ends with are counted.
    every = own.where("defect is null and ground_truth_answer is not null").where(~F.col("ground_truth_answer").rlike(r"\w(?:\.\.\.|…)\s*$"))
    every = every.select(F.explode(seen("ground_truth_answer")).alias("c")).select(F.shiftright("c", 1).alias("h"), (F.col("c") % 2 == 1).alias("over"))
    few = tails.count() < 500_000  # of 8 bytes each
    counted = every.join(F.broadcast(wanted) if few else wanted, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"), F.count_if("over").alias("ends"))
    looked = tails.join(counted, "h", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "ends": F.coalesce("ends", F.lit(0))})
    # The longest context that was seen often enough decides; without any the last word is unknown, cut within.
    w = Window.partitionBy("id").orderBy(F.desc("known"), F.desc("length"))
    decided = looked.withColumn("known", F.col("n") >= least_seen).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    cut = decided.where(~F.col("known") | (F.col("ends") < least_share * F.col("n"))).select(F.col("id").alias("item_id"), F.lit("truncated").alias("defect"))
    return certain.unionByName(cut)
