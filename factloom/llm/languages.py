"""Natural language hidden inside code (problem 3).

A file is one sequence of characters under a hidden Markov model with one state for code and one for each language; emissions are character bigrams
within a state.  Whatever lies outside comments and string literals, and identifiers, numbers, labels and commented-out code inside them, is held in
the code state, so the Viterbi search is restricted to the rest.  Transitions are sticky within a line and free between lines; with the state known
outside the spans and free at line ends the best path of a file is made of the best paths of its lines, which are searched together in blocks, those
that differ only in digits once.  A language is reported when words or ideographs in its state make a prose passage within one comment or literal.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.grammar import analyse
from factloom.functions.lexing import SPAN
from factloom.llm.common import keep_header_language, managed_files, scan, variants
from factloom.sources.tables import table

LANGUAGES = ("en", "zh", "de", "fr", "es", "ja", "ru")
STATES = ("code", *LANGUAGES)
#: Log cost of changing the state between two characters of a line.
SWITCH = 25.0
#: Weight of a state's single characters against its bigrams.
BACKED_OFF = 20.0
#: Bound of the labelled sample the emissions are fitted on, in documents and characters of each.
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARACTERS = 3000
WORDS, HAN_CHARACTERS = 4, 8

#: Seeds, so that every state has a model where the sample holds nothing of a language.
_SEEDS = {
    "code": "if (x > 15.24) return y; for i in range(3): a[i] = b.c * 2 + d; src/lib/file_name.bin let mut v = f(a, b); int n = 0; while (p != NULL) { p = p->next; } "
    "import os def g(a, b=None): return {k: v} snake_case_name CamelCaseName E352) %s %d {} x = y if z else w; auto q = std::move(r); #include <a.h> self.value += 1 &str f64 const char *s;",
    "en": "all human beings are born free and equal in dignity and rights. they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
    "everyone has the right to life, liberty and security of person. no one shall be held in slavery. what do you want to do when it rains and there is nothing left but this book"
    " everyone is entitled to all the rights and freedoms set forth in this declaration, without distinction of any kind, such as race, colour, sex, langua"
    "ge, religion, political or other opinion, national or social origin, property, birth or other status. all are equal before the law and are entitled wi"
    "thout any discrimination to equal protection of the law. no one shall be subjected to arbitrary arrest, detention or exile. everyone charged with a pe"
    "nal offence has the right to be presumed innocent until proved guilty according to law",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren. sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen. jeder hat "
    "das recht auf leben, freiheit und sicherheit der person. niemand darf in sklaverei gehalten werden. was möchtest du machen, wenn es regnet und nichts übrig ist außer diesem buch"
    " jeder hat anspruch auf alle in dieser erklärung verkündeten rechte und freiheiten, ohne irgendeinen unterschied, etwa nach rasse, hautfarbe, geschlec"
    "ht, sprache, religion, politischer oder sonstiger anschauung, nationaler oder sozialer herkunft, vermögen, geburt oder sonstigem stand. alle menschen "
    "sind vor dem gesetz gleich und haben ohne unterschied anspruch auf gleichen schutz durch das gesetz. niemand darf willkürlich festgenommen, in haft ge"
    "halten oder des landes verwiesen werden. jeder gilt als unschuldig, solange seine schuld nicht nachgewiesen ist",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits. ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de "
    "fraternité. tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. nul ne sera tenu en esclavage. que veux-tu faire quand il pleut et qu'il ne reste rien d'autre"
    " chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente déclaration, sans distinction aucune, notamment de r"
    "ace, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissa"
    "nce ou de toute autre situation. tous sont égaux devant la loi et ont droit sans distinction à une égale protection de la loi. nul ne peut être arbitr"
    "airement arrêté, détenu ni exilé. toute personne accusée est présumée innocente jusqu'à ce que sa culpabilité ait été établie. ce n'est pas encore le "
    "moment, tant que personne ne l'a demandé",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. todo "
    "individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. nadie estará sometido a esclavitud. qué quieres hacer cuando llueve y no queda más que este libro"
    " toda persona tiene los derechos y libertades proclamados en esta declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión p"
    "olítica o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. todos son iguales ante la ley"
    " y tienen, sin distinción, derecho a igual protección de la ley. nadie podrá ser arbitrariamente detenido, preso ni desterrado. toda persona acusada d"
    "e delito tiene derecho a que se presuma su inocencia mientras no se pruebe su culpabilidad",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах. они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. каждый человек "
    "имеет право на жизнь, на свободу и на личную неприкосновенность. никто не должен содержаться в рабстве. что ты хочешь делать, когда идет дождь и ничего не осталось, кроме этой книги"
    " каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей декларацией, без какого бы то ни было различия, как то в о"
    "тношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословн"
    "ого или иного положения. все люди равны перед законом и имеют право, без всякого различия, на равную защиту закона. никто не может быть подвергнут про"
    "извольному аресту, задержанию или изгнанию",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役。下雨的时候你想做什么，除了这本书什么都没有了"
    "人人有资格享有本宣言所载的一切权利和自由，不分种族、肤色、性别、语言、宗教、政治或其他见解、国籍或社会出身、财产、出生或其他身份等任何区别。法律之前人人平等，并有权享受法律的平等保护，不受任何歧视。任何人不得加以任意逮捕、拘禁或放逐。凡受刑事控告者，在未经依法证实有罪以前，有权被视为无罪",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。雨が降ってこの本しか残っていないときは何をしたいですか"
    "すべて人は、人種、皮膚の色、性、言語、宗教、政治上その他の意見、国民的若しくは社会的出身、財産、門地その他の地位又はこれに類するいかなる事由による差別をも受けることなく、この宣言に掲げるすべての権利と自由とを享有することができる。すべての人は、法の下において平等であり、また、いかなる差別もなしに法の"
    "平等な保護を受ける権利を有する。何人も、ほしいままに逮捕、拘禁、又は追放されることはない",
}

_LATIN = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" "äöüßéèêëàâçîïôùûœáíóúñ" "абвгдежзийклмнопрстуфхцчшщъыьэюяё" " '\"-.,;:!?()[]{}<>=+*/&|%#$@^~\\_`¿¡«»。，、；：（）「」・！？…—")}
_DIGIT, _HAN, _KANA, _OTHER = len(_LATIN), len(_LATIN) + 1, len(_LATIN) + 2, len(_LATIN) + 3
_SYMBOLS = _OTHER + 1
_HAN_BUCKETS = 4096
_SHARED = [_LATIN[c] for c in "\"-.,;:!?()[]{}<>=+*/&|%#$@^~\\_`"] + [_DIGIT]


def _encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Class of each character and, for ideographs, its bucket (-1 otherwise)."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    classes = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    han = np.where(classes == _HAN, points % _HAN_BUCKETS, -1)
    return classes, han


def _table() -> np.ndarray:
    classes = np.full(0x10000, _OTHER, dtype=np.int64)
    for point in range(0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        low = c.lower()
        if low in _LATIN:
            classes[point] = _LATIN[low]
        elif c.isdigit():
            classes[point] = _DIGIT
        elif c.isspace():
            classes[point] = _LATIN[" "]
        elif 0x3041 <= point <= 0x30FF:
            classes[point] = _KANA
        elif 0x3400 <= point <= 0x9FFF or point == 0x3005:
            classes[point] = _HAN
    return classes


_TABLE = _table()


class SpanModel:
    """Bigram emissions per state, with ideographs scored by their bucket besides."""

    def __init__(self, texts: dict[str, list[str]]):
        states = len(STATES)
        pairs = np.zeros((states, _SYMBOLS, _SYMBOLS))
        ideographs = np.full((states, _HAN_BUCKETS), 0.02)
        for s, state in enumerate(STATES):
            for text in (_SEEDS[state] * 3, *texts.get(state, ())):
                classes, han = _encode(" " + text[:SAMPLE_CHARACTERS])
                np.add.at(pairs[s], (classes[:-1], classes[1:]), 1.0)
                np.add.at(ideographs[s], han[han >= 0], 1.0)
        # rows seen rarely fall back on the state's own characters: else a few foreign words would look certain
        alone = pairs.sum(axis=1, keepdims=True) + 0.5
        alone /= alone.sum(axis=2, keepdims=True)
        smoothed = (pairs + BACKED_OFF * alone) / (pairs.sum(axis=2, keepdims=True) + BACKED_OFF)
        # marks and digits tell code from prose but no language from another: their probabilities are the same for all of them
        shared = smoothed[1:, :, _SHARED].mean(axis=0)
        smoothed[1:, :, _SHARED] = shared
        smoothed /= smoothed.sum(axis=2, keepdims=True)
        self.pairs = np.log(smoothed).transpose(1, 2, 0).astype(np.float32)
        self.ideographs = np.log(ideographs / ideographs.sum(axis=1, keepdims=True)).T.astype(np.float32)
        # a line begins in a language as often as the sample's documents are in it, in code as often as in any language
        documents = np.array([len(texts.get(state, ())) + 1.0 for state in LANGUAGES])
        self.start = np.log(np.concatenate([[0.5], 0.5 * documents / documents.sum()])).astype(np.float32)

    def likeliest(self, text: str) -> str:
        """Language under which a text is likeliest as a whole."""
        classes, han = _encode(" " + text)
        score = self.pairs[classes[:-1], classes[1:]].sum(axis=0) + self.ideographs[han[han >= 0]].sum(axis=0)
        return LANGUAGES[int(score[1:].argmax())]

    def paths(self, spans: list[str]) -> list[np.ndarray]:
        """Viterbi state of each character of each span, all spans of a block advancing together."""
        out: list[np.ndarray | None] = [None] * len(spans)
        order = sorted(range(len(spans)), key=lambda k: len(spans[k]))
        at = 0
        while at < len(order):
            block = [order[at]]
            at += 1
            while at < len(order) and len(spans[order[at]]) * (len(block) + 1) <= 400_000 and len(block) < 1024:
                block.append(order[at])
                at += 1
            self._block(spans, block, out)
        return out

    def _block(self, spans, block, out) -> None:
        longest = max(len(spans[k]) for k in block)
        classes = np.full((len(block), longest + 1), _LATIN[" "], dtype=np.int64)
        han = np.full((len(block), longest), -1, dtype=np.int64)
        for row, k in enumerate(block):
            c, h = _encode(spans[k])
            classes[row, 1 : len(c) + 1], han[row, : len(h)] = c, h
        score = np.tile(self.start, (len(block), 1))
        back = np.empty((longest, len(block), len(STATES)), dtype=np.int8)
        own = np.arange(len(STATES), dtype=np.int8)
        # the block is sorted by length: rows that have ended are a prefix, and each keeps the state it ended in
        lengths = np.array([len(spans[k]) for k in block])
        ended = np.searchsorted(lengths, np.arange(longest + 1), side="right")
        last = np.empty(len(block), dtype=np.int64)
        for t in range(longest):
            live = slice(ended[t], None)
            current = score[live]
            best = current.argmax(axis=1)
            top = np.take_along_axis(current, best[:, None], 1) - np.float32(SWITCH)
            stay = current >= top
            back[t, live] = np.where(stay, own, best[:, None].astype(np.int8))
            current = np.where(stay, current, top) + self.pairs[classes[live, t], classes[live, t + 1]]
            ideograph = np.nonzero(han[live, t] >= 0)[0]
            if len(ideograph):
                current[ideograph] += self.ideographs[han[live, t][ideograph]]
            score[live] = current
            done = ended[t + 1] - ended[t]
            if done:
                last[ended[t] : ended[t + 1]] = current[:done].argmax(axis=1)
        path = np.empty((longest, len(block)), dtype=np.int8)
        state = last.copy()
        for t in range(longest - 1, -1, -1):
            live = slice(ended[t], None)
            path[t, live] = state[live]
            state[live] = back[t, live][np.arange(len(block) - ended[t]), state[live]]
        for row, k in enumerate(block):
            out[k] = path[: lengths[row], row]


_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_IDEOGRAPH = re.compile("[\u3041-\u30ff\u3400-\u9fff\u3005]")
_IDENTIFIER = re.compile(r"[A-Za-z0-9_]*(?:_[A-Za-z0-9]|[A-Za-z]\d|\d[A-Za-z])[A-Za-z0-9_]*|[A-Za-z0-9_-]+(?:[./\\][A-Za-z0-9_-]+)+|^\s*[^\W\d_]+(?: [^\W\d_]+)?:(?=\s|$)|%[sdif]|\{[^{}\n]*\}", re.M)
_CODE_LINE = re.compile(
    r"^\s*(?:(?:if|while|for|switch)\s*\(.*\).*[;{]?|(?:if|elif|while)\s.*[<>=!]=?\s*[-\w.]+\s*(?::.*|\{.*)|for\s.*\s(?:in|=)\s.*[:{;].*|(?:return|break|continue|raise|goto)\b[^;]*;"
    r"|return\s+[\w.]+(?:\s*[-+*/]\s*[\w.]+)*\s*|[\w.\[\]>*&:-]+(?:\s+[\w*&]+)*\s*(?:[-+*/|&^]?=|:=)\s*[^=].*|.*[;{}]\s*|(?:from\s+\S+\s+)?import\s+[\w., *]+|(?:use|#include|let|def|fn|class|struct)\s+\S+.*[;:{>)].*|[\w.:]+\(.*\);?)\s*$"
)
#: Words that code and prose share or that only code has; they are no evidence of prose by themselves.
_KEYWORDS = frozenset(
    "if else elif for while do switch case default break continue return goto raise try except finally with as in is not and or lambda yield await async def class pass del import from global "
    "fn let mut pub use mod impl trait struct enum union match loop move ref where type dyn unsafe crate self super const static extern inline volatile register constexpr mutable virtual explicit "
    "unsigned signed long short int char float double bool void auto typedef typename template using namespace operator new delete throw sizeof public private protected true false none null nullptr".split()
)
#: Words in a row: blanks between them, besides punctuation after a word, numbers, and brackets around words.
_IN_A_ROW = re.compile(r"(?<![\w.])[^\W\d_]+(?:['’-][^\W\d_]+)*(?:[,.:;!?)\"»]*\s+(?:[(#]*\d[\d.,]*[),.:;]*\s+)*[(\"«]*[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w(\[]))+")
_PLAIN_PAIR = re.compile(r"(?=(?<![^\W\d_])([^\W\d_]+(?:['’-][^\W\d_]+)*)\s+([^\W\d_]+))")
_MARKERS = re.compile(r"^[ \t]*(?://[/!]*|/\*+!?|\*+/?|#+!?)[ \t]?", re.M)
_ESCAPES = re.compile(r"\\(?:u\{([0-9a-fA-F_]+)\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|((?:x[0-9a-fA-F]{2}\\?)+)|([0-7]{1,3})|N\{([^}]*)\}|(\r?\n[ \t]*)|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": " ", "b": " ", "f": " ", "v": " ", "0": " "}
_BYTE_RUN = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3})+")


def unescape(body: str) -> str:
    """Characters that the escapes of a literal stand for; runs of byte escapes are read as UTF-8 where they are valid."""
    if "\\" not in body:
        return body

    def run(m: re.Match) -> str:
        raw = bytes(int(x[1:], 16) if x[0] == "x" else int(x, 8) & 255 for x in m[0].split("\\")[1:])
        try:
            return raw.decode("utf-8") if max(raw) > 127 else raw.decode("latin-1").replace("\\", " ")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    def one(m: re.Match) -> str:
        point = m[1] or m[2] or m[3]
        if point:
            value = int(point.replace("_", ""), 16)
            return chr(value) if value < 0x110000 else " "
        if m[6]:
            import unicodedata

            try:
                return unicodedata.lookup(m[6])
            except KeyError:
                return " "
        if m[7]:
            return ""
        return _SIMPLE.get(m[8], m[8] or " ")

    text = _ESCAPES.sub(one, _BYTE_RUN.sub(run, body))
    if any("\ud800" <= c <= "\udfff" for c in text):
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


_QUOTED = re.compile(r"^[A-Za-z0-9]{0,3}(#*)(\"\"\"|'''|\"|')([\s\S]*?)\2\1$")


def literal_text(token: str) -> str:
    """What a string literal says."""
    m = _QUOTED.match(token)
    if not m:
        return token
    prefix = token[: m.start(2)].lower()
    body = m[3]
    if "f" in prefix:
        body = re.sub(r"\{[^{}]*\}", " ", body)
    if "r" in prefix and token[: m.start(2)].lower() not in ("u8", "u"):
        raw = re.match(r"([^()\\\s\"]{0,16})\(([\s\S]*)\)\1$", body) if prefix.endswith("r") else None
        return raw[2] if raw else body
    return unescape(body)


def is_code(line: str) -> bool:
    """Whether a comment line is commented-out code: of its form, and without WORDS words in a row that hold two plain ones side by side."""
    if not _CODE_LINE.match(line) or _IDEOGRAPH.search(line):
        return False
    for row in _IN_A_ROW.finditer(_IDENTIFIER.sub(" ", line)):
        if len(_WORD.findall(row[0])) >= WORDS and any(a.lower() not in _KEYWORDS and b.lower() not in _KEYWORDS for a, b in _PLAIN_PAIR.findall(row[0])):
            return False
    return True


def comment_text(token: str) -> str:
    """A comment without its markers, commented-out code dropped line by line."""
    body = re.sub(r"\*+/\s*$", "", token) if token.startswith("/*") else token
    lines = _MARKERS.sub("", body).split("\n")
    return "\n".join("" if is_code(line) else line for line in lines)


_DIGITS = re.compile(r"\d+")
_CANDIDATE = re.compile(r"[^\W\d_]{2}[,.;:!?)]*\s+(?:\S+\s+)*?[^\W\d_]")


_BLANK = re.compile(r"\s+")


def prepared(text: str) -> str | None:
    """Normal form of a span that can hold a passage at all (identifiers, labels and blank runs gone, digits alike), else ``None``."""
    if len(_IDEOGRAPH.findall(text)) < HAN_CHARACTERS and not _CANDIDATE.search(text):
        return None
    clean = _BLANK.sub(" ", _IDENTIFIER.sub(" ", text)).strip()
    if len(_IDEOGRAPH.findall(clean)) < HAN_CHARACTERS and len(_WORD.findall(clean)) < WORDS:
        return None
    return _DIGITS.sub("0", clean)


def _words_in_a_row(text: str) -> int:
    """Words of a text, those with ideographs apart."""
    words = _WORD.findall(text)
    return len(words) if text.isascii() else sum(1 for w in words if not _IDEOGRAPH.search(w))


def passages(text: str, path: np.ndarray) -> dict[str, int]:
    """Languages with a prose passage in the decoded normal form, and how many of its characters each of them takes."""
    first = int(path[0]) if len(path) else 0
    if not (path != first).any():
        language = STATES[first]
        if language == "code":
            return {}
        if language in ("zh", "ja"):
            held = len(_IDEOGRAPH.findall(text)) >= HAN_CHARACTERS
        else:
            held = _words_in_a_row(text) >= WORDS
        return {language: len(path)} if held else {}
    best: dict[str, int] = defaultdict(int)
    run, count = None, 0
    for m in _WORD.finditer(text):
        if _IDEOGRAPH.search(m[0]):
            continue
        s = STATES[np.bincount(path[m.start() : m.end()], minlength=len(STATES)).argmax()]
        run, count = s, count + 1 if s == run else 1
        best[s] = max(best[s], count)
    out: dict[str, int] = {}
    for k, language in enumerate(STATES):
        if language in ("zh", "ja"):
            if sum(1 for m in _IDEOGRAPH.finditer(text) if path[m.start()] == k) >= HAN_CHARACTERS:
                out[language] = int((path == k).sum())
        elif language != "code" and best.get(language, 0) >= WORDS:
            out[language] = int((path == k).sum())
    return out


def prose_spans(lexed: list[str], language: str) -> list[tuple[str, float]]:
    """Comments and string literals of a file as ``(text, characters of the file per character of it)``.

    Adjacent line comments make one span, comments before the first code are left out, those inside directives count like all others.
    """
    quotes = ('"', "'") if language == "python" else ('"',)
    out: list[tuple[str, float]] = []
    block: list[str] = []
    seen_code = False

    def literal(token: str) -> None:
        text = literal_text(token)
        out.append((text, (len(token) - 2) / len(text) if "\\" in token and text else 1.0))

    def flush() -> None:
        if block:
            out.append((comment_text("\n".join(block)), 1.0))
            block.clear()

    for token in lexed:
        first = token[0]
        if (first == "/" and token[1:2] in ("/", "*")) or (first == "#" and language == "python"):
            if seen_code:
                if token[:2] == "/*":
                    flush()
                    out.append((comment_text(token), 1.0))
                else:
                    block.append(token)
            continue
        seen_code = True
        if block:
            flush()
        if first == "#" and language in ("c", "cpp"):
            for m in SPAN[language].finditer(token):
                if m.lastgroup == "c":
                    out.append((comment_text(m[0]), 1.0))
                elif m.lastgroup == "s":
                    literal(m[0])
        elif len(token) > 5 and token[-1] in quotes or (token[-1] == "#" and '"' in token and language == "rust"):
            if not (language == "rust" and token[0] in "bc" and token[1:2] == "'"):
                literal(token)
    flush()
    return out


_cache: dict[str, dict[str, int]] = {}


def _short(line: str) -> bool:
    """Whether a line alone cannot hold a passage but has words or ideographs that may be part of one."""
    # plain words stay when identifiers and labels go, but for the first word of a label
    if sum(map(str.isalpha, line.split())) > WORDS and line.isascii():
        return False
    clean = _IDENTIFIER.sub(" ", line)
    return len(_IDEOGRAPH.findall(clean)) < HAN_CHARACTERS and 0 < len(_WORD.findall(clean)) < WORDS


def pieces(text: str) -> list[str]:
    """Lines of a span; ones too short to hold a passage go with the line before them, so that wrapped passages stay whole."""
    if "\n" not in text:
        return [text]
    out: list[str] = []
    joins = False
    for line in text.split("\n"):
        short = bool(line) and not line.isspace() and _short(line)
        if short and joins:
            out[-1] += ("" if _IDEOGRAPH.search(line) else " ") + line
        else:
            out.append(line)
        joins = bool(line) and not line.isspace()
    return out


def decode_spans(model: SpanModel, spans: list[tuple[str, float]]) -> list[dict[str, float]]:
    """Languages of each span ``(text, characters of the file that one of its characters takes)`` with the characters of the file that each takes."""
    forms = [[(f, len(p.strip()) * scale) for p in pieces(text) if (f := prepared(p)) is not None] for text, scale in spans]
    missing = list({f for own in forms for f, _ in own if f not in _cache})
    if missing:
        if len(_cache) > 400_000:
            _cache.clear()
            missing = list({f for own in forms for f, _ in own})
        for form, path in zip(missing, model.paths(missing)):
            _cache[form] = passages(form, path)
    out: list[dict[str, float]] = []
    for own in forms:
        total: dict[str, float] = defaultdict(float)
        for form, characters in own:
            for k, n in _cache[form].items():
                total[k] += characters * n / len(form)
        out.append(total)
    return out


def fit(spark: SparkSession, directory: str) -> SpanModel:
    """Fit the emissions on at most SAMPLE_DOCUMENTS documents with a language label, without those whose label a model of the seeds denies."""
    labelled = (
        table(spark, directory, "documents")
        .select("doc_id", F.lower("lang").alias("lang"), "text")
        .filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull() & ~F.col("text").rlike(r"[;{}]\s*\n|^(import|use|#include) |def \w+\(|```"))
    )
    # ids alone are ranked: each partition would else send the driver the texts of a whole sample
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    rows = labelled.join(F.broadcast(chosen.distinct()), "doc_id").select("lang", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text")).collect()
    return fitted([(row.lang, row.text) for row in rows])


def fitted(labelled: list[tuple[str, str]]) -> SpanModel:
    """Model of the labelled texts that the seeds' model agrees with."""
    seeds = SpanModel({})
    texts: dict[str, list[str]] = defaultdict(list)
    for language, text in labelled:
        if seeds.likeliest(text) == language:
            texts[language].append(text)
    return SpanModel(texts)


def language_shares(spark: SparkSession, directory: str) -> DataFrame:
    """``(file_id, lang, characters, share)``: languages of each valid managed file and the part of its characters that each takes.

    Files without text or without a passage give no row; null contents are skipped; repeated deliveries count once.
    """
    model = spark.sparkContext.broadcast(fit(spark, directory))

    def per_slice(columns):
        files, spans = [], []
        for file_id, path, content in zip(columns["file_id"], columns["relative_path"], columns["content"]):
            held = None
            for language in variants(path):
                problem, text, lexed = analyse(content, language, words=False)
                if problem is None and lexed:
                    if held is None or held[0] is not lexed:  # a header's tokens are the same in both languages
                        begin = len(spans)
                        spans += prose_spans(lexed, language)
                        held = lexed, begin, len(spans)
                    files.append((file_id, path, language, len(text), *held[1:]))
        decoded = decode_spans(model.value, spans)
        for file_id, path, language, size, a, b in files:
            total: dict[str, float] = defaultdict(float)
            for d in decoded[a:b]:
                for k, n in d.items():
                    total[k] += n
            for k, n in total.items():
                yield file_id, path, language, k, round(n), min(1.0, n / size)

    rows = scan(managed_files(spark, directory), per_slice, "file_id bigint, relative_path string, language string, lang string, characters bigint, share double")
    kept = keep_header_language(rows, spark, directory)
    return kept.groupBy("file_id", "lang").agg(F.max("characters").alias("characters"), F.round(F.max("share"), 6).alias("share"))


def found(spark: SparkSession, directory: str) -> DataFrame:
    """``p3_found(file_id, lang)``."""
    return language_shares(spark, directory).select("file_id", "lang")
