"""Natural-language sentences: where they are in a piece of text, and in which of eight languages."""

from __future__ import annotations

import math
import re
from functools import lru_cache

#: Function words by language. Fixed values.
FUNCTION_WORDS = {
    "en": "a about after all also an and any are as at be because been before being both but by can cannot could did do does down each even every first for from had has have how if in into is it its long may more must never no not of off on once one only or other our out over same should so some still such than that the their them then there these they this those through to too under until up upon us use used very was we what when where whether which while who why will with without would you your",
    "de": "aber alle allem allen als also am an auch auf aus bei beim bereits bevor bis bitte da dabei dafür damit danach dann darf das dass dem den denn der des deshalb die dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines einmal er es falls für gegen gibt hat haben hier ich ihm ihn ihr ihre im immer in ins ist ja jede jedem jeden jeder jedes jedoch jetzt kann kein keine keinen könnte man mehr mit muss müssen nach nicht nichts noch nun nur ob oder ohne schon sehr sein seine selbst sich sie sind so sobald sofern sollte solange sondern über um und uns unter vom von vor war warum was weder weil weiter welche wenn wer werden weshalb wie wieder wird wo wurde wurden zu zum zur zwischen",
    "fr": "afin ainsi alors après au aucun aucune aussi autre aux avant avec avoir bien car ce ceci cela celle celui ces cet cette chaque comme contre dans de depuis des dès deux doit donc dont du elle elles en encore entre est et était été être faut fois font ici il ils jamais je jusqu la le les leur leurs lorsque lui mais même mieux moins ne ni non nous on ont ou où par parce pas peu peut peuvent plus plusieurs pour pourquoi pourrait puis quand que quel quelle qui quoi rien sa sans se selon sera ses si soit son sont sous suite sur tant tous tout toute toutes très trop un une vaut vers vous à",
    "es": "a al algo alguna alguno antes aquí así aunque bien cada casi como con contra cual cuando cuanto de debe del desde después donde dos durante e el ella ellos en entonces entre era es esa ese eso esta está estaba estado están este esto estos fue ha haber había hace hasta hay la las le les lo los luego mal más mejor menos mi mientras mismo mucho muy nada ni ningún ninguna no nos o otra otro para parece pero poco por porque primero puede pueden pues que qué quien se sea según ser si sido siempre sin sobre solo son su sus también tan tanto todavía todo todos tras tu un una uno usted vez y ya",
    "pt": "a agora ainda além ali antes ao aos apenas aqui as assim até bem cada com como contra da das de dela dele depois desde deve do dos e é ela ele eles em enquanto entre era essa esse esta está estão estava este estiver eu foi foram for há isso isto já lhe lo logo mais mas melhor menos mesmo muito na não nada nas nem nenhum nenhuma no nos nós nossa o onde os ou outra outro para pela pelas pelo pelos pode podem porque por pois porém pouco qual quando que quem se seja sem sempre ser seu seus sim só sob sobre sua suas são também tão tem tinha toda todas todo todos tudo um uma vai você vez vezes à às",
}
#: Function words of languages that are not asked for: what speaks one of them is none of the others. Fixed values.
OTHERS = {
    "it": "a al alla anche ancora che chi ci come con cosa da dal dalla degli dei del della delle dello di dopo dove e è ed fra già gli ha hanno i il in io la le lei lo loro lui ma mentre mi molto ne nel nella nelle nello non nostro o ogni per perché più poi prima può quale quando quello questa questi questo se senza si sia sono sopra sotto sua sul sulla suo tra tutti tutto un una uno",
    "nl": "aan al alle als bij daar dan dat de den deze die dit door een en er geen had heb hebben heeft het hier hij hoe hun ik in is je kan maar meer met mijn na naar niet nog nu of om omdat ook op over te toch toen tot uit van veel voor waar was wat werd wie wij wordt zal ze zich zijn zo zonder",
    "sv": "alla att av bara bli den det dig din du där efter eller en ett från för genom ha hade han har hon hur här i inte jag kan kunde man med men mig min mot mycket ni nu någon när och om oss på sedan sig sin ska som så till under upp ut utan var vara vi vid är över",
    "pl": "a ale bardzo bez być czy dla do gdy gdzie go i ich ile ja jak jako je jego jej jest jeszcze już każdy która które który lub ma mnie może na nad nie niż o od on ona oni pod po przed przez przy są się tak tam te tego tej ten to tu tylko w we więc wszystko z za ze że",
}
LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
MIN_WORDS, MIN_UNSPACED = 5, 10

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_KANA = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]")
_UNSPACED = re.compile(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ々〆〇]")
_UNSPACED_RUN = re.compile(r"(?:[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ々〆〇、，：；・ー「」『』（）]|(?<=[぀-鿿])[ \n]+(?=[぀-鿿])){10,}")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_END = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+|(?<=[。！？])|\n\s*\n|:\s*\n")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Marks of code in a line; two of them, or one at its end, make it code.
_CODE_END = re.compile(r"[{;}]\s*$|\)\s*[:{]\s*$|^\s*(?:end|[})\]]+[;,]?)\s*$|^\s*@\w+\s*$")
_CODE_MARK = re.compile(r":=|=>|->|[=!<>]=|\+=|-=|\|\||&&|<<|>>|\w\.\w+\(|\w\[|\(\)|\s=\s|\w=\w|[{}\[\]|\\$]|::|\w_\w|\w\(\w*\)|'\w+'|\"\w+\"|\w\(['\"]")
_QUERY = re.compile(r"^\s*(?:SELECT\b.*\bFROM|INSERT\s+INTO|UPDATE\b.*\bSET|DELETE\s+FROM|CREATE\s+(?:TABLE|INDEX|VIEW|DATABASE)|ALTER\s+TABLE|DROP\s+TABLE|MERGE\s+INTO|WITH\s+\w+\s+AS)\b", re.S)
_QUERY_LOW = re.compile(r"^\s*(?:select\b.*\bfrom\b|insert\s+into\b|update\b.*\bset\b|delete\s+from\b).*[=*<>;?]", re.S | re.I)
_COMMAND = re.compile(r"^\s*(?:\$\s+|>\s+)?(?:sudo|git|npm|npx|yarn|pip3?|python3?|node|docker|kubectl|curl|wget|make|cmake|cargo|go|mvn|gradle|rm|cp|mv|ls|cd|cat|grep|sed|awk|tar|ssh|scp|rsync|chmod|export|bash|sh|apt(?:-get)?|brew|psql|mysql|openssl|find)\s+(?:[-\w./~$]|[\"'])")
_FLAG = re.compile(r"(?:^|\s)--?[A-Za-z][\w-]*|\s[./~][\w./-]+|\s\|\s|\s&&\s|\w=\S")
_PATHLIKE = re.compile(r"\S*[/\\]\S+[/\\]\S*|\w+://\S+|\S+\.\w{1,5}(?=[\s,;:]|$)|`[^`]*`|\S*_\S*|\S*\d\S*[^\W\d]\S*|[^\s\d]*[^\W\d]\S*\d\S*|\S{25,}|\b[a-z]+[A-Z]\w*")


RANK = {x: i for i, x in enumerate((*LANGUAGES, *OTHERS))}


@lru_cache(maxsize=1)
def weights() -> dict[str, list[tuple[str, float]]]:
    """word -> (language, vote): the rarer a word is among languages, the more it says."""
    of: dict[str, list[str]] = {}
    for language, words in FUNCTION_WORDS.items():
        for w in words.split():
            of.setdefault(w, []).append(language)
    n = len(FUNCTION_WORDS)
    out = {w: [(x, math.log(1 + n / len(ls)) - (0.6 if len(ls) > 2 else 0.0)) for x in ls] for w, ls in of.items()}
    for language, words in OTHERS.items():
        for w in words.split():
            shared = len(of.get(w, ())) + sum(w in ws.split() for ws in OTHERS.values())
            out.setdefault(w, []).append((language, math.log(1 + n / shared)))
    return out


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, votes in weights().items():
        a.add_word(f" {w} ", votes)
    a.make_automaton()
    return a


#: Lines without any of these are words: no mark of code, no end of code, no query and no command.
_SUSPECT = re.compile(r"[{}()\[\];:=<>|&$\\_'\"@*?+/~-]|\w\.\w|\s\.\w|^\s*end\s*$|^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|MERGE|WITH)\b")


def code_like(line: str) -> bool:
    """Whether a line is code, a query, a command or a list of paths and keys rather than words."""
    if not _SUSPECT.search(line):
        return False
    if _CODE_END.search(line):
        return True
    marks = len(_CODE_MARK.findall(line))
    if marks and marks * 6 > len(line.split()):
        return True
    if _QUERY.search(line) or _QUERY_LOW.search(line):
        return True
    return bool(_COMMAND.search(line) and _FLAG.search(line))


def sentences(text: str) -> list[str]:
    """Pieces of a text that can be sentences: cut at their ends and at blank lines, lines joined."""
    return [" ".join(s.split()) for s in _END.split(text) if s and not s.isspace()]


def spoken(pieces: list[str]) -> list[str | None]:
    """The language of each piece that is a sentence, else None: one automaton pass over all of them."""
    out: list[str | None] = [None] * len(pieces)
    latin: list[tuple[int, str]] = []
    for i, piece in enumerate(pieces):
        if not piece.isascii():
            if _UNSPACED.search(piece):
                if m := _UNSPACED_RUN.search(piece):
                    out[i] = "ja" if _KANA.search(piece) else "zh"
                    continue
            elif _CYRILLIC.search(piece):
                words = WORD.findall(piece)
                if sum(1 for w in words if _CYRILLIC.match(w)) >= MIN_WORDS:
                    out[i] = "ru"
                    continue
        if len(piece) < 12 or piece.count(" ") < MIN_WORDS - 1 or "-----BEGIN" in piece or code_like(piece):
            continue
        bare = _PATHLIKE.sub(" ", piece)
        letters = _NOT_LETTERS.sub(" ", bare.lower()).strip()
        if letters.count(" ") >= MIN_WORDS - 1:
            latin.append((i, letters))
    if latin:
        starts, parts, at = [], [], 0
        for _, letters in latin:
            starts.append(at)
            parts.append(f" {letters} ")
            at += len(letters) + 3
        joined = "|".join(parts)
        votes: list[dict[str, float]] = [{} for _ in latin]
        k, last = 0, len(starts) - 1
        for end, words in automaton().iter(joined):
            while k < last and starts[k + 1] <= end - 1:
                k += 1
            v = votes[k]
            for language, w in words:
                v[language] = v.get(language, 0.0) + w
        for (i, letters), v in zip(latin, votes):
            if v:
                best = max(v, key=lambda x: (v[x], -RANK[x]))
                if v[best] >= 1.0 and best in FUNCTION_WORDS:
                    out[i] = best
    return out


_TAG = re.compile(r"^\s*(?:[@\\](?!inheritDoc)\w+|:(?:param|returns?|rtype|raises?|type|throws)\b[^:]*:|\{@inheritDoc\}|@inheritDoc).*$", re.M)
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|tbd|xxx|hack|wip)\b[\s:.\-]*", re.I)
_DUMMY = re.compile(r"^\W*(?:lorem ipsum|to be (?:written|done|documented)|fill in)\b", re.I)
_TOOL = re.compile(r"^\W*(?:eslint|jshint|jslint|tslint|prettier|istanbul|c8|noqa|nosec|pylint|mypy|pyright|type:|flake8|pragma|rubocop|nolint|go:|lint:|golint|clang-format|clang-tidy|rustfmt|clippy|@ts-|ts-|checkstyle|suppress|spotless|NOSONAR|cspell|coverage|fmt:|yapf|isort|formatter|frozen_string_literal|encoding:|sourceMappingURL|@formatter|cppcheck|iwyu|webpack|@flow|@jsx|vim?:)", re.I)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_FILLER = frozenset("a an the this that function method procedure routine constructor of for to and or is are it its returns return returned param params parameter parameters value values argument arguments given takes gets sets does do description docstring undocumented see above below none no todo tbd".split())


def informative(doc: str | None, name: str, params: list[str], least: int = 4) -> bool:
    """Whether documentation tells more than a name and its parameters do: a real sentence in any language."""
    if not doc or not doc.strip():
        return False
    body = _TAG.sub("", doc)
    lines = []
    for line in body.split("\n"):
        line = _PLACEHOLDER.sub("", line.strip())
        if not line or _TOOL.match(line) or _DUMMY.match(line) or code_like(line):
            continue
        lines.append(line)
    text = " ".join(lines)
    if len(_UNSPACED.findall(text)) >= 8:
        return True
    known = {w.lower() for x in (name, *params) for w in (*_CAMEL.findall(x), x)}
    told = [w for w in WORD.findall(text) if w.lower() not in known]
    return len(told) >= least and sum(1 for w in told if w.lower() not in _FILLER) >= 2 and len(WORD.findall(text)) >= least + 1
