"""The running English prose of a text, sentence by sentence, whatever dress it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter

from millrace.llm.leakage import BREAKS, BROKEN, ESCAPE, INVISIBLE, TAG

MARKS = re.compile(r"[ \t]*(//+|#+|--|>|\*|%|;+)(?=[ \t]|$)")
BULLET = re.compile(r"\s*(?:[-*+\u2022]|\d{1,3}[.)]|[a-z][.)])\s+")
HEADING = re.compile(r"\s*#{1,6}\s")
LOG = re.compile(r"\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|.*\b(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE)\b.*[=:]")
CODE = re.compile(r"\s*(?:func\b.*[({]|(?:type|var|const|package|import|return|defer|go|case|switch|select)\b.*[({=\[\":]|[}\])]+[,;)]*\s*$|default:|.*[{;]\s*$|@\w+)|\t")
CODE_CHARS = re.compile(r"[{}()\[\]<>=;|&_$\\]")
CODE_SIGN = re.compile(r"[{}()\[\]<>=;|&_$\\\t@]|^\s*(?:package|import|return|default|[})\]])")
ENDS = re.compile(r"[.!?][\"')\]\u201d\u2019*_`]*(?:\s|$)")
ABBREVIATION = re.compile(r"\b(e\.g|i\.e|cf|etc|vs|approx|resp|viz|al|fig|no|vol|dr|mr|mrs|prof)\.", re.I)
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]\u201d\u2019]*\s+(?=[\"'(\[\u201c\u2018]*[^\W\d_]|[\"'(]*\d)")
WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)?")
#: Articles, prepositions, pronouns and auxiliaries, for texts without any language labels.
FUNCTION_WORDS = {
    "en": frozenset("the of and to a is that it in for with as by on not be are this which an or its we my your you do if why has have no into when can one how what was were should would must any each at from but so".split()),
    "de": frozenset("der die das und den dem des ein eine nicht mit von zu ist für auf im sich auch es wird nach vor ohne über".split()),
    "es": frozenset("el la los las y de que en un una por con para del se no su al más sin después antes".split()),
    "fr": frozenset("le la les et de des que un une pour dans est pas sur au du en ce qui ne plus sans après avant".split()),
}


def undressed(text: str) -> list[str]:
    """Lines of a text without escapes, mark-up, invisible characters and the comment or quote marks before them."""
    if text.lstrip("\ufeff \t\r\n").startswith(('{"', '"', "[")) and "\\" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else (m[3] or "\n"), text)
        text = re.sub(r'(?:^|,)\s*[{\[]*\s*(?:"\w+"\s*:\s*(?:\d+\s*,\s*|"(?=[^"]*))|")', "\n\n", text)
        text = re.sub(r'"\s*[}\]]*\s*(?=\n|$)', "\n", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", BREAKS.sub("\n\n", text))
    if not text.isascii():
        text = INVISIBLE.sub("", text).replace("\u00a0", " ")
    lines = [x.rstrip() for x in text.split("\n")]
    filled = [x for x in lines if x]
    marked = [m.group(1)[:2] if (m := MARKS.match(x)) else "" for x in filled]
    if marked:
        mark, n = Counter(marked).most_common(1)[0]
        if mark and n >= 0.9 * len(filled) and (mark[0] not in "#*" or n >= 3):
            same = sum(1 for m in marked if m[:1] == mark[:1])
            if same >= 0.9 * len(filled) and not (mark[0] == "#" and max(len(x) for x in filled) < 60):
                lines = [MARKS.sub("", x, count=1) if x else x for x in lines]
                lines = [x[1:] if x.startswith(" ") else x for x in lines]
    return [re.sub(r"^[ \t]*(?:>[ \t]?)+|^[ \t]*//+[ \t]?", "", x) if x.lstrip()[:1] in (">", "/") else x for x in lines]


def paragraphs(text: str) -> list[str]:
    """Paragraphs of running prose, without code, logs, headings and lists of terms; any language."""
    out: list[str] = []
    now: list[str] = []
    fence = False

    def flush() -> None:
        if now:
            joined = BROKEN.sub("", "\n".join(now)) if any(x.endswith("-") for x in now) else "\n".join(now)
            joined = " ".join(joined.split())
            if joined.count(" ") >= 2 and ENDS.search(joined):
                out.append(joined)
            now.clear()

    for line in undressed(text):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            flush()
            fence = not fence
            continue
        if fence:
            continue
        if not bare or (bare[0] == "#" and HEADING.match(line)) or ((bare[0] in "[0123456789" or "=" in bare) and LOG.match(line)):
            flush()
            continue
        if not bare[0].isupper() and (m := BULLET.match(line)):
            flush()
            rest = line[m.end() :]
            if len(rest.split()) >= 6 and rest[-1:] in ".!?":
                now.append(rest)
            elif len(rest.split()) >= 9 and rest[:1].isupper():
                now.append(rest)
            continue
        if CODE_SIGN.search(line) and (CODE.match(line) or len(CODE_CHARS.findall(bare)) > 0.06 * len(bare) + 1):
            flush()
            continue
        now.append(bare)
    flush()
    return out


def english(words: list[str]) -> bool:
    """Whether function words tell English rather than another of the languages known."""
    en, *others = (sum(map(v.__contains__, words)) for v in FUNCTION_WORDS.values())
    return en > 0 and en >= 1.2 * max(others)


def split_sentences(paragraph: str) -> list[str]:
    """The sentences of a paragraph in lower case."""
    p = paragraph
    if "." in p[:-1]:
        p = ABBREVIATION.sub(lambda m: m[1].replace(".", "\u2024") + "\u2024", p)
    return [s.replace("\u2024", ".").lower() for s in SENTENCE.split(p) if s.count(" ") >= 2]


def sentences(text: str) -> list[str]:
    """English prose sentences in lower case, the language told by function words."""
    return [s for p in paragraphs(text) if english(p.lower().split()) for s in split_sentences(p)]
