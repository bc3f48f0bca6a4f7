"""Cleaning and judging of documentation comments (C#, TypeScript, C++ styles)."""

from __future__ import annotations

import html
import re

_MARKS = re.compile(r"^\s*(?:/{2,}[!<]*|/\*+[!<]*|\*+/|\*+(?!\*))?[ \t]*|[ \t]*\*+/\s*$", re.M)
_NOTES = re.compile(
    r"<(param|typeparam|returns?|value|seealso)\b[^>]*?/>|<(param|typeparam|returns?|value|seealso)\b[^>]*>.*?(?:</\2\s*>|\Z)", re.S | re.I
)
_INHERIT = re.compile(r"<(?:inheritdoc|include)\b[^>]*?/?>(?:\s*</(?:inheritdoc|include)>)?|\{@inheritdoc[^}]*\}|[@\\](?:inheritdoc|copydoc|copybrief|copydetails|include)\b[ \t]*[\w:.#(),~]*", re.I)
_CREF = re.compile(r"""(?:cref|path)\s*=\s*["']([^"']+)["']|\{@inheritdoc\s+([^}\s]+)|[@\\]copy(?:doc|brief|details)\s+([\w:.#]+)""", re.I)
_INLINE = re.compile(r"<(?:see|paramref|typeparamref|a)\b[^>]*?/>|<(see|a)\b[^>]*>(.*?)</\1\s*>|\{@(?:link|linkcode|linkplain|code)\s+([^}]*)\}", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_BLOCK = re.compile(r"(?:(?<=\s)|^)[@\\]([A-Za-z]+)(?:\[[^\]]*\])?", re.M)
#: Block tags whose text is documentation; the text of other tags is a note, stamp or placeholder.
_SPEAKING = frozenset("brief short summary remarks remark details detail description desc note warning attention par important exception throws throw deprecated example code li pre post invariant abstract".split())
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[;\n]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[^\W\d_]+")

#: Words that say nothing about a symbol.
_ENGLISH = """
a an the this that these those its it is are was were be been being to of for from in into on at by with and or as if any all some one each given
specified passed provided supplied current new own simple simply just basic default main actual internal public private protected static virtual
abstract async asynchronously asynchronous following certain respective corresponding used use using which who what when where how via per out up over
does do done did performs executes runs gets sets returns retrieves obtains fetches implements implementation represents defines declares contains
holds creates constructs initializes instantiates makes builds allows lets enables helps utility util handles invokes calls responsible purpose see
also note details wrapper overload override overridden method function func procedure routine ctor dtor destructor operator member class struct type
object instance interface property field event enum record module namespace parameter param argument args value result void null instance-wise
variable here there you we i my your our us can may will should would
"""
_OTHERS = """
der die das ein einen des dem den und oder von zu fur für mit im auf funktion konstruktor le la les un une du de et ou pour avec dans sur méthode
fonction constructeur el los las una del y o para con en método función
"""
FILLER = frozenset(_ENGLISH.split() + _OTHERS.split())
#: Words of placeholders; a sentence of nothing else is one.
PLACEHOLDER = frozenset("""
todo fixme tbd tba tbc wip xxx hack na n none nil nothing empty blank blah bla foo bar baz asdf qwerty qwertz lorem ipsum dolor sit
amet test dummy stub placeholder temp tmp undocumented undefined unknown unspecified description descriptions documentation
documented document docs doc doku comment comments commented summary remarks text missing pending needed need required goes go
comes coming soon follow follows later add added insert write written fill describe described yet not no available provided found
please somebody someone anybody before next release self explanatory obvious trivial ditto same above below idem etc
dokumentation beschreibung kommentar fehlt folgt keine kein noch description manquante aucune documentación descripción pendiente ninguna
""".split())
_OPENERS = re.compile(r"^\W*(?:@?to[\s-]?do|fix[\s-]?me|tbd|tba|tbc|wip|xxx+|placeholder|lorem\s+ipsum|bla+h?\b|asdf|qwert[yz])\b", re.I)
_ABSENT = re.compile(
    r"^\W*(?:there\s+(?:is|was)\s+)?(?:(?:no|missing|without|add|insert|write|needs?|requires?)\b.{0,30}\b(?:comment|documentation|description|summary|docs?|remarks?|text)\b"
    r"|(?:comment|documentation|description|summary|docs?|remarks?|text)s?\b.{0,20}\b(?:pending|missing|goes?\s+here|here|to\s+(?:follow|come|be)|follows|needed|required|not\s+(?:yet\s+)?(?:available|provided|written)|tbd|todo|n/a)\b"
    r"|(?:still\s+)?to\s+be\s+(?:documented|described|done|written|defined|added|filled|completed|determined|announced)\b"
    r"|not\s+(?:yet\s+)?(?:documented|described)\b|undocumented\b)", re.I,
)
_MADE = r"(?:generated|made|written|created|produced|emitted|authored|composed|compiled|built|edited|modified|changed|updated|added|reviewed|maintained|exported|drafted|inserted|scaffolded|erzeugt|generiert|erstellt|geschrieben|généré|écrit|créé|generado|escrito|creado)"
_STAMP = re.compile(
    r"\b(?:auto|machine|tool|computer|robot|hand)[\s-]*" + _MADE + r"\b"
    r"|^\W*(?:(?:this|the)\s+[\w\s]{0,40}?(?:was|is|has\s+been|were)\s+|(?:last|first|originally|initially|automatically|automatisch|code|documentation|comment|file|stub)\s+){0,2}" + _MADE + r"\s+(?:automatically\s+)?(?:by|from|with|using|through|von|durch|mit|par|por)\b"
    r"|^\W*(?:last\s+|automatically\s+|automatisch\s+)" + _MADE + r"\b|^\W*" + _MADE + r"\s+(?:on|at|in|am|le|el)?\s*\W*(?:\d|mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"|\bdo(?:\s+not|n['’]t)\s+(?:edit|modify|change|touch|alter)\b|\bnicht\s+(?:bearbeiten|ändern)\b|\bne\s+pas\s+modifier\b|\bno\s+(?:editar|modificar)\b"
    r"|^\W*(?:authors?|owner|creator|maintainer|contact|date|version|revision|created|modified|changed|reviewer|copyright|license|licence|since|ticket)\s*[:=]|^\W*(?:copyright\b|\(c\)\s*(?:19|20)\d\d|©|\$\w+[:$])", re.I,
)


def stem(word: str) -> str:
    """A crude stem that the inflections of an English word share."""
    for suffix in ("isations", "izations", "isation", "ization", "ations", "ation", "ings", "ing", "ments", "ment", "ions", "ion", "ies", "ied", "ers", "ors", "er", "or", "ed", "es", "ly", "s"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            word = word[: -len(suffix)]
            break
    while len(word) > 3 and word[-1] in "yie":
        word = word[:-1]
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    for suffix in ("iz", "is", "at"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 4:
            return word[: -len(suffix)]
    return word


def parts(text: str) -> list[str]:
    """Lower-case words, identifiers taken apart."""
    return [w.lower() for w in _PART.findall(text)]


_FILLER_STEMS = frozenset(map(stem, FILLER))
_PLACEHOLDER_STEMS = frozenset(map(stem, PLACEHOLDER))


def inherits(comment: str) -> tuple[bool, str | None]:
    """Whether the comment takes over another's text, and whose, if it says so."""
    text = html.unescape(_MARKS.sub("", comment))
    found = _INHERIT.search(text)
    if not found or "<include" in found[0].lower():
        return False, None
    cref = _CREF.search(text)
    return True, next((g for g in cref.groups() if g), None) if cref else None


def statement(comment: str | None) -> str:
    """The text of a comment without marks, markup, entities, notes on parameters and returns, and
    inheriting tags."""
    if not comment:
        return ""
    text = _MARKS.sub("", comment.replace("\r\n", "\n"))
    text = _NOTES.sub(" ", text)
    text = _INHERIT.sub(" ", text)
    text = _INLINE.sub(lambda m: " " + (m[2] or m[3] or "") + " ", text)
    text = html.unescape(html.unescape(_TAG.sub(" ", text)))
    text = _TAG.sub(" ", _INHERIT.sub(" ", _NOTES.sub(" ", text)))
    pieces = _BLOCK.split(text)
    kept = [pieces[0]] + [body for tag, body in zip(pieces[1::2], pieces[2::2]) if tag.lower() in _SPEAKING]
    for tag, body in zip(pieces[1::2], pieces[2::2]):
        if tag.lower() not in _SPEAKING and "\n\n" in body:
            kept.append(body.split("\n\n", 1)[1])  # a blank line ends a note
    return re.sub(r"[ \t]*\n[ \t]*", "\n", "\n".join(k.strip() for k in kept)).strip()


def content_words(sentence: str, known: set[str]) -> int:
    """Words that say more than the symbol's names, its kind and filler."""
    return sum(len(w) > 1 and (s := stem(w)) not in known and w not in FILLER and s not in _FILLER_STEMS for w in parts(sentence))


def is_empty_sentence(sentence: str, known: set[str]) -> bool:
    if _OPENERS.search(sentence) or _ABSENT.search(sentence) or _STAMP.search(sentence):
        return True
    if call := re.fullmatch(r"\W*([\w.]+)\s*\([\w\s,.*&<>\[\]?:=]*\)\W*", sentence):
        sentence = call[1]  # a call or signature says what the name says
    words = [w for w in parts(sentence) if w not in FILLER and len(w) > 1]
    left = [w for w in words if stem(w) not in known and stem(w) not in _FILLER_STEMS]
    return all(w in PLACEHOLDER for w in left)


def own_names(name: str | None, fqn: str | None, key: str | None, signature: str | None, kind: str | None) -> set[str]:
    """Stems of the symbol's own and type name, its kind and its parameters."""
    text = [name or "", kind or ""]
    for path in (fqn, key):
        if path:
            segments = re.split(r"[.:#/]+", path.split("(")[0])
            text += segments[-3:]
    if signature:
        text.append(signature)
    return {stem(w) for t in text for w in parts(t)} | {stem(t.lower()) for t in text[:2]}


def judge(comment, name, fqn, key, signature, kind) -> tuple[str, str]:
    """('own', text), ('inherits', target or '') or ('none', '').  A statement beside an inheriting
    tag is the symbol's own."""
    if not comment:
        return "none", ""
    text = statement(comment)
    if text:
        known = own_names(name, fqn, key, signature, kind)
        flat = " ".join(text.split())
        whole = " ".join(w for w in re.split(r"\s+", flat))
        sentences = [s for s in _SENTENCE.split(whole) if s.strip()]
        if any(not is_empty_sentence(s, known) for s in sentences):
            return "own", flat
    taken, target = inherits(comment)
    return ("inherits", target or "") if taken else ("none", "")
