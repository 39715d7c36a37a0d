"""Personal information in free text, found behind its disguises and replaced by typed placeholders.

A ``Tape`` holds a text together with the source span of every character. Transducers rewrite it step by step (width,
look-alike letters and kinds of blanks; digits spelled as words; at and dot spelled out or bracketed) and carry the spans
along; identifiers are recognised on the rewritten text, and their ends are mapped back to source characters, so that
what is replaced is exactly what the writer wrote.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.lookalike import LOOKS

TYPES = ("email", "phone", "id_number", "address", "name")


class Tape:
    """A text and where each of its characters comes from; spans are kept only once something moved."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, None, None

    def _spans(self) -> None:
        if self.starts is None:
            n = len(self.text)
            self.starts, self.ends = list(range(n)), list(range(1, n + 1))

    def drop(self, pattern: re.Pattern[str]) -> None:
        self.rewrite(pattern, lambda m: "")

    def rewrite(self, pattern: re.Pattern[str], to: Callable[[re.Match[str]], str]) -> None:
        """Replaces matches; every new character gets the span of the whole match."""
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new == m[0]:
                continue
            self._spans()
            a, b = m.span()
            out += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*out, self.text[at:]])
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


_HIDDEN = re.compile("[­͏᠎​-‏⁠-⁤﻿]")
_ODD = re.compile("[   -   ‐-―−⁄＀-￯　]")
_MIXED = re.compile(r"[^\W\d_]+")
_TWIN = {c: same["latin"] for c, same in LOOKS.items()}
_ASCII = re.compile(r"[a-zA-Z]")
# Names of the digits.
_DIGITS = {
    w: str(n)
    for row in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve", "ноль один два три четыре пять шесть семь восемь девять", "oh ein zwo")
    for n, w in enumerate(row.split())
} | {"oh": "0"}
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)\b(?:{_WORD})(?:[\s,\-]+(?:{_WORD}|\d))+\b|(?<=\d)(?:[\s\-]+(?:{_WORD}))+\b")
_ONE = re.compile(rf"(?i)({_WORD})|\d")
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT, _DOT = r"\s*[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*", r"\s*[\[({<]\s*(?:dot|\.|punto|punkt|point)\s*[\])}>]\s*"
_SPELLED_MAIL = re.compile(rf"(?i)([\w.+'-]*\w)(?:{_AT}|\s+(?:at|arroba|ät)\s+(?=[\w.-]+?(?:{_DOT}|\s+(?:dot|punto|punkt|point)\s+)))({_LABEL}(?:(?:{_DOT}|\s+(?:dot|punto|punkt|point)\s+|\.){_LABEL})+)|([\w.+'-]+@{_LABEL}(?:(?:{_DOT}|\s+dot\s+|\.){_LABEL})+)")
_JOINTS = re.compile(rf"(?i){_AT}|{_DOT}|\s+(?:at|arroba|ät)\s+|\s+(?:dot|punto|punkt|point)\s+")


def _plain(m: re.Match[str]) -> str:
    c = m[0]
    if c in "‐‑‒–—―−":
        return "-"
    return unicodedata.normalize("NFKC", c) or c


_WORDS = re.compile(r"[^\W\d_]+")
_AT_WORDS = frozenset("at arroba ät".split())


def words(text: str) -> set[str]:
    """The words of a text in lower case, by which patterns are passed over that can't match."""
    return set(_WORDS.findall(text.lower()))


def normalised(text: str) -> Tape:
    """The text with disguises undone, and its spans."""
    tape = Tape(text)
    if not text.isascii():
        if _HIDDEN.search(text):
            tape.drop(_HIDDEN)
        if _ODD.search(text):
            tape.rewrite(_ODD, _plain)
        # a look-alike within a word of Latin letters
        tape.rewrite(_MIXED, lambda m: "".join(_TWIN.get(c, c) for c in m[0]) if _ASCII.search(m[0]) and not m[0].isascii() else m[0])
    there = words(tape.text)
    if not there.isdisjoint(_DIGITS):
        tape.rewrite(_SPELLED, lambda m: _digits(m[0]))
    # every match of _SPELLED_MAIL has an at, and only joints are rewritten
    if ("@" in tape.text or not there.isdisjoint(_AT_WORDS)) and _JOINTS.search(tape.text):
        _mail_joints(tape)
    return tape


def _digits(run: str) -> str:
    """Four or more digits in a row, spelled: the digits; fewer are words of the language."""
    found = [(_DIGITS[x[0].lower()] if x[1] else x[0]) for x in _ONE.finditer(run)]
    return "".join(found) if len(found) >= 4 else run


def _mail_joints(tape: Tape) -> None:
    spans = [m.span() for m in _SPELLED_MAIL.finditer(tape.text)]
    if spans:
        inside = lambda m: any(a < m.start() and m.end() < b for a, b in spans)
        tape.rewrite(_JOINTS, lambda m: ("@" if re.search(r"(?i)at|@|arroba|ät", m[0]) else ".") if inside(m) else m[0])


_MAIL = re.compile(r"(?i)(?<![\w.+@/-])[\w](?:[\w.+'-]*[\w+])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@])")

_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|poste|доб\.)\s?\d{1,6})?"
#: Letters and digits of scripts that put blanks between words: a number doesn't begin or end within such a word.
_TIGHT = "0-9A-Za-z_À-ʯͰ-ӿ԰-֏א-ۿ"
_PHONE = re.compile(
    rf"""(?ix)(?<![{_TIGHT}.+/@=\#-])(?:
      \+\d{{1,3}}[\s.-]?(?:\(0\)[\s.-]?)?\(?\d{{1,5}}\)?(?:[\s./-]?\d{{2,6}}){{1,5}}
    | 00\d{{1,3}}[\s.-](?:\(0\)[\s.-]?)?\(?\d{{1,5}}\)?(?:[\s./-]\d{{2,6}}){{1,5}}
    | (?:1[\s.-]?)?\(\d{{3}}\)[\s.-]?\d{{3}}[\s.-]\d{{4}}
    | (?:1[\s.-])?[2-9]\d{{2}}([\s.-])\d{{3}}\1\d{{4}}
    | 1[2-9]\d{{2}}[2-9]\d{{6}}
    | \(?0\d{{2,4}}\)?[\s/-]\d{{4,8}}(?:[\s-]\d{{2,5}})?
    | 0\d(?:[\s.]\d{{2}}){{4}}
    | 07\d{{9}}
    | 0\d{{1,4}}-\d{{1,4}}-\d{{4}}
    | 1[3-9]\d[ -]\d{{4}}[ -]\d{{4}}
    ){_EXT}(?![{_TIGHT}@/=]|[.:-]\d)"""
)
# Words that say a telephone number follows, in whatever grouping.
_PHONE_LABELLED = re.compile(rf"(?i)(?:(?<![^\W_])(?:tel(?:efon|ephone|éfono|éphone)?|phone|mobile|cell|fax|handy|móvil|portable|whatsapp|call(?: me)?(?: at| on)?|dial|ring(?: me)?(?: at| on)?|text me at|reach me at|тел|телефон|звоните)(?:\s*(?:number|no|nr|is|ist|es|est))?|电话|電話|手机|携帯)\.?\s*[:：是は]?\s*(\+?\(?\d[\d ().-]{{5,18}}\d)(?![{_TIGHT}@/=]|[.:-]\d)")
_PHONE_WORDS = frozenset("tel telefon telephone teléfono téléphone phone mobile cell fax handy móvil portable whatsapp call dial ring reach text тел телефон звоните".split())
#: Bank account numbers, which aren't asked for: no piece of one is a telephone number.
_ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")
# Nouns whose numbers are not telephone numbers.
_NOT_PHONE = re.compile(r"(?i)\b(?:ticket|order|rule|sku|build|batch|invoice|case|checksum|ratio was|port|version|job|ref|reference|trace|dossier|vorgang|caso|заявка|id|no\.?|nr\.?|#|commit|node|isbn|serial|part|item)\s*(?:id\s*)?[:#]?\s*$")

_ID_LABEL = r"""(?ix)(?<![\w-])(?:ssn|social\s+security(?:\s+(?:no\.?|number))?|(?:passport|insurance|national\s+insurance|ni|tax|identity(?:\s+card)?|id(?:\s+card)?)\s+(?:no\.?|number|nr\.?)|national\s+id(?:\s+(?:no\.?|number))?|tax\s+id|steuer-?\s?id(?:entifikationsnummer)?|steuernummer|ausweis(?:nummer|-?nr\.?)?|reisepass(?:nummer)?|dni|nie|nif|nss|pasaporte|passeport|n[°º]\s+fiscal|паспорт|снилс|инн|id)
   \s*(?:[:=\#]\s*)?(?:(?:is|es|lautet|ist|est|no\.?|nr\.?)\s+)?"""
_ID_LABELLED = re.compile(_ID_LABEL + r"([A-Z]{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?[A-Z]|[A-Z]{1,2}\d{6,8}|[XYZ]?\d{7,8}[\s-]?[A-Z]|\d{3}[\s-]?\d{2}[\s-]?\d{4}|\d{2}\s?\d{3}\s?\d{3}\s?\d{3}|\d{8,12})(?![\w/@]|-\d)")
_ID_PLAIN = re.compile(r"(?<![\w.@/=-])(?:[A-CEGHJ-PQR-TW-Z]{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?\d{2}[\s-]?[A-D]|\d{8}-?[A-HJ-NP-TV-Z]|\d{3}-\d{2}-\d{4})(?![\w@/-])")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_TOWN = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*(?:[ ](?!(?:Hi|My|The|Please|Contact|From|Tel|Mail|Vivo|Mein|Meine|Ask|Call)\b)[A-ZÀ-ÖØ-Þ][\w'’]+){0,1}"
# Kinds of streets.
_EN_KIND = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Close|Mews|Terrace|Ter\.?|Court|Ct\.?|Way|Boulevard|Blvd\.?|Place|Pl\.?|Square|Sq\.?|Crescent|Row|Hill|Walk|Gardens|Grove|Parkway|Pkwy\.?)"
_FR_KIND = r"(?:rue|avenue|av\.|impasse|bd|boulevard|place|allée|chemin|quai|route|cours|square|passage)"
_ES_KIND = r"(?:Calle|C/|Plaza|Avda\.|Av\.|Avenida|Paseo|Camino|Ronda|Travesía)"
_RU_KIND = r"(?:ул\.|улица|пр\.|просп\.|проспект|пер\.|переулок|наб\.|набережная|пл\.|площадь|шоссе|бульвар|б-р)"
_CODE_EN = r"(?:,?[ ](?:[A-Z]{2}[ ]\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}))"
_ADDRESS = re.compile(
    rf"""(?x)(?<![\w.@/-])(?:
      \d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}?{_EN_KIND}(?![\w])(?:[ ](?:NW|NE|SW|SE|North|South|East|West)\b)?(?![ ]+[a-z]+[ ](?:items|of|is|are|was))(?:,?[ ](?:Apt\.?|Apartment|Unit|Suite|Flat|\#)[ ]?\#?\w+)?(?:,[ ]{_TOWN}?{_CODE_EN}|,[ ]{_TOWN}|{_CODE_EN})?
    | \d{{1,4}}(?:[ ](?:bis|ter|quater))?,?[ ]{_FR_KIND}[ ](?:de[ ]la[ ]|de[ ]l['’]|des[ ]|du[ ]|de[ ]|d['’])?{_CAP}(?:[ ]{_CAP}){{0,2}}(?:,[ ]\d{{5}}[ ]{_TOWN})?
    | {_ES_KIND}[ ](?:de[ ]la[ ]|del[ ]|de[ ])?{_CAP}(?:[ ]{_CAP}){{0,2}},?[ ](?:n\.[ºo°][ ]?|núm\.[ ]?)?\d{{1,4}}(?:,[ ]?(?:\d{{1,2}}\.?[ºª][ ]?[A-Z]?|bajo|ático|\d{{1,2}}[ ]?[A-Z]))?(?:,[ ]\d{{5}}[ ]{_TOWN})?
    | (?:(?!(?:Meine|Deine|Seine|Ihre|Unsere|Eure|Diese|Jene|Eine|Keine)r?[ ])[A-ZÄÖÜ]\w*(?:e|er|en)[ ])?[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm)[ ]\d{{1,4}}(?:[ ]?[a-z](?!\w))?(?:,[ ]\d{{5}}[ ]{_TOWN})?
    | {_RU_KIND}[ ]?[А-ЯЁ0-9][\w.-]*(?:[ ][А-ЯЁ][\w.-]*){{0,2}},[ ](?:д\.|дом)[ ]?\d{{1,4}}[А-Яа-я]?(?:[/-]\d{{1,3}})?(?:,[ ](?:корп\.|к\.|стр\.)[ ]?\d{{1,3}})?(?:,[ ](?:кв\.|квартира|оф\.|офис)[ ]?\d{{1,4}})?(?:,[ ]\d{{6}})?(?:,[ ](?:г\.[ ])?[А-ЯЁ][\w-]+)?
    )"""
)
# Words of which a text with a street address has one, but for the German kinds, which end a word.
_STREET_WORDS = frozenset("street st road rd avenue ave lane ln drive dr close mews terrace ter court ct way boulevard blvd place pl square sq crescent row hill walk gardens grove parkway pkwy rue av impasse bd allée chemin quai route cours passage calle c plaza avda avenida paseo camino ronda travesía ул улица пр просп проспект пер переулок наб набережная пл площадь шоссе бульвар б".split())
_ID_WORDS = frozenset("ssn social passport insurance ni tax identity id national steuer steuerid steueridentifikationsnummer steuernummer ausweis ausweisnummer reisepass reisepassnummer dni nie nif nss pasaporte passeport fiscal паспорт снилс инн".split())
_GERMAN_STREET = re.compile(r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm) \d")
_MAP_ITEM = re.compile(r"\s+(?:map|incident|release|protocol|cluster)\b")
_STREET_ONLY = re.compile(rf"^\d+[A-Za-z]?[ ].*{_EN_KIND}$")

_W2 = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_W = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_I = r"[^\W\d_]\."
_NAME = rf"(?:{_W2}, (?:{_W2}(?: {_I})?|{_I}(?: ?{_I})?)|{_W} {_I}(?: ?{_I})?(?! ?{_W})|(?:{_W}|{_I})(?: {_I})?[ ]{_W})"
_STOP = r"""(?=[,.;!?"'\n)\]<(]|\s*$|\s)"""
_TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Herr|Frau|Mme|г-н|г-жа)\.?\s+)?"
# What stands before and after a name, by language.
_CONTEXTS = (
    (r"\bsaid\s+(?:that\s+)?", r"(?=\s+lives\b)"),
    (r"\b(?:I\s+am|I['’]m|my\s+name\s+is|this\s+is)\s+", r"(?=\s+and\s+my\b|,?\s+(?:and\s+)?(?:my|I)\b)"),
    (r"\b[Cc]ustomer\s+", r"(?=\s*\()"),
    (r"\b(?:[Cc]ontact|Name|Kontakt|Contacto)\s*:\s*", r"(?=\s*[;,\n])"),
    (r"\bFrom:\s*", r"(?=\s*<)"),
    (r"\b(?:[Tt]hanks|[Tt]hank you|[Rr]egards|[Ss]incerely|[Gg]rüße|Gruß|[Cc]ordialement|[Aa]tentamente|[Ss]aludos|С уважением)\s*,\s*", _STOP),
    (r"\bbelongs\s+to\s+", _STOP),
    (r"\b[Aa]sk\s+", r"(?=\s+about\b)"),
    (r"m['’]appelle\s+", r"(?=,\s)"),
    (r"\b[Mm]e\s+llamo\s+", r"(?=\s+y\s)"),
    (r"\bMein\s+Name\s+ist\s+", r"(?=,\s)"),
    (r"\b[Мм]еня\s+зовут\s+", r"(?=,\s)"),
    (r"счёт:\s*", r"(?=,\s)"),
    (r"\bfields\s+from:\s*", r"(?=,\s)"),
    (r"\b[Bb]itte\s+", r"(?=\s+anrufen\b)"),
    (r"\b(?:users|people|customers)\s+like\s+", r"(?=,\s)"),
    (r"\bDear\s+", r"(?=,)"),
    (r"\b[Tt]ell\s+", r"(?=\s*!)"),
    (r"(?<=[\w.])\s+for\s+", r"""(?=\s*\.?(?:\s*$|["\n]|\.\s|\.;|;|\s--))"""),
    (r"(?<=[.!?]\s)(?:[Mm]erci|[Gg]racias|[Dd]anke|[Tt]hanks|[Hh]ello|[Hh]i|[Bb]ravo|Спасибо)\s+", r"(?=\s*!)"),
)
_NAMES = [re.compile(rf"{before}{_TITLE}({_NAME}){after}") for before, after in _CONTEXTS]
# In the order of the contexts, words of which a text must have one.
_NAME_WORDS = [
    frozenset(row.split())
    for row in ("lives", "am m is", "customer", "contact name kontakt contacto", "from", "thanks you regards sincerely grüße gruß cordialement atentamente saludos уважением", "belongs", "ask", "appelle", "llamo", "name", "зовут", "счёт", "fields", "anrufen", "like", "dear", "tell", "for", "merci gracias danke thanks hello hi bravo спасибо")
]
# Names in any other wording: two or three words in the shape of a name are scored by what stands beside them.
_UP = r"[A-ZÀ-ÖØ-ÞŠŽĆČĐŁŚŹŻŐŰĞİŞА-ЯЁ]"
_LOW = r"[a-zà-öø-ÿšžćčđłśźżőűğışа-яёěřůťďňąęńĺ]"
_PART = rf"(?:(?:O|D|L)['’])?{_UP}{_LOW}+(?:{_UP}{_LOW}+)?(?:[-'’]{_UP}?{_LOW}+)*"
_SHAPED = re.compile(rf"(?<![\w.@/#'’-]){_PART}(?: {_UP}\.)?(?: (?:van|von|de|der|den|del|della|da|di|la|le|bin|al|ben))*(?: {_PART}){{1,2}}(?![\w@/]|['’-]\w)")
# Words before a name. Those of the first group say that a name follows, those of the second that a person may.
_SAYS = re.compile(
    r"(?i)(?:\b(?:name(?: is|['’]s|:)?|i am|i['’]m|this is|call me|here is|signed(?: by)?[,:]?|(?:(?:kind|best|warm|with) )?regards[,:]?|sincerely[,:]?|yours(?: truly| faithfully)?[,:]?|cheers[,:]?|thanks[,:]|thank you[,:]"
    r"|contact|call|phone|e-?mail|ask for|speak (?:to|with)|talk to|reach|meet|met|invite|tell|dear|hello|hi|attn[.:]?|attention[:]?|mr|mrs|ms|miss|mx|dr|prof|professor|sir|madam|herrn?|frau|señora?|sra?|don|doña|monsieur|madame|mme|mlle|м-р|г-н|г-жа|господин|госпожа"
    r"|mein name ist|ich bin|ich heiße|(?:viele |beste |liebe |mit freundlichen )?grüßen?[,]?|gruß[,]?|sehr geehrte[r]?|lieber?|je suis|je m['’]appelle|m['’]appelle|mon nom est|cordialement[,]?|bonjour|soy|me llamo|mi nombre es|atentamente[,]?|saludos[,]?|hola|estimad[oa]"
    r"|меня зовут|моё имя|мое имя|с уважением[,]?|уважаем(?:ый|ая)|звоните|обращайтесь к|позовите)\.?|^(?:from|to|cc|author|owner|assignee|reporter|applicant|recipient|sender|customer|client|patient|employee|user|name|kontakt|contacto|nombre|nom|имя)\s*:)\s*$"
)
_PERSON = re.compile(r"(?i)\b(?:manager|colleague|customer|client|patient|employee|teacher|doctor|engineer|director|officer|admin|administrator|neighbou?r|friend|brother|sister|mother|father|wife|husband|son|daughter|by|with|from|for|kollege|kollegin|kunde|kundin|chef|chefin|collègue|client|cliente|jefe|jefa|colega|коллега|клиент|директор|инженер|врач|друг)\s*,?\s*$")
# What people do, right after a name.
_DOES = re.compile(r"(?i)^(?:,? (?:who )?(?:lives|lived|said|says|wrote|writes|phoned|called|approved|asked|asks|signed|replied|answered|confirmed|complained|reported|works|worked|joined|left|moved|told|thinks|wants|wohnt|sagt|sagte|schrieb|arbeitet|bittet|habite|a dit|a écrit|travaille|vive|dijo|escribió|trabaja|pidió|живёт|живет|сказала?|написала?|работает|просит|позвонила?|ответила?)\b)")
# Words that make up names of things, places and times, not of people.
_THINGS = frozenset(
    "yesterday today tomorrow tonight later then also now once again recently finally maybe perhaps only both each every gestern heute morgen dann hier aujourd demain ayer hoy mañana вчера сегодня завтра потом me us which whom whose one mode mr mrs ms miss mx dr prof professor sir madam herr frau señor señora sr sra don doña monsieur madame mme mlle street road avenue lane drive court square place park bridge harbor harbour station airport river lake mount north south east west new old great saint san santa los las city town county state university college school church hospital bank hotel museum library team group department office service services server system network gateway router cluster node database table index cache queue module package project program report incident release version protocol update map line board center centre company corporation inc ltd gmbh support security desk help center monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes sábado domingo the a an this that these those it we you he she they i my our your his her their please hello hi dear thanks thank regards best kind if when where what who why how is are was were do does did can could will would should may might must no yes not and or but for to of in on at by from with all any some mozilla windows linux apple google chrome safari firefox internet english german french spanish russian chinese".split()
)
#: Score from which a candidate is a name.
NAME_FROM = 3.0
_CUE_WORDS = frozenset(
    "name am m this call here signed regards sincerely yours cheers thanks thank contact phone mail email ask speak talk reach meet met invite tell dear hello hi attn attention mr mrs ms miss mx dr prof professor sir madam herr herrn frau señor señora sr sra don doña monsieur madame mme mlle bin heiße grüße grüßen gruß geehrte geehrter liebe lieber suis appelle nom cordialement bonjour soy llamo nombre atentamente saludos hola estimado estimada зовут имя уважением уважаемый уважаемая звоните обращайтесь позовите господин госпожа from to cc author owner assignee reporter applicant recipient sender customer client patient employee user kontakt contacto "
    "lives lived said says wrote writes phoned called approved asked asks replied answered confirmed complained reported works worked joined left moved told thinks wants wohnt sagt sagte schrieb arbeitet bittet habite dit écrit travaille vive dijo escribió trabaja pidió живёт живет сказал сказала написал написала работает просит позвонил позвонила ответил ответила".split()
)


def name_score(text: str, start: int, end: int) -> float:
    """How much text[start:end], in the shape of a name, stands where names do; from ``NAME_FROM`` on it is one."""
    parts = [w.lower() for w in _WORDS.findall(text[start:end]) if len(w) > 1]
    before = text[max(0, start - 40) : start]
    score = 1.0
    if _SAYS.search(before):
        score += 2.0
    elif _PERSON.search(before):
        score += 2.0
    if _DOES.match(text[end : end + 24]):
        score += 2.0
    score -= 3.0 * sum(w in _THINGS or w in _STREET_WORDS for w in parts)
    return score


_FULL_WORD = re.compile(r"\b\w+\b(?!\.)")
_SHIP = re.compile(r"(?i)\b(?:ship|send|deliver|mail|post)\b")
_NOT_NAME = {"the", "a", "an", "this", "it", "me", "you", "your", "my", "our", "us", "them", "we", "he", "she", "they", "be", "all"}


def shaped_names(text: str) -> Iterator[tuple[int, int]]:
    """Candidates that score as names. A first word that announces a name (a title, a greeting) is left out of it."""
    for m in _SHAPED.finditer(text):
        a, b = m.span()
        words_at = [(x.start(), x.end()) for x in re.finditer(r"[^\s]+", text[a:b])]
        starts = [a + x for x, _ in words_at]
        ends = [a + y for _, y in words_at]
        tries = [(i, j) for n in range(len(starts), 1, -1) for i in range(len(starts) - n + 1) for j in [i + n - 1]]
        for i, j in tries:
            # the last word must be a word of a name
            if len(_WORDS.findall(text[starts[i] : ends[j]])) >= 2 and not text[ends[j] - 1] == "." and name_score(text, starts[i], ends[j]) >= NAME_FROM:
                yield starts[i], ends[j]
                break


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every piece in source positions, in order, without overlap; earlier types of TYPES go first."""
    tape = normalised(text)
    s, out, taken = tape.text, [], []
    there = words(s)

    def take(a: int, b: int, kind: str) -> None:
        if b > a and all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((*tape.source(a, b), kind))

    if "@" in s:
        for m in _MAIL.finditer(s):
            take(*m.span(), "email")
    some_digits = _SOME_DIGITS.search(s)
    if some_digits:
        for m in _ID_LABELLED.finditer(s) if not there.isdisjoint(_ID_WORDS) else ():
            take(*m.span(1), "id_number")
    if _DIGIT.search(s):
        for m in _ADDRESS.finditer(s) if not there.isdisjoint(_STREET_WORDS) or _GERMAN_STREET.search(s) else ():
            if not (_STREET_ONLY.match(m[0]) and _MAP_ITEM.match(s, m.end())):
                take(*m.span(), "address")
    if some_digits:
        taken += [m.span() for m in _ACCOUNT.finditer(s)]
        for m in _PHONE.finditer(s):
            digits = sum(c.isdigit() for c in m[0])
            if digits >= 9 and not _NOT_PHONE.search(s, max(0, m.start() - 80), m.start()):
                take(*m.span(), "phone")
        for m in _PHONE_LABELLED.finditer(s) if not there.isdisjoint(_PHONE_WORDS) or not s.isascii() else ():
            if 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                take(*m.span(1), "phone")
        for m in _ID_PLAIN.finditer(s):
            if not _NOT_PHONE.search(s, max(0, m.start() - 80), m.start()):
                take(*m.span(), "id_number")
    for p, any_of in zip(_NAMES, _NAME_WORDS, strict=True):
        if not there.isdisjoint(any_of):
            for m in p.finditer(s):
                if p is _FOR and not _SHIP.search(s, 0, m.start()):
                    continue
                last, _, first = m[1].partition(", ")
                if not _NOT_NAME & {w.lower() for w in _FULL_WORD.findall(m[1])} and not (first[:1].islower() and not last[:1].islower()):
                    take(*m.span(1), "name")
    if not there.isdisjoint(_CUE_WORDS):
        for a, b in shaped_names(s):
            take(a, b, "name")
    return sorted(out)


# Telephone and identity numbers have several digits, an address may have one.
_SOME_DIGITS, _DIGIT = re.compile(r"\d[\d\W]*\d|\d [A-Za-z]"), re.compile(r"\d")
_FOR = next(p for p in _NAMES if "for\\s+" in p.pattern)

# Not to be moved below the grouping of equal texts by the optimizer: marked as not deterministic where it is used.
SPAN = T.ArrayType(T.StructType([T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("pii_type", T.StringType())]))


@F.pandas_udf(SPAN)
def _found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: [{"start_pos": a, "end_pos": b, "pii_type": k} for a, b, k in spans(t)])


def text_spans(df: DataFrame, space: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, found): members has space, id and raw (a digest of the text), one row for each record; found has raw, text and
    spans for every distinct text with at least one piece."""
    rows = df.select(F.col(space).alias("space"), F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    members = rows.select("space", "id", F.unhex(F.sha2("text", 256)).alias("raw")).dropDuplicates(["space", "id"])
    found = rows.select("text").distinct().withColumn("spans", _found.asNondeterministic()("text")).where(F.size("spans") > 0)
    return members, found.select(F.unhex(F.sha2("text", 256)).alias("raw"), "text", "spans")


def personal_data(df: DataFrame, space: str, key: str, text: str) -> DataFrame:
    """space, id, start_pos, end_pos, pii_type: one row for each piece in each record.

    Positions are 0-based code points of the stored text, the end exclusive; pieces of a record don't overlap. Rows with
    one (space, key) are one record; null and empty texts have no pieces. Equal texts are read once.
    """
    members, found = text_spans(df, space, key, text)
    return members.join(found.select("raw", "spans"), "raw").select("space", "id", F.explode("spans").alias("p")).select("space", "id", "p.start_pos", "p.end_pos", "p.pii_type")


def _cut(text: str, pieces: list) -> str:
    out, at = [], 0
    for p in pieces:
        out += [text[at : p["start_pos"]], f"[{p['pii_type'].upper()}]"]
        at = p["end_pos"]
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redacted(text: pd.Series, pieces: pd.Series) -> pd.Series:
    return pd.Series([_cut(t, p) if t is not None and p is not None else t for t, p in zip(text, pieces)], dtype=object)


def redacted(df: DataFrame, space: str, key: str, text: str) -> DataFrame:
    """space, id, text: every record with its pieces replaced by ``[TYPE]``, all else unchanged; a null text stays null."""
    rows = df.select(F.col(space).alias("space"), F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL").dropDuplicates(["space", "id"])
    _, found = text_spans(df, space, key, text)
    clean = found.select("raw", _redacted("text", "spans").alias("clean"))
    return rows.withColumn("raw", F.unhex(F.sha2("text", 256))).join(clean, "raw", "left").select("space", "id", F.coalesce("clean", "text").alias("text"))
