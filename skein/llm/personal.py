"""Personal information in free text, by bootstrapped contextual extraction.

A scan of every text yields mentions: spans that may be an e-mail address, a phone or identity
number, a postal address or a name. A mention has features, its lexical patterns: the words before
and after it, the shape of a number, the host of an address, the first and last word of a name.
Mentions that are proof by themselves (cue words, full written forms, titles, a name that the
e-mail address beside it spells, names of known people) are the seeds, cue words of other numbers
the negative ones. Spark then scores the graph of patterns and instances round by round to its
fixed point: a pattern is trusted for a kind by the lower confidence bound of its share of
instances of that kind, an instance becomes known by the share of its mentions that stand in
trusted patterns. Known instances are found wherever they stand, and the spans are replaced by
typed placeholders.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import cut

EMAIL, PHONE, ID, ADDRESS, NAME, NUMBER = "email", "phone", "id_number", "address", "name", "number"
PLACEHOLDERS = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", ID: "[ID_NUMBER]", ADDRESS: "[ADDRESS]", NAME: "[NAME]"}

NONE = "none"

#: A pattern is trusted from this lower bound of its share on, if two instances or more (one for
#: a host) speak for it. Z is the width of the bound in standard deviations.
TRUST, Z = 0.5, 1.0
#: An instance is known if this share of its mentions stands in trusted contexts.
SHARE = 0.5
#: What an instance of no known kind counts against a pattern, by the side of its feature. Shapes
#: and hosts are judged by the instances whose kind is known.
AGAINST = {"<": 0.5, "(": 0.5, ">": 0.5, ")": 0.5, "^": 0.05, "$": 0.05, "=": 0.0, "@": 0.0}

#: Compatible forms that stand for one character each, so that offsets stay.
PLAIN = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20, 0x2011: 0x2D, 0x2010: 0x2D, 0x2013: 0x2D, 0x2019: 0x27}

#: An address is written plainly, with both marks in brackets, or with both as capital words.
LOCAL = r"(?<![\w.+\-/@])[A-Za-z0-9](?:[\w.%+\-]{0,62}[A-Za-z0-9_])?"
HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
AT_DOT = (
    (r"(?:@|\s@\s)", r"\."),
    (r"\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?", r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?)"),
    (r"\sAT\s", r"(?:\.|\sDOT\s)"),
)
MAIL = re.compile("|".join(rf"{LOCAL}{at}(?:{HOST}{dot}){{1,5}}[A-Za-z]{{2,24}}(?![\w@])" for at, dot in AT_DOT), re.ASCII)

DIGITS = re.compile(r"(?<![\w.,:/#=\-+$%^~<>])(?:\+|00)?\(?\d(?:[ .\-/()]{0,2}\d){6,18}(?![\w%]|[.,:/\-]\w)|(?<=[=:：])(?:\+|00)?\(?\d(?:[ .\-/()]{0,2}\d){6,18}(?![\w%]|[.,:/\-]\w)|(?<![\w.,:/#=\-])\+\(?\d(?:[ .\-/()]{0,2}\d){6,18}(?![\w%]|[.,:/\-]\w)", re.ASCII)
INTERNATIONAL = re.compile(r"(?:\+|00)[1-9][\d .\-/()]{8,20}")
SURE_ID = re.compile(r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]")
LETTERED = re.compile(
    r"(?<![\w\-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[Xx]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{1,2}\d{6,8}|[12] \d{2} \d{2} (?:\d{2}|2[AB]) \d{3} \d{3}(?: \d{2})?)(?![\w\-])",
    re.ASCII,
)
SURE_LETTERED = re.compile(r"[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[1-9]\d{16}[Xx]")
DATE = re.compile(r"(?:19|20)\d{2}[\-/. ](?:0?[1-9]|1[0-2])[\-/. ](?:0?[1-9]|[12]\d|3[01])(?:\D.*)?|(?:0?[1-9]|[12]\d|3[01])[\-/.](?:0?[1-9]|[12]\d|3[01])[\-/.](?:19|20)\d{2}|\d{1,3}(?:\.\d{1,3}){3}|\d+\.\d+(?:\.\d+)*|(?:1[67]\d{8}|1[67]\d{11}|1[67]\d{14})")

#: What the word right before a number, or a name, says of it: seeds of the graph.
CUES = {
    PHONE: "phone tel tél telefon teléfono téléphone fon mobile móvil movil handy portable cell cellphone telephone hotline fax whatsapp 电话 手机 联系电话 手机号".split(),
    ID: "ssn nino dni nie nif nir passport reisepass passeport pasaporte steuer-id steueridentifikationsnummer personalausweis ausweisnummer 身份证 身份证号 护照 护照号".split(),
    NONE: "batch range sku row rows checksum semver trace commit issue ticket request build version port order invoice id offset line span job hash pid".split(),
}
PHRASES = {
    ID: re.compile(r"(?:social security(?: number)?|national insurance(?: number)?|ni number|tax(?:payer)? id|resident id|identity (?:card|number)|id card|passport(?: no\.?| number)?|documento de identidad|mi dni es|num[ée]ro de s[ée]cu(?:rit[ée] sociale)?|ssn (?:is|on file)|steuer-?id|steuernummer|sozialversicherungsnummer|身份证(?:号码?)?|护照号?码?)\s*[:：=#]?\s*$", re.IGNORECASE),
    PHONE: re.compile(r"(?:(?:phone|tel|t[ée]l|m[óo]vil|mobile|hotline|handy|电话|手机号?)\s*[.:：=]?|(?:my|the|his|her|our) number is|call(?: me(?: at| on)?)?|reach (?:me|us|him|her) (?:at|on)|ring)\s*$", re.IGNORECASE),
}

CAP = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ]*(?:['\-][A-Za-zÀ-ÿ]+)*"
ROADS = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Close|Court|Ct|Drive|Dr|Way|Place|Pl|Square|Sq|Terrace|Crescent|Highway|Parkway|Row|Gardens|Grove|Hill|Mews|Walk)"
PLACES = re.compile(
    rf"(?:(?:Flat|Apt|Apartment|Unit|Suite) \d+\w?, ?)?\b\d{{1,5}}[A-Za-z]? (?:{CAP} ){{1,4}}{ROADS}\b\.?(?:,? (?:Apt|Suite|Unit|Flat|Floor|#)\.? ?\d+\w?)?(?:, (?:{CAP} ?){{1,3}})(?:,? ?[A-Z]{{1,2}}\d?[\w ]{{2,8}}\b)?"
    rf"|\bP\.? ?O\.? Box \d+|\bPostfach \d+|\bApartado (?:de correos )?\d+|\b(?:BP|Boîte postale) \d+"
    rf"|\b(?:{CAP}(?: {CAP})?(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|damm|ufer)|(?:Am|An der|An den|Im|In der|Auf dem|Zum|Zur|Unter den|{CAP}) (?:{CAP}) ?|{CAP}(?:stra(?:ß|ss)e|weg|gasse|allee|platz|ring|damm|ufer)) ?\d{{1,4}} ?[a-z]?, ?\d{{5}} {CAP}"
    rf"|\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|boulevard|place|chemin|all[ée]e|quai|route|cours|square|passage)\b[^,\n]{{2,50}}, ?\d{{5}} {CAP}"
    rf"|(?:\bC/|\bCalle|\bAvenida|\bAvda\.?|\bAv\.|\bPlaza|\bPaseo|\bCamino|\bCarrera|\bRonda|\bTraves[íi]a) ?[^,\n]{{2,50}}? \d{{1,4}}(?:, ?\d+[.ºª][^,]{{0,12}})?, ?\d{{5}} {CAP}"
    r"|[一-鿿]{1,8}(?:省|市|区|县|镇)[一-鿿]{1,12}(?:路|街|巷|道|弄|胡同)\d{1,5}号(?:[\d一-鿿]{1,8}(?:室|楼|单元|栋|层|户))?|[一-鿿]{2,8}(?:路|街|巷|大道)\d{1,5}号\d{0,5}(?:室|楼|单元|栋)?",
)

#: Without one of these marks no text matches MAIL or PLACES.
MAIL_MARKS = re.compile(r"@|[\[({]\s?(?:at|AT)\s?[\])}]|\sAT\s")
PLACE_MARKS = re.compile(rf" {ROADS}\b|Box \d|Postfach|Apartado|BP \d|Boîte|\d{{5}} [A-ZÀ-Þ]|号")

PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|la|le|el|bin|ibn|al|ter|ten|zu|Van|Von|Der|De|Del|Di|Da|La|Le|VAN|VON|DER|DE|DEL|DI|DA|LA|LE)"
LATIN_NAME = re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_@.+\-/])(?=({CAP} (?:{PARTICLE} ){{0,2}}{CAP})(?![A-Za-zÀ-ÿ0-9_@(/]|\.[A-Za-z0-9_]))")
REVERSED = re.compile(rf"(?<=: )(?:{PARTICLE} ){{0,2}}{CAP}, {CAP}(?![A-Za-zÀ-ÿ0-9_@])")
TITLED = re.compile(rf"(?<!\w)(?:Herrn?|Frau|Mme|Mlle|M\.|Mr\.?|Mrs\.?|Ms\.?|Miss|Sr\.?|Sra\.?|Srta\.?|Dr\.?|Prof\.?|Señora?|Monsieur|Madame|Don|Doña)(?: Dr\.| Prof\.)? (?:[A-Z]\. ?)*((?:{PARTICLE} ){{0,2}}{CAP}(?: {CAP})?)(?![\w@])")
LOWER = re.compile(rf"(?<!\w)(?:this is|name is|i am|i'm|je suis|je m'appelle|ich bin|ich hei(?:ß|ss)e|soy|me llamo) ([a-zà-ÿ'\-]{{3,20}} (?:{PARTICLE} ){{0,2}}[a-zà-ÿ'\-]{{3,20}})(?![\w@])")
HAN_NAME = re.compile(r"(?:联系人(?:是|为|：|:)|我(?:叫|是)|姓名(?:是|：|:)|名字(?:是|叫)|负责人(?:是|为|：|:)|客户(?:是|叫)|收件人(?:是|：|:))\s?([一-鿿·]{2,4})|([一-鿿]{1,3})(?:先生|女士|小姐)")
NOT_NAMES = set("the a an this that these we they it he she you i in on at of to for from with and or but if when while after before both between every each keep move put set use do does can should how what why where which who open rolling nobody logs user assistant system note context content".split())


ARTICLE = re.compile(r"\b(?:the|an?|der|die|das|den|dem|ein|eine|les?|une?|los|las|una?)\s$", re.IGNORECASE)


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


# LATIN_NAME looks ahead, so that every pair of a run of capitalised words is a mention.


def tokens_of(name: str) -> list[str]:
    """The words of a name that are its own: no particles, no initials."""
    return [t for t in re.findall(r"[^\W\d_]+(?:['\-][^\W\d_]+)*", fold(name)) if len(t) > 1 and not re.fullmatch(PARTICLE, t)]


#: A name told by its own words: what follows is a name if it is written like one.
TOLD = re.compile(r"(?:my name is|i am called|je m'appelle|mon nom est|ich hei(?:ß|ss)e|mein name ist|me llamo|mi nombre es)\s$", re.IGNORECASE)

#: Forms that may be an address, but are proof only in a trusted context.
MAY_PLACES = re.compile(
    rf"\b\d{{1,5}}[A-Za-z]? (?:{CAP} ){{1,4}}{ROADS}\b|\b{CAP}(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz) ?\d{{1,4}}[a-z]?\b"
    rf"|\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|boulevard|chemin|all[ée]e|quai) (?:(?:d[eu]s?|la|le|l') ?)*{CAP}(?: {CAP})*|(?:\bC/|\bCalle|\bAvenida|\bPlaza|\bPaseo) ?(?:(?:del?|la|los|las) )*{CAP}(?: {CAP})* \d{{1,4}}\b"
)
MAY_PLACE_MARKS = re.compile(rf"\d[A-Za-z]? (?:[^\W\d_][\w'\-]* ){{1,4}}{ROADS}\b|(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz) ?\d|\d,? (?:rue|avenue|impasse|boulevard|chemin|all[ée]e|quai) |C/|Calle |Avenida |Plaza |Paseo ")

POSTCODE = re.compile(r"\d{5} [A-ZÀ-Þ]")

WORDS = re.compile(r"[^\W\d_]+(?:['\-][^\W\d_]+)*")
SENTENCE_END = re.compile(r"(?<=[^\W\d_]{4})[.!?]\s|[。！？]")
TELLING = re.compile(r"[^\W\d_]{4}|[一-鿿]{2}")


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of the words beside a span, within its line and sentence: two and one word before, two and one after.

    Han text counts by its nearest four characters. A pattern needs a word of four letters or
    two Han characters, so that function words and marks alone are none.
    """
    left = SENTENCE_END.split(text[max(0, start - 48) : start].rsplit("\n", 1)[-1].lower())[-1]
    right = SENTENCE_END.split(text[end : end + 48].split("\n", 1)[0].lower())[0]
    before = [w if w < "⺀" else w[-4:] for w in WORDS.findall(left)[-2:]]
    after = [w if w < "⺀" else w[:4] for w in WORDS.findall(right)[:2]]
    sides = (("< ", before if len(before) == 2 else []), ("( ", before[-1:]), ("> ", after if len(after) == 2 else []), (") ", after[:1]))
    return [mark + " ".join(words) for mark, words in sides if any(TELLING.search(w) for w in words)]


def number_kind(text: str, start: int, end: int, lettered: bool) -> str | None:
    """The kind that the words before a number or its full form prove; NONE where they prove that it is no case; None where it is open."""
    span, before = text[start:end], text[max(0, start - 48) : start].split("\n")[-1]
    for kind, phrase in PHRASES.items():
        if phrase.search(before):
            return kind
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", before.lower())
    last = words[-1] if words else ""
    for kind, cues in CUES.items():
        if last in cues and not re.search(r"[\w.!?。]\s*[.!?。]\s*$", before.replace("él.", "él").replace("el.", "el")):
            return kind
    if lettered:
        return ID if SURE_LETTERED.fullmatch(span) else None
    if DATE.fullmatch(span):
        return NONE
    if SURE_ID.fullmatch(span):
        return ID
    return PHONE if INTERNATIONAL.fullmatch(span) else None


def shape(span: str) -> str:
    """A number with its digits as 9 and its letters as A."""
    return "= " + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", span))


def mentions(text: str) -> list[tuple[str, int, int, str | None, str, list[str]]]:
    """(class, start, end, seed kind or None, instance, own patterns) of every span that may be personal."""
    plain = text if text.isascii() else text.translate(PLAIN)
    out, taken = [], []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    spelled = []
    if ("@" in plain or "AT" in plain or AT_HINTS.search(plain)) and MAIL_MARKS.search(plain):
        for m in MAIL.finditer(plain):
            whole = m.group()
            host = re.sub(r"\s?[\[({]?\s?\b(?:dot|DOT)\b\s?[\])}]?\s?|\s?[\[({]\s?\.\s?[\])}]\s?", ".", re.split(r"@|[\[({]\s?(?:at|AT|@)\s?[\])}]|\sAT\s", whole)[-1]).strip().lower()
            if whole.startswith("git@") and plain[m.end() : m.end() + 1] == ":":
                out.append((EMAIL, m.start(), m.end(), NONE, whole.lower(), ["@ " + host]))
                continue
            out.append((EMAIL, m.start(), m.end(), None if " AT " in whole else EMAIL, whole.lower(), ["@ " + host]))
            taken.append((m.start(), m.end()))
            spelled.append(re.sub(r"[^a-z]", "", fold(re.split(r"@|\s|[\[({]", whole)[0])))
    if re.search(r"\d", plain):
        roads = any(h in plain for h in ROAD_HINTS)
        for m in PLACES.finditer(plain) if (roads or any(h in plain for h in PLACE_HINTS) or POSTCODE.search(plain)) and PLACE_MARKS.search(plain) else ():
            if free(m.start(), m.end()):
                out.append((ADDRESS, m.start(), m.end(), ADDRESS, m.group().lower(), []))
                taken.append((m.start(), m.end()))
        for m in MAY_PLACES.finditer(plain) if (roads or any(h in plain for h in MAY_HINTS)) and MAY_PLACE_MARKS.search(plain) else ():
            if free(m.start(), m.end()):
                out.append((ADDRESS, m.start(), m.end(), None, m.group().lower(), []))
        for pattern, lettered in ((LETTERED, True), (DIGITS, False)):
            for m in pattern.finditer(plain) if lettered or SEVEN.search(plain) else ():
                if free(m.start(), m.end()):
                    kind = number_kind(plain, m.start(), m.end(), lettered)
                    out.append((NUMBER, m.start(), m.end(), kind, m.group(), [shape(m.group())]))
                    if kind in (ID, PHONE):
                        taken.append((m.start(), m.end()))
    names = [(*m.span(1), m.group(1), False) for m in LATIN_NAME.finditer(plain)] + [(*m.span(), m.group(), False) for m in REVERSED.finditer(plain)]
    names += [(*m.span(1), m.group(1), True) for m in (TITLED.finditer(plain) if any(h in plain for h in TITLE_HINTS) else ())] + [(*m.span(1), m.group(1), False) for m in LOWER.finditer(plain)]
    for start, end, name, titled in names:
        own = tokens_of(name)
        if not titled and ARTICLE.search(plain[max(0, start - 6) : start]):
            continue
        if free(start, end) and own and not any(t in NOT_NAMES for t in own) and (titled or len(own) >= 2):
            first, last = (own[-1], own[0]) if ", " in name else (own[0], own[-1])
            letters = [re.sub(r"[^a-z]", "", t) for t in own]
            sure = titled or any(all(len(t) > 2 and t in s for t in letters) for s in spelled) or (TOLD.search(plain[max(0, start - 20) : start]) is not None and name[:1].isupper())
            out.append((NAME, start, end, NAME if sure else None, " ".join(sorted(own)), ["^ " + first, "$ " + last] if len(own) > 1 else ["$ " + last]))
    for m in HAN_NAME.finditer(plain) if not plain.isascii() and HAN.search(plain) else ():
        group = 1 if m.group(1) else 2
        out.append((NAME, *m.span(group), NAME if group == 1 else None, m.group(group), []))
    return out


#: Substrings without one of which no text matches an expression; looking for them is far faster.
ROAD_HINTS = tuple(" " + r for r in ROADS[3:-1].split("|"))
PLACE_HINTS = ("Box ", "Postfach", "Apartado", "BP ", "Boîte", "号")
MAY_HINTS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", " rue ", " avenue ", " impasse ", " boulevard ", " chemin ", " allée ", " quai ", "C/", "Calle ", "Avenida ", "Plaza ", "Paseo ")
TITLE_HINTS = ("Herr", "Frau", "Mme", "Mlle", "M. ", "Mr", "Ms", "Miss", "Sr", "Dr", "Prof", "Señor", "Monsieur", "Madame", "Don")
AT_HINTS = re.compile(r"at\s?[\])}]")
SEVEN = re.compile(r"\d(?:[ .\-/()]{0,2}\d){6}", re.ASCII)
HAN = re.compile(r"[一-鿿]")


SCAN = "src string, row_id bigint, cls string, start int, end int, seed string, instance string, features array<string>"


def scan(texts: DataFrame) -> DataFrame:
    """The mentions of (src, row_id, text) rows with their patterns; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for src, row_id, text in zip(batch["src"], batch["row_id"], batch["text"]):
                if text:
                    out += [(src, row_id, cls, a, b, seed, instance, own + contexts(text, a, b)) for cls, a, b, seed, instance, own in mentions(text)]
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in SCAN.split(", ")])

    return texts.select("src", "row_id", "text").mapInPandas(run, SCAN)


def lower_bound(hits, n):
    """The lower end of the Wilson interval of a share of hits among n, as a column."""
    p = hits / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def trusted_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, feature, side, kind, trust) of the patterns that announce one kind, NONE included.

    edges has (cls, feature, instance, n), known (cls, instance, kind). Shares count different
    instances; for the words beside a span the mentions must reach the share as well. A host
    is trusted from one plain address on.
    """
    kinds = (*PLACEHOLDERS, NONE)
    hit = lambda k: F.count_if(F.col("kind") == k).alias(k)
    mass = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}")
    per = edges.join(known, ["cls", "instance"], "left").groupBy("cls", "feature").agg(*(hit(k) for k in kinds), *(mass(k) for k in kinds), F.count("*").alias("every"), F.sum("n").alias("n_every"))
    side = F.substring("feature", 1, 1)
    against = F.element_at(F.create_map(*(F.lit(x) for pair in AGAINST.items() for x in pair)), side)
    labelled = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    per = per.withColumn("best", F.array_max(F.array(*(F.struct(F.col(k).alias("hits"), F.col(f"n_{k}").alias("mass"), F.lit(k).alias("kind")) for k in kinds))))
    per = per.withColumn("size", labelled + against * (F.col("every") - labelled)).where("best.hits > 0")
    per = per.select("cls", "feature", side.alias("side"), "best.kind", "best.hits", lower_bound(F.col("best.hits"), F.col("size")).alias("trust"), (F.col("best.mass") >= TRUST * F.col("n_every")).alias("mostly"))
    kept = (F.col("trust") >= TRUST) & ((F.col("hits") > 1) | (F.col("side") == "@")) & (F.col("mostly") | ~F.col("side").isin("<", "(", ">", ")"))
    return per.where(kept).select("cls", "feature", "side", "kind", "trust")


def newly_known(edges: DataFrame, instances: DataFrame, trusted: DataFrame) -> DataFrame:
    """(cls, instance, kind) of the instances that trusted patterns prove.

    A number follows its shape, an address its host; else SHARE of an instance's mentions must
    stand in trusted contexts. A name needs two independent contexts or a known word with them,
    or both its words known.
    """
    e = edges.join(trusted, ["cls", "feature"])
    on = lambda s: F.col("side") == s
    mass = lambda s: F.sum(F.when(on(s), F.col("n")).otherwise(0)).alias(f"m{s}")
    rows = e.groupBy("cls", "instance").agg(
        *(mass(s) for s in "<(>)"), *(F.count_if(on(s)).alias(f"c{s}") for s in "<(>)^$"),
        F.max(F.when(F.col("side").isin("=", "@"), F.struct("trust", "kind"))).alias("form"), F.max(F.when(F.col("side").isin("<", "(", ">", ")"), F.struct("trust", "kind"))).alias("around"),
    ).join(instances.select("cls", "instance", "total"), ["cls", "instance"])
    share = F.greatest(F.greatest("m<", "m("), F.greatest("m>", "m)")) / F.col("total")
    independent = F.greatest("c<", "c(") + F.greatest("c>", "c)")
    parts = F.least(F.col("c^"), F.lit(1)) + F.least(F.col("c$"), F.lit(1))
    name = ((share >= SHARE) & (independent + parts >= 2)) | (parts == 2)
    by_context = F.when(share >= SHARE, F.col("around.kind"))
    kind = F.when(F.col("cls") == NAME, F.when(name, NAME)).when(F.col("form").isNotNull(), F.col("form.kind")).otherwise(by_context)
    return rows.select("cls", "instance", kind.alias("kind")).where("kind is not null")


def known_instances(found: DataFrame, people: DataFrame) -> DataFrame:
    """(cls, instance, kind) at the fixed point of the graph of patterns and instances.

    Seeds are the mentions' own and the names of people (display_name), whose first and last
    words are known words. Every round only adds instances, so the rounds end; they go on until
    one adds none.
    """
    edges = cut(found.select("cls", "instance", F.explode("features").alias("feature")).groupBy("cls", "feature", "instance").agg(F.count("*").alias("n")))
    seeded = found.groupBy("cls", "instance", "seed").agg(F.count("*").alias("n")).groupBy("cls", "instance").agg(F.sum("n").alias("total"), F.max(F.when(F.col("seed").isNotNull(), F.struct("n", "seed"))).alias("top"))
    instances = cut(seeded.select("cls", "instance", "total", F.col("top.seed").alias("kind")))

    @F.pandas_udf("struct<own array<string>>")
    def spelled(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"own": [tokens_of(x) for x in names]})

    named = people.where("display_name is not null").select(spelled("display_name").alias("x")).where("size(x.own) > 1")
    own = named.select(F.lit(NAME).alias("cls"), F.array_join(F.array_sort("x.own"), " ").alias("instance"), F.lit(NAME).alias("kind"))
    sides = F.array(F.concat(F.lit("^ "), F.col("x.own")[0]), F.concat(F.lit("$ "), F.element_at("x.own", -1)))
    directory = cut(named.select(F.lit(NAME).alias("cls"), F.explode(sides).alias("feature")).distinct())
    sure = instances.where("kind is not null").select("cls", "instance", "kind")
    known = cut(sure.unionByName(own.join(sure, ["cls", "instance"], "left_anti").distinct()))
    while True:
        trusted = trusted_patterns(edges, known)
        listed = directory.join(trusted, ["cls", "feature"], "left_anti").select("cls", "feature", F.substring("feature", 1, 1).alias("side"), F.lit(NAME).alias("kind"), F.lit(1.0).alias("trust"))
        fresh = cut(newly_known(edges, instances, trusted.unionByName(listed)).join(known, ["cls", "instance"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)


def judged(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(src, row_id, start, end, cls, seed, kind) of every mention: its own seed's kind, else that of its instance, null for none."""
    found = cut(scan(texts))
    known = known_instances(found, people)
    rows = found.drop("features").join(known, ["cls", "instance"], "left")
    return rows.select("src", "row_id", "start", "end", "cls", "seed", F.nullif(F.coalesce("seed", "kind"), F.lit(NONE)).alias("kind"))


def found_spans(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(src, row_id, start, end, kind) of all personal information in (src, row_id, text) rows.

    people has a column display_name; its names are seeds of the graph.
    """
    return judged(texts, people).where("kind is not null").select("src", "row_id", "start", "end", "kind").distinct()


def texts_of(messages: DataFrame, memories: DataFrame) -> DataFrame:
    """(src, row_id, text) of the turns and the memories."""
    turns = messages.select(F.lit("turn").alias("src"), F.col("msg_id").alias("row_id"), "text")
    return turns.unionByName(memories.select(F.lit("memory").alias("src"), F.col("mem_no").alias("row_id"), F.col("content").alias("text")))


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(src, row_id, text, n_spans): every text with its spans replaced by typed placeholders, the rest untouched.

    Of spans that overlap the one that starts first, then the longest, is replaced. Null texts stay null.
    """
    lists = spans.groupBy("src", "row_id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))

    def replace(text: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, all_spans):
            if t is None or found is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at : s["start"]], PLACEHOLDERS[s["kind"]]]
                    at = s["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype="object")

    run = F.pandas_udf(replace, "string")
    joined = texts.join(lists, ["src", "row_id"], "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(run("text", "spans"))
    return joined.select("src", "row_id", text.alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"))
