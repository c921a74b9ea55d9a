"""Trusted labels for blocks of text: residue that stands where content should be, chrome, or neither.

A unit is a line or sentence. A unit is residue only as a whole: a sentence that quotes or
discusses a placeholder or a notice does not match.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

PLACEHOLDER, FILLER, ERROR, SCRIPT, CHROME, OTHER = "placeholder", "filler", "error", "script", "chrome", "other"
RESIDUE = (PLACEHOLDER, FILLER, ERROR, SCRIPT)

NAME = r"[^\W\d][\w .:\-]{0,40}?"
#: Words that ask a writer to fill something in, by language.
ASK = (
    r"insert|fill(?: in| out)?|enter|your|add|replace|put|write|type|choose|select|specify|describe|goes here|placeholder|tbd|"
    r"completar|rellenar|insertar|escriba|escribir|añadir|poner|compl[ée]ter|[àa] remplir|ins[ée]rer|ajouter|saisir|remplacer|"
    r"eintragen|einf[üu]gen|ausf[üu]llen|erg[äa]nzen|einsetzen|eingeben|填写|填入|补充|待填|输入|插入|替换"
)
SLOTS = [
    r"\{\{[^{}]{0,80}\}\}", r"\{%[^%]{0,80}%\}", r"<%[=-]?[^%]{0,80}%>", r"\$\{[^{}]{0,60}\}", r"#\{[^{}]{0,60}\}", r"\{[A-Za-z_][\w.\-]{0,40}\}",
    r"\[\[[^\[\]]{1,60}\]\]", r"<<[^<>]{1,60}>>", r"@@[\w.\-]{1,40}@@", r"__[A-Za-z][\w.\-]{0,40}__", r"%[A-Za-z][\w.\-]{1,40}%", r"%\([\w.]{1,40}\)s",
    r"\$[A-Z][A-Z0-9_]{2,40}\$?", r"##[A-Z][A-Z0-9_]{1,40}##", r"\[object Object\]", r"<!--[^>]{0,80}-->",
    rf"[\[<(（【{{«][^\[\]<>()（）【】{{}}«»]{{0,60}}?(?:{ASK})[^\[\]<>()（）【】{{}}«»]{{0,60}}?[\]>)）】}}»]",
]
SLOT = re.compile("|".join(SLOTS), re.IGNORECASE)
ASKED = re.compile(
    rf"(?:todo\s*[:\-]\s*(?:describe|add|fill in|write|complete|insert)\s+(?:the|a|your)?\s*{NAME}|(?:add|insert|enter|put|write|type|describe|replace)\s+(?:the|your|a)\s+{NAME}\s+(?:here|below)|"
    rf"replace this (?:line|text|block|paragraph|section) with (?:the |your )?{NAME}|{NAME} goes here|fill in (?:the|your) {NAME}|(?:fixme|xxx+|tktk|t\.?b\.?d\.?)\s*[:\-]?\s*(?:{NAME})?)[.!]?",
    re.IGNORECASE,
)
EMPTY_VALUES = re.compile(r"(?:undefined|null|nan|none|n/?a|nil|\[object object\]|#(?:n/a|ref!|value!|name\?))[.!]?", re.IGNORECASE)

#: Words of Latin filler.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus pulvinar tellus ligula "
    "praesent vestibulum mauris donec pellentesque suspendisse curabitur aenean integer vitae nec eget ac justo odio".split()
)
MASH = re.compile(r"(?:(?:asdf|qwer(?:ty)?|zxcv|jkl|hjkl|foo|bar|baz|qux|blah?|bla|xyz|abc|aaa+|bbb+|ccc+|ddd+|eee+|xxx+|yyy+|zzz+|test(?:ing)?|text|dummy|sample|\d+)[\s,.!\-]*){3,}", re.IGNORECASE)
#: The same for long units, without a second way to read a word.
LONG_MASH = re.compile(MASH.pattern.replace("+|", "++|").replace(r"\d+)", r"\d++)").replace(r"[\s,.!\-]*", r"[\s,.!\-]*+").replace("){3,}", "){3,}+"), re.IGNORECASE)
FILL = re.compile(
    r"(?:dummy|sample|placeholder|filler|example) (?:text|copy|content|paragraph|heading|body|footer|title|data|sentence)|(?:text|copy|content|description|details|body) (?:coming|will follow|to follow|goes|to be added|to come)(?: soon| here| later)?|"
    r"coming soon|replace (?:me|this|it)? ?before publishing|(?:words|text) to fill|type your text|your text here|draft filler|ignore this text|lorem ipsum|"
    r"blindtext|platzhalter|f[üu]lltext|beispieltext|mustertext|hier steht (?:bald|sp[äa]ter)|(?:texte?|contenu) (?:provisoire|factice|de remplissage|[àa] venir|d'exemple)|faux[- ]texte|"
    r"texto de (?:relleno|ejemplo|muestra|prueba)|texto provisional|contenido (?:pr[óo]ximamente|pendiente|de ejemplo)|占位|测试文本|示例文本|样例文本|待补充|稍后(?:替换|补充)|内容待|此处为",
    re.IGNORECASE,
)

#: Reason phrases of status codes, and what else error pages call themselves.
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|conflict|gone|"
    "length required|precondition failed|payload too large|content too large|uri too long|unsupported media type|misdirected request|unprocessable (?:entity|content)|too early|"
    "upgrade required|too many requests|unavailable for legal reasons|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|"
    "insufficient storage|web server is down|origin is (?:down|unreachable)|connection timed out|access denied|server error|ssl handshake failed|invalid ssl certificate|page not found"
)
CODE = r"[1-5]\d\d"
STATUS = re.compile(
    rf"[\W_]*(?:(?:https?|status(?: code)?|code|error|erreur|fehler|fehlercode|错误)[\s:/=\-\"'|#]*(?:[\d.]+)?[\s:/=\-\"'|#,(]*)*(?:{CODE})[\s:|,\-–—()\"'.]*(?:error|message|reason|title)?[\s:=\"']*(?:{REASONS})?[\W_]*"
    rf"|[\W_]*(?:{REASONS})[\s:|,\-–—(]*(?:error|http|status)?[\s:]*(?:{CODE})?[\W_]*|[\W_]*(?:error|erreur|fehler|错误)\s*[:\-]?\s*(?:{REASONS})[\W_]*",
    re.IGNORECASE,
)
#: What a status line is made of, at any length; STATUS itself takes too long on long lines.
STATUS_PARTS = re.compile(rf"(?:{REASONS})|\b(?:https?|status(?: code)?|code|error|erreur|fehler(?:code)?|message|reason|title|{CODE}|\d+(?:\.\d+)+)\b|错误", re.IGNORECASE)
STATUS_VALUE = re.compile(rf"\b{CODE}\b|{REASONS}", re.IGNORECASE)
THING = r"(?:page|site|link|address|url|record|document|file|resource|workspace|space|area|server|viewer|app|application|service|request|conversation|transcript|session|dashboard|graph|certificate|origin|gateway|connection|content)"
#: Matched on lower-case text, which is far faster than ignoring case.
FAULTS = re.compile(
    rf"(?:(?:we |you )?(?:could(?: not|n't)|can(?:not|'t)) (?:find|load|open|reach|display|show|access|connect to|be reached) (?:the|this|that|your)? ?{THING}?|{THING} (?:you (?:asked|looked|are looking|were looking|requested)[\w ]{{0,12}} )?(?:does not exist|doesn't exist|was moved|was removed|has been (?:removed|moved|deleted)|has expired|is not available|is unavailable|cannot be (?:reached|found|displayed|loaded)|could not be (?:found|reached|loaded|displayed|verified|checked|trusted)|is (?:currently )?(?:down|offline|unreachable))|"
    rf"something (?:broke|went wrong)|(?:an |hit an )?unexpected (?:error|problem)|unexpected server error|uncaught \w+ error|unhandled exception|internal error|(?:you (?:are|do) not (?:allowed|authori[sz]ed|have (?:access|permission))|you don't have (?:access|permission)|access (?:is )?denied|permission denied)|"
    rf"(?:your )?session (?:ran out|timed out|is over|has ended)|sign in (?:again|once more)|upstream (?:closed|refused|prematurely|timed)|closed the connection|headers were sent|no (?:healthy )?upstream|bad response from|backend fetch failed|name (?:could not be )?resolved|"
    rf"ein(?:e)? (?:unerwarteter |interner )?fehler (?:ist )?(?:aufgetreten)|es ist ein fehler|(?:der )?server (?:antwortet nicht|ist nicht erreichbar)|sitzung (?:ist )?abgelaufen|(?:le )?serveur ne r[ée]pond|(?:votre )?session (?:a )?expir[ée]|vous n'avez pas (?:acc[èe]s|l'autorisation)|"
    rf"no existe (?:la|esta) p[áa]gina|p[áa]gina solicitada|se ha producido un error|ha ocurrido un error|el servidor no responde|(?:su |la )?sesi[óo]n ha (?:expirado|caducado)|no tiene (?:acceso|permiso)|发生(?:了)?(?:未知)?错误|会话已(?:过期|失效)|登录已(?:过期|失效)|请重新登录|连接(?:超时|被拒绝|已重置)|"
    rf"(?:share |invitation |this )?link (?:has )?expired|too many requests|slow down|rate limit exceeded|(?:down|closed|offline) for (?:\w+ )?maintenance|under maintenance|back in a few|(?:gateway|server|request|connection|upstream) (?:waited too long|timed out|took too long|did not (?:answer|respond))|session (?:has )?expired|connection (?:was )?(?:refused|reset)|"
    rf"(?:diese |die )?seite (?:gibt es nicht|existiert nicht|wurde nicht gefunden|nicht gefunden|ist nicht (?:verf[üu]gbar|erreichbar))|kein(?:en)? zugriff|zugriff verweigert|interner serverfehler|etwas ist schief|(?:cette )?page (?:introuvable|n'existe pas|n'est pas disponible)|acc[èe]s (?:refus[ée]|interdit)|erreur (?:interne|inattendue)|service indisponible|une erreur (?:est survenue|s'est produite)|"
    rf"(?:esta )?p[áa]gina (?:no (?:existe|encontrada|se (?:encuentra|encontr[óo])|est[áa] disponible))|acceso (?:denegado|prohibido)|error (?:interno|inesperado)|algo (?:sali[óo] mal|ha fallado)|no se (?:pudo|puede|ha podido) (?:encontrar|cargar|mostrar|abrir)|servicio no disponible|"
    rf"页面(?:不存在|未找到|无法|找不到)|找不到(?:该)?页面|无法访问|无权访问|没有权限|拒绝访问|访问被拒绝|服务(?:器)?(?:内部)?错误|服务(?:暂时)?不可用|请求过多|请求过于频繁|链接已(?:过期|失效)|系统维护|网关超时|出错了)"
)
JS = r"(?:java\s?scripts?|client-side scripts?|browser scripts?|scripts? (?:of|in|from) the browser|scripts?|active scripting|脚本|javascript)"
NEEDS = re.compile(
    rf"(?:(?:needs?|requires?|depends? on|relies on|only works? with|works only with|does not (?:run|work|load)[\w ]{{0,20}} (?:while|without|if|unless)|doesn't (?:run|work|load)[\w ]{{0,20}} (?:while|without|if|unless)|cannot (?:be (?:shown|displayed|loaded)|run|load|work)[\w ]{{0,12}} without|enable|allow|turn(?:ing)?(?: on)?|switch(?:ing)?(?: on)?|activate|permit|must (?:enable|allow|have)|has disabled|is (?:disabled|off|turned off|switched off|blocked|required|needed))[^.!?]{{0,60}}\b{JS}|\b{JS}[^.!?]{{0,40}}(?:is (?:disabled|off|required|needed|turned off|switched off|blocked|not enabled)|to be (?:switched|turned) on|must be (?:enabled|on)|needs to be|has been disabled|disabled|required|erforderlich|deaktiviert|d[ée]sactiv[ée]|desactivado)|"
    rf"(?:braucht|ben[öo]tigt|erfordert|ben[öo]tigen|einschalten|aktivieren|aktiviert(?:es)?|erlauben|n[ée]cessite|requiert|besoin|sans|activer|autoriser|activez|autorisez|necesita|requiere|active|habilite|activar|habilitar|sin|permita)[^.!?]{{0,40}}\b{JS}|\b{JS}[^.!?]{{0,30}}(?:aktivieren|einschalten|erlauben|aktiviert|activ[ée]s?|activados?)|(?:开启|启用|需要|允许|打开|禁用|关闭)[^。！？]{{0,8}}(?:脚本|javascript)|(?:脚本|javascript)[^。！？]{{0,10}}(?:开启|启用|才能|被禁用|已禁用)|"
    rf"noscript|checking your browser|verifying (?:that )?you are (?:a )?human|making sure (?:that )?you are (?:a )?human|are you a robot|browser (?:is )?(?:not supported|missing features|out of date|too old|unsupported|outdated)|unsupported browser|if nothing happens|enable (?:it|them|cookies)|cookies to continue|please enable it and reload)"
)
MORE_SCRIPT = re.compile(r"(?:loading\W*|this takes a few seconds\W*|please wait\W*|please enable (?:it|them) and reload\W*|(?:and )?reload(?: the page)?\W*|nothing to show\W*)", re.IGNORECASE)

#: Words around real pages that are no content of their own.
NAV = set(
    "home docs login logout menu search imprint import export settings memories transcripts graph overview about help status terms sign in up dashboard conversation shared memory viewer "
    "transcript contact privacy cookies blog pricing support faq legal impressum datenschutz anmelden suche hilfe startseite accueil aide connexion recherche inicio ayuda buscar "
    "index sitemap profile account language english deutsch share back next previous top skip to content".split()
)
CHROMES = re.compile(
    r"(?<!\w)(?:(?:go )?(?:back|return) (?:to (?:the )?)?(?:home|start|main|front)\s?(?:page)?|return home|zur[üu]ck zur startseite|retour [àa] l'accueil|volver al inicio|please try again(?: later| in a few minutes)?|try again(?: later)?|versuchen sie es sp[äa]ter|r[ée]essayez plus tard|int[ée]ntelo m[áa]s tarde|"
    r"if the problem persists,? (?:please )?contact (?:the |your )?(?:administrator|support)|contact (?:the |your )?(?:administrator|support)|request id\W*[\w\-]*|reference\W*(?:id)?\W*[\w\-]*|ray id\W*[\w\-]*|trace id\W*[\w\-]*|edge proxy|nginx(?:/[\d.]+)?|apache(?:/[\d.]+)?|cloudfront|varnish|"
    r"at [\w.$<>]+ \([^()]{1,120}\)|dear (?:team|all|colleagues|sir or madam)|hello(?: team| all)?|hi(?: team| all)?|(?:best|kind) regards|regards|thanks|hallo zusammen|bonjour|hola)(?!\w)|返回首页|返回主页|请稍后再试",
    re.IGNORECASE,
)
LABEL = re.compile(r"\*\*([^*\n]{1,40})\*\*\s*[:：]\s*|^(?:user|assistant|human|system)\s*[:：]\s*", re.IGNORECASE | re.MULTILINE)
KEYED = re.compile(r"^([A-Z][\w ]{1,24})[:：]\s+(?=\S)")
TAG = re.compile(r"</?(?:h[1-6]|p|hr|br|div|span|body|html|head|title|center|noscript|b|i|strong|em|a|ul|li|pre|code|section|main)\b[^<>]{0,80}/?>", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
INVISIBLE = re.compile(r"[​-‏⁠-⁤﻿­᠎]")


def cleaned(text: str) -> str:
    """Text with entities resolved, compatible forms unified, page tags and invisible characters removed."""
    text = html.unescape(text) if "&" in text else text
    text = text if text.isascii() else unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return TAG.sub(" ", text) if "<" in text else text


#: Words without one of which a unit cannot match a dearer pattern; \u4e00-text is looked through for marks of its own.
FAULT_WORDS = set(
    "find load open reach display show access connect exist moved removed deleted expired available unavailable down offline unreachable broke wrong unexpected uncaught unhandled internal denied permission allowed authorized authorised "
    "requests slow exceeded maintenance minutes waited timed took answer respond session sign upstream closed headers backend resolved refused reset fehler seite zugriff verweigert schief server sitzung erreur page accès acces indisponible serveur "
    "página pagina acceso error algo pudo puede podido servicio existe sesión sesion tiene reached checked trusted verified serverfehler autorisation few".split()
)
SCRIPT_WORDS = set("browser human robot happens cookies reload loading wait show seconds noscript".split())
FILL_WORDS = set(
    "text copy content paragraph heading body footer title data sentence description details coming replace words type draft ignore lorem blindtext platzhalter fülltext fulltext "
    "beispieltext mustertext steht texte textes contenu faux texto contenido".split()
)
CHROME_WORDS = set(
    "home start main front startseite accueil inicio try later again versuchen réessayez reessayez inténtelo intentelo inténtalo problem contact request reference ray trace edge nginx apache cloudfront varnish at dear hello hi regards thanks hallo bonjour hola".split()
)
ASK_WORDS = set("todo add insert enter put write type describe replace goes fill fixme tktk tbd t".split())
HAN_MARKS = {
    FILLER: re.compile("占位|测试|示例|样例|待补充|稍后|内容待|此处为"), SCRIPT: re.compile("脚本"), CHROME: re.compile("返回首页|返回主页|请稍后再试"),
    ERROR: re.compile("错误|过期|失效|重新登录|连接|页面|访问|权限|服务|请求|链接|维护|超时|出错"),
}
#: Every word that a status line may have.
STATUS_VOCABULARY = set(re.findall(r"[^\W\d_]+", REASONS.replace("(?:", " ").replace(")", " "))) | set("http https status code error erreur fehler fehlercode message reason title 错误 gateway timeout time out".split())
SLOT_MARKS = re.compile(r"[{}\[\]<>@_%$(（【«]")
LETTER = re.compile(r"\w")
WORD = re.compile(r"[^\W\d_]+")
LEAD = re.compile(r"^(?:[>\-*•#|\s]|\d+[.)]\s)+")
BLANKS = re.compile(r"\s+")
REPEATED = re.compile(r"(.{4,80}?)(?:\s*\1){1,}")
QUOTES = re.compile(r"[\"“”«»„]")


@lru_cache(maxsize=100_000)
def kind_of(unit: str) -> str:
    """What a line or sentence is as a whole."""
    unit = BLANKS.sub(" ", LEAD.sub("", unit)).strip()
    if not LETTER.search(unit):
        return PLACEHOLDER if SLOT.fullmatch(unit) else CHROME
    if SLOT_MARKS.search(unit):
        bare = SLOT.sub(" ", unit)
        if bare != unit and not LETTER.search(bare):
            return PLACEHOLDER
    words = WORD.findall(unit.lower())
    own = set(words)
    if len(words) <= 14 and len(unit) <= 600 and (EMPTY_VALUES.fullmatch(unit) or (own & ASK_WORDS or any(w.startswith("xxx") for w in own)) and ASKED.fullmatch(unit)):
        return PLACEHOLDER
    if words and (MASH if len(unit) <= 600 else LONG_MASH).fullmatch(unit):
        return FILLER
    if len(words) >= 6 and len(own) * 2 <= len(words):
        unit = REPEATED.sub(r"\1", unit)
    if _latin(words) == FILLER:
        return FILLER
    plain, before = unit.isascii(), unit
    hints = lambda kind, listed: not own.isdisjoint(listed) or not plain and HAN_MARKS[kind].search(unit)
    if len(unit) <= 200 and hints(CHROME, CHROME_WORDS):
        unit = BLANKS.sub(" ", CHROMES.sub(" ", unit)).strip(" .,|!:")
        if not LETTER.search(unit):
            return CHROME
    if QUOTES.search(unit) and len(WORD.findall(unit)) > 8 and not unit.startswith("{"):
        return OTHER
    if hints(FILLER, FILL_WORDS) and _left(FILL, unit) <= 90:
        return FILLER
    if (hints(SCRIPT, SCRIPT_WORDS) or any("script" in w for w in own)) and (_left(NEEDS, unit.lower()) <= 160 or MORE_SCRIPT.fullmatch(unit)):
        return SCRIPT
    # a status line has no other words; what stands around it as chrome is gone by now
    rest = words if unit == before else WORD.findall(unit.lower())
    if all(w in STATUS_VOCABULARY for w in rest) and (len(unit) <= 160 and STATUS.fullmatch(unit) or STATUS_VALUE.search(unit) and not LETTER.search(STATUS_PARTS.sub(" ", unit))):
        return ERROR
    # a match of FAULTS has one of its words at least and is hardly longer than 150 characters
    if (150 * sum(w in FAULT_WORDS for w in words) >= max(1, len(unit) - 110) if plain else hints(ERROR, FAULT_WORDS)) and _left(FAULTS, unit.lower()) <= 110:
        return ERROR
    return CHROME if all(w in NAV for w in words) and words else OTHER


def _left(pattern: re.Pattern, unit: str) -> float:
    """How many characters of a unit no match of the pattern covers; infinite without a match."""
    sizes = [m.end() - m.start() for m in pattern.finditer(unit)]
    return len(unit) - sum(sizes) if sizes else float("inf")


def _latin(words: list[str]) -> str:
    """FILLER where most words are those of Latin filler."""
    known = [w for w in words if w in LATIN]
    enough = len(words) >= 2 and len(known) >= 0.75 * len(words) and ("lorem" in known or sum(len(w) > 3 for w in known) >= 2)
    return FILLER if enough else OTHER


def fields_of(text: str) -> list[tuple[str, str]]:
    """(place, text) of a text's fields: body, or field for what a label, speaker or key introduces; headings are dropped.

    A heading line is a record's title or a section's name and no content of its own, unless it
    is itself residue.
    """
    out: list[tuple[str, str]] = []
    marks = [(m.start(), m.end()) for m in LABEL.finditer(text)]
    starts = [(0, 0, "body"), *((a, b, "field") for a, b in marks)]
    for i, (_, begin, place) in enumerate(starts):
        end = starts[i + 1][0] if i + 1 < len(starts) else len(text)
        out.append((place, text[begin:end]))
    return [(p, t) for p, t in out if t.strip()]


def units_of(text: str) -> Iterator[str]:
    """The lines of a text, split into sentences; lines that a wrap broke in mid-sentence are joined, as is a paragraph that is residue as one."""
    for paragraph in re.split(r"\n\s*\n", text):
        flat = re.sub(r"\s+", " ", paragraph).strip()
        if not flat:
            continue
        if "\n" in paragraph.strip() and len(flat) <= 600:
            joined = [s for s in SENTENCE.split(flat) if s.strip()]
            if all(kind_of(s) != OTHER for s in joined):
                yield from joined
                continue
            if len(joined) > 1 and kind_of(flat) in RESIDUE:
                yield flat
                continue
        for line in re.sub(r"^[ \t]*(\S{1,12})[ \t]*\n\s*(?=[a-zà-ÿ0-9])", r"\1 ", paragraph, flags=re.MULTILINE).split("\n"):
            line = line.strip()
            keyed = KEYED.match(line)
            if keyed and kind_of(line) == OTHER and kind_of(line[keyed.end() :]) in RESIDUE:
                line = line[keyed.end() :]
            if kind_of(line) != OTHER:
                yield line
            else:
                yield from (s for s in SENTENCE.split(line) if s.strip())
