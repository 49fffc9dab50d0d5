"""Annotated spans for the training of the tagger: patterns that mark private data in a bounded sample of texts.

They label training rows only. At run time no pattern finds, adds, moves or removes a span; the tagger alone does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

I = re.I  # noqa: E741
#: Each character becomes one character, so that positions stay: wide forms, dashes and blanks of all kinds.
_PLAIN = {**{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}, **dict.fromkeys(range(0x2010, 0x2016), "-"), 0x2212: "-", **dict.fromkeys([0xA0, 0x2007, 0x2009, 0x202F, 0x3000, *range(0x2000, 0x200B)], " ")}

_AT = r"(?:\s?@\s?|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_HOST = r"[a-z0-9][a-z0-9-]*"
EMAIL = [
    re.compile(rf"[a-z0-9][a-z0-9._%+-]*@{_HOST}(?:\.{_HOST})*\.[a-z]{{2,}}", I | re.A),
    re.compile(rf"[a-z0-9][a-z0-9._%+-]*(?:\s+dot\s+[a-z0-9._%+-]+)*{_AT}{_HOST}(?:{_DOT}{_HOST})*(?:\s*[\[({{]\s*dot\s*[\])}}]\s*|\s+dot\s+)[a-z]{{2,}}", I | re.A),
    re.compile(rf"[a-z0-9][a-z0-9._%+-]*(?:\s*[\[({{]\s*at\s*[\])}}]\s*|\s@\s){_HOST}(?:\.{_HOST})*\.[a-z]{{2,}}", I | re.A),
]
_NOT_A_PHONE = re.compile(r"(?:\b(?:order|case|ticket|part|bulletin|claim|ref|reference|invoice|campaign|recall|license|licence|vin|ro|policy|serial|box|code no|factura|pieza|caso|orden|부품|번호)\s*(?:no\.?|number|id|n\.º|:)?\s*#?\s*|#\s*)\Z", I)
_SEP = r"(?:\s*[-./]\s*|\s+|)"
PHONE = [
    re.compile(rf"(?<![\w$#-])(?<!\d[.,/])(?:\+?1{_SEP})?(?:\(\s*\d{{3}}\s*\)|\d{{3}}){_SEP}\d{{3}}{_SEP}\d{{4}}(?:,?\s*(?:ext\.?|x|extension)\s*\d+)?(?![\w]*\d)(?!-\w)", I | re.A),
    re.compile(rf"(?<![\w#-])(?:\+?82{_SEP}(?:\(0\))?)?0?1[016-9]{_SEP}\d{{3,4}}{_SEP}\d{{4}}(?!\d)(?!-\d)", I | re.A),
    re.compile(rf"(?<![\w#-])(?:\+82{_SEP}\d{{1,2}}|0(?:2|[3-6]\d|70)){_SEP}\d{{3,4}}{_SEP}\d{{4}}(?!\d)(?!-\d)", I | re.A),
    re.compile(r"\barea code\s+\d{3}\W+(?:then\s+)?\d{3}[\s.-]?\d{4}(?!\d)", I),
    re.compile(r"(?:\b(?:phone|tel|cell|call(?: me)?(?: at)?|fax|mobile|reach me at|teléfono|ll[aá]m\w+ al)\b\W{0,3}|전화\s*|연락처는?\s*)(?:no\.?\s*)?\d{3,4}[\s.-]\d{4}(?!\d)", I),
    re.compile(r"(?<![\w#])\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4}(?!\d)", re.A),
]
ID_NUMBER = [
    re.compile(r"(?<![A-Za-z0-9])(?=[A-HJ-NPR-Z0-9*]*\d)(?=[A-HJ-NPR-Z0-9*]*[A-HJ-NPR-Z])[A-HJ-NPR-Z0-9*]{17}(?![A-Za-z0-9*])", I),
    re.compile(r"(?<![A-Za-z0-9])(?=(?:[A-HJ-NPR-Z0-9][ -]?){0,16}\d)(?:[A-HJ-NPR-Z0-9]{1,8}[ -]){1,6}[A-HJ-NPR-Z0-9]{1,8}(?![A-Za-z0-9])"),
    re.compile(r"\bVIN\b[^.!?\n]{0,40}?(?<![A-Za-z0-9])(?=[A-Z0-9*-]*\d)[A-Z0-9*-]{5,17}(?![A-Za-z0-9])", I),
    re.compile(r"\b(?:driver'?s?\s+)?licen[sc]e\b(?!\s+plate)[^.!?\n\d]{0,25}?(?<![A-Za-z0-9])(?:[A-Z]\d{2,}|[A-Z]-?\d|\d{5})[A-Z0-9 -]{4,}\d", I),
    re.compile(r"\b(?:licencia|permiso)\b[^.!?\n\d]{0,30}?(?<![A-Za-z0-9])[A-Z]?\d[A-Z0-9 -]{4,}\d", I),
    re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])", I),
    re.compile(r"(?<![\w$#./-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"),
    re.compile(r"\b(?:SSN|social security)\b[^.!?\n\d]{0,30}?[\dX*]{3}[ .-]?[\dX*]{2}[ .-]?\d{4}", I),
    re.compile(r"(?<![\w-])\d{6}\s?-\s?[1-8][\d*]{6}(?![\d*])"),
    re.compile(r"(?:주민|등록|면허)\S*\s*(?:번호\S*)?\s*\d[\d* -]{7,}[\d*]"),
    re.compile(r"차대\s?번호\S*\s*[:]?\s*(?:(?:끝|뒤)\S*\s*)?\S*?(?=[A-Z0-9*]*\d)[A-Z0-9*]{5,17}", I),
]
_ROAD = r"(?:street|st|road|rd|avenue|ave|av|boulevard|blvd|lane|ln|drive|dr|court|ct|close|terrace|ter|way|place|pl|circle|cir|parkway|pkwy|square|sq|trail|trl|crescent|row|loop)"
_BETWEEN = r"(?!(?:mph|miles?|mi|km|kph|on|at|to|the|in|and|of|from|for|was|were|a\.m|p\.m|am|pm|hrs?|minutes?|seconds?|volts?|amps?|psi|mm|when|near|by|with|my|a|an|this|that|is|it|days?|weeks?|feet|ft|along|while|exit|i|we|then|new|or)\b)"
ADDRESS = [
    re.compile(r"\b(?:p\.?\s?o\.?|post\s+office)\s*box\s*#?\s*\d+", I),
    re.compile(r"\b(?:rural\s+route|r\.?r\.?|rt\.?|route|rfd|hc)\s*#?\s*\d+,?\s*box\s*#?\s*\d+", I),
    re.compile(r"(?<![\w$#.,/:-])\d{1,6}(?:-[A-Z])?\s+(?:[NSEW]\.?\s+)?(?:county|state|co\.?|farm)\s+(?:rd|road|highway|hwy|route)\.?\s+\d+", I),
    re.compile(rf"(?<![\w$#.,/:-])(?<!exit )(?<!route )(?<!hwy )(?<!hwy\. )(?:no\.?\s*)?\d{{1,6}}(?:\s?-\s?[A-Z\d]{{1,4}}|[A-Z])?,?\s+(?:[NSEW]{{1,2}}\.?\s+|(?:north|south|east|west)\s+)?(?:{_BETWEEN}[^\W\d_][\w'’-]*\s+){{1,3}}{_ROAD}\b\.?(?:,?\s*(?:apt|unit|suite|ste|#)\.?\s*\w+)?", I),
    re.compile(r"(?:(?<!\w)(?:calle|avenida|avda|av|paseo|plaza|carrera|camino|ronda|travesía)\b\.?|(?<!\w)c/)\s*(?:(?:de|del|la|las|los|el)\s+)*[^\W\d_][\w'’-]*(?:\s+[^\W\d_][\w'’-]*){0,2},?\s*(?:n\.?\s?[º°o]\.?\s*|núm\.?\s*)?\d+", I),
    re.compile(r"(?:[가-힣]{1,10}(?:시|도|군|구|읍|면|동)\s+)*[가-힣]+(?:로|길|대로)\s?(?:\d+번?길\s?)?\d+(?:-\d+)?(?![\d.]|\s*(?:km|킬로|시|분|초|년|월|일|번째))"),
    re.compile(r"[가-힣]+(?:동|리|읍|면)\s?\d+(?:-\d+)?\s?번지"),
    re.compile(r"\d+\s?丁目\s?\d+|\d+番地|[一-鿿]+(?:路|街|大道)\s?\d+\s?号|ถนน\S+\s?\d+|บ้านเลขที่\s?\d+"),
]
_NAME = r"[^\W\d_][^\W\d_'’]*(?:[-'’][^\W\d_]+)?"
_FULL = rf"{_NAME}(?:\s+(?:[^\W\d_]\.?\s+)?{_NAME}){{0,2}}"
_NOT_NAMES = {*"the a an my our his her your this that it i we he she they is was were be been left not no in on at to of and or for with from up off me you him them us service parts desk dealer owner contact driver caller twice again about yesterday today then mechanic manager advisor tech shop warranty vehicle car details more help info work order number name phone email please el la los un una mi su no se".split()}
_FIRM = re.compile(r"\b(?:motors?|auto|service|garage|cars|dealership|tow|towing|center|co\.|inc|ltd|corp|company|gmbh)\b", I)
_RELATION = r"(?:wife|husband|spouse|son|daughter|brother|sister|mother|father|mom|dad|neighbou?r|friend|partner|uncle|aunt|cousin|fiancée?|roommate|esposa|esposo|hermano|hermana|hijo|hija|vecino|vecina|padre|madre)"
NAME = [
    re.compile(rf"\b(?:my|his|her|our)\s+(?:full\s+)?name\s+is\s+({_FULL})", I),
    re.compile(rf"\b(?:owner|contact|driver|customer|caller)(?:['’]s)?\s+name\s*(?::|is|-)\s*({_FULL})", I),
    re.compile(rf"\bme\s+llamo\s+({_FULL})|\bmi\s+nombre\s+es\s+({_FULL})", I),
    re.compile(rf"(?:\A|(?<=[.!?)\"\n\r]))\s*contact\s+({_FULL})\s+(?:at|on|by|via)\b", I),
    re.compile(rf"\b(?:signed|sincerely|regards|yours truly|thank you|atentamente|firmado)\s*[,:]\s*({_FULL})", I),
    re.compile(rf"\b(?:sent|reported|filed|written|submitted)\s+by\s+({_FULL})\s*(?:\(|[.,]|\Z|\n)", I),
    re.compile(rf"(?:\A|\W)I,\s+({_FULL}),", I),
    re.compile(rf"(?<!\w)(?:mrs?|ms|miss|dr|sra?|srta|herr|frau)\.?\s+(?!del\b|de\b)({_FULL})", I),
    re.compile(rf"\b(?:manager|advisor|adviser|mechanic|technician|owner|supervisor|representative|agent|encargad[oa]|gerente|mecánic[oa]|técnic[oa]),\s+({_FULL}),", I),
    re.compile(rf"\bmy\s+{_RELATION},?\s+({_NAME})(?=,|\s+(?:was|is|and|had|has|drove|says|said|saw)\b)|\bmi\s+{_RELATION},?\s+({_NAME})(?=,|\s+(?:estaba|iba|es|y|conducía|vio)\b)", I),
    re.compile(rf"\bask\s+for\s+({_NAME},\s+{_NAME}(?:\s+[A-Z]\.?)?|{_FULL})(?=\s+(?:in|at|by|when)\b|[.,])", I),
    re.compile(rf"(?:\A|(?<=[.!?)\"\n\r]))\s*({_FULL})\s+was\s+(?:behind the wheel|in the (?:passenger|back|front|car)|driving with)\b", I),
    re.compile(rf"(?:\A|(?<=[.!?)\"\n\r]))\s*({_NAME}(?:\s+[^\W\d_]\.?)?\s+{_NAME}),\s+(?=\d|no\.|p\.?\s?o\.?\s*box|rural|route)", I),
    re.compile(r"(?:차주|운전자|소유자|신고자|고객|정비사|담당자|신고인)(?:\s?(?:이름|성함|성명))?(?:은|는|인|:)?\s+(?!이름|연락)((?:[가-힣]{2,5}|[A-Za-z][\w .'-]+?))(?=\s*(?:,|씨|님|라고|이라고|의|으로|\())"),
    re.compile(r"(?:이름|성함|성명)(?:은|는|:)?\s+((?:[가-힣]{2,5}?|[A-Za-z][\w .'-]+?))(?=\s*(?:이?라고|입니다|이다|씨|님|,|\.))"),
    re.compile(r"(?<![가-힣])((?!고객|사장|기사|점장|정비사|차주)[가-힣]{2,5})\s?씨(?=[가는의께와에를]|\s|\.|,)"),
    re.compile(r"(?:我叫|我的名字是|姓名[:：]?)([一-鿿]{2,4})|([一-鿿]{1,4})(?:さん|氏)(?=[はがのに])|ชื่อ\s?([฀-๿]+)"),
]


def _spaced_vin(s: str) -> bool:
    s = re.sub("[ -]", "", s)
    return len(s) == 17 and s[-4:].isdigit() and sum(map(str.isdigit, s)) >= 5 and not s.isdigit()


#: For each pattern, strings (in lower case) of which a text needs one; empty: none. They only save time.
_NEEDS = {
    **dict(zip(EMAIL, [("@",), ("dot",), ("@", "[at", "(at", "{at", "[ at", "( at")], strict=True)),
    PHONE[3]: ("area code",), PHONE[4]: ("phone", "tel", "cell", "call", "fax", "mobile", "reach me", "teléf", "llam", "llám", "전화", "연락처"), PHONE[5]: ("+",),
    ID_NUMBER[1]: ("vin", "identification", "chassis", "차대", "bastidor"), ID_NUMBER[2]: ("vin",), ID_NUMBER[3]: ("licen",), ID_NUMBER[4]: ("licencia", "permiso"), ID_NUMBER[7]: ("ssn", "social"), ID_NUMBER[9]: ("주민", "등록", "면허"), ID_NUMBER[10]: ("차대",),
    ADDRESS[0]: ("box",), ADDRESS[1]: ("box",), ADDRESS[2]: ("county", "state", "co ", "co.", "farm"), ADDRESS[4]: ("calle", "aven", "avda", "av", "paseo", "plaza", "carrera", "camino", "ronda", "traves", "c/"), ADDRESS[5]: ("로", "길"), ADDRESS[6]: ("번지",), ADDRESS[7]: ("丁目", "番地", "号", "ถนน", "บ้าน"),
    **dict(zip(NAME, [("name",), ("name",), ("llamo", "nombre"), ("contact",), ("signed", "sincerely", "regards", "truly", "thank you", "atentamente", "firmado"), (" by ",), ("i, ",), ("mr", "ms", "miss", "dr", "sr", "herr", "frau"), ("manager", "advis", "mechanic", "techn", "owner", "supervisor", "represent", "agent", "encargad", "gerente", "mecánic", "técnic"), ("my ", "mi "), ("ask for", "ask  for"), ("behind the wheel", "was in the", "driving with"), (", ",), ("차주", "운전자", "소유자", "신고", "고객", "정비사", "담당자"), ("이름", "성함", "성명"), ("씨",), ("我", "姓名", "さん", "氏", "ชื่อ")], strict=True)),
}
_ROAD_WORD = re.compile(rf"\b{_ROAD}\b", I)
_HOUSE = re.compile(r"[^\W\d_],\s+(?:\d|no\.|p\.?\s?o|rural|route)", I)
_DIGITS = re.compile(r"\d{3}[\s./()-]{0,6}\d{4}")
_SEVENTEEN = re.compile(r"[a-z0-9*]{17}")


def _matches(p: re.Pattern, plain: str, low: str) -> Iterator[re.Match]:
    if (needs := _NEEDS.get(p)) and not any(x in low for x in needs):
        return
    if p is ADDRESS[3]:
        end = 0
        for road in _ROAD_WORD.finditer(plain):
            if road.start() >= end and any(map(str.isdigit, plain[max(0, road.start() - 80) : road.start()])):
                stop = road.end() + 30
                while stop < len(plain) and plain[stop].isalnum():
                    stop += 1
                for m in p.finditer(plain, max(end, road.start() - 80), stop):
                    yield m
                    end = m.end()
    elif not (p in PHONE[:3] and not _DIGITS.search(low) or p is ID_NUMBER[0] and not _SEVENTEEN.search(low) or p is NAME[12] and not _HOUSE.search(plain)):
        yield from p.finditer(plain)


def find(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each piece of private data, without overlaps; an earlier kind goes first."""
    plain, out = text.translate(_PLAIN) if not text.isascii() else text, []
    low = plain.lower()

    def add(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y, _ in out):
            out.append((a, b, kind))

    for p in EMAIL:
        for m in _matches(p, plain, low):
            add(*m.span(), "email")
    for p in ID_NUMBER:
        for m in _matches(p, plain, low):
            if p is not ID_NUMBER[1] or _spaced_vin(m[0]):
                add(*m.span(), "id_number")
    for p in PHONE:
        for m in _matches(p, plain, low):
            if not _NOT_A_PHONE.search(plain[max(0, m.start() - 30) : m.start()]):
                add(*m.span(), "phone")
    for p in ADDRESS:
        for m in _matches(p, plain, low):
            if not re.search(r"(?:exit|route|hwy\.?|highway|bulletin|part no\.|version)\s*\Z", plain[max(0, m.start() - 12) : m.start()], I):
                add(*m.span(), "address")
    for p in NAME:
        for m in _matches(p, plain, low):
            k = next(k for k in range(1, 9) if m[k])
            a, b = m.start(k), m.start(k)
            for w in re.finditer(r"[^\s,]+", m[k]):
                if w[0].lower().strip(".") in _NOT_NAMES and not (b > a and len(w[0].strip(".")) == 1):
                    break
                b = a + w.end()
            if b > a and not _FIRM.search(plain[a : m.end(k) + 12].partition(",")[0]):
                add(a, b, "person_name")
    return sorted(out)
